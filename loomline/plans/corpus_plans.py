"""Queries on the corpus tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions import text as T
from loomline.operators import corpus as C
from loomline.plans.registry import query
from loomline.session import table

# Topics and the words that speak for them in the test corpus; a parameter of the operators.
TOPICS = {
    "thyroid": ["thyroid", "thyroïde", "schilddrüse", "tiroides", "basal rate", "taux de base", "grundrate", "tasa basal"],
    "sugar": ["blood sugar", "glycogen", "honey", "fruit juice", "glycémie", "miel", "blutzucker", "glucosa"],
    "light": ["red light", "morning light", "lumière", "licht", "luz"],
    "stress": ["cortisol", "adrenalin", "stress", "kortisol", "tension émotionnelle"],
    "salt": ["salt", "magnesium", "potassium", "sel de table", "speisesalz", "sal de mesa", "magnésium", "magnesio"],
    "fat": ["coconut oil", "polyunsaturated", "fatty acid", "kokosöl", "huile de coco", "aceite de coco"],
}
TECHNICAL = ["peroxidation", "endotoxin", "progesterone", "estrogen", "cortisol", "glycogen", "thyroid", "metabolism", "magnesium", "potassium"]
FILLERS = ["yeah", "mm", "mm hmm", "uh huh", "right", "okay", "ok", "yes", "no", "hmm", "um"]
NOISE = [r"https?://[^\s<>\"]+", r"<[^<>]{1,200}>", r"&[a-z]{2,6};|&#[0-9]{1,5};", r"_{4,}", r"[=*#~-]{4,}", r"[\w.]+@[\w.]+\.[a-z]{2,4}"]
RULES = [(r"https?://[^\s<>\"]+", " "), (r"<[^<>]{1,200}>", " "), (r"&nbsp;", " "), (r"&amp;", "&"), (r"&#39;", "'"), (r"_{4,}", " "), (r"[=*#~]{3,}", " "), (r"\[(?:laughter|music|applause|inaudible)\]", " "), (r"\.{3,}", "...")]


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(xs: list[str]) -> str:
    return "[" + ", ".join(map(_q, xs)) + "]"


_SQ = r"trim(regexp_replace({}, '[\s\p{{Z}}]+', ' ', 'g'))"


def _sq(x: str) -> str:
    return _SQ.format(x)


def _fp(x: str) -> str:
    return _sq(rf"regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}\p{{Mn}}_\s\p{{Z}}]', '', 'g')")


def _wc(x: str) -> str:
    return rf"len(list_filter(string_split_regex(coalesce({x}, ''), '[\s\p{{Z}}]+'), lambda w: w <> ''))"


def _words(x: str) -> str:
    return rf"regexp_extract_all(lower(coalesce({x}, '')), '(\p{{L}}+)', 1)"


_KIND_SQL = "CASE WHEN regexp_replace(lower(coalesce({0}, '')), '[^a-z]', '', 'g') = '' THEN 'unknown' ELSE regexp_replace(lower({0}), '[^a-z]', '', 'g') END"


def _kind(c: str) -> F.Column:
    letters = F.regexp_replace(F.lower(F.coalesce(F.col(c), F.lit(""))), "[^a-z]", "")
    return F.when(letters == "", F.lit("unknown")).otherwise(letters)


@query(f"""SELECT CASE WHEN length(fp) <= 20 THEN concat_ws('#', md5(fp), doc_id::VARCHAR) ELSE md5(fp) END AS fingerprint, min(doc_id) AS first_doc, count(*) AS copies
FROM (SELECT doc_id, {_fp("text")} AS fp FROM documents WHERE text IS NOT NULL) GROUP BY 1""")
def doc_fingerprint_dedup(spark: SparkSession, d: str) -> DataFrame:
    fp = table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", T.fingerprint(F.col("text")).alias("fp"))
    return C.first_of_each(fp, F.md5("fp"), "doc_id", F.length("fp") <= 20).select(F.col("key").alias("fingerprint"), F.col("first").alias("first_doc"), "copies")


@query(f"""WITH g AS (SELECT md5({_fp("ray_peat_response")}) AS fingerprint, count(*) AS copies, min(source_file) AS first_file, count(DISTINCT source_file) AS files FROM search_results WHERE ray_peat_response IS NOT NULL GROUP BY 1)
SELECT * FROM g WHERE copies > 1 ORDER BY copies DESC, fingerprint LIMIT 50""")
def dup_groups_top(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "search_results").filter("ray_peat_response IS NOT NULL").select(F.md5(T.fingerprint(F.col("ray_peat_response"))).alias("fingerprint"), "source_file")
    return s.groupBy("fingerprint").agg(F.count("*").alias("copies"), F.min("source_file").alias("first_file"), F.countDistinct("source_file").alias("files")).filter("copies > 1").orderBy(F.desc("copies"), "fingerprint").limit(50)


@query(f"""SELECT reason, count(*) AS passages, sum(n) AS words FROM (SELECT CASE WHEN {_fp("coalesce(ray_peat_response, '')")} IN ({", ".join(map(_q, FILLERS))}) THEN 'filler'
WHEN contains(coalesce(ray_peat_response, ''), '________') THEN 'gap' WHEN {_wc("ray_peat_response")} < 25 THEN 'short' ELSE 'kept' END AS reason, {_wc("ray_peat_response")} AS n FROM search_results) GROUP BY reason""")
def quality_gate_reasons(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("ray_peat_response")
    return table(spark, d, "search_results").select(C.quality_reason(t, FILLERS).alias("reason"), T.word_count(t).alias("n")).groupBy("reason").agg(F.count("*").alias("passages"), F.sum("n").alias("words"))


_HITS = ", ".join(f"{{'s': len(list_filter({_list(kw)}, lambda k: contains(low, k))), 'o': {i}, 't': '{t}'}}" for i, (t, kw) in enumerate(TOPICS.items()))


@query(f"""WITH s AS (SELECT id, primary_topic, lower(coalesce(ray_peat_response, '')) AS low FROM search_results),
h AS (SELECT id, primary_topic, unnest([{_HITS}]) AS h FROM s),
r AS (SELECT id, primary_topic, h.t AS t, h.o AS o, h.s AS s, row_number() OVER (PARTITION BY id, primary_topic ORDER BY h.s DESC, h.o) AS r FROM (SELECT DISTINCT id, primary_topic, h FROM h) WHERE h.s > 0)
SELECT topics, count(*) AS passages FROM (SELECT id, primary_topic, string_agg(t, '|' ORDER BY s DESC, o) AS topics FROM r WHERE r <= 3 GROUP BY id, primary_topic) GROUP BY topics""")
def topic_classify_top3(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "search_results").select("id", "primary_topic", F.concat_ws("|", C.top_topics(F.col("ray_peat_response"), TOPICS)).alias("topics")).filter("topics <> ''").distinct()
    return s.groupBy("topics").agg(F.count("*").alias("passages"))


def _weighted_sql(kw: list[str]) -> str:
    parts = [f"((length(p) - length(replace(p, {_q(' ' + k.replace(' ', '  ') + ' ')}, ''))) // {len(k.replace(' ', '  ')) + 2}) * {len(k) / 10.0}::DOUBLE" for k in kw]
    return f"round(({' + '.join(parts)}) / {len(kw)}, 6)"


@query(rf"""WITH s AS (SELECT doc_id, '  ' || regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+', '  ', 'g') || '  ' AS p FROM documents)
SELECT doc_id, {", ".join(f"{_weighted_sql(kw)} AS {t}" for t, kw in TOPICS.items())} FROM s""")
def topic_weighted(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", *[C.weighted_topic(F.col("text"), kw).alias(t) for t, kw in TOPICS.items()])


@query(f"""SELECT coalesce(kind, 'all') AS kind, count(*) AS passages, count(DISTINCT source_file) AS files, count(*) FILTER (WHERE coalesce(context, '') <> '') AS with_context,
round(100.0 * count(*) FILTER (WHERE coalesce(context, '') <> '') / count(*), 4) AS context_pct, count(DISTINCT fp) AS distinct_texts
FROM (SELECT {_KIND_SQL.format("source_type")} AS kind, source_file, context, md5({_fp("coalesce(ray_peat_response, '')")}) AS fp FROM search_results) GROUP BY ROLLUP (kind)""")
def corpus_audit_by_type(spark: SparkSession, d: str) -> DataFrame:
    has = F.coalesce("context", F.lit("")) != ""
    s = table(spark, d, "search_results").select(_kind("source_type").alias("kind"), "source_file", has.alias("has"), F.md5(T.fingerprint(F.coalesce("ray_peat_response", F.lit("")))).alias("fp"))
    return s.rollup("kind").agg(
        F.count("*").alias("passages"), F.countDistinct("source_file").alias("files"), F.count_if("has").alias("with_context"), F.round(100.0 * F.count_if("has") / F.count("*"), 4).alias("context_pct"), F.countDistinct("fp").alias("distinct_texts")
    ).withColumn("kind", F.coalesce("kind", F.lit("all")))


_BUCKET = [(25, "0-24"), (50, "25-49"), (100, "50-99"), (200, "100-199"), (400, "200-399"), (800, "400-799")]


@query(f"""SELECT bucket, count(*) AS documents, sum(n) AS words FROM (SELECT {_wc("text")} AS n, CASE {" ".join(f"WHEN {_wc('text')} < {b} THEN '{n}'" for b, n in _BUCKET)} ELSE '800+' END AS bucket FROM documents) GROUP BY bucket""")
def token_histogram(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n")
    bucket = F.when(n < _BUCKET[0][0], _BUCKET[0][1])
    for b, name in _BUCKET[1:]:
        bucket = bucket.when(n < b, name)
    return table(spark, d, "documents").select(T.word_count(F.col("text")).alias("n")).withColumn("bucket", bucket.otherwise("800+")).groupBy("bucket").agg(F.count("*").alias("documents"), F.sum("n").alias("words"))


@query(f"""SELECT kind, count(*) AS n, min(w) AS least, max(w) AS greatest, round(avg(w), 6) AS mean, list_sort(list(w))[count(*) // 2 + 1] AS upper_median
FROM (SELECT {_KIND_SQL.format("source")} AS kind, {_wc("text")} AS w FROM documents) GROUP BY kind""")
def token_stats_upper_median(spark: SparkSession, d: str) -> DataFrame:
    return C.upper_median(table(spark, d, "documents").select(_kind("source").alias("kind"), T.word_count(F.col("text")).alias("w")), "kind", "w")


@query(f"""SELECT coalesce(dir, 'all') AS dir, coalesce(file, 'all') AS file, count(*) AS passages, sum(w) AS words, sum(chars) AS chars FROM
(SELECT split_part(f, '/', 1) AS dir, f AS file, {_wc("ray_peat_response")} AS w, length(coalesce(ray_peat_response, '')) AS chars FROM (SELECT *, trim(replace(source_file, '\\', '/')) AS f FROM search_results)) GROUP BY ROLLUP (dir, file)""".replace("\\\\", "\\"))
def corpus_scale_rollup(spark: SparkSession, d: str) -> DataFrame:
    f = T.clean_path(F.col("source_file"))
    s = table(spark, d, "search_results").select(F.split_part(f, F.lit("/"), F.lit(1)).alias("dir"), f.alias("file"), T.word_count(F.col("ray_peat_response")).alias("w"), F.length(F.coalesce("ray_peat_response", F.lit(""))).alias("chars"))
    return s.rollup("dir", "file").agg(F.count("*").alias("passages"), F.sum("w").alias("words"), F.sum("chars").alias("chars")).select(F.coalesce("dir", F.lit("all")).alias("dir"), F.coalesce("file", F.lit("all")).alias("file"), "passages", "words", "chars")


@query("SELECT id, 'v3_' || substr(md5(concat_ws(':', source_file, id)), 1, 12) AS stable_id, substr(sha256(coalesce(ray_peat_response, '')), 1, 16) AS content_hash, greatest(1, length(coalesce(ray_peat_response, '')) // 4) AS token_estimate FROM search_results")
def stable_ids(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("ray_peat_response")
    return table(spark, d, "search_results").select("id", T.stable_id("v3_", F.col("source_file"), F.col("id")).alias("stable_id"), F.substring(F.sha2(F.coalesce(t, F.lit("")), 256), 1, 16).alias("content_hash"), T.token_estimate(t).alias("token_estimate"))


@query(r"""SELECT source_file, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(source_file, '\', '/'), '^.*/', ''), '\.[a-z0-9]+$', ''), '_processed$', ''), '-[0-9]+$', ''), '[-_]+', ' ', 'g')) AS extracted FROM (SELECT DISTINCT source_file FROM search_results)""")
def title_extract(spark: SparkSession, d: str) -> DataFrame:
    c = T.clean_path(F.col("source_file"))
    for p, by in ((r"^.*/", ""), (r"\.[a-z0-9]+$", ""), (r"_processed$", ""), (r"-[0-9]+$", ""), (r"[-_]+", " ")):
        c = F.regexp_replace(c, p, by)
    return table(spark, d, "search_results").select("source_file").distinct().select("source_file", F.trim(c).alias("extracted"))


_YEAR = r"\b((?:19|20)[0-9]{2})\b"


@query(f"""WITH s AS (SELECT doc_id, text, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '') AS lines FROM documents),
t AS (SELECT *, list_filter(lines[1:5], lambda x: length(x) BETWEEN 20 AND 200 AND NOT ends_with(x, '.')) AS good FROM s)
SELECT doc_id, {_wc("text")} AS words, length(coalesce(text, '')) AS chars, CASE WHEN len(good) > 0 THEN good[1] WHEN len(lines) > 0 THEN substr(lines[1], 1, 100) END AS heading, nullif(regexp_extract(coalesce(text, ''), '{_YEAR}', 1), '') AS year FROM t""")
def doc_metadata(spark: SparkSession, d: str) -> DataFrame:
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x, F.lit(" \t\r"))), lambda x: x != "")
    good = F.filter(F.slice("lines", 1, 5), lambda x: F.length(x).between(20, 200) & ~F.endswith(x, F.lit(".")))
    heading = F.coalesce(F.get(F.col("good"), F.lit(0)), F.substring(F.get(F.col("lines"), F.lit(0)), 1, 100))
    return (
        table(spark, d, "documents").withColumn("lines", lines).withColumn("good", good)
        .select("doc_id", T.word_count(F.col("text")).alias("words"), F.length(F.coalesce("text", F.lit(""))).alias("chars"), heading.alias("heading"), F.nullif(F.regexp_extract(F.coalesce("text", F.lit("")), _YEAR, 1), F.lit("")).alias("year"))
    )


_NOISE_SQL = " + ".join(f"coalesce(list_sum(list_transform(regexp_extract_all(t, {_q(p)}), lambda x: length(x))), 0)" for p in NOISE)


@query(f"SELECT doc_id, CASE WHEN length(t) < 50 THEN 0.0 ELSE least(1.0, round(({_NOISE_SQL}) / length(t)::DOUBLE, 6)) END::DOUBLE AS noise FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)")
def noise_ratio(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", C.match_share(F.col("text"), NOISE).alias("noise"))


def _rules_sql(x: str) -> str:
    for p, by in RULES:
        x = f"regexp_replace({x}, {_q(p)}, {_q(by)}, 'g')"
    return _sq(x)


@query(f"SELECT doc_id, length(c) AS clean_chars, md5(c) AS clean_md5, CASE WHEN length(c) < 200 THEN 'too_short' WHEN length(c) < 0.3 * length(text) THEN 'mostly_noise' ELSE 'clean' END AS decision FROM (SELECT doc_id, coalesce(text, '') AS text, {_rules_sql('coalesce(text, chr(32))')} AS c FROM documents)")
def rules_clean(spark: SparkSession, d: str) -> DataFrame:
    c, n = F.col("c"), F.length("c")
    decision = F.when(n < 200, "too_short").when(n < 0.3 * F.length(F.coalesce("text", F.lit(""))), "mostly_noise").otherwise("clean")
    return table(spark, d, "documents").select("doc_id", "text", C.clean_by_rules(F.col("text"), RULES).alias("c")).select("doc_id", n.alias("clean_chars"), F.md5(c).alias("clean_md5"), decision.alias("decision"))


@query(f"""SELECT doc_id, CASE WHEN n = 0 THEN 0.5 ELSE round(0.4 * least(1.0, n::DOUBLE / s / 30) + 0.3 * least(1.0, 3.0 * len(list_distinct(w)) / n) + 0.3 * least(1.0, 10.0 * tech / n), 6) END::DOUBLE AS difficulty
FROM (SELECT doc_id, w, len(w) AS n, greatest(1, len(regexp_extract_all(coalesce(text, ''), '[.!?]+'))) AS s, len(list_filter(w, lambda x: x IN ({", ".join(map(_q, TECHNICAL))}))) AS tech FROM (SELECT doc_id, text, {_words("text")} AS w FROM documents))""")
def difficulty_score(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", C.difficulty(F.col("text"), TECHNICAL).alias("difficulty"))


@query(r"""SELECT host, count(*) AS links, count(DISTINCT doc_id) AS documents FROM (SELECT doc_id, lower(unnest(regexp_extract_all(coalesce(text, ''), 'https?://([^/\s<>"'')]+)', 1))) AS host FROM documents) GROUP BY host""")
def link_hosts(spark: SparkSession, d: str) -> DataFrame:
    links = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"""https?://([^/\s<>"')]+)"""), F.lit(1))
    return table(spark, d, "documents").select("doc_id", F.explode(links).alias("h")).groupBy(F.lower("h").alias("host")).agg(F.count("*").alias("links"), F.countDistinct("doc_id").alias("documents"))


_HTML = [(r"(?is)<(script|style|nav|footer|head)[^>]*>.*?</(script|style|nav|footer|head)>", " "), (r"(?i)</?(p|br|div|li|h[1-6]|tr|article|section|blockquote)[^<>]*>", "\n"), (r"<[^<>]{1,300}>", "")]


def _html_sql(x: str) -> str:
    for p, by in _HTML:
        x = f"regexp_replace({x}, {_q(p)}, {_q(by)}, 'g')"
    return _sq(x)


@query(f"SELECT doc_id, length(c) AS chars, md5(c) AS text_md5 FROM (SELECT doc_id, {_html_sql('text')} AS c FROM documents WHERE contains(text, '<') AND regexp_matches(text, '</?[a-zA-Z]'))")
def html_text(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "documents").filter(F.col("text").contains("<") & F.col("text").rlike("</?[a-zA-Z]"))
    return s.select("doc_id", C.clean_by_rules(F.col("text"), _HTML).alias("c")).select("doc_id", F.length("c").alias("chars"), F.md5("c").alias("text_md5"))


@query(f"""WITH l AS (SELECT source_file AS lid, list_distinct({_words("title")}) AS lw FROM source_files WHERE title IS NOT NULL), r AS (SELECT doc_id AS rid, list_distinct({_words("title")}) AS rw FROM documents WHERE title IS NOT NULL)
SELECT lid, rid, overlap FROM (SELECT lid, rid, round(len(list_intersect(lw, rw))::DOUBLE / len(lw), 6) AS overlap FROM l, r WHERE len(lw) > 0) WHERE overlap > 0.6""")
def title_overlap_join(spark: SparkSession, d: str) -> DataFrame:
    left = table(spark, d, "source_files").filter("title IS NOT NULL").select(F.col("source_file").alias("lid"), T.letters(F.col("title")).alias("words"))
    right = table(spark, d, "documents").filter("title IS NOT NULL").select(F.col("doc_id").alias("rid"), T.letters(F.col("title")).alias("words"))
    return C.overlap_join(left, right, 0.6)


@query(r"""WITH f AS (SELECT trim(replace(source_file, '\', '/')) AS path, lower(regexp_replace(coalesce(source_type, 'unknown'), '[^A-Za-z]', '', 'g')) AS kind FROM source_files),
s AS (SELECT DISTINCT id, trim(replace(source_file, '\', '/')) AS path FROM search_results),
v AS (SELECT s.id, f.kind, count(*) AS n FROM s JOIN f ON ends_with(f.path, split_part(s.path, '/', -1)) AND (ends_with(f.path, s.path) OR ends_with(s.path, f.path)) GROUP BY 1, 2)
SELECT kind, count(*) AS passages FROM (SELECT id, kind, row_number() OVER (PARTITION BY id ORDER BY n DESC, kind) AS r FROM v) WHERE r = 1 GROUP BY kind""")
def suffix_join_vote(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "source_files").select(T.clean_path(F.col("source_file")).alias("path"), F.lower(F.regexp_replace(F.coalesce("source_type", F.lit("unknown")), "[^A-Za-z]", "")).alias("kind")).withColumn("base", F.substring_index("path", "/", -1))
    s = table(spark, d, "search_results").select("id", T.clean_path(F.col("source_file")).alias("own")).distinct().withColumn("base", F.substring_index("own", "/", -1))
    met = s.join(f, "base").filter(F.endswith("path", F.col("own")) | F.endswith("own", F.col("path")))
    votes = met.groupBy("id", "kind").agg(F.count("*").alias("n"))
    best = votes.groupBy("id").agg(F.min(F.struct((-F.col("n")).alias("n"), "kind")).alias("b"))
    return best.groupBy(F.col("b.kind").alias("kind")).agg(F.count("*").alias("passages"))


@query("""WITH c AS (SELECT DISTINCT id, question, answer FROM conversations WHERE answer IS NOT NULL AND question IS NOT NULL AND NOT contains(answer, '**') AND NOT contains(question, '**'))
SELECT id, 0 AS chunk_index, length(trim(answer, E' \\n\\r\\t')) AS text_chars, md5(trim(question, E' \\n\\r\\t')) AS context_md5 FROM c""")
def marker_parse(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").filter("answer IS NOT NULL AND question IS NOT NULL AND NOT contains(answer, '**') AND NOT contains(question, '**')").select("id", "question", "answer").distinct()
    marked = c.select("id", F.concat(F.lit("**CONTEXT:** "), "question", F.lit("\n\n**ANSWER:** "), "answer").alias("text"))
    return C.marked_parts(marked, "id", "text", "ANSWER", "CONTEXT").select("id", "chunk_index", F.length("text").alias("text_chars"), F.md5("context").alias("context_md5"))
