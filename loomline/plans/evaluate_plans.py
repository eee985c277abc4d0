"""Queries that evaluate answers, retrieval and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.functions import text as T
from loomline.plans.corpus_plans import _KIND_SQL, _kind, _wc, _words
from loomline.plans.registry import SQL, query
from loomline.plans.vector_plans import _COS, _KNN, _knn
from loomline.session import table

_C = "c AS (SELECT DISTINCT id, question, answer, confidence, sources FROM conversations)"


def _conv(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("id", "question", "answer", "confidence", "sources").distinct()


@query(rf"""WITH {_C} SELECT coalesce(upper(trim(confidence)), '(none)') AS confidence, count(*) AS answers, round(avg({_wc("answer")}), 6) AS mean_words, sum(len(regexp_extract_all(coalesce(answer, ''), '\[[0-9]+(?:, ?[0-9]+)*\]'))) AS citations,
count(*) FILTER (WHERE regexp_matches(coalesce(answer, ''), '(^|\n)([-*•]|[0-9]+\.) ')) AS with_list, count(*) FILTER (WHERE ends_with(trim(coalesce(answer, '')), '?')) AS asks_back FROM c GROUP BY 1""")
def answer_metrics(spark: SparkSession, d: str) -> DataFrame:
    a = F.coalesce("answer", F.lit(""))
    return _conv(spark, d).groupBy(F.coalesce(F.upper(F.trim("confidence")), F.lit("(none)")).alias("confidence")).agg(
        F.count("*").alias("answers"), F.round(F.avg(T.word_count(F.col("answer"))), 6).alias("mean_words"), F.sum(F.size(F.regexp_extract_all(a, F.lit(r"(\[[0-9]+(?:, ?[0-9]+)*\])"), F.lit(1)))).alias("citations"),
        F.count_if(a.rlike(r"(^|\n)([-*•]|[0-9]+\.) ")).alias("with_list"), F.count_if(F.endswith(F.trim(a), F.lit("?"))).alias("asks_back"),
    )


@query(f"""WITH {_C}, t AS (SELECT id, list_distinct(list_filter({_words("question")}, lambda w: length(w) >= 5)) AS t, lower(coalesce(answer, '')) AS a FROM c),
g AS (SELECT id, len(t) AS terms, len(list_filter(t, lambda w: contains(a, CASE WHEN length(w) > 6 THEN substr(w, 1, length(w) - 3) ELSE w END))) AS found FROM t)
SELECT id, terms, found, CASE WHEN terms = 0 THEN 'open' WHEN found = 0 THEN 'ungrounded' WHEN found * 2 < terms THEN 'weak' ELSE 'grounded' END AS grounding FROM g""")
def entity_grounding(spark: SparkSession, d: str) -> DataFrame:
    low = F.lower(F.coalesce("answer", F.lit("")))
    terms = F.array_distinct(F.filter(T.letters(F.col("question")), lambda w: F.length(w) >= 5))
    g = _conv(spark, d).select("id", terms.alias("t"), low.alias("a"))
    found = F.size(F.filter("t", lambda w: F.contains(F.col("a"), F.when(F.length(w) > 6, F.substring(w, F.lit(1), F.length(w) - 3)).otherwise(w))))
    g = g.select("id", F.size("t").alias("terms"), found.alias("found"))
    return g.withColumn("grounding", F.when(F.col("terms") == 0, "open").when(F.col("found") == 0, "ungrounded").when(F.col("found") * 2 < F.col("terms"), "weak").otherwise("grounded"))


_CITED = r"""s AS (SELECT id, question, trim(replace(unnest(l), '\', '/')) AS path, generate_subscripts(l, 1) AS pos FROM (SELECT id, question, from_json(sources, '["VARCHAR"]') AS l FROM c WHERE json_valid(sources))),
f AS (SELECT trim(replace(source_file, '\', '/')) AS path, title FROM source_files)"""


def _cited(spark: SparkSession, d: str) -> DataFrame:
    s = _conv(spark, d).select("id", "question", F.posexplode(F.from_json("sources", "array<string>")).alias("p", "raw")).select("id", "question", T.clean_path(F.col("raw")).alias("path"), (F.col("p") + 1).alias("pos"))
    return s.join(table(spark, d, "source_files").select(T.clean_path(F.col("source_file")).alias("path"), "title"), "path", "left")


@query(f"""WITH {_C}, {_CITED}, k AS (SELECT s.id, s.path, s.pos, list_distinct({_words("question")}) AS q, list_distinct({_words("title")}) AS w FROM s LEFT JOIN f USING (path)),
r AS (SELECT id, path, pos, round(0.7 / pos + 0.3 * len(list_intersect(q, w)) / greatest(1, len(q)), 6) AS score FROM k)
SELECT id, path, pos, score::DOUBLE AS score, row_number() OVER (PARTITION BY id ORDER BY score DESC, pos, path) AS rank FROM r""")
def keyword_rerank(spark: SparkSession, d: str) -> DataFrame:
    q, w = F.array_distinct(T.letters(F.col("question"))), F.array_distinct(T.letters(F.col("title")))
    score = F.round(F.lit(0.7) / F.col("pos") + F.lit(0.3) * F.size(F.array_intersect(q, w)) / F.greatest(F.lit(1), F.size(q)), 6)
    k = _cited(spark, d).select("id", "path", "pos", score.alias("score"))
    return k.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "pos", "path")))


@query(f"""WITH {_C}, {_CITED} SELECT id, count(*) AS sources, md5(string_agg('[S' || pos || '] ' || path || ' (' || coalesce(substr(title, 1, 60), '') || ')', chr(10) || '---' || chr(10) ORDER BY pos)) AS context_md5 FROM s LEFT JOIN f USING (path) GROUP BY id, question""")
def prompt_context(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat(F.lit("[S"), F.col("pos").cast("string"), F.lit("] "), "path", F.lit(" ("), F.coalesce(F.substring("title", 1, 60), F.lit("")), F.lit(")"))
    g = _cited(spark, d).groupBy("id", "question").agg(F.count("*").alias("sources"), F.sort_array(F.collect_list(F.struct("pos", line.alias("line")))).alias("l"))  # as many as one row cites
    return g.select("id", "sources", F.md5(F.concat_ws("\n---\n", F.transform("l", lambda x: x["line"]))).alias("context_md5"))


@query(f"""WITH k AS ({_KNN.format("AND q.vec_id <> e.vec_id")}), g AS (SELECT qid, max(score) AS top, count(*) FILTER (WHERE score >= 0.3) AS strong, round(avg(score) FILTER (WHERE rank <= 5), 6) AS mean5 FROM k GROUP BY qid)
SELECT qid, top, strong, mean5, CASE WHEN top >= 0.5 AND strong >= 5 THEN 'HIGH' WHEN top >= 0.35 AND strong >= 2 THEN 'MEDIUM' WHEN mean5 >= 0.2 THEN 'LOW' ELSE 'ABSTAIN' END AS tier FROM g""")
def confidence_tier(spark: SparkSession, d: str) -> DataFrame:
    g = _knn(spark, d, True).groupBy("qid").agg(F.max("score").alias("top"), F.count_if(F.col("score") >= 0.3).alias("strong"), F.round(F.avg(F.when(F.col("rank") <= 5, F.col("score"))), 6).alias("mean5"))
    tier = F.when((F.col("top") >= 0.5) & (F.col("strong") >= 5), "HIGH").when((F.col("top") >= 0.35) & (F.col("strong") >= 2), "MEDIUM").when(F.col("mean5") >= 0.2, "LOW").otherwise("ABSTAIN")
    return g.withColumn("tier", tier)


@query(f"""WITH k AS (SELECT q.vec_id AS qid, q.label AS ql, e.vec_id AS id, e.label AS l, {_COS} AS score FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0 AND q.vec_id <> e.vec_id)
SELECT qid, arg_max(id, {{'s': score, 'i': -id}}) FILTER (WHERE l = ql) AS positive, arg_max(id, {{'s': score, 'i': -id}}) FILTER (WHERE l <> ql) AS negative, round(max(score) FILTER (WHERE l = ql) - max(score) FILTER (WHERE l <> ql), 6) AS gap FROM k GROUP BY qid""")
def hard_negatives(spark: SparkSession, d: str) -> DataFrame:
    """Nearest of the same and of another label for each of the query set, from one exact block join that keeps both."""
    from loomline.operators.vector import knn_join

    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vec"))
    q = e.filter("id % 100 = 0").select(F.col("id").alias("qid"), "label", "vec")
    k = knn_join(e, q, 1, True, by_label=True)
    met = q.filter("qid IS NOT NULL AND vec IS NOT NULL").select("qid")  # a query without either has a row as well
    order = F.struct("score", (-F.col("id")).alias("i"))
    g = k.select("qid", "same", "score", "id").unionByName(met, allowMissingColumns=True).groupBy("qid").agg(F.max(F.when(F.col("same"), order)).alias("p"), F.max(F.when(~F.col("same"), order)).alias("n"))
    return g.select("qid", (-F.col("p.i")).alias("positive"), (-F.col("n.i")).alias("negative"), F.round(F.col("p.score") - F.col("n.score"), 6).alias("gap"))


@query("SELECT lower(trim(question)) AS anchor, min(id) AS first_id, count(*) AS copies FROM conversations WHERE question IS NOT NULL GROUP BY 1")
def pair_dedup(spark: SparkSession, d: str) -> DataFrame:
    from loomline.operators.corpus import first_of_each

    return first_of_each(table(spark, d, "conversations").filter("question IS NOT NULL"), F.lower(F.trim("question")), "id").select(F.col("key").alias("anchor"), F.col("first").alias("first_id"), "copies")


@query("SELECT CASE WHEN substr(md5(doc_id::VARCHAR), 1, 2) < '1a' THEN 'test' ELSE 'train' END AS part, count(*) AS documents, min(doc_id) AS first_doc FROM documents GROUP BY 1")
def hash_split(spark: SparkSession, d: str) -> DataFrame:
    part = F.when(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 2) < "1a", "test").otherwise("train")
    return table(spark, d, "documents").groupBy(part.alias("part")).agg(F.count("*").alias("documents"), F.min("doc_id").alias("first_doc"))


@query(f"""WITH r AS (SELECT DISTINCT doc_id, reviewer, toxic, quality FROM review_labels), j AS (SELECT {_KIND_SQL.format("source")} AS kind, r.* FROM r JOIN documents USING (doc_id))
SELECT coalesce(kind, 'all') AS kind, count(*) AS labels, count(DISTINCT doc_id) AS documents, round(avg(quality), 6) AS mean_quality, count(*) FILTER (WHERE toxic = 1) AS toxic, count(*) FILTER (WHERE toxic IS NULL) AS unlabelled FROM j GROUP BY ROLLUP (kind)""")
def category_means_rollup(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "review_labels").select("doc_id", "reviewer", "toxic", "quality").distinct()
    j = r.join(table(spark, d, "documents").select("doc_id", _kind("source").alias("kind")), "doc_id")
    return j.rollup("kind").agg(
        F.count("*").alias("labels"), F.countDistinct("doc_id").alias("documents"), F.round(F.avg("quality"), 6).alias("mean_quality"), F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_if(F.col("toxic").isNull()).alias("unlabelled")
    ).withColumn("kind", F.coalesce("kind", F.lit("all")))


@query("""WITH m AS (SELECT doc_id, count(*) AS labels, count(DISTINCT toxic) AS opinions, avg(quality) AS q FROM review_labels GROUP BY doc_id)
SELECT doc_id, labels, opinions, round(q, 6) AS mean_quality FROM m ORDER BY q, doc_id LIMIT 25""")
def worst_documents(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "review_labels").groupBy("doc_id").agg(F.count("*").alias("labels"), F.countDistinct("toxic").alias("opinions"), F.avg("quality").alias("q"))
    return m.orderBy(F.asc_nulls_last("q"), "doc_id").limit(25).select("doc_id", "labels", "opinions", F.round("q", 6).alias("mean_quality"))


@query("""WITH d AS (SELECT doc_id, count(*) FILTER (WHERE toxic = 1) AS yes, count(*) FILTER (WHERE toxic = 0) AS no, avg(quality) AS q FROM review_labels GROUP BY doc_id)
SELECT yes > no AS toxic, coalesce(q <= 2, false) AS low_quality, count(*) AS documents, sum(CASE WHEN yes > 0 AND no > 0 THEN 1 ELSE 0 END) AS disputed FROM d GROUP BY 1, 2""")
def label_confusion(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "review_labels").groupBy("doc_id").agg(F.count_if(F.col("toxic") == 1).alias("yes"), F.count_if(F.col("toxic") == 0).alias("no"), F.avg("quality").alias("q"))
    return g.groupBy((F.col("yes") > F.col("no")).alias("toxic"), F.coalesce(F.col("q") <= 2, F.lit(False)).alias("low_quality")).agg(F.count("*").alias("documents"), F.sum(F.when((F.col("yes") > 0) & (F.col("no") > 0), 1).otherwise(0)).alias("disputed"))


@query(f"""WITH g AS ({SQL["hard_negatives"]}) SELECT v.label, count(*) AS queries, count(gap) AS pairs, round(avg(gap), 6) AS mean_gap, min(gap) AS least_gap, max(gap) AS greatest_gap, count(*) FILTER (WHERE gap >= 0) AS well_ordered FROM g JOIN embeddings v ON v.vec_id = g.qid GROUP BY 1""")
def mined_gap_stats(spark: SparkSession, d: str) -> DataFrame:
    """Gaps between positive and negative of the mined rows, by label."""
    labels = table(spark, d, "embeddings").select(F.col("vec_id").alias("qid"), "label")
    return hard_negatives(spark, d).join(labels, "qid").groupBy("label").agg(
        F.count("*").alias("queries"), F.count("gap").alias("pairs"), F.round(F.avg("gap"), 6).alias("mean_gap"), F.min("gap").alias("least_gap"), F.max("gap").alias("greatest_gap"), F.count_if(F.col("gap") >= 0).alias("well_ordered")
    )


@query("""WITH a AS (SELECT DISTINCT id, answer, sources FROM conversations WHERE id IS NOT NULL AND answer IS NOT NULL),
q AS (SELECT id, unnest(list_distinct(regexp_extract_all(answer, '"([^"]{20,})"', 1))) AS quote FROM a),
s AS (SELECT id, unnest(CAST(json_extract_string(CASE WHEN json_valid(sources) THEN sources ELSE '[]' END, '$[*]') AS VARCHAR[])) AS f FROM a),
f AS (SELECT DISTINCT id, replace(f, chr(92), '/') AS f FROM s), t AS (SELECT replace(source_file, chr(92), '/') AS f, ray_peat_response AS x FROM search_results)
SELECT count(*) AS quotes, count(*) FILTER (WHERE found) AS in_a_source, count(*) FILTER (WHERE NOT found) AS fabricated FROM (
SELECT q.id, q.quote, coalesce(bool_or(contains(t.x, q.quote)), false) AS found FROM q LEFT JOIN f ON f.id = q.id LEFT JOIN t ON t.f = f.f GROUP BY 1, 2)""")
def fabricated_quotes(spark: SparkSession, d: str) -> DataFrame:
    """Quotations of twenty characters or more in answers, and whether a passage of a source that the answer names holds them. Passages are read
    once and joined by file only for answers that quote."""
    answers = table(spark, d, "conversations").filter("id IS NOT NULL AND answer IS NOT NULL").select("id", "answer", "sources").distinct()
    quotes = answers.select("id", "sources", F.explode(F.array_distinct(F.regexp_extract_all("answer", F.lit('"([^"]{20,})"'), F.lit(1)))).alias("quote"))
    named = quotes.select("id", "quote", F.explode_outer(F.array_distinct(F.transform(F.from_json("sources", "array<string>"), lambda f: F.replace(f, F.lit("\\"), F.lit("/"))))).alias("f"))
    passages = table(spark, d, "search_results").select(F.replace("source_file", F.lit("\\"), F.lit("/")).alias("f"), F.col("ray_peat_response").alias("x"))
    found = named.join(passages, "f", "left").groupBy("id", "quote").agg(F.coalesce(F.max(F.contains("x", "quote")), F.lit(False)).alias("found"))
    return found.agg(F.count("*").alias("quotes"), F.count_if("found").alias("in_a_source"), F.count_if(~F.col("found")).alias("fabricated"))


@query("""WITH t AS (SELECT DISTINCT lower(trim(primary_topic)) AS topic FROM search_results WHERE trim(primary_topic) <> ''), n AS (SELECT lower(trim(primary_topic)) AS topic, count(*) AS n FROM search_results GROUP BY 1),
w AS (SELECT DISTINCT id, lower(trim(unnest(expected_topics))) AS want FROM eval_questions), e AS (SELECT w.id, t.topic FROM w JOIN t ON t.topic = w.want),
p AS (SELECT DISTINCT id, unnest(string_split(want, ' ')) AS word FROM w WHERE id NOT IN (SELECT id FROM e)), l AS (SELECT DISTINCT p.id, t.topic FROM p JOIN t ON contains(t.topic, p.word) WHERE length(word) >= 4),
b AS (SELECT id, topic, 'exact' AS how FROM e UNION ALL SELECT id, topic, 'word' FROM l) SELECT id, how, count(*) AS topics, CAST(sum(n) AS BIGINT) AS passages FROM (SELECT DISTINCT * FROM b) JOIN n USING (topic) GROUP BY 1, 2""")
def topic_filter_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Passages of the topics that a test item expects: by equal topic, and where no topic is equal by words of four letters or more in it."""
    n = table(spark, d, "search_results").groupBy(F.lower(F.trim("primary_topic")).alias("topic")).agg(F.count("*").alias("n"))
    topics = n.filter("topic <> ''")
    want = table(spark, d, "eval_questions").select("id", F.explode("expected_topics").alias("want")).select("id", F.lower(F.trim("want")).alias("want")).distinct()
    exact = want.join(topics, want["want"] == topics["topic"]).select("id", "topic", "n").distinct()
    words = want.join(exact.select("id").distinct(), "id", "left_anti").select("id", F.explode(F.split("want", " ")).alias("word")).filter(F.length("word") >= 4).distinct()
    like = words.join(topics, F.contains("topic", "word")).select("id", "topic", "n").distinct()
    both = exact.withColumn("how", F.lit("exact")).unionByName(like.withColumn("how", F.lit("word")))
    return both.groupBy("id", "how").agg(F.count("*").alias("topics"), F.sum("n").alias("passages"))


@query("""WITH c AS (SELECT doc_id, max(octet_length(encode(text))) AS bytes, max(ingested_at) AS kept_at FROM documents WHERE text IS NOT NULL GROUP BY 1), r AS (SELECT doc_id, count(*) AS reads FROM chunk_metadata GROUP BY 1)
SELECT count(*) AS entries, round(sum(bytes) / 1048576.0, 6) AS megabytes, epoch_us(min(kept_at)) AS oldest_us, arg_max(doc_id, {'r': coalesce(reads, 0), 'd': -doc_id}) AS most_read, max(reads) AS most_reads FROM c LEFT JOIN r USING (doc_id)""")
def cache_stats(spark: SparkSession, d: str) -> DataFrame:
    """A store of texts: entries, size, oldest entry and the one read most often."""
    entries = table(spark, d, "documents").filter("text IS NOT NULL").groupBy("doc_id").agg(F.max(F.octet_length("text")).alias("bytes"), F.max("ingested_at").alias("at"))
    reads = table(spark, d, "chunk_metadata").groupBy("doc_id").agg(F.count("*").alias("reads"))
    both = entries.join(reads, "doc_id", "left")
    return both.agg(
        F.count("*").alias("entries"), F.round(F.sum("bytes") / 1048576.0, 6).alias("megabytes"), F.unix_micros(F.min(F.col("at").cast("timestamp"))).alias("oldest_us"),
        F.max_by("doc_id", F.struct(F.coalesce("reads", F.lit(0)).alias("r"), (-F.col("doc_id")).alias("d"))).alias("most_read"), F.max("reads").alias("most_reads"),
    )
