"""Queries that review answers, corpora and learners: abstention, parsers compared, duplicates, folds with bounds, neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.functions import answers as A
from loomline.functions import text as T
from loomline.operators import corpus as C
from loomline.operators import graph as G
from loomline.operators import learning as L
from loomline.plans.corpus_plans import _fp, _list, _words
from loomline.plans.event_plans import _E, _events
from loomline.plans.graph_plans import _TRI, _triples
from loomline.plans.registry import query
from loomline.session import table

_HOLDS = lambda x, kind: f"len(list_filter({_list(A.phrases(kind))}, lambda p: contains(lower(coalesce({x}, '')), p))) > 0"
_SIGNAL = f"CASE WHEN {_HOLDS('answer', A.ABSTAINS)} THEN 'abstained' WHEN {_HOLDS('answer', A.PUSHES_BACK)} THEN 'premise_rejected' ELSE 'answered' END"
_LOG = f"c AS (SELECT DISTINCT id, question, answer, confidence, n_sources FROM conversations), s AS (SELECT *, {_SIGNAL} AS signal FROM c)"


def _signals(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select("id", "question", "answer", "confidence", "n_sources").distinct()
    return c.withColumn("signal", A.abstention(F.col("answer")))


@query(f"WITH {_LOG} SELECT coalesce(upper(trim(confidence)), 'NONE') AS confidence, signal, count(*) AS answers FROM s GROUP BY 1, 2")
def abstention_signals(spark: SparkSession, d: str) -> DataFrame:
    return _signals(spark, d).groupBy(F.coalesce(F.upper(F.trim("confidence")), F.lit("NONE")).alias("confidence"), "signal").agg(F.count("*").alias("answers"))


_EXPECTED = "CASE WHEN coalesce(n_sources, 0) = 0 THEN 'abstain' WHEN regexp_matches(lower(coalesce(question, '')), 'true|vrai|stimmt|verdad') THEN 'reject_premise' ELSE 'answer' END"


@query(f"""WITH {_LOG}, p AS (SELECT {_EXPECTED} AS pool, signal FROM s),
g AS (SELECT count(*) FILTER (WHERE pool = 'abstain') AS abstain_total, count(*) FILTER (WHERE pool = 'abstain' AND signal = 'abstained') AS abstain_correct, count(*) FILTER (WHERE pool = 'reject_premise') AS reject_total,
count(*) FILTER (WHERE pool = 'reject_premise' AND signal <> 'answered') AS reject_correct, count(*) FILTER (WHERE pool = 'answer') AS answer_total, count(*) FILTER (WHERE pool = 'answer' AND signal = 'abstained') AS false_refusals FROM p)
SELECT *, round(abstain_correct / greatest(1, abstain_total)::DOUBLE, 3) AS abstain_rate, round(reject_correct / greatest(1, reject_total)::DOUBLE, 3) AS reject_rate, round(false_refusals / greatest(1, answer_total)::DOUBLE, 3) AS false_refusal_rate,
round((abstain_correct + reject_correct) / greatest(1, abstain_total + reject_total)::DOUBLE, 3) AS defense_rate FROM g""")
def abstention_rates(spark: SparkSession, d: str) -> DataFrame:
    """Three pools by what was to be expected: no sources at all, a premise asked to be confirmed, any other question."""
    q = F.lower(F.coalesce("question", F.lit("")))
    pool = F.when(F.coalesce("n_sources", F.lit(0)) == 0, "abstain").when(q.rlike("true|vrai|stimmt|verdad"), "reject_premise").otherwise("answer")
    p = _signals(spark, d).select(pool.alias("pool"), "signal")
    held = lambda name, right: [F.count_if(F.col("pool") == name), F.count_if((F.col("pool") == name) & right)]
    (at, ac), (rt, rc), (nt, nf) = held("abstain", F.col("signal") == "abstained"), held("reject_premise", F.col("signal") != "answered"), held("answer", F.col("signal") == "abstained")
    g = p.agg(at.alias("abstain_total"), ac.alias("abstain_correct"), rt.alias("reject_total"), rc.alias("reject_correct"), nt.alias("answer_total"), nf.alias("false_refusals"))
    rate = lambda n, of: F.round(n / F.greatest(F.lit(1), of), 3)
    c = F.col
    return g.select(
        "*", rate(c("abstain_correct"), c("abstain_total")).alias("abstain_rate"), rate(c("reject_correct"), c("reject_total")).alias("reject_rate"), rate(c("false_refusals"), c("answer_total")).alias("false_refusal_rate"),
        rate(c("abstain_correct") + c("reject_correct"), c("abstain_total") + c("reject_total")).alias("defense_rate"),
    )


@query(f"""WITH {_LOG}, m AS (SELECT id % 2 = 0 AS a, unnest([CASE WHEN signal = 'abstained' THEN 'abstained' END, CASE WHEN NOT regexp_matches(coalesce(answer, ''), '\\[[0-9]') THEN 'uncited' END, CASE WHEN signal = 'premise_rejected' THEN 'premise_rejected' END, 'answers']) AS measure FROM s)
SELECT measure, count(*) FILTER (WHERE a) AS in_a, count(*) FILTER (WHERE NOT a) AS in_b, count(*) FILTER (WHERE a) - count(*) FILTER (WHERE NOT a) AS difference FROM m WHERE measure IS NOT NULL GROUP BY measure""".replace("\\\\", "\\"))
def abstention_by_arm(spark: SparkSession, d: str) -> DataFrame:
    """Abstentions, answers without a citation and rejected premises in both arms of a test (here by parity of the id)."""
    measures = F.array(
        F.when(F.col("signal") == "abstained", "abstained"), F.when(~F.coalesce("answer", F.lit("")).rlike(r"\[[0-9]"), "uncited"), F.when(F.col("signal") == "premise_rejected", "premise_rejected"), F.lit("answers")
    )
    m = _signals(spark, d).select((F.col("id") % 2 == 0).alias("a"), F.explode(measures).alias("measure")).filter("measure IS NOT NULL")
    return m.groupBy("measure").agg(F.count_if("a").alias("in_a"), F.count_if(~F.col("a")).alias("in_b")).withColumn("difference", F.col("in_a") - F.col("in_b"))


_SENTENCES = lambda x: rf"string_split(regexp_replace(coalesce({x}, ''), '([.!?])[ \t\r\n\f]+', '\1' || chr(1), 'g'), chr(1))"


@query(rf"""WITH c AS (SELECT DISTINCT id, answer, n_sources FROM conversations), s AS (SELECT id, n_sources, {_SENTENCES("answer")} AS s FROM c),
k AS (SELECT id, s, list_filter(s, lambda x: len(list_filter(regexp_extract_all(x, '\[S?(\d{{1,6}})\]', 1), lambda n: CAST(n AS INTEGER) > n_sources)) > 0) AS claims FROM s)
SELECT id, len(claims) AS claims, md5(array_to_string(list_filter(s, lambda x: len(list_filter(claims, lambda c: contains(lower(x), lower(c)) OR contains(lower(c), lower(x)))) = 0), ' ')) AS kept_md5 FROM k WHERE len(claims) > 0""")
def claims_stripped(spark: SparkSession, d: str) -> DataFrame:
    """Answers without the sentences that cite a source beyond those given."""
    c = table(spark, d, "conversations").select("id", "answer", "n_sources").distinct()
    beyond = lambda s: F.exists(F.regexp_extract_all(s, F.lit(r"\[S?(\d{1,6})\]"), F.lit(1)), lambda n: n.cast("int") > F.col("n_sources"))
    k = c.withColumn("unsupported", F.filter(T.sentences(F.col("answer")), beyond)).filter(F.size("unsupported") > 0)
    return k.select("id", F.size("unsupported").alias("claims"), F.md5(A.without_claims(F.col("answer"), F.col("unsupported"))).alias("kept_md5"))


@query(r"""WITH s AS (SELECT doc_id, list_filter(list_transform(""" + _SENTENCES("text") + r""", lambda x: regexp_replace(x, '^[ \t\r\n\f]+|[ \t\r\n\f]+$', '', 'g')), lambda x: length(x) > 20) AS s FROM documents),
m AS (SELECT doc_id, len(s) AS n, list_sort(list_transform(s, lambda x, i: {'n': length(x), 'i': i, 's': x}))[len(s) // 2 + 1].s AS m FROM s)
SELECT doc_id, n AS sentences, md5(CASE WHEN length(m) > 220 THEN regexp_replace(substr(m, 1, 220), ' [^ ]*\z', '') || '...' ELSE m END) AS central_md5 FROM m""")
def central_sentence(spark: SparkSession, d: str) -> DataFrame:
    """The sentence of middle length (over 20 characters, the first of equals), clipped at a blank beyond 220; null where there is none."""
    trimmed = F.transform(T.sentences(F.col("text")), lambda x: F.regexp_replace(x, r"^[ \t\r\n\f]+|[ \t\r\n\f]+\z", ""))
    s = table(spark, d, "documents").select("doc_id", F.filter(trimmed, lambda x: F.length(x) > 20).alias("s"))
    ranked = F.array_sort(F.transform("s", lambda x, i: F.struct(F.length(x).alias("n"), i.alias("i"), x.alias("s"))))
    m = s.select("doc_id", F.size("s").alias("sentences"), F.get(ranked, F.floor(F.size("s") / 2).cast("int"))["s"].alias("m"))
    clipped = F.concat(F.regexp_replace(F.substring("m", 1, 220), r" [^ ]*\z", ""), F.lit("..."))
    return m.select("doc_id", "sentences", F.md5(F.when(F.length("m") > 220, clipped).otherwise(F.col("m"))).alias("central_md5"))


_MARKED = r"""t AS (SELECT id, CASE WHEN id % 2 = 0 THEN '**CONTEXT:** ' || question || E'\n\n**ANSWER:** ' || answer ELSE '**ANSWER:** ' || answer || E'\n\n**CONTEXT:** ' || question END AS text, question
FROM (SELECT DISTINCT id, question, answer FROM conversations WHERE answer IS NOT NULL AND question IS NOT NULL AND NOT contains(answer, '**') AND NOT contains(question, '**')))"""


@query(rf"""WITH {_MARKED}, n AS (SELECT question, string_split(text, E'\n\n') AS b FROM t), p AS (SELECT question, b, list_position(list_transform(b, lambda x: starts_with(x, '**ANSWER:**')), true) AS i FROM n)
SELECT 'markers' AS parser, count(*) AS chunks, count(*) FILTER (WHERE trim(question, E' \n\r\t') <> '') AS with_context FROM t UNION ALL
SELECT 'blank lines', count(*), count(*) FILTER (WHERE (i > 1 AND starts_with(b[i - 1], '**CONTEXT:**')) OR starts_with(coalesce(b[i + 1], ''), '**CONTEXT:**')) FROM p""")
def parser_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Contexts that a parser by markers finds, in either order, and one that looks at the neighbouring block only."""
    c = table(spark, d, "conversations").filter("answer IS NOT NULL AND question IS NOT NULL AND NOT contains(answer, '**') AND NOT contains(question, '**')").select("id", "question", "answer").distinct()
    said, context = F.concat(F.lit("**ANSWER:** "), "answer"), F.concat(F.lit("**CONTEXT:** "), "question")
    t = c.select("id", F.when(F.col("id") % 2 == 0, F.concat_ws("\n\n", context, said)).otherwise(F.concat_ws("\n\n", said, context)).alias("text"))
    smart = C.marked_parts(t, "id", "text", "ANSWER", "CONTEXT").agg(F.lit("markers").alias("parser"), F.count("*").alias("chunks"), F.count_if(F.col("context") != "").alias("with_context"))
    b = F.split("text", "\n\n")
    i = F.array_position(F.transform(b, lambda x: F.startswith(x, F.lit("**ANSWER:**"))), True).cast("int")
    near = lambda at: F.coalesce(F.startswith(F.get(b, at), F.lit("**CONTEXT:**")), F.lit(False))
    plain = t.agg(F.lit("blank lines").alias("parser"), F.count("*").alias("chunks"), F.count_if(near(i - 2) | near(i)).alias("with_context"))
    return smart.unionByName(plain)


_DUP = f"f AS (SELECT {_fp('ray_peat_response')} AS fp, replace(source_file, '\\', '/') AS file FROM search_results WHERE ray_peat_response IS NOT NULL), g AS (SELECT md5(fp) AS fp_md5, count(*) AS n FROM f WHERE length(fp) > 20 GROUP BY 1)".replace("\\\\", "\\")


def _prints(spark: SparkSession, d: str) -> DataFrame:
    fp = T.fingerprint(F.col("ray_peat_response"))
    return table(spark, d, "search_results").filter("ray_peat_response IS NOT NULL").select(fp.alias("fp"), F.replace("source_file", F.lit("\\"), F.lit("/")).alias("file")).filter(F.length("fp") > 20).select(F.md5("fp").alias("fp_md5"), "file")


@query(f"WITH {_DUP} SELECT count(*) AS fingerprints, count(*) FILTER (WHERE n > 1) AS repeated, coalesce(sum(n - 1), 0)::BIGINT AS extra_rows FROM g")
def duplicate_summary(spark: SparkSession, d: str) -> DataFrame:
    g = _prints(spark, d).groupBy("fp_md5").agg(F.count("*").alias("n"))
    return g.agg(F.count("*").alias("fingerprints"), F.count_if(F.col("n") > 1).alias("repeated"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra_rows"))


@query(f"""WITH {_DUP}, w AS (SELECT * FROM g WHERE n > 1 ORDER BY n DESC, fp_md5 LIMIT 5), u AS (SELECT DISTINCT fp_md5, n, file FROM w JOIN (SELECT md5(fp) AS fp_md5, file FROM f) USING (fp_md5)),
r AS (SELECT *, row_number() OVER (PARTITION BY fp_md5 ORDER BY file) AS r FROM u WHERE file IS NOT NULL) SELECT fp_md5, n, string_agg(file, '; ' ORDER BY file) AS files FROM r WHERE r <= 5 GROUP BY 1, 2""")
def duplicate_worst(spark: SparkSession, d: str) -> DataFrame:
    """The five texts with most copies, each with up to five of its files; a top-k report."""
    p = _prints(spark, d)
    worst = p.groupBy("fp_md5").agg(F.count("*").alias("n")).filter("n > 1").orderBy(F.desc("n"), "fp_md5").limit(5)
    files = p.filter("file IS NOT NULL").join(F.broadcast(worst), "fp_md5").select("fp_md5", "n", "file").distinct()
    few = files.withColumn("r", F.row_number().over(Window.partitionBy("fp_md5").orderBy("file"))).filter("r <= 5")
    return few.groupBy("fp_md5", "n").agg(F.array_join(F.array_sort(F.collect_list("file")), "; ").alias("files"))


_ABILITY = f"""{_E}, a AS (SELECT user_id, CASE WHEN topic % 2 = 0 THEN 'Topic ' ELSE 'topic ' END || topic AS topic, round(avg(p), 6) AS theta FROM e WHERE p IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 3),
i AS (SELECT item, round(1 - avg(p), 6) AS b FROM e GROUP BY 1), k AS (SELECT DISTINCT user_id, item, 'Topic ' || topic AS topic FROM e)"""


@query(f"""WITH {_ABILITY}, j AS (SELECT k.user_id, coalesce(nullif(b, 0), 0.5) AS b, coalesce(l.theta, x.theta) AS theta FROM k JOIN i USING (item) LEFT JOIN a l ON l.user_id = k.user_id AND l.topic = lower(k.topic) LEFT JOIN a x ON x.user_id = k.user_id AND x.topic = k.topic)
SELECT user_id, count(*) AS items, count(theta) AS anchored, round(avg(round(abs(b - coalesce(theta, 0.5)) * 1000000)::BIGINT) / 1000000, 5) AS mean_gap FROM j GROUP BY user_id""")
def ability_anchor(spark: SparkSession, d: str) -> DataFrame:
    """How far a user's items lie from the ability in their topic; topics are spelt in two ways in the abilities."""
    e = _events(spark, d)
    name = F.concat(F.when(F.col("topic") % 2 == 0, "Topic ").otherwise("topic "), F.col("topic").cast("string"))
    abilities = e.filter("p IS NOT NULL").groupBy("user_id", name.alias("topic")).agg(F.count("*").alias("n"), F.round(F.avg("p"), 6).alias("theta")).filter("n >= 3").drop("n")
    hard = e.groupBy("item").agg(F.round(1 - F.avg("p"), 6).alias("difficulty"))
    used = e.select("user_id", "item", F.concat(F.lit("Topic "), F.col("topic").cast("string")).alias("topic")).distinct()
    j = L.anchored(used.join(hard, "item"), abilities)
    return j.groupBy("user_id").agg(F.count("*").alias("items"), F.count_if("known").alias("anchored"), F.round(F.avg(F.round(F.col("gap") * 1_000_000).cast("bigint")) / 1_000_000, 5).alias("mean_gap"))


@query(f"""WITH {_E}, f AS (SELECT item, round(ln(1 + count(*)) * 1000000)::BIGINT AS factor FROM e WHERE event_type = 'purchase' GROUP BY 1 HAVING count(*) >= 3), k AS (SELECT DISTINCT user_id, item FROM e)
SELECT user_id, count(*) AS candidates, count(*) - count(factor) AS without_factor, round(sum(coalesce(factor, 0)) / 1000000.0::DOUBLE, 4) AS score FROM k LEFT JOIN f USING (item) GROUP BY user_id""")
def factor_scores(spark: SparkSession, d: str) -> DataFrame:
    """A user's items with the factor of each, 0 where an item has none; factors in millionths, so that sums are exact."""
    e = _events(spark, d)
    f = e.filter("event_type = 'purchase'").groupBy("item").agg(F.count("*").alias("c")).filter("c >= 3").select("item", F.round(F.log(1.0 + F.col("c")) * 1_000_000).cast("bigint").alias("factor"))
    k = e.select("user_id", "item").distinct().join(f, "item", "left")
    return k.groupBy("user_id").agg(F.count("*").alias("candidates"), F.count_if(F.col("factor").isNull()).alias("without_factor"), F.round(F.sum(F.coalesce("factor", F.lit(0))) / 1_000_000.0, 4).alias("score"))


_STEP = "CASE WHEN p > 0.8 THEN 1 WHEN p < 0.3 THEN -1 ELSE 0 END"


@query(f"""WITH {_E} SELECT user_id, count(*) AS n, round(list_reduce(list_prepend(10, list({_STEP} ORDER BY ts, event_id)), lambda a, x: least(20, greatest(0, a + x))) / 20.0::DOUBLE, 2) AS preferred FROM e WHERE p IS NOT NULL GROUP BY user_id""")
def preferred_difficulty(spark: SparkSession, d: str) -> DataFrame:
    """From 0.5, a step of 0.05 up after a success and down after a failure, within 0 and 1."""
    e = _events(spark, d).filter("p IS NOT NULL").withColumn("step", F.when(F.col("p") > 0.8, 1).when(F.col("p") < 0.3, -1).otherwise(0))
    return L.clipped_fold(e, ["user_id"], "step", 10, 0, 20).select("user_id", "n", F.round(F.col("value") / 20.0, 2).alias("preferred"))


@query(f"""WITH {_E} SELECT user_id, topic, count(*) AS n, round(list_reduce(list_prepend(0::BIGINT, list(round((p - 0.5) * 100000)::BIGINT ORDER BY ts, event_id)), lambda a, x: least(1000000, greatest(0, a + x))) / 1000000.0::DOUBLE, 6) AS mastery FROM e WHERE p IS NOT NULL GROUP BY 1, 2""")
def mastery_fold(spark: SparkSession, d: str) -> DataFrame:
    """From 0, a tenth of the performance above or below one half, within 0 and 1, in millionths."""
    e = _events(spark, d).filter("p IS NOT NULL").withColumn("step", F.round((F.col("p") - 0.5) * 100000).cast("bigint"))
    return L.clipped_fold(e, ["user_id", "topic"], "step", 0, 0, 1_000_000).select("user_id", "topic", "n", F.round(F.col("value") / 1_000_000.0, 6).alias("mastery"))


@query(f"""WITH {_TRI}, k AS (SELECT subject AS a, relation, object AS b, count(DISTINCT id) AS support FROM tri WHERE subject <> object GROUP BY 1, 2, 3 HAVING count(DISTINCT id) >= 2),
two AS (SELECT x.a AS node, y.b AS other, 'indirect_' || y.relation AS relation, max(round(x.support * y.support * 0.7, 4))::DOUBLE AS strength FROM k x JOIN k y ON x.b = y.a WHERE x.a <> y.b GROUP BY 1, 2, 3),
o AS (SELECT a AS node, b AS other, relation, support::DOUBLE AS strength FROM k UNION ALL SELECT * FROM two)
SELECT node, other, relation, strength, rank FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY strength DESC, other, relation) AS rank FROM o) WHERE rank <= 5""")
def neighbours_ranked(spark: SparkSession, d: str) -> DataFrame:
    """Direct and indirect neighbours of each concept, the five strongest."""
    k = _triples(spark, d).filter("subject <> object").groupBy(F.col("subject").alias("a"), "relation", F.col("object").alias("b")).agg(F.countDistinct("id").alias("support")).filter("support >= 2")
    return G.neighbours(k)


_FIELDS = ["id", "context", "ray_peat_response", "source_file", "primary_topic"]


@query(f"SELECT coalesce(missing, 'none') AS missing, count(*) AS rows FROM (SELECT CASE {' '.join(f'''WHEN trim(coalesce({f}, '')) = '' THEN '{f}' ''' for f in _FIELDS)} END AS missing FROM search_results) GROUP BY 1")
def required_fields(spark: SparkSession, d: str) -> DataFrame:
    """Rows by the first required field that is empty."""
    empty = F.coalesce(*[F.when(F.trim(F.coalesce(f, F.lit(""))) == "", f) for f in _FIELDS], F.lit("none"))
    return table(spark, d, "search_results").groupBy(empty.alias("missing")).agg(F.count("*").alias("rows"))


@query("""WITH r AS (SELECT doc_id, count(DISTINCT reviewer) AS reviewers, max(toxic) AS toxic FROM review_labels GROUP BY 1), l AS (SELECT doc_id, coalesce(r.toxic, -1) AS reviewed, coalesce(reviewers, 0) AS reviewers FROM documents LEFT JOIN r USING (doc_id))
SELECT reviewed, count(*) AS documents, sum(reviewers)::BIGINT AS reviews FROM l WHERE reviewed >= 0 GROUP BY 1""")
def reviewed_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents that a reviewer has judged; those without a judgement count as -1 and are left out."""
    r = table(spark, d, "review_labels").groupBy("doc_id").agg(F.countDistinct("reviewer").alias("reviewers"), F.max("toxic").alias("toxic"))
    both = table(spark, d, "documents").select("doc_id").join(r, "doc_id", "left").select(F.coalesce("toxic", F.lit(-1)).alias("reviewed"), "reviewers")
    return both.filter("reviewed >= 0").groupBy("reviewed").agg(F.count("*").alias("documents"), F.sum("reviewers").alias("reviews"))


@query("""WITH c AS (SELECT doc_id::VARCHAR || '_processed.txt' AS file, sum(end_pos - start_pos)::BIGINT AS made FROM (SELECT DISTINCT doc_id, chunk_id, start_pos, end_pos FROM chunk_metadata) GROUP BY 1),
r AS (SELECT doc_id::VARCHAR || '.txt' AS file, length(text)::BIGINT AS raw FROM documents WHERE length(text) > 0)
SELECT r.file, raw, made, (made * 100) // raw AS pct FROM c JOIN r ON replace(c.file, '_processed.txt', '.txt') = r.file WHERE (made * 100) // raw > 104""")
def bloated_files(spark: SparkSession, d: str) -> DataFrame:
    """Texts whose pieces add up to well over the raw text, joined by the name derived from the processed one."""
    c = table(spark, d, "chunk_metadata").select("doc_id", "chunk_id", "start_pos", "end_pos").distinct().groupBy("doc_id").agg(F.sum(F.col("end_pos") - F.col("start_pos")).alias("made"))
    made = c.select(F.replace(F.concat(F.col("doc_id").cast("string"), F.lit("_processed.txt")), F.lit("_processed.txt"), F.lit(".txt")).alias("file"), "made")
    raw = table(spark, d, "documents").filter(F.length("text") > 0).select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("file"), F.length("text").cast("bigint").alias("raw"))
    return made.join(raw, "file").select("file", "raw", "made", F.expr("made * 100 div raw").alias("pct")).filter("pct > 104")


@query(f"""WITH c AS (SELECT DISTINCT id, question, from_json(sources, '["VARCHAR"]') AS s FROM conversations WHERE json_valid(sources)), w AS (SELECT id, s, list_distinct({_words("question")}) AS w FROM c),
u AS (SELECT id, unnest(s) AS source, generate_subscripts(s, 1) AS i, w FROM w), g AS (SELECT id, source, i, len(list_filter(w, lambda x: contains(lower(source), x))) AS hits FROM u)
SELECT id, source, hits, row_number() OVER (PARTITION BY id ORDER BY hits DESC, i) AS rank FROM g""")
def rerank_by_index(spark: SparkSession, d: str) -> DataFrame:
    """A question's sources in the order of a second score; the ranking names candidates by their place in the list."""
    c = table(spark, d, "conversations").select("id", T.letters(F.col("question")).alias("w"), F.from_json("sources", "array<string>").alias("s")).distinct()
    hits = lambda x: F.size(F.filter(F.array_distinct("w"), lambda v: F.contains(F.lower(x), v)))
    order = F.array_sort(F.transform("s", lambda x, i: F.struct((-hits(x)).alias("score"), i.alias("index"))))
    ranked = c.withColumn("order", order).select("id", "s", F.posexplode("order").alias("pos", "o"))
    return ranked.select("id", F.get("s", F.col("o.index")).alias("source"), (-F.col("o.score")).alias("hits"), (F.col("pos") + 1).alias("rank"))


# Parts of a path and the class of source they stand for, the first that fits.
CLASSES = {
    "01_Audio_Transcripts": "transcript", "02_Publications": "article", "03_Chronological_Content": "newsletter", "04_Health_Topics": "article", "05_Academic_Documents": "academic",
    "06_Email_Communications": "email", "07_Special_Collections": "special", "08_Newslatters": "newsletter",
}
_PARTS = "string_split(replace(source_file, '\\', '/'), '/')".replace("\\\\", "\\")


@query(f"""SELECT class, decade, count(*) AS files FROM (SELECT CASE {' '.join(f"WHEN list_contains({_PARTS}, '{k}') THEN '{v}'" for k, v in CLASSES.items())} ELSE 'misc' END AS class, nullif(regexp_extract(source_file, '((?:19|20)[0-9])0s', 1), '') AS decade FROM source_files) GROUP BY 1, 2""")
def source_classes(spark: SparkSession, d: str) -> DataFrame:
    """Class of source by a part of the path, and the decade it names."""
    parts = F.split(F.replace("source_file", F.lit("\\"), F.lit("/")), "/")
    kind = F.coalesce(*[F.when(F.array_contains(parts, k), v) for k, v in CLASSES.items()], F.lit("misc"))
    decade = F.nullif(F.regexp_extract("source_file", "((?:19|20)[0-9])0s", 1), F.lit(""))
    return table(spark, d, "source_files").groupBy(kind.alias("class"), decade.alias("decade")).agg(F.count("*").alias("files"))
