"""Queries on concept graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.operators import graph as G
from loomline.plans.corpus_plans import _q
from loomline.plans.registry import query
from loomline.session import table

_STOP = ", ".join(map(_q, G.STOP))
_TOK = rf"""q AS (SELECT DISTINCT id, question FROM conversations), w AS (SELECT id, list_filter(regexp_extract_all(lower(coalesce(question, '')), '([a-z][a-z''-]+)', 1), lambda x: length(x) > 2 AND x NOT IN ({_STOP})) AS t FROM q),
l AS (SELECT id, unnest(t) AS term, generate_subscripts(t, 1) AS i FROM w)"""
_PAIRS = f"""{_TOK}, pairs AS (SELECT least(x.term, y.term) AS a, greatest(x.term, y.term) AS b, count(*) AS n FROM l x JOIN l y ON x.id = y.id AND y.i > x.i AND y.i < x.i + 20 AND x.term <> y.term GROUP BY 1, 2)"""
_PPMI = f"""{_PAIRS}, terms AS (SELECT term, count(*) AS c FROM l GROUP BY 1), tot AS (SELECT sum(c) AS tc, count(*) AS v FROM terms), tn AS (SELECT sum(n) AS tn FROM pairs),
edges AS (SELECT a, b, n, round(greatest(0.0, ln(((n + 1.0) / (tn + v)) / (((ta.c + 1.0) / (tc + v)) * ((tb.c + 1.0) / (tc + v))))), 6) AS ppmi FROM pairs JOIN terms ta ON a = ta.term JOIN terms tb ON b = tb.term, tot, tn)"""


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("id", "question").distinct().select("id", G.tokens(F.col("question"), G.STOP).alias("t"))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    t = _tokens(spark, d)
    return G.ppmi(G.pairs_in_window(t, "t"), t.select(F.explode("t").alias("term")).groupBy("term").agg(F.count("*").alias("c")))


@query(f"WITH {_PAIRS} SELECT a, b, n::BIGINT AS n FROM pairs WHERE n >= 3")
def cooccurrence(spark: SparkSession, d: str) -> DataFrame:
    return G.pairs_in_window(_tokens(spark, d), "t").filter("n >= 3")


@query(f"WITH {_PPMI} SELECT a, b, n, ppmi FROM edges WHERE ppmi > 0 AND n >= 3")
def ppmi_edges(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d).filter("n >= 3")


_QTERMS = r"qt AS (SELECT DISTINCT id AS qid, unnest(regexp_extract_all(lower(question), '([a-z][a-z''-]+)', 1)) AS term FROM eval_questions)"


@query(f"""WITH {_PPMI}, {_QTERMS}, both_ AS (SELECT a AS src, b AS dst, ppmi FROM edges WHERE ppmi > 0 AND n >= 3 UNION ALL SELECT b, a, ppmi FROM edges WHERE ppmi > 0 AND n >= 3),
near AS (SELECT qid, dst AS term, max(ppmi) AS score FROM both_ JOIN qt ON src = term GROUP BY 1, 2),
o AS (SELECT * FROM near ANTI JOIN qt USING (qid, term))
SELECT qid, term, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, term) AS rank FROM o) WHERE rank <= 5""")
def expand_terms(spark: SparkSession, d: str) -> DataFrame:
    words = F.regexp_extract_all(F.lower("question"), F.lit(r"([a-z][a-z'-]+)"), F.lit(1))
    q = table(spark, d, "eval_questions").select(F.col("id").alias("qid"), F.explode(words).alias("term")).distinct()
    return G.expand(_edges(spark, d).filter("n >= 3"), q, "ppmi")


_REL = " ".join(f"WHEN v IN ({', '.join(map(_q, vs))}) THEN '{r}'" for r, vs in G.RELATIONS.items())
_P = _q(G.verb_pattern())
_TRI = f"""s AS (SELECT id, lower(coalesce(ray_peat_response, '')) AS t FROM search_results), z AS (SELECT id, unnest(list_zip(regexp_extract_all(t, {_P}, 1), regexp_extract_all(t, {_P}, 2), regexp_extract_all(t, {_P}, 3))) AS z FROM s),
u AS (SELECT id, z[1] AS s, z[2] AS v, z[3] AS o FROM z), tri AS (SELECT id, trim(regexp_replace(s, '^(the|a|an) ', '')) AS subject, CASE {_REL} END AS relation, trim(regexp_replace(o, '^(the|a|an) ', '')) AS object FROM u)"""
_EDGE = f"{_TRI}, edge AS (SELECT subject AS a, object AS b, count(*) AS n, count(DISTINCT id) AS support FROM tri WHERE subject <> object GROUP BY 1, 2)"


def _triples(spark: SparkSession, d: str) -> DataFrame:
    return G.triples(table(spark, d, "search_results"), "id", "ray_peat_response")


def _triple_edges(spark: SparkSession, d: str) -> DataFrame:
    return _triples(spark, d).filter("subject <> object").groupBy(F.col("subject").alias("a"), F.col("object").alias("b")).agg(F.count("*").alias("n"), F.countDistinct("id").alias("support"))


@query(f"""WITH {_TRI}, r AS (SELECT *, CASE WHEN subject = object THEN 'rejected' END AS bad, row_number() OVER (PARTITION BY id, subject, relation, object ORDER BY id) AS k FROM tri)
SELECT relation, coalesce(bad, CASE WHEN k > 1 THEN 'repeated' ELSE 'inserted' END) AS status, count(*) AS triples FROM r GROUP BY 1, 2""")
def triples_ingest(spark: SparkSession, d: str) -> DataFrame:
    g = _triples(spark, d).groupBy("id", "subject", "relation", "object").agg(F.count("*").alias("c"))
    status = F.when(F.col("subject") == F.col("object"), F.array(F.struct(F.lit("rejected").alias("s"), F.col("c").alias("c")))).otherwise(
        F.array(F.struct(F.lit("inserted").alias("s"), F.lit(1).cast("bigint").alias("c")), F.struct(F.lit("repeated").alias("s"), (F.col("c") - 1).alias("c")))
    )
    return g.select("relation", F.explode(status).alias("x")).filter("x.c > 0").groupBy("relation", F.col("x.s").alias("status")).agg(F.sum("x.c").alias("triples"))


@query(f"WITH {_EDGE} SELECT a, b, n, support, 1 + support AS width FROM edge WHERE support >= 3")
def edge_support(spark: SparkSession, d: str) -> DataFrame:
    return _triple_edges(spark, d).filter("support >= 3").withColumn("width", 1 + F.col("support"))


@query(f"WITH {_EDGE}, n AS (SELECT a AS node FROM edge UNION ALL SELECT b FROM edge) SELECT node, count(*) AS degree FROM n GROUP BY node ORDER BY degree DESC, node LIMIT 25")
def degree_top(spark: SparkSession, d: str) -> DataFrame:
    e = _triple_edges(spark, d)
    return e.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "node").limit(25)


@query(f"WITH {_EDGE}, n AS (SELECT a AS node FROM edge UNION SELECT b FROM edge) SELECT (SELECT count(*) FROM n) AS nodes, count(*) AS edges, round(count(*) / ((SELECT count(*) FROM n) * ((SELECT count(*) FROM n) - 1.0)), 6) AS density, round(2.0 * count(*) / (SELECT count(*) FROM n), 6) AS mean_degree FROM edge")
def graph_stats(spark: SparkSession, d: str) -> DataFrame:
    e = _triple_edges(spark, d)
    nodes = e.select(F.explode(F.array("a", "b")).alias("node")).agg(F.countDistinct("node").alias("nodes"))
    n = F.col("nodes")
    return e.agg(F.count("*").alias("edges")).join(nodes).select("nodes", "edges", F.round(F.col("edges") / (n * (n - 1.0)), 6).alias("density"), F.round(2.0 * F.col("edges") / n, 6).alias("mean_degree"))


@query(f"""WITH {_EDGE}, k AS (SELECT * FROM edge WHERE support >= 2), two AS (SELECT x.a AS node, y.b AS other, max(round(x.support * y.support * 0.7, 4)) AS strength FROM k x JOIN k y ON x.b = y.a WHERE x.a <> y.b GROUP BY 1, 2),
o AS (SELECT * FROM two ANTI JOIN (SELECT a AS node, b AS other FROM k) USING (node, other))
SELECT node, other, strength::DOUBLE AS strength FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY strength DESC, other) AS r FROM o) WHERE r <= 3""")
def two_hop(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    k = _triple_edges(spark, d).filter("support >= 2")
    x, y = k.select(F.col("a").alias("node"), F.col("b").alias("mid"), F.col("support").alias("s1")), k.select(F.col("a").alias("mid"), F.col("b").alias("other"), F.col("support").alias("s2"))
    two = x.join(y, "mid").filter("node <> other").groupBy("node", "other").agg(F.max(F.round(F.col("s1") * F.col("s2") * F.lit(0.7), 4)).alias("strength"))
    o = two.join(k.select(F.col("a").alias("node"), F.col("b").alias("other")), ["node", "other"], "left_anti")
    return o.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("strength"), "other"))).filter("r <= 3").select("node", "other", "strength")


_NAMES = "|".join(sorted((c for cs in G.CONCEPTS.values() for c in cs), key=lambda c: (-len(c), c)))
_KIND = "CASE " + " ".join(f"WHEN concept IN ({', '.join(map(_q, cs))}) THEN {_q(k)}" for k, cs in G.CONCEPTS.items()) + " END"
_CONCEPTS = rf"""c AS (SELECT concept, {_KIND} AS kind, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(coalesce(text, '')), '\b({_NAMES})\b', 1)) AS concept FROM documents) GROUP BY 1, 2 HAVING count(*) >= 3)"""
_VERBS = "|".join(v for vs in G.RELATIONS.values() for v in vs)
_RELATION = "CASE " + " ".join(f"WHEN v IN ({', '.join(map(_q, vs))}) THEN {_q(r)}" for r, vs in G.RELATIONS.items()) + " END"


@query(f"WITH {_CONCEPTS} SELECT * FROM c")
def concept_counts(spark: SparkSession, d: str) -> DataFrame:
    return G.concepts(table(spark, d, "documents"), "text")


@query(rf"""WITH {_CONCEPTS}, m AS (SELECT unnest(regexp_extract_all(lower(coalesce(text, '')), '([a-z]+ [a-z]+) ({_VERBS}) ([a-z]+ [a-z]+)', 0)) AS m FROM documents),
t AS (SELECT trim(regexp_replace(regexp_extract(m, '^(.*?) ({_VERBS}) (.*)$', 1), '^(the|a|an) ', '')) AS subject, regexp_extract(m, '^([a-z]+ [a-z]+) ({_VERBS}) ', 2) AS v, trim(regexp_replace(regexp_extract(m, '^[a-z]+ [a-z]+ ({_VERBS}) (.*)$', 2), '^(the|a|an) ', '')) AS object FROM m)
SELECT subject, {_RELATION} AS relation, object, x.kind AS subject_kind, y.kind AS object_kind, count(*) AS n FROM t JOIN c x ON x.concept = subject JOIN c y ON y.concept = object GROUP BY ALL""")
def concept_pairs(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    known = G.between_known(G.triples(docs, "doc_id", "text"), G.concepts(docs, "text"))
    return known.groupBy("subject", "relation", "object", "subject_kind", "object_kind").agg(F.count("*").alias("n"))
