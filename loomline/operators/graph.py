"""Concept graphs: co-occurrence, PPMI, triples, neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Verbs that state a relation in the test corpus, by the relation they stand for; a parameter of the operators.
RELATIONS = {
    "increases": ["raises", "amplifies", "feeds", "drives", "sharpens"],
    "decreases": ["lowers", "limits", "masks", "delays", "shortens"],
    "supports": ["supports", "prepares", "spares", "balances", "stabilises"],
    "changes": ["shifts", "steers", "replaces", "reflects", "predicts"],
}
STOP = ["the", "and", "that", "for", "with", "when", "what", "are", "how", "does", "really", "have", "been", "now", "using", "weeks", "but", "read", "says", "who", "right", "true", "about", "can", "take", "grams", "expected", "sister"]


def tokens(text: Column, stop: list[str]) -> Column:
    """Lower case words of letters, hyphens and apostrophes, longer than two, not in the stop list."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([a-z][a-z'-]+)"), F.lit(1))
    return F.filter(found, lambda w: (F.length(w) > 2) & ~w.isin(*stop))


def pairs_in_window(df: DataFrame, tokens_col: str, window: int = 20) -> DataFrame:
    """(a, b, n): unordered pairs of different words less than ``window`` apart. Pairs are made inside the row from slices
    and counted with map-side combine; no join."""
    t = F.col(tokens_col)

    def after(w: Column, i: Column) -> Column:
        return F.transform(F.slice(t, i + 2, window - 1), lambda v: F.struct(F.least(w, v).alias("a"), F.greatest(w, v).alias("b")))

    made = df.select(F.explode(F.flatten(F.transform(t, after))).alias("p"))
    return made.filter("p.a <> p.b").groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.count("*").alias("n"))


def ppmi(pairs: DataFrame, terms: DataFrame, add: float = 1.0) -> DataFrame:
    """(a, b, n, ppmi): positive pointwise mutual information with add-k smoothing; zero edges are dropped."""
    total = terms.agg(F.sum("c").alias("tc"), F.count("*").alias("v"))
    both = pairs.agg(F.sum("n").alias("tn"))
    joined = pairs.join(terms.select(F.col("term").alias("a"), F.col("c").alias("ca")), "a").join(terms.select(F.col("term").alias("b"), F.col("c").alias("cb")), "b").join(F.broadcast(total)).join(F.broadcast(both))
    p_ab = (F.col("n") + add) / (F.col("tn") + add * F.col("v"))
    p_a, p_b = ((F.col(c) + add) / (F.col("tc") + add * F.col("v")) for c in ("ca", "cb"))
    return joined.select("a", "b", "n", F.round(F.greatest(F.lit(0.0), F.log(p_ab / (p_a * p_b))), 6).alias("ppmi")).filter("ppmi > 0")


def both_ways(edges: DataFrame, weight: str) -> DataFrame:
    return edges.select(F.col("a").alias("src"), F.col("b").alias("dst"), weight).unionByName(edges.select(F.col("b").alias("src"), F.col("a").alias("dst"), weight))


def expand(edges: DataFrame, queries: DataFrame, weight: str, k: int = 5) -> DataFrame:
    """(qid, term, score, rank): the k terms nearest to the query's terms, by the greatest weight; own terms excluded."""
    from pyspark.sql import Window

    near = both_ways(edges, weight).join(queries.select("qid", F.col("term").alias("src")), "src").groupBy("qid", F.col("dst").alias("term")).agg(F.max(weight).alias("score"))
    other = near.join(queries.select("qid", "term"), ["qid", "term"], "left_anti")
    return other.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "term"))).filter(F.col("rank") <= k)


def verb_pattern(relations: dict[str, list[str]] = RELATIONS) -> str:
    verbs = "|".join(v for vs in relations.values() for v in vs)
    return rf"([a-z]+ [a-z]+) ({verbs}) ([a-z]+ [a-z]+)"


def triples(df: DataFrame, id_col: str, text_col: str, relations: dict[str, list[str]] = RELATIONS) -> DataFrame:
    """(id, subject, relation, object) of each stated relation; articles dropped, verbs brought to their relation."""
    pattern = verb_pattern(relations)
    stated = F.regexp_extract_all(F.lower(F.coalesce(text_col, F.lit(""))), F.lit(f"({pattern})"), F.lit(1))  # one scan of the text
    parts = F.transform(stated, lambda m: F.struct(F.regexp_extract(m, pattern, 1).alias("s"), F.regexp_extract(m, pattern, 2).alias("v"), F.regexp_extract(m, pattern, 3).alias("o")))
    long = df.select(F.col(id_col).alias("id"), F.explode(parts).alias("t"))
    name = lambda c: F.trim(F.regexp_replace(c, "^(the|a|an) ", ""))
    relation = F.when(F.lit(False), F.lit(""))
    for r, verbs in relations.items():
        relation = relation.when(F.col("t.v").isin(*verbs), F.lit(r))
    return long.select("id", name(F.col("t.s")).alias("subject"), relation.alias("relation"), name(F.col("t.o")).alias("object"))


# Concepts of the test corpus by kind; a parameter of the operators.
CONCEPTS = {
    "hormone": ["progesterone", "estrogen", "cortisol", "adrenalin", "thyroid extract"],
    "process": ["lipid peroxidation", "wound healing", "stress reaction", "sluggish digestion", "slow breathing"],
    "condition": ["dry skin", "nightly waking", "emotional strain", "bowel irritation", "estrogen excess"],
    "remedy": ["orange juice", "coconut oil", "red light", "gelatin broth", "raw carrot"],
}


def concepts(df: DataFrame, text_col: str, kinds: dict[str, list[str]] | None = None, least: int = 3) -> DataFrame:
    """(concept, kind, n): how often each known concept stands at word limits in the texts, where at least ``least`` times. Where one name
    holds another the longer one counts; counts are added up before the shuffle. Null texts hold none."""
    kinds = kinds or CONCEPTS
    kind_of = {c.lower(): k for k, names in kinds.items() for c in names}
    pattern = r"\b(" + "|".join(sorted(kind_of, key=lambda c: (-len(c), c))) + r")\b"
    found = df.select(F.explode(F.regexp_extract_all(F.lower(F.coalesce(text_col, F.lit(""))), F.lit(pattern), F.lit(1))).alias("concept"))
    kind = F.create_map(*[F.lit(x) for pair in kind_of.items() for x in pair])
    return found.groupBy("concept").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("concept", kind[F.col("concept")].alias("kind"), "n")


def between_known(stated: DataFrame, known: DataFrame) -> DataFrame:
    """Triples (subject, relation, object) whose both ends are known concepts, with the kinds of both; the list of concepts is a bounded parameter."""
    ends = F.broadcast(known.select("concept", "kind"))
    one = stated.join(ends.select(F.col("concept").alias("subject"), F.col("kind").alias("subject_kind")), "subject")
    return one.join(ends.select(F.col("concept").alias("object"), F.col("kind").alias("object_kind")), "object")


def neighbours(edges: DataFrame, k: int = 5, decay: float = 0.7) -> DataFrame:
    """(node, other, relation, strength, rank): the k strongest neighbours of each node at one or two steps. ``edges`` has (a, relation, b, support), one row for each.

    Two steps have the product of the supports times ``decay`` and a relation that begins with ``indirect_``. Of the edges that leave a middle node only the
    strongest can be among the k of any node, so a hub's edges are not multiplied with each other: k of them, and one for each relation back to the node itself.
    """
    from pyspark.sql import Window

    relations = len(RELATIONS)
    w = Window.partitionBy("a").orderBy(F.desc("support"), "b", "relation")
    onward = edges.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k + relations).select(F.col("a").alias("mid"), F.col("b").alias("other"), F.col("relation").alias("rel"), F.col("support").alias("s2"))
    first = edges.groupBy(F.col("a").alias("node"), F.col("b").alias("mid")).agg(F.max("support").alias("s1"))
    two = first.join(onward, "mid").filter("node <> other").groupBy("node", "other", F.concat(F.lit("indirect_"), "rel").alias("relation")).agg(F.max(F.round(F.col("s1") * F.col("s2") * F.lit(decay), 4)).alias("strength"))
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other"), "relation", F.col("support").cast("double").alias("strength")).unionByName(two)
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("strength"), "other", "relation"))).filter(F.col("rank") <= k)
