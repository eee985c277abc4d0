"""Readers: explicit schemas, tolerant of broken rows."""

from __future__ import annotations

import html.parser
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.functions.text import word_count


def corpus_files(spark: SparkSession, root: str, glob: str = "*.txt", least_words: int = 0) -> DataFrame:
    """(path, text) of the files below a folder, path relative to it; files under ``least_words`` words are left out."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(root)
    out = files.select(_relative(F.input_file_name(), root).alias("path"), F.col("value").alias("text"))
    return out.filter(word_count(F.col("text")) >= least_words)


def file_inventory(spark: SparkSession, root: str) -> DataFrame:
    """(path, category, extension, bytes, modified) from file metadata only; hidden files are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", "modificationTime")
    rel = _relative(F.col("path"), root)
    parts = F.split(rel, "/")
    return files.select(
        rel.alias("path"), F.when(F.size(parts) > 1, parts[0]).otherwise(F.lit("root")).alias("category"), F.lower(F.regexp_extract(rel, r"(\.[^./]+)$", 1)).alias("extension"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified")
    )


def _relative(path: Column, root: str) -> Column:
    clean = F.url_decode(F.regexp_replace(path, r"^[a-z]+:/*", "/"))
    return F.replace(clean, F.lit(root.rstrip("/") + "/"), F.lit(""))


def jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines; blank and malformed lines are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def json_list(spark: SparkSession, path: str, field: str, schema: T.StructType | str) -> DataFrame:
    """A JSON document with a list under ``field``: one row per element."""
    element = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    whole = T.StructType([T.StructField(field, T.ArrayType(element))])
    return spark.read.schema(whole).option("multiLine", True).json(path).select(F.explode(field).alias("r")).select("r.*")


def csv_typed(spark: SparkSession, path: str, types: dict[str, str], defaults: dict[str, object] | None = None) -> DataFrame:
    """CSV with a header, each field cast with ``try_cast``; what can't be cast becomes its default or null."""
    text = T.StructType([T.StructField(c, T.StringType()) for c in types])
    raw = spark.read.schema(text).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    cols = []
    for c, t in types.items():
        v = F.expr(f"try_cast(`{c}` AS {t})")
        cols.append((F.coalesce(v, F.lit(defaults[c]).cast(t)) if defaults and c in defaults else v).alias(c))
    return raw.select(*cols)


def parquet_or_empty(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A table if it is there, else an empty one of the schema."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def checked_vectors(df: DataFrame, vec_col: str, dim: int) -> DataFrame:
    """The rows, failing on a vector of another size when they are read; null vectors pass."""
    ok = F.assert_true((F.size(vec_col) == dim) | F.col(vec_col).isNull(), F.lit(f"a vector is not of size {dim}"))
    return df.filter(ok.isNull())


def links_long(df: DataFrame, id_col: str, link_cols: list[str]) -> DataFrame:
    """Several link columns to rows (id, slot, url); blanks are dropped."""
    return df.unpivot([id_col], link_cols, "slot", "url").filter(F.trim(F.coalesce("url", F.lit(""))) != "")


class _Text(html.parser.HTMLParser):
    DROP = {"script", "style", "nav", "footer", "head", "header", "aside", "noscript", "form"}
    BLOCK = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "article", "main", "section", "div", "br", "tr"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.depth, self.out, self.title, self.in_title = 0, [], "", False

    def handle_starttag(self, tag, attrs):
        self.in_title = tag == "title"
        if tag in self.DROP:
            self.depth += 1
        elif tag in self.BLOCK:
            self.out.append("\n")

    def handle_endtag(self, tag):
        self.in_title = False
        if tag in self.DROP and self.depth:
            self.depth -= 1
        elif tag in self.BLOCK:
            self.out.append("\n")

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        elif not self.depth:
            self.out.append(data)


def page_text(markup: str | None) -> tuple[str, str]:
    """(title, text) of a page: blocks on lines of their own, chrome dropped. Broken markup never fails."""
    p = _Text()
    try:
        p.feed(markup or "")
        p.close()
    except AssertionError:
        pass
    lines = (" ".join(x.split()) for x in "".join(p.out).split("\n"))
    return " ".join(p.title.split()), "\n".join(x for x in lines if x)


def html_pages(df: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, title, text) of pages, parsed batch by batch."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            got = [page_text(x if isinstance(x, str) else "") for x in pdf["html"]]
            yield pd.DataFrame({"id": pdf["id"], "title": [t for t, _ in got], "text": [x for _, x in got]})

    return df.select(F.col(id_col).cast("string").alias("id"), F.col(html_col).alias("html")).mapInPandas(run, "id string, title string, text string")
