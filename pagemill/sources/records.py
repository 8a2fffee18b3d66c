"""Reading and writing of page records, questions, logs and caches, with checks that fail loudly."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.functions.text import squeeze, text_layer, visible

PAGE = "doc_id string, page int, text string, non_whitespace_chars int, extraction_status string"
QUESTION = "id string, split string, question string, answer struct<answer_text:string,is_answerable:boolean>, pdf struct<doc_id_str:string>, evidences array<struct<local_id:string,page:int,bbox:array<double>,element_type:string>>, facts array<struct<local_id:string,evidence_local_id:string,text_description:string>>, extract_class int"


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Page records from JSON lines; a malformed or blank line is an error when it is read."""
    raw = spark.read.text(path)
    parsed = F.from_json("value", PAGE, {"mode": "FAILFAST"})
    checked = F.when(F.trim("value") == "", F.raise_error(F.lit("blank line in page records"))).otherwise(parsed)
    return raw.select(checked.alias("r")).select("r.*")


def write_pages(pages: DataFrame, path: str, overwrite: bool = False) -> None:
    """JSON lines with keys in order; refuses to replace what is there unless told to."""
    pages.select(*sorted(pages.columns)).write.mode("overwrite" if overwrite else "errorifexists").json(path)


def read_questions(spark: SparkSession, path: str, split: str, open_splits: tuple[str, ...]) -> DataFrame:
    """Questions of one split; a split that is not open is refused before anything is read."""
    if split not in open_splits:
        raise PermissionError(f"split {split} is locked")
    return spark.read.schema(QUESTION).option("multiLine", True).option("mode", "FAILFAST").json(path).filter(F.col("split") == split)


def scan_files(spark: SparkSession, path: str, extract: Callable[[bytes], list[str]], suffix: str = "*") -> DataFrame:
    """Pages of binary files through a reader ``bytes -> page texts``; the file name without ending is the id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(name, k + 1, text) for name, content in zip(b["name"], b["content"]) for k, text in enumerate(extract(bytes(content)))]
            yield pd.DataFrame(rows, columns=["doc_id", "page", "raw"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", suffix).load(path)
    name = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    pages = files.select(name.alias("name"), "content").mapInPandas(run, "doc_id string, page int, raw string")
    return build_records(pages)


def build_records(pages: DataFrame) -> DataFrame:
    """Page records of raw pages ``(doc_id, page, raw)``; counts are taken on the raw text."""
    raw = F.coalesce("raw", F.lit(""))
    n = visible(raw)
    return pages.select("doc_id", "page", squeeze(raw).alias("text"), n.cast("int").alias("non_whitespace_chars"), text_layer(n).alias("extraction_status"))


def read_page_files(spark: SparkSession, path: str) -> DataFrame:
    """``page, text`` of a folder with one text file a page, named with ``page-<n>``; pages missing or there twice are an error."""
    files = spark.read.text(path, wholetext=True).withColumn("file", F.col("_metadata.file_name"))
    pages = files.select(F.regexp_extract("file", r"page-(\d+)", 1).cast("int").alias("page"), F.col("value").alias("text"))
    odd = integrity(pages.select(F.lit("").alias("doc_id"), "page")).head()
    if odd:
        raise ValueError(f"page files of {path}: {'some pages are there twice' if odd['repeated'] else 'some pages are missing'}")
    return pages


def read_word_table(spark: SparkSession, path: str) -> DataFrame:
    """Recognised words from tab-separated files: blank words and confidences below 0 are left out."""
    rows = spark.read.schema("conf double, text string").option("mode", "FAILFAST").csv(path, sep="\t", header=True)
    return rows.filter(F.trim("text") != "").filter("conf >= 0")


def word_quality(words: DataFrame, *by: str) -> DataFrame:
    """Words, mean confidence, mass and share of sure words."""
    return words.groupBy(*by).agg(F.count("*").alias("words"), F.avg("conf").alias("mean_conf"), F.sum("conf").alias("mass"), F.try_divide(F.count_if(F.col("conf") >= 80), F.count("*")).alias("sure"))


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Cached vectors; a vector with a value that is not finite is an error when it is read."""
    df = spark.read.parquet(path)
    ok = F.forall("embedding", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.withColumn("embedding", F.when(ok, F.col("embedding")).otherwise(F.raise_error(F.lit("vector is not finite"))))


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """``digest, file`` of a checksum list with two spaces between."""
    p = F.split("value", "  ", 2)
    return spark.read.text(path).filter(F.trim("value") != "").select(p[0].alias("digest"), p[1].alias("file"))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """``file, digest`` of the files of a folder."""
    return spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.sha2("content", 256).alias("digest"))


def integrity(pages: DataFrame) -> DataFrame:
    """Violations of each document: pages that are missing, repeated or out of order."""
    g = pages.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_distinct("page").alias("d"), F.min("page").alias("lo"), F.max("page").alias("hi"))
    return g.select("doc_id", (F.col("n") != F.col("d")).alias("repeated"), ((F.col("lo") != 1) | (F.col("hi") != F.col("d"))).alias("gaps")).filter("repeated or gaps")


def expected(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows if their keys are just those wanted, each once; raises with the number of missing, other and repeated keys."""
    both = rows.groupBy(key).agg(F.count("*").alias("n")).join(wanted.select(key).distinct().withColumn("w", F.lit(1)), key, "full_outer")
    found = both.agg(F.count_if(F.col("n").isNull()).alias("missing"), F.count_if(F.col("w").isNull()).alias("other"), F.count_if(F.col("n") > 1).alias("repeated")).head().asDict()
    if any(found.values()):
        raise ValueError(f"keys that are not as expected: {found}")
    return rows


def missing_parts(wanted: DataFrame, done: DataFrame, key: str, digest: str) -> DataFrame:
    """``key, digest, todo``: parts to build, ``new`` where nothing is there and ``changed`` where its digest is another."""
    had = done.select(key, F.col(digest).alias("had"), F.lit(True).alias("there"))
    todo = F.when(F.col("there").isNull(), "new").when(~F.col("had").eqNullSafe(F.col(digest)), "changed")
    return wanted.select(key, digest).join(had, key, "left").select(key, digest, todo.alias("todo")).filter("todo is not null")


def answered_by(local: DataFrame, outside: DataFrame, keys: list[str], value: str, digest: str) -> DataFrame:
    """Local values with outside ones where there is none; an outside value for another input (by digest) is an error."""
    other = outside.select(*keys, F.col(value).alias("outer"), F.col(digest).alias("of"))
    both = local.join(other, keys, "left")
    stale = F.col(value).isNull() & F.col("outer").isNotNull() & ~F.col("of").eqNullSafe(F.col(digest))
    chosen = F.when(stale, F.raise_error(F.lit("an outside value is of another input"))).otherwise(F.coalesce(value, "outer"))
    return both.withColumn(value, chosen).drop("outer", "of")


def canonical_json(value: object) -> bytes:
    """JSON with sorted keys, two spaces and a newline at the end."""
    return (json.dumps(value, sort_keys=True, indent=2, ensure_ascii=False) + "\n").encode()


def forbidden_fields(schema: T.DataType, names: frozenset[str], at: str = "") -> list[str]:
    """Paths of fields, nested ones included, whose name is not allowed; looked up in the plan, no data is read."""
    if isinstance(schema, T.ArrayType):
        return forbidden_fields(schema.elementType, names, at + "[]")
    if isinstance(schema, T.MapType):
        return forbidden_fields(schema.valueType, names, at + "{}")
    if not isinstance(schema, T.StructType):
        return []
    out = []
    for f in schema.fields:
        path = f"{at}.{f.name}" if at else f.name
        out += ([path] if f.name in names else []) + forbidden_fields(f.dataType, names, path)
    return out


def insert_new(rows: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Rows whose key the store does not hold, to be appended."""
    return rows.dropDuplicates([key]).join(stored.select(key), key, "left_anti")


def overlay(old: DataFrame, new: DataFrame, wanted: DataFrame) -> DataFrame:
    """Pages with the recovered ones in place of the old; fails when other pages than the wanted ones came."""
    key = ["doc_id", "page"]
    odd = new.select(*key).exceptAll(wanted.select(*key)).unionByName(wanted.select(*key).exceptAll(new.select(*key)))
    if not odd.isEmpty():
        raise ValueError("recovered pages are not the wanted ones")
    n = new.select(*key, F.col("text").alias("fresh"))
    return old.join(n, key, "left").withColumn("text", F.coalesce("fresh", "text")).drop("fresh")
