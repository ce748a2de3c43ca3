"""Inputs: Parquet tables, JSON evaluation cases and terminology, page bytes with a caller's parser."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CASES = "id string, category string, question string, expected_source_document string, expected_page_section string, expected_chunk_id string, expected_keywords array<string>, relevance_reason string"
TERMS = "terms array<struct<term_en: string, term_ar: string, synonyms_en: array<string>, synonyms_ar: array<string>>>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def evaluation_cases(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CASES).json(path, multiLine=True)


def terminology(spark: SparkSession, paths: list[str], whole_files: bool = True) -> DataFrame:
    """(term_ar, term_en) in lower case; Arabic entries and synonyms are split at slashes; of a repeated term the last file's counts.

    A file is one JSON object, or one a line where whole_files is false.
    """
    found = None
    arabic = F.concat(F.array("t.term_ar"), F.coalesce("t.synonyms_ar", F.array().cast("array<string>")))
    for number, path in enumerate(paths):
        rows = spark.read.schema(TERMS).json(path, multiLine=whole_files).select(F.posexplode("terms").alias("pos", "t"))
        rows = rows.select(F.lit(number).alias("file"), "pos", F.lower(F.trim("t.term_en")).alias("term_en"), F.explode(F.flatten(F.transform(arabic, lambda a: F.split(a, "/")))).alias("term_ar"))
        found = rows if found is None else found.unionByName(rows)
    latest = Window.partitionBy("term_ar").orderBy(F.desc("file"), F.desc("pos"))
    rows = found.withColumn("term_ar", F.lower(F.trim("term_ar"))).withColumn("nth", F.row_number().over(latest))
    return rows.where("nth = 1 AND term_ar <> '' AND term_en <> ''").select("term_ar", "term_en")


def pages(spark: SparkSession, path: str, parse: Callable[[bytes], list[str]]) -> DataFrame:
    """(document, page, text) of binary files that aren't rejected; parse gives the texts of a file's pages, numbered from 1."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for document, content in batch.itertuples(index=False, name=None):
                texts = parse(content)
                yield pd.DataFrame({"document": document, "page": range(1, len(texts) + 1), "text": texts})

    files = scanned(spark, path).where("rejected IS NULL").select("document", "content")
    return files.mapInPandas(work, "document string, page int, text string")


def _empty_files(spark: SparkSession, path: str) -> list[str]:
    """Names of the files without a byte; the listing is the file system's own."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(conf)
    found = [s for top in system.globStatus(target) or [] for s in (system.listStatus(top.getPath()) if top.isDirectory() else [top])]
    return [s.getPath().getName() for s in found if s.isFile() and s.getLen() == 0 and not s.getPath().getName().startswith(("_", "."))]


def scanned(spark: SparkSession, path: str) -> DataFrame:
    """document, content and rejected of all files under path: why a file can't be parsed ('empty', 'encrypted'), or null.

    Listing and reading are Spark's, a task a few files; the bytes of rejected files aren't passed on.
    """
    files = spark.read.format("binaryFile").load(path)
    holds = lambda word: F.contains("content", F.to_binary(F.lit(word), F.lit("utf-8")))
    reason = F.when(F.col("length") == 0, "empty").when(F.startswith("content", F.to_binary(F.lit("%PDF"), F.lit("utf-8"))) & holds("/Encrypt"), "encrypted")
    rows = files.select(F.element_at(F.split("path", "/"), -1).alias("document"), "content", reason.alias("rejected"))
    rows = rows.withColumn("content", F.when(F.col("rejected").isNull(), F.col("content")))
    empty = [(name, None, "empty") for name in _empty_files(spark, path)]  # Spark's file sources leave them out
    return rows.unionByName(spark.createDataFrame(empty, "document string, content binary, rejected string"))


#: Characters that pages write as names, the ampersand last.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
_UNSEEN = r"(?is)<!--.*?-->|<(?:script|style)\b.*?</(?:script|style)\s*>"
_BREAKS = r"(?i)<(?:br|/p|/h[1-6]|/li|/div|/tr|/title|/td)\b[^>]*>"


def page_text(html: Column) -> Column:
    """What a web page shows, a line for each block: without comments, scripts, styles and tags; null is empty."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), _UNSEEN, "")
    text = F.regexp_replace(F.regexp_replace(text, _BREAKS, "\n"), r"<[^>]*>", "")
    for name, sign in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(sign))
    return F.regexp_replace(text, r"[ \t]*\n[ \t\n]*", "\n")


def web_pages(pages: DataFrame) -> DataFrame:
    """document (the host), page and text of pages(page_id, url, html), so that what recurs on a host's pages is found."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z]+://([^/?#]+)", 1))
    return pages.select(host.alias("document"), F.col("page_id").alias("page"), page_text(F.col("html")).alias("text"))
