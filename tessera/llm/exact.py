"""Exact dedup by content-defined chunk recipes, DataFrame functions only.

A text is cut where its own characters say so; equal chunks get one verified identifier, and two
texts are equal when their ordered lists of identifiers are. Chunk bytes move once, to be
compared with chunks of the same hash; after that only lists of integers move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import SPACE, documents, forget, materialise, salt, text_or_empty

#: A chunk has 512 characters at least and 4096 at most, and ends with a character that stands two places before too. So the text
#: itself decides where it is cut, whatever its script.
CHUNK = r"(?s).{509,4093}?(.).\1|.{1,4096}"


def normalised(column: str = "text") -> Column:
    return F.regexp_replace(text_or_empty(column), SPACE, " ")


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_no: str | None = None) -> DataFrame:
    """One row per document: doc_id, row_no, text_sha256 and recipe, the ordered verified chunk identifiers.

    Rows are numbered once, in what is written; row_no names a column of docs that numbers them already.

    An identifier is the chunk's XXH64, and behind it the number of the chunk among different chunks
    of the same hash (0 but for a collision). All chunks of a hash are compared byte by byte.
    """
    number = F.monotonically_increasing_id() if row_no is None else F.col(row_no)
    rows = docs.select(F.col(id_col).alias("doc_id"), number.alias("row_no"), normalised(text_col).alias("norm"))
    rows = rows.withColumn("chunks", F.regexp_extract_all("norm", F.lit(CHUNK), F.lit(0)))
    recipe = F.transform("chunks", lambda c: F.xxhash64(c)).alias("recipe")
    listed = materialise(rows.select("doc_id", "row_no", F.sha2("norm", 256).alias("text_sha256"), recipe), "recipes")
    chunks = rows.select(F.explode("chunks").alias("chunk")).groupBy(F.xxhash64("chunk").alias("hash"), "chunk").agg(F.lit(1).alias("one"))
    alike = Window.partitionBy("hash").orderBy("chunk")
    clashing = chunks.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1")
    clashing = materialise(clashing.select("hash"), "clashes")
    if clashing.isEmpty():
        return listed
    # Two different chunks with one hash: their identifiers get a number, by joining on the bytes.
    if row_no is None:  # both sides of what follows have to see one numbering
        forget(listed)
        rows = materialise(rows, "numbered")
        listed = rows.select("doc_id", "row_no", F.sha2("norm", 256).alias("text_sha256"), recipe)
        chunks = rows.select(F.explode("chunks").alias("chunk")).groupBy(F.xxhash64("chunk").alias("hash"), "chunk").agg(F.lit(1).alias("one"))
    numbered = chunks.join(clashing, "hash", "left_semi").select("hash", "chunk", F.row_number().over(alike).alias("nth"))
    parts = rows.select("row_no", F.posexplode("chunks").alias("pos", "chunk")).withColumn("hash", F.xxhash64("chunk"))
    fixed = (
        parts.join(numbered, ["hash", "chunk"])
        .groupBy("row_no")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "nth"))).alias("fix"))
    )
    mark = F.coalesce(F.flatten(F.transform("fix", lambda f: F.array(f["pos"].cast("long"), f["nth"].cast("long")))), F.array().cast("array<long>"))
    return listed.join(fixed, "row_no", "left").select("doc_id", "row_no", "text_sha256", F.concat("recipe", mark).alias("recipe"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 for every row.

    Null counts as empty text, and empty texts equal each other. Of rows that repeat the smallest
    doc_id itself one stays. Null ids sort behind all others. Empty table: empty result. Other
    columns are ignored. A group of any size is counted by partial sums, not gathered.
    """
    listed = recipes(docs, id_col, text_col).withColumn("salt", salt("row_no"))
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_no")
    parts = listed.groupBy("recipe", "salt").agg(F.min(first).alias("first"), F.count("*").alias("n"))
    groups = parts.groupBy("recipe").agg(F.min("first").alias("first"), F.sum("n").alias("group_size"), F.collect_list("salt").alias("salts"))
    groups = groups.select("recipe", "first", "group_size", F.explode("salts").alias("salt"))  # a large group's rows are dealt out by salt
    return listed.join(groups, ["recipe", "salt"]).select(
        "doc_id", F.col("first.doc_id").alias("keep_id"), F.col("group_size").cast("long"),
        (F.col("row_no") == F.col("first.row_no")).alias("kept"), "text_sha256",
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of docs that exact_dedup keeps, with all their columns.

    Rows are numbered and written before anything reads the numbers, so it doesn't matter how docs is made. Nulls,
    repeated rows and empty tables are as in exact_dedup.
    """
    number = "row_no"
    while number in docs.columns:
        number += "_"
    marked = materialise(docs.withColumn(number, F.monotonically_increasing_id()), "marked")
    listed = recipes(marked, row_no=number)
    kept = listed.groupBy("recipe").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_no")).alias("first")
    ).select(F.col("first.row_no").alias(number))
    return marked.join(kept, number, "left_semi").drop(number)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


ORACLE_SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS n FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = min(doc_id) OVER w AS kept, sha256(n) AS text_sha256
FROM t WINDOW w AS (PARTITION BY n)
"""

QUERIES = {"op9_exact_dedup": op9_exact_dedup}
ORACLES = {"op9_exact_dedup": ORACLE_SQL}
