"""From page texts to the chunks of a corpus: cleaning, chunks, exact dedup within a document, rules, fingerprint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import rulesets as R
from tessera.functions import text as T
from tessera.operators import chunking, cleaning


def build(pages: DataFrame, document: str = "document", ratio: float = 0.04, size: int = R.CHUNK_SIZE, overlap: int = R.CHUNK_OVERLAP) -> DataFrame:
    """The chunks of all documents of pages, without what cleaning takes out; of equal texts in one document the first chunk stays.

    Equal means alike in lower case with white space collapsed. Ids are those given before copies go.
    """
    lined = cleaning.page_lines(pages, document)
    kept = cleaning.classified(lined, cleaning.recurring_lines(lined, ratio)).where("reason IS NULL")
    chunks = chunking.chunk(kept.select("document", "page", "line_no", "line"), size, overlap)
    first = F.min_by(F.struct(*chunks.columns), F.struct(F.length("chunk_id"), "chunk_id")).alias("c")  # numbers of an id have four digits or more
    return chunks.groupBy("document", F.sha2(T.folded(F.col("text")), 256).alias("key")).agg(first).select("c.*")


def violations(chunks: DataFrame) -> DataFrame:
    """(rule, n) for chunks: none at all, repeated ids, blank texts, wrong page ranges, missing fields; n is 0 where all is well."""
    missing = F.array_contains(F.array(*[F.col(c).isNull() for c in ("document", "section", "page_start", "page_end", "chunk_id", "token_count")]), True)
    once = chunks.agg(
        F.when(F.count("*") == 0, 1).otherwise(0).cast("long").alias("no_chunks"),
        F.count_if(T.stripped(F.coalesce("text", F.lit(""))) == "").alias("blank_text"),
        F.count_if((F.col("page_start") < 1) | (F.col("page_end") < F.col("page_start"))).alias("page_range"), F.count_if(missing).alias("missing_field"),
    ).unpivot([], ["no_chunks", "blank_text", "page_range", "missing_field"], "rule", "n")
    repeated = chunks.groupBy("chunk_id").count().where("count > 1").agg(F.count("*").alias("n")).select(F.lit("repeated_id").alias("rule"), "n")
    return once.unionByName(repeated)


def fingerprint(chunks: DataFrame) -> DataFrame:
    """(fingerprint) of a corpus: a hash over one hash per document, which is over its chunk ids in order. Documents meet as 40 characters each."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct(F.length("chunk_id").alias("n"), "chunk_id"))), lambda x: x["chunk_id"])
    each = chunks.groupBy("document").agg(F.sha1(F.array_join(ids, "|")).alias("h"))
    blocks = each.groupBy(F.substring("h", 1, 3).alias("block")).agg(F.sha1(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "document", "h"))), "|")).alias("h"))
    return blocks.agg(F.substring(F.sha1(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "block", "h"))), "|")), 1, 10).alias("fingerprint"))
