"""Conflict-constrained best-fit packing of documents into fixed token windows.

Items are dealt into blocks of bounded size by a hash, and each block is packed by itself, largest
item first. Open bins stand in order of their room left; from the first bin with room enough the
search walks on to the next tighter-than-others one until a bin has no conflict.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import SPACE, documents, text_or_empty

#: Tokens of a bin; documents of one source that a bin may hold; rows of a block.
CAPACITY, PER_SOURCE, BLOCK_ROWS = 4096, 4, 8192


def pack_block(sizes: list[int], sources: list[int], clusters: list[int], capacity: int, per_source: int) -> list[int]:
    """Bin number of each item; items have sizes of at most capacity, in descending order.

    A bin carries one bitmap of the clusters it holds and per_source bitmaps of sources: bit s of
    the k-th is set once k+1 documents of source s are in. An item conflicts with a bin that has
    its cluster's bit, or its source's bit in the last bitmap.
    """
    rooms: list[tuple[int, int]] = []  # (room left, bin), ascending
    held: list[int] = []
    quotas: list[list[int]] = []
    placed = []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        at = bisect_left(rooms, (size, -1))
        own, kin = 1 << cluster, 1 << source
        while at < len(rooms) and (held[b := rooms[at][1]] & own or quotas[b][-1] & kin):
            at += 1
        if at < len(rooms):
            room, b = rooms.pop(at)
        else:
            room, b = capacity, len(held)
            held.append(0)
            quotas.append([0] * per_source)
        held[b] |= own
        for k in range(per_source):
            if not quotas[b][k] & kin:
                quotas[b][k] |= kin
                break
        insort(rooms, (room - size, b))
        placed.append(b)
    return placed


def pack(
    docs: DataFrame,
    capacity: int = CAPACITY,
    per_source: int = PER_SOURCE,
    block_rows: int = BLOCK_ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per piece: doc_id, piece, n_tokens, bin_id, bin_offset, bin_fill, source.

    Tokens are words. A document longer than the capacity fills bins of its own with its full
    pieces; only its last piece is packed with others, so no token is lost. A bin holds at most
    per_source documents of one source (null is a source) and one document of each
    duplicate cluster (equal text but for white space). Documents of one size go by their ids (null ones
    last), then by their texts' hashes. Null and empty texts are pieces of no
    tokens. Repeated rows are packed each. Empty table: empty result. Other columns are ignored.
    A hot source or cluster is spread over all blocks; each block leaves one slack bin or so.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
        F.trim(F.regexp_replace(text_or_empty(text_col), SPACE, " ")).alias("norm"),
    )
    blocks = max(1, -(-docs.count() // block_rows))
    items = rows.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), "source", F.xxhash64("norm").alias("cluster"),
        F.when(F.col("norm") == "", 0).otherwise(F.size(F.split("norm", " "))).alias("words"),
    )
    alike = items.groupBy(*items.columns).agg(F.count("*").alias("n"))  # repeated rows are told apart by a number, so they can be spread
    items = alike.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n")))).drop("n")
    items = items.withColumn("block", F.pmod(F.xxhash64("doc_id", "no_id", "cluster", "copy"), F.lit(blocks))).drop("copy")

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        block = int(frame["block"].iloc[0])
        frame = frame.sort_values(["no_id", "doc_id", "cluster", "source"], kind="stable").reset_index(drop=True)
        full, rest = frame["words"] // capacity, frame["words"] % capacity
        rest = rest.where((rest > 0) | (full == 0), -1)  # no last piece where full pieces are all
        last = frame[rest >= 0].assign(size=rest[rest >= 0]).sort_values("size", ascending=False, kind="stable")
        bins = pack_block(last["size"].tolist(), pd.factorize(last["source"])[0].tolist(), pd.factorize(last["cluster"])[0].tolist(), capacity, per_source)
        out = last.assign(piece=full[last.index].astype("int32"), bin=bins, n_tokens=last["size"])
        own = frame.loc[frame.index.repeat(full)]
        pieces = own.groupby(level=0).cumcount().astype("int32")
        own = own.assign(piece=pieces, bin=range(max(bins, default=-1) + 1, max(bins, default=-1) + 1 + len(own)), n_tokens=capacity)
        out = pd.concat([out, own], ignore_index=True)
        out["bin_offset"] = out.groupby("bin")["n_tokens"].cumsum() - out["n_tokens"]
        out["bin_fill"] = out.groupby("bin")["n_tokens"].transform("sum")
        out["bin_id"] = out["bin"] + (block << 32)
        return out[["doc_id", "no_id", "piece", "n_tokens", "bin_id", "bin_offset", "bin_fill", "source"]]

    packed = items.groupBy("block").applyInPandas(
        work, "doc_id long, no_id boolean, piece int, n_tokens long, bin_id long, bin_offset long, bin_fill long, source string"
    )
    return packed.withColumn("doc_id", F.when(~F.col("no_id"), F.col("doc_id"))).drop("no_id")


def op7_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))


QUERIES = {"op7_best_fit": op7_best_fit}
ORACLES: dict[str, str] = {}
