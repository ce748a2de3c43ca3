"""Sharding by weighted rendezvous hashing, DataFrame functions only.

Every shard draws a score from (record key, shard number); the best score wins. A further
shard adds one draw and changes none of the others, so a record either stays or moves to it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import documents, text_or_empty

#: Rows that one slot-numbering group is meant to hold, and the most groups a shard is cut into.
ROWS_PER_GROUP, MAX_GROUPS = 4096, 4096


def _draw(key: Column, salt: str) -> Column:
    """An integer in [0, 2^52), even over keys, from 13 hex digits of MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", key, F.lit(salt))), 1, 13), 16, 10).cast("long")


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """Number of the shard with the least -ln(u)/weight (ties: the lower number); u from the key and the number."""
    best = F.array_min(F.array(*[_entry(key, s, w) for s, w in enumerate(weights)]))
    return best["shard"]


def _entry(key: Column, shard: int, weight: float) -> Column:
    u = (_draw(key, str(shard)).cast("double") + 0.5) / float(1 << 52)
    return F.struct((-F.ln(u) / F.lit(float(weight))).alias("cost"), F.lit(shard).alias("shard"))


def shard_records(
    docs: DataFrame,
    n_shards: int = 8,
    weights: Sequence[float] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    new_weight: float = 1.0,
) -> DataFrame:
    """Shard, slot and the shard with one shard more, for every row.

    A null text counts as empty; a null id is a key of its own; repeated rows get the same shard
    and slots of their own; an empty table gives an empty result; other columns are ignored.
    Slots are numbered 0.. in each shard: rows are dealt into groups by a hash of the key, a group
    is numbered by itself, and the sizes of the groups before it (a table of at most
    (n_shards x MAX_GROUPS) rows) are added. So no task holds a whole shard.
    """
    weights = list(weights or [1.0] * n_shards)
    if len(weights) != n_shards or min(weights) <= 0:
        raise ValueError("one positive weight for each shard is needed")
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    groups = max(1, min(MAX_GROUPS, -(-docs.count() // (ROWS_PER_GROUP * n_shards))))
    key_of_id = F.col("doc_id").cast("string")
    key = F.coalesce(key_of_id, F.lit("null"))
    placed = rows.select(
        "doc_id",
        (F.octet_length("text") + 1).cast("long").alias("size"),
        F.crc32("text").alias("text_crc32"),
        rendezvous(key, weights).alias("shard"),
        rendezvous(key, [*weights, new_weight]).alias("grown_shard"),
        (_draw(F.coalesce(key_of_id, F.concat(F.lit("null"), F.crc32("text").cast("string"))), "slot") % groups).cast("int").alias("grp"),
    )
    sizes = placed.groupBy("shard", "grp").count()
    before = Window.partitionBy("shard").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("shard", "grp", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("shard", "grp").orderBy("doc_id", "size", "text_crc32")
    return (
        placed.withColumn("pos", F.row_number().over(own) - 1)
        .join(F.broadcast(offsets), ["shard", "grp"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
            (F.col("base") + F.col("pos")).cast("long").alias("slot"), "grown_shard",
        )
    )


def op10_rendezvous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_records(documents(spark, sf_dir))


def _sql_draw(salt: str) -> str:
    return f"('0x' || substr(md5(doc_id::VARCHAR || ':{salt}'), 1, 13))::BIGINT"


def _crc_table() -> list[int]:
    table = []
    for n in range(256):
        for _ in range(8):
            n = (n >> 1) ^ (0xEDB88320 if n & 1 else 0)
        table.append(n)
    return table


ORACLE_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), b AS (
  SELECT doc_id, (strlen(t) + 1)::BIGINT AS size,
    xor(list_reduce(
      list_prepend(4294967295::BIGINT,
        CASE WHEN strlen(t) = 0 THEN []::BIGINT[]
        ELSE list_transform(range(0, strlen(t)::BIGINT), lambda i: ('0x' || substr(hex(encode(t)), (2 * i + 1)::BIGINT, 2))::BIGINT) END),
      lambda a, x: xor(a >> 8, ({_crc_table()})[(xor(a, x) & 255) + 1])), 4294967295::BIGINT) AS text_crc32,
    [{", ".join(_sql_draw(str(s)) for s in range(9))}] AS draws,
    {_sql_draw("slot")} % greatest(1, least({MAX_GROUPS}, ceil((SELECT count(*) FROM documents) / ({ROWS_PER_GROUP} * 8.0))))::BIGINT AS grp
  FROM d
), s AS (
  SELECT *, list_position(draws[1:8], list_max(draws[1:8])) - 1 AS shard,
    list_position(draws, list_max(draws)) - 1 AS grown_shard FROM b
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INT AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY grp, doc_id, size, text_crc32) - 1 AS slot, grown_shard::INT AS grown_shard
FROM s
"""

QUERIES = {"op10_rendezvous": op10_rendezvous}
ORACLES = {"op10_rendezvous": ORACLE_SQL}
