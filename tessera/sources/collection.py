"""A stored collection of vectors with upsert: rows lie in buckets of their keys, and a batch rewrites the buckets it touches."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import retrieval

#: Buckets of a collection; a batch rewrites a bucket as a whole.
BUCKETS = 64


class VectorCollection:
    """Rows of one key each under path, partitioned by bucket; order is the column whose greatest value wins for a key.

    A batch is merged with the buckets that its keys fall into and written to a folder beside them first, so that nothing
    is read from where it is overwritten. Rows older than the stored row of their key don't replace it, so a batch
    may come twice or late.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "doc_id", order: str = "batch", buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.order, self.buckets = spark, path, key, order, buckets

    def read(self) -> DataFrame | None:
        """The stored rows, or None before the first batch."""
        try:
            return self.spark.read.parquet(f"{self.path}/rows").drop("bucket")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def upsert(self, batch: DataFrame) -> None:
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        new, stored = batch.withColumn("bucket", bucket), self.read()
        if stored is not None:
            touched = F.broadcast(new.select("bucket").distinct())  # BUCKETS rows at most
            new = new.unionByName(self.spark.read.parquet(f"{self.path}/rows").join(touched, "bucket", "left_semi").select(*new.columns))
        columns = [c for c in new.columns if c != "bucket"]
        latest = retrieval.latest(new.select(*columns), self.key, self.order).withColumn("bucket", bucket)
        merged = f"{self.path}/merged"
        latest.write.mode("overwrite").parquet(merged)
        rows = self.spark.read.schema(latest.schema).parquet(merged).repartition(self.buckets, "bucket")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.path}/rows")

    def count(self) -> int:
        stored = self.read()
        return 0 if stored is None else stored.count()
