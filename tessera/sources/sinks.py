"""Outputs: hits as JSON logs, audit tables as CSV, reports as one row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def retrieval_log(hits: DataFrame) -> DataFrame:
    """query_id and its hits in order; write with .write.json."""
    hit = F.struct("rank", "doc_id", "score")
    return hits.groupBy("query_id").agg(F.array_sort(F.collect_list(hit)).alias("results"))


def audit_template(hits: DataFrame) -> DataFrame:
    """For every query its results, best score and documents, with empty columns for labels; write with .write.csv."""
    rows = hits.groupBy("query_id").agg(
        F.count("*").alias("n_results"), F.round(F.max("score"), 4).alias("top_score"),
        F.array_join(F.array_sort(F.collect_set(F.col("source"))), ", ").alias("documents"),
    )
    return rows.select("*", *[F.lit("").alias(c) for c in ("relevant", "correct_source", "duplicate", "missing_context", "notes")])


def best_configuration(matrix: DataFrame) -> DataFrame:
    """The row of the best (precision, reciprocal_rank)."""
    return matrix.orderBy(F.desc("precision"), F.desc("reciprocal_rank"), "configuration").limit(1)


def write_manifest(chunks: DataFrame, path: str, **settings: object) -> None:
    """path/chunks, the chunks as JSON lines, and path/config, one line of the settings and the corpus's fingerprint among them."""
    chunks.write.mode("overwrite").json(f"{path}/chunks")
    _one_row(chunks, settings).write.mode("overwrite").json(f"{path}/config")


def write_evaluation(results: DataFrame, metrics: DataFrame, path: str, **settings: object) -> None:
    """path/config, path/metrics and path/results of an evaluation, as JSON lines."""
    _one_row(results, settings).write.mode("overwrite").json(f"{path}/config")
    metrics.write.mode("overwrite").json(f"{path}/metrics")
    results.write.mode("overwrite").json(f"{path}/results")


def _one_row(df: DataFrame, settings: dict[str, object]) -> DataFrame:
    return df.sparkSession.range(1).select(*[F.lit(value).alias(name) for name, value in settings.items()])
