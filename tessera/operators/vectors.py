"""Vector search by an inverted file: every vector in the cell of its nearest centroid, queries joined with cells.

Centroids are fitted on a bounded sample of the vectors; all vectors are indexed. A search probes each query's nearest
cells. Searched `surely`, it goes on through all cells that the triangle inequality can't exclude, so that the
result is that of a comparison with every vector.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import nearest
from tessera.operators.retrieval import top_k
from tessera.sources.scratch import written_once

#: Vectors that the centroids are fitted on; most cells; rows of a cell that are searched as one piece.
SAMPLE, MOST_CELLS, PIECE = 50_000, 4096, 50_000
#: Share of the cells that a search probes, and least number of them.
PROBED, LEAST_PROBES = 0.45, 4
#: How far rounding can move a distance.
_SLACK = 1e-6


def unit(vector: Column) -> Column:
    """The vector over its length, in doubles; one of zeros stays as it is, so that its cosine with anything is 0."""
    v = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    # an array of one length, so that it isn't added up again for each component
    return F.get(F.transform(F.array(norm), lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0)))), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


@dataclass
class Index:
    """rows(cell, piece, doc_id, v), cells(cell, n, pieces, radius) and the centroids, of which there are MOST_CELLS at most."""

    rows: DataFrame
    cells: DataFrame
    centroids: np.ndarray


def _fitted(vectors: DataFrame, cells: int, sample: int, seed: int) -> np.ndarray:
    drawn = vectors.orderBy(F.xxhash64("doc_id", "v")).limit(sample).select(array_to_vector("v").alias("features"))
    model = KMeans(k=cells, seed=seed, maxIter=10, initSteps=2).fit(drawn)
    return np.array(model.clusterCenters())


def _apart(v: pa.Array, centres: np.ndarray) -> np.ndarray:
    v = v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)
    return np.sqrt(np.maximum(0, (v * v).sum(1)[:, None] - 2 * v @ centres.T + (centres * centres).sum(1)))


def _nearest(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """rows(doc_id, v) with the nearest cell and how far its centroid is apart."""
    sent = rows.sparkSession.sparkContext.broadcast(centroids)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                apart = _apart(batch.column("v"), sent.value)
                cell = apart.argmin(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(apart[np.arange(len(cell)), cell])], [*batch.schema.names, "cell", "apart"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(work, f"{kinds}, cell int, apart double")


def _probed(rows: DataFrame, centroids: np.ndarray, probes: int, radius: np.ndarray | None = None) -> DataFrame:
    """rows(query_id, v, bar) with cells, a bit for each cell that is searched: the `probes` nearest, or given the cells' radius all
    others that may hold something as near as bar. Without a bar, and for a zero vector, any may."""
    sent = rows.sparkSession.sparkContext.broadcast((centroids, radius))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, reach = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            apart = _apart(batch.column("v"), centres)
            cells = np.zeros(apart.shape, bool)
            np.put_along_axis(cells, np.argsort(apart, axis=1, kind="stable")[:, :probes], True, axis=1)
            if reach is not None:
                bar = batch.column("bar").to_numpy(zero_copy_only=False)[:, None].astype(float)
                v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                cells = ~cells & (np.isnan(bar) | ~v.any(1)[:, None] | (apart - reach - _SLACK <= bar))
            bits = pa.array([x.tobytes() for x in np.packbits(cells, axis=1)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("v"), bits], ["query_id", "embedding", "cells"])

    return rows.mapInArrow(work, f"query_id {rows.schema['query_id'].dataType.simpleString()}, embedding array<double>, cells binary")


def build_index(vectors: DataFrame, cells: int | None = None, sample: int = SAMPLE, seed: int = 7) -> Index:
    """The index of vectors(doc_id, embedding); null and empty vectors are left out, repeated rows are kept.

    Without a number of cells it is the root of the number of vectors, MOST_CELLS at most. A cell of many rows, such as
    copies of one vector, is cut into pieces that are searched apart.
    """
    rows = vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).select("doc_id", unit(F.col("embedding")).alias("v"))
    n = rows.count()
    cells = min(cells or math.isqrt(n), MOST_CELLS, n)
    centroids = _fitted(rows, cells, sample, seed) if n and cells > 1 else np.array([r.v for r in rows.limit(1).collect()])
    placed = _nearest(rows, centroids).select("cell", "apart", "doc_id", "v")
    placed = written_once(placed.withColumn("spread", F.xxhash64("doc_id")), "cells")
    sizes = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("apart").alias("radius"))
    sizes = written_once(sizes.withColumn("pieces", F.ceil(F.col("n") / PIECE).cast("int")), "sizes")
    # a row for each cell: MOST_CELLS at most
    pieced = placed.join(F.broadcast(sizes.select("cell", "pieces")), "cell").withColumn("piece", F.pmod("spread", "pieces").cast("int"))
    return Index(pieced.select("cell", "piece", "doc_id", "v"), sizes, centroids)


def _scored(index: Index, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, score) of what can be among the k best in the cells of asked(query_id, embedding, cells); a task has some
    pieces of cells and some queries."""
    rows = index.rows.select("doc_id", F.col("v").alias("embedding"), "cell", "piece")
    return nearest.scores(rows, asked, k, True, F.xxhash64("cell", "piece"))


def ann_topk(index: Index, queries: DataFrame, k: int = 5, probes: int | None = None, least: float = -1.0, surely: bool = False) -> DataFrame:
    """query_id, doc_id, score (cosine, 6 decimals) and rank of the k best for queries(query_id, embedding); ties: the smaller doc_id.

    probes cells are searched for each query, by default PROBED of all. surely: then all further cells whose
    distance less their radius doesn't exceed that of the k-th hit so far. A zero vector has the cosine 0 with all.
    Null and empty query vectors have no hits.
    """
    n = len(index.centroids)
    if not n:
        return queries.select("query_id", F.lit(None).cast("long").alias("doc_id"), F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    probes = min(n, probes or max(LEAST_PROBES, math.ceil(PROBED * n)))
    asked = queries.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).select("query_id", unit(F.col("embedding")).alias("v"))
    asked = written_once(asked, "asked")
    first = _scored(index, _probed(asked, index.centroids, probes), k)
    if not surely:
        return top_k(first.where(F.col("score") >= least), k).select("query_id", "doc_id", "score", "rank")
    best = written_once(top_k(first, k), "nearest")
    # a hit of score s lies sqrt(1 + |q| |q| - 2 s) away; zero vectors lie nearer to all than that says, so they count as 1
    bar = best.groupBy("query_id").agg(F.when(F.count("*") >= k, F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.min("score"))) + 1e-3).alias("bar"))
    radius = np.full(n, -math.inf)
    for r in index.cells.select("cell", "radius").collect():  # a row for each cell
        radius[r.cell] = r.radius
    more = _scored(index, _probed(asked.join(bar, "query_id", "left"), index.centroids, probes, radius), k)
    both = best.select("query_id", "doc_id", "score").unionByName(more)
    return top_k(both.where(F.col("score") >= least), k).select("query_id", "doc_id", "score", "rank")


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: queries, hits of truth(query_id, doc_id), and the share of them that found has."""
    hits = truth.select("query_id", "doc_id").join(found.select("query_id", "doc_id", F.lit(1).alias("hit")), ["query_id", "doc_id"], "left")
    return hits.agg(F.count_distinct("query_id").alias("n_queries"), F.count("*").alias("n_hits"), F.round(F.count("hit") / F.count("*"), 6).alias("recall"))
