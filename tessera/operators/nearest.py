"""Cosines of vectors with queries: parts of both meet in tasks, which pass on what can still be among a query's k best.

A matrix product tells what can be; of that, the cosine is added up in the order of the components, so that it is the same wherever it is made.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.scoring import best

#: Vectors and queries of a part, about; rows that are multiplied at once; products of components that are held at once.
VECTORS, QUERIES, ROWS, PAIRS = 16_384, 32_768, 4096, 100_000


def _matrices(column: pa.ChunkedArray) -> list[tuple[np.ndarray, np.ndarray | None]]:
    """Rows and their vectors in doubles, for each length; rows without a whole vector have None."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    ends = np.cumsum(np.maximum(sizes, 0))
    if flat.null_count:
        gaps = np.concatenate([[0], np.cumsum(flat.is_null().to_numpy(zero_copy_only=False))])
        sizes = np.where(gaps[ends] > gaps[ends - np.maximum(sizes, 0)], -1, sizes)
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    found = []
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        found.append((rows, values[(ends[rows] - size)[:, None] + np.arange(size)] if size > 0 else None))
    return found


def _summed(products: np.ndarray) -> np.ndarray:
    return np.cumsum(products, axis=1)[:, -1]


def _cosines(v: np.ndarray, q: np.ndarray, sized: bool) -> np.ndarray:
    """Cosine of each row of v with the same row of q; of unit vectors (sized) the plain product."""
    found = _summed(v * q)
    if not sized:
        length = np.sqrt(_summed(v * v)) * np.sqrt(_summed(q * q))
        found = np.divide(found, length, out=np.zeros(len(found)), where=length != 0)
    return found


def _part(vectors: pa.Table, queries: pa.Table, k: int, sized: bool):
    """Rows of queries, rows of vectors and cosines of what can be among the best. vectors are in order of ids."""
    cells = vectors.column("cell").to_numpy() if "cell" in vectors.column_names else None
    probed = None if cells is None else [np.frombuffer(x, np.uint8) for x in queries.column("cells").to_pylist()]
    mine = _matrices(vectors.column("v"))
    with np.errstate(all="ignore"):
        for theirs, q in _matrices(queries.column("v")):
            for begin in range(0, len(theirs), 512):
                asked = theirs[begin : begin + 512]
                some = None if q is None else q[begin : begin + 512]
                open_ = None if probed is None else np.unpackbits(np.stack([probed[i] for i in asked]), axis=1).astype(bool)
                top = np.full((len(asked), k), -math.inf)
                lengths = None if some is None or sized else np.sqrt((some * some).sum(1))
                for rows, v in mine:
                    for at in range(0, len(rows), ROWS):
                        own = rows[at : at + ROWS]
                        these = None if v is None else v[at : at + ROWS]
                        together = some is not None and these is not None and some.shape[1] == these.shape[1]
                        made = np.zeros((len(asked), len(own)))
                        if together and cells is None:
                            made = some @ these.T
                            if not sized:
                                made /= lengths[:, None] * np.sqrt((these * these).sum(1))[None, :]
                        if cells is not None:
                            made[:] = -math.inf
                            for cell in np.unique(cells[own]):
                                here, who = np.flatnonzero(cells[own] == cell), np.flatnonzero(open_[:, cell])
                                if len(who):
                                    made[np.ix_(who, here)] = some[who] @ these[here].T if together else 0.0
                        # what isn't a number comes first, as Spark sorts it; a zero vector has the cosine 0
                        if together and not sized:
                            made[np.outer(lengths == 0, np.ones(len(own), bool)) | ((these * these).sum(1) == 0)[None, :]] = 0.0
                        made[np.isnan(made)] = math.inf
                        a, d = best(made, top, not together)  # what looks equal may differ once it is added up in order
                        for p in range(0, len(a), PAIRS):
                            x, y = a[p : p + PAIRS], d[p : p + PAIRS]
                            s = _cosines(these[y], some[x], sized) if together else np.zeros(len(x))
                            x, y, s = _fewer(x, y, s, k)
                            yield asked[x], own[y], s


def _fewer(x: np.ndarray, y: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((y, s, x))
    x, y, s = x[order], y[order], s[order]
    new = np.flatnonzero((np.diff(x, prepend=-1) != 0) | (np.diff(s, prepend=np.nan) != 0) & ~(np.isnan(s) & np.isnan(np.roll(s, 1))))
    turn = np.arange(len(x)) - np.repeat(new, np.diff([*new, len(x)]))
    return x[turn < k], y[turn < k], s[turn < k]


def scores(vectors: DataFrame, queries: DataFrame, k: int, sized: bool = False, part: Column | None = None) -> DataFrame:
    """query_id, doc_id and score (6 decimals): at least the k best of vectors(doc_id, embedding) for each of queries(query_id, embedding).

    With a column cell of vectors and a column cells of queries (a bit for each cell) only cells whose bit is set are compared. part: what
    the vectors are dealt to parts by, doc_id and embedding by default. sized: all have the length 1, or 0.
    """
    n, n_queries = vectors.count(), queries.count()
    parts, shares = max(1, -(-n // VECTORS)), max(1, -(-n_queries // QUERIES))
    deal = F.xxhash64("doc_id", "embedding") if part is None else part
    has = [c for c in ("cell",) if c in vectors.columns], [c for c in ("cells",) if c in queries.columns]
    mine = vectors.select("doc_id", F.col("embedding").alias("v"), *has[0], F.pmod(deal, F.lit(parts)).alias("part"), F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"))
    theirs = queries.select("query_id", F.col("embedding").alias("v"), *has[1], F.pmod(F.xxhash64("query_id", "embedding"), F.lit(shares)).cast("int").alias("share"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"))

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        kinds = [("query_id", right.schema.field("query_id").type), ("doc_id", left.schema.field("doc_id").type), ("score", pa.float64())]
        ids = left.column("doc_id")
        left = left.take(pc.sort_indices(ids, null_placement="at_start"))
        out = [pa.table([right.column("query_id").take(pa.array(a)), left.column("doc_id").take(pa.array(d)), pa.array(s, pa.float64())], schema=pa.schema(kinds)) for a, d, s in (_part(left, right, k, sized) if left.num_rows and right.num_rows else ())]
        return pa.concat_tables(out) if out else pa.schema(kinds).empty_table()

    kind = lambda df, c: df.schema[c].dataType.simpleString()
    found = mine.groupBy("part", "share").cogroup(theirs.groupBy("part", "share")).applyInArrow(work, f"query_id {kind(queries, 'query_id')}, doc_id {kind(vectors, 'doc_id')}, score double")
    return found.withColumn("score", F.round("score", 6))
