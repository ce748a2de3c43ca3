"""Vector code compression: product codes whose assignment rounds skip distances by adaptive bounds.

Every part of a vector keeps its b closest codebook entries, a lower bound on the distance of each, and one outer
bound for all other entries. When entries move, bounds shrink by how far they moved; only entries whose bound no longer
excludes them are measured again, in integers. b follows what the rounds turn out to need.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import forget, materialise, received, salt, salted_join, send_out

#: Components become integers as floor(SCALE * x).
SCALE = 1024
#: Closest entries that a part keeps at first, and at least; share of the parts whose needs b has to meet.
CLOSEST, LEAST, MET = 16, 2, 0.98
#: Bounds are kept as float32; rounding never exceeds this share of a distance.
SLACK = 1e-6


def usable(vector: Column) -> Column:
    """Neither null nor empty, and every component a finite number."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~odd


def integers(vectors: DataFrame, id_col: str, vec_col: str, label_col: str, parts: int) -> DataFrame:
    """vec_id, label and x (integer components) of the vectors that are kept; written once, in the shared folder."""
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("v"))
    rows = rows.where(usable(F.col("v")))
    sizes = rows.groupBy(F.size("v").alias("dims")).agg(F.count("*").alias("n"), F.max(F.array_max(F.transform("v", F.abs))).alias("most"))
    lengths = sizes.orderBy(F.desc("n"), F.desc("dims")).limit(1).collect()  # one row: the length that most vectors have
    dims, most = (lengths[0].dims, lengths[0].most) if lengths else (parts, 0.0)
    if dims % parts:
        raise ValueError(f"vectors of {dims} components can't be cut into {parts} equal parts")
    if dims * (2 * (most * SCALE + 1)) ** 2 >= 2.0**63:
        raise ValueError("components are too large: squared distances leave 64 bits")
    x = F.transform("v", lambda c: F.floor(c * SCALE).cast("int"))
    return materialise(rows.where(F.size("v") == dims).select("vec_id", "label", x.alias("x")), "vectors")


def first_books(rows: DataFrame, parts: int, entries: int) -> np.ndarray:
    """parts x entries x components: the vectors of the smallest ids (ties: the smaller vector; null ids last)."""
    least = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()
    found = np.array([r.x for r in least], dtype=np.int64)
    return np.stack(np.split(found, parts, axis=1)) if len(found) else np.zeros((parts, 0, 1), dtype=np.int64)


def measured(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all entries, exact: by matrix product where doubles hold every term."""
    reach = max(np.abs(x).max(initial=0), np.abs(book).max(initial=0))
    if x.shape[1] * (2.0 * float(reach)) ** 2 < 2.0**52:
        a, b = x.astype(float), book.astype(float)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([((x - entry) ** 2).sum(1) for entry in book], axis=1)


def _below(squared: np.ndarray) -> np.ndarray:
    return (np.sqrt(squared) * (1 - SLACK)).astype(np.float32)


def searched(x: np.ndarray, book: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray]:
    """The b closest entries of each row (ties: lower index) and b lower bounds: one for each but the first, then the outer one."""
    squared = measured(x, book)
    order = np.argsort(squared, axis=1, kind="stable")[:, : b + 1]
    bounds = _below(np.take_along_axis(squared, order[:, 1:], axis=1))
    if order.shape[1] <= b:  # there are no other entries
        bounds = np.hstack([bounds, np.full((len(x), 1), np.inf, dtype=np.float32)])
    return order[:, :b].astype(np.uint8), bounds


def updated(x: np.ndarray, book: np.ndarray, moved: np.ndarray, near: np.ndarray, bounds: np.ndarray, b: int):
    """near and bounds after the entries have moved, and how many entries each row had to look at (b + 1: all of them).

    moved: how far each entry moved, rounded up. A row looks at its first z entries, where z is the least number behind
    which all bounds exceed the distance to the first one; equal or nearly equal values count as not exceeding.
    """
    bounds = bounds.astype(float)
    bounds[:, :-1] -= moved[near[:, 1:]]
    bounds[:, -1] -= moved.max()
    if b < near.shape[1]:  # what is no longer listed goes under the outer bound
        bounds = np.hstack([bounds[:, : b - 1], bounds[:, b - 1 :].min(axis=1, keepdims=True)])
        near = near[:, :b]
    near, width = near.copy(), near.shape[1]
    own = np.sqrt(((x - book[near[:, 0]]) ** 2).sum(1)) * (1 + SLACK)
    behind = np.minimum.accumulate(bounds[:, ::-1], axis=1)[:, ::-1]  # behind[:, z - 1]: the least bound from entry z on
    clear = own[:, None] < behind
    need = np.where(clear.any(axis=1), clear.argmax(axis=1) + 1, width + 1)
    for z in range(2, width + 1):
        at = np.flatnonzero(need == z)
        if len(at):
            listed = near[at, :z]
            squared = ((x[at, None, :] - book[listed]) ** 2).sum(2)
            order = np.lexsort((listed, squared), axis=1)
            near[at, :z] = np.take_along_axis(listed, order, axis=1)
            bounds[at, : z - 1] = _below(np.take_along_axis(squared, order, axis=1)[:, 1:])
    at = np.flatnonzero(need == width + 1)
    if len(at):
        near[at], bounds[at] = searched(x[at], book, width)
    return near, (bounds - np.abs(bounds) * SLACK).astype(np.float32), need


def _matrix(column: pa.Array, rows: int, kind) -> np.ndarray:
    if pa.types.is_list(column.type):
        return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(rows, -1)
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(rows, -1)


def _packed(matrix: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in matrix], type=pa.binary())


def assigned(rows: DataFrame, books: np.ndarray, moved: np.ndarray | None, b: int) -> DataFrame:
    """rows with each part's closest entries (near), their bounds and the entries that the rows had to look at (needs).

    Without moved, every distance is measured; otherwise rows have near and bounds of the round before.
    """
    parts, (sent) = len(books), send_out(rows.sparkSession, (books, moved))
    keep = ["vec_id", "label", "x"]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in keep) + ", near binary, bounds binary, needs binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, moved = received(sent)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = np.split(_matrix(batch.column("x"), n, np.int64), parts, axis=1)
            if moved is None:
                found = [(*searched(x[p], books[p], b), np.full(n, b + 1)) for p in range(parts)]
            else:
                near = np.split(_matrix(batch.column("near"), n, np.uint8), parts, axis=1)
                bounds = np.split(_matrix(batch.column("bounds"), n, np.float32), parts, axis=1)
                found = [updated(x[p], books[p], moved[p], near[p], bounds[p], b) for p in range(parts)]
            near, bounds, needs = (np.hstack([f[i].reshape(n, -1) for f in found]) for i in range(3))
            columns = [batch.column(c) for c in keep] + [_packed(near), _packed(bounds.astype(np.float32)), _packed(needs.astype(np.uint8))]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "near", "bounds", "needs"])

    return materialise(rows.mapInArrow(run, schema), "bounds")


def moved_books(rows: DataFrame, books: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Codebooks of the floored means, how far every entry moved (rounded up), and how many parts looked at 0, 1, 2.. entries.

    Tasks send one sum for each part and entry; parts x entries rows reach the driver.
    """
    parts, entries, dims = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts, needs = np.zeros((parts, entries, dims), dtype=np.int64), np.zeros((parts, entries), dtype=np.int64), np.zeros(256, dtype=np.int64)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = np.split(_matrix(batch.column("x"), n, np.int64), parts, axis=1)
            first = _matrix(batch.column("near"), n, np.uint8).reshape(n, parts, -1)[:, :, 0]
            needs += np.bincount(_matrix(batch.column("needs"), n, np.uint8).ravel(), minlength=256)
            for p in range(parts):
                np.add.at(sums[p], first[:, p], x[p])
                counts[p] += np.bincount(first[:, p], minlength=entries)
        have = np.argwhere(counts)
        yield pa.RecordBatch.from_pydict(
            {"part": pa.array(have[:, 0], pa.int32()), "entry": pa.array(have[:, 1], pa.int32()), "n": pa.array(counts[counts > 0], pa.int64()),
             "sums": pa.array(list(sums[counts > 0]), pa.list_(pa.int64()))})
        told = np.flatnonzero(needs)
        yield pa.RecordBatch.from_pydict(
            {"part": pa.array([-1] * len(told), pa.int32()), "entry": pa.array(told, pa.int32()), "n": pa.array(needs[told], pa.int64()),
             "sums": pa.array([[0] * dims] * len(told), pa.list_(pa.int64()))})

    some = rows.select("x", "near", "needs").mapInArrow(run, "part int, entry int, n long, sums array<bigint>")
    total = some.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(dims)])
    after, needs = books.copy(), [0] * 256
    for r in total.collect():
        if r.part < 0:
            needs[r.entry] = r.n
        else:
            after[r.part, r.entry] = [r[f"s{i}"] // r.n for i in range(dims)]
    return after, np.sqrt(((after - books) ** 2).sum(2)) * (1 + SLACK), needs


def adapted(needs: list[int], b: int) -> int:
    """The least number of listed entries that serves MET of the parts that the present b serves."""
    served = sum(needs[: b + 1])
    if not served:
        return b
    return next(z for z in range(LEAST, b + 1) if sum(needs[: z + 1]) >= MET * served or z == b)


def compress(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
    parts: int = 4, entries: int = 256, rounds: int = 4, closest: int = CLOSEST,
) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every vector that is kept.

    Left out: null and empty vectors, those with null, NaN or infinite components, and those whose length isn't the one
    that most kept vectors have (ties: the greater length). A length that parts doesn't divide, and components so large that
    squared distances leave 64 bits, raise ValueError. Null ids sort behind all others; of equal ids the smaller vector
    comes first; repeated rows are coded each. Fewer vectors than entries: a smaller codebook. Null labels are one label.
    Empty table: empty result. Other columns are ignored.
    """
    if not 1 < entries <= 256 or not LEAST <= closest <= 128:
        raise ValueError("2 to 256 entries fit a code of two hex digits, and 2 to 128 of them are kept")
    rows, b, moved = integers(vectors, id_col, vec_col, label_col, parts), closest, None
    books = first_books(rows, parts, entries)
    b = max(1, min(b, books.shape[1]))
    if not books.shape[1]:
        return rows.selectExpr("vec_id", "'' AS code", "0L AS error", "0L AS label_error", "'' AS codebooks_sha256")
    for turn in range(rounds + 1):
        after = assigned(rows, books, moved, b)
        forget(rows)
        rows = after
        if turn < rounds:
            books, moved, needs = moved_books(rows, books)
            b = adapted(needs, b) if turn else b
    coded = materialise(_coded(rows, books), "codes")
    forget(rows)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    coded = coded.withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))).withColumn("salt", salt("vec_id", "code"))
    sums = coded.groupBy("key", "salt").agg(F.sum("error").alias("error")).groupBy("key").agg(F.sum("error").alias("label_error"))
    return salted_join(coded, sums, "key").select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _coded(rows: DataFrame, books: np.ndarray) -> DataFrame:
    parts, sent = len(books), send_out(rows.sparkSession, books)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = received(sent)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = np.split(_matrix(batch.column("x"), n, np.int64), parts, axis=1)
            first = _matrix(batch.column("near"), n, np.uint8).reshape(n, parts, -1)[:, :, 0]
            error = sum(((x[p] - books[p][first[:, p]]) ** 2).sum(1) for p in range(parts))
            codes = pa.array([bytes(row).hex() for row in first], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), codes, pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    return rows.select("vec_id", "label", "x", "near").mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def op11_adaptive_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql(parts: int = 4, rounds: int = 4) -> str:
    """The same rounds with every distance measured."""
    steps = [f"""
v AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda c: floor({SCALE} * c::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = len(embedding)
), p AS MATERIALIZED (
  SELECT vec_id, label, q, x[q * (len(x) // {parts}) + 1 : (q + 1) * (len(x) // {parts})] AS x FROM v, range({parts}) AS r(q)
), b0 AS MATERIALIZED (
  SELECT q, row_number() OVER (PARTITION BY q ORDER BY vec_id) - 1 AS e, x AS y FROM p
  QUALIFY e < 256
)"""]
    for r in range(rounds + 1):
        steps.append(f"""
d{r} AS MATERIALIZED (
  SELECT vec_id, label, q, x, min({{'d': list_sum(list_transform(list_zip(x, y), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'e': e}}) AS a
  FROM p JOIN b{r} USING (q) GROUP BY ALL
)""")
        if r < rounds:
            steps.append(f"""
s{r} AS (
  SELECT q, e, i, sum(c)::BIGINT AS s, count(*) AS n FROM (SELECT q, a.e AS e, unnest(x) AS c, unnest(range(len(x))) AS i FROM d{r}) GROUP BY ALL
), m{r} AS (
  SELECT q, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS y FROM s{r} GROUP BY q, e
), b{r + 1} AS MATERIALIZED (
  SELECT q, e, coalesce(m.y, b.y) AS y FROM b{r} b LEFT JOIN m{r} m USING (q, e)
)""")
    return f"""
WITH {",".join(steps)},
h AS (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY q, e)) AS codebooks_sha256 FROM b{rounds}),
c AS (
  SELECT vec_id, label, string_agg(format('{{:02x}}', a.e), '' ORDER BY q) AS code, sum(a.d)::BIGINT AS error FROM d{rounds} GROUP BY vec_id, label
)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM c, h
"""


QUERIES = {"op11_adaptive_bounds": op11_adaptive_bounds}
ORACLES = {"op11_adaptive_bounds": _sql()}
