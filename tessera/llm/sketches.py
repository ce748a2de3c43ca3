"""Document fingerprints by a threshold-scaled sketch of word shingles.

All hashes below a fixed fraction of the hash range are kept, however long the text. So the sketch
of a union is the union of sketches, and what two sketches share estimates containment even where
one text is many times the other. Where that fraction holds very few hashes of a short text it is
doubled until it holds enough, and the sketch says so.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import documents, text_or_empty

#: Words of a shingle, halvings of the hash range below which hashes are kept (an eighth), least number kept where there are more.
WORDS, HALVINGS, LEAST = 5, 3, 16
#: Rows that a range of ids is meant to hold, most ranges.
RANGE_ROWS, MAX_RANGES = 1024, 16384
_RANGE = 1 << 40
_MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_MIX[1])
    return x ^ (x >> np.uint64(31))


@dataclass
class Sketch:
    """A text's shingle hashes below the share 2^-halvings of their range, sorted and unique."""

    kept: np.ndarray
    halvings: int

    def below(self, halvings: int) -> np.ndarray:
        """Those of the hashes that a narrower share keeps too."""
        return self.kept[: np.searchsorted(self.kept, np.uint64(_RANGE >> halvings))]

    def written(self) -> str:
        """The halvings, a colon, and 10 hex digits a kept hash, ascending; '' for a text without words."""
        return f"{self.halvings}:" + "".join(f"{h:010x}" for h in self.kept.tolist()) if len(self.kept) else ""


def _scaled(every: np.ndarray, halvings: int) -> Sketch:
    """The fixed share, or for a text of few shingles the first of its doubles that keeps LEAST of them, and in the end all."""
    for h in range(halvings, 0, -1):
        if np.searchsorted(every, np.uint64(_RANGE >> h)) >= LEAST:
            return Sketch(every[: np.searchsorted(every, np.uint64(_RANGE >> h))], h)
    return Sketch(every, 0)


def sketch(text: str | None, words: int = WORDS, halvings: int = HALVINGS) -> Sketch:
    """The text's 40-bit shingle hashes. A text of fewer words is one shingle; only a text without words has none."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return Sketch(np.zeros(0, np.uint64), 0)
    codes = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))
    span = min(words, len(codes))
    rolled = np.full(len(codes) - span + 1, span, np.uint64)
    for k in range(span):
        rolled = rolled * np.uint64(_MIX[2]) + codes[k : len(codes) - span + 1 + k]
    return _scaled(np.unique(_mixed(rolled) >> np.uint64(24)), halvings)


def read(written: str) -> Sketch:
    """A sketch from its written form."""
    if not written:
        return Sketch(np.zeros(0, np.uint64), 0)
    halvings, digits = written.split(":")
    return Sketch(np.array([int(digits[i : i + 10], 16) for i in range(0, len(digits), 10)], np.uint64), int(halvings))


def merged(a: Sketch, b: Sketch) -> Sketch:
    """The sketch of both texts' shingles together, at the narrower of their shares."""
    if not len(a.kept) or not len(b.kept):
        return a if len(a.kept) else b
    halvings = max(a.halvings, b.halvings)
    return Sketch(np.union1d(a.below(halvings), b.below(halvings)), halvings)


def likeness(a: Sketch, b: Sketch) -> float:
    """Share of the sketch of fewer hashes that is in the other, of hashes below the narrower of their shares.

    It estimates how much of the shorter text the longer one contains, and needs what the fingerprints say only. 1 for two empty
    sketches, 0 if one is empty. If a short text has no hash below the narrower share, nothing tells
    them alike: 0.
    """
    if not len(a.kept) or not len(b.kept):
        return float(len(a.kept) == len(b.kept))
    halvings = max(a.halvings, b.halvings)
    x, y = a.below(halvings), b.below(halvings)
    return len(np.intersect1d(x, y, assume_unique=True)) / min(len(x), len(y)) if len(x) and len(y) else 0.0


def fingerprints(docs: DataFrame, words: int = WORDS, halvings: int = HALVINGS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles kept and fingerprint for every row; null text counts as empty, whose fingerprint is ''."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sketch(t, words, halvings) for t in batch.column(1).to_pylist()]
            columns = [batch.column(0), pa.array([len(s.kept) for s in found], pa.int64()), pa.array([s.written() for s in found], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_kept", "fingerprint"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(work, "doc_id long, n_kept long, fingerprint string")


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", range_rows: int = RANGE_ROWS) -> DataFrame:
    """Rows dealt into ranges of ids: rng, doc_id, text, follows. In a range, sorted by (follows, doc_id desc, text),
    the row behind each is the next document in descending order of id; the last one, with follows 1,
    is a copy of the first row of the next range and only serves as its predecessor's next.

    The bounds are quantiles of the ids, at most MAX_RANGES; only they and one id per range reach the driver.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    n = max(1, min(MAX_RANGES, -(-rows.count() // range_rows)))
    bounds = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 10 * n)).first()[0] or []
    splits = [-float("inf"), *sorted({float(b) for b in bounds}), float("inf")]
    if len(splits) == 2:  # one range: there are no ids, or one
        dealt = rows.select(F.lit(0).alias("rng"), "doc_id", "text")
    else:
        cut = Bucketizer(splits=splits, inputCol="__at", outputCol="__rng", handleInvalid="keep")
        dealt = cut.transform(rows.withColumn("__at", F.col("doc_id").cast("double"))).select(
            F.when(F.col("doc_id").isNull(), -1).otherwise(F.col("__rng")).cast("int").alias("rng"), "doc_id", "text"
        )
    heads = sorted((tuple(r) for r in dealt.groupBy("rng").agg(F.max("doc_id")).collect()), reverse=True)
    after = [(rng, head, heads[i - 1][0]) for i, (rng, head) in enumerate(heads)]  # the first range's head follows the last range
    heads_df = docs.sparkSession.createDataFrame(after, "rng int, head long, target int")
    first = dealt.join(F.broadcast(heads_df), "rng").where(F.col("doc_id").eqNullSafe(F.col("head")))
    return dealt.withColumn("follows", F.lit(0)).unionByName(
        first.select(F.col("target").alias("rng"), "doc_id", "text", F.lit(1).alias("follows"))
    )


_EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def against_edits(docs: DataFrame, words: int = WORDS, halvings: int = HALVINGS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every row's text and of its edited text, and their likeness to each other and the next row's.

    The edited text: the last third of its code points (rounded down) replaced by the first as many of
    the next document in descending order of id; after the last comes the first. Among rows of one id
    the order is that of the texts. Null text is empty; null ids come last. A table of one row
    is its own next. Empty table: empty result. Other columns are ignored.
    """

    names = _EDITED.replace(" long", "").replace(" string", "").replace(" double", "").split(", ")
    kinds = [{"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[c.split()[1]] for c in _EDITED.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None  # (range, id, text, sketch) whose next row is still to come
        for batch in batches:
            out = []
            for rng, doc_id, text, follows in zip(*[batch.column(c).to_pylist() for c in ("rng", "doc_id", "text", "follows")], strict=True):
                own = sketch(text, words, halvings)
                if waiting is not None and waiting[0] == rng:
                    _, before_id, before, before_sketch = waiting
                    third = len(before) // 3
                    edited = before[: len(before) - third] + text[:third]
                    changed = sketch(edited, words, halvings)
                    out.append((
                        before_id, len(before), hashlib.sha256(edited.encode()).hexdigest(), before_sketch.written(), changed.written(),
                        likeness(before_sketch, changed), likeness(before_sketch, own),
                    ))
                waiting = None if follows else (rng, doc_id, text, own)
            columns = list(zip(*out, strict=True)) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    ranged = with_next(docs, id_col, text_col)
    return (
        ranged.repartition("rng")
        .sortWithinPartitions("rng", "follows", F.col("doc_id").desc_nulls_last(), "text")
        .mapInArrow(work, _EDITED)
    )


def op6_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return against_edits(documents(spark, sf_dir))


QUERIES = {"op6_scaled_sketch": op6_scaled_sketch}
ORACLES: dict[str, str] = {}
