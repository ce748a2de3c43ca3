"""SimHash near-dedup with pigeonring filtering.

Fingerprints of 64 bits are cut into segments on a ring. If two differ in at most t bits, then from
some segment on, every chain of l consecutive segments differs in at most l*t/segments bits. The
chain's first links have a budget below one bit: they must be equal and are the join key. The
longer chains, then the whole distance, are checked inside the join, so only links come out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import documents, forget, materialise, salt, salted_join
from tessera.llm.graph import connected_components

BITS = 64
#: A bucket of more fingerprints than this is linked through common neighbours, not pair by pair.
BUCKET = 64


def fingerprint(text: str | None, words: int) -> int:
    """Signed 64-bit SimHash of the word shingles of text; 0 without words."""
    parts = (text or "").encode().lower().split()  # on bytes both touch ASCII only
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        spans = [(0, len(joined))]
    else:
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        spans = zip(starts[: len(parts) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)
    view, digest = memoryview(joined), xxhash.xxh64_intdigest
    hashes = np.array([digest(view[i:j], 42) for i, j in spans], np.uint64)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # long texts in slices: memory stays bounded
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp for every row; null text counts as empty."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = pa.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), prints], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(work, "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class Ring:
    """Segments of the ring for a distance, and the masks and budgets of its chains."""

    def __init__(self, distance: int, segments: int | None = None):
        self.distance, self.segments = distance, segments or 2 * distance + 1
        if not distance < self.segments <= BITS:
            raise ValueError("more segments than the distance, and at most 64, are needed")
        cuts = [round(i * BITS / self.segments) for i in range(self.segments + 1)]
        self.masks = [((1 << cuts[i + 1]) - 1) ^ ((1 << cuts[i]) - 1) for i in range(self.segments)]
        self.first = max(l for l in range(1, self.segments + 1) if self.budget(l) == 0 or l == 1)

    def budget(self, length: int) -> int:
        return length * self.distance // self.segments

    def chain(self, start: int, length: int) -> int:
        mask = 0
        for i in range(start, start + length):
            mask |= self.masks[i % self.segments]
        return mask

    def viable(self, start: int, a: Column, b: Column) -> Column:
        """Whether every chain from start on, up to the whole ring, is within its budget."""
        differing, passes = a.bitwiseXOR(b), F.lit(True)
        for length in range(self.first + 1, self.segments + 1):
            passes = passes & (F.bit_count(differing.bitwiseAND(F.lit(_signed(self.chain(start, length))))) <= self.budget(length))
        return passes


def links(prints: DataFrame, distance: int = 2, segments: int | None = None, bucket: int = BUCKET) -> DataFrame:
    """prints(fp), distinct -> (a, b): links that connect all fingerprints at the distance or less.

    Small buckets give every linked pair. In a bucket of more than `bucket` fingerprints, at distances
    2 and 3, each meets its neighbours: all values in reach of half the distance. Two fingerprints are
    linked exactly when one is within the lower half of a value and the other within the upper half,
    so all in reach of a value are tied to the least of those nearest it. Nothing is lost, and n
    fingerprints give n times a fixed number of rows, not n squared. At other distances all
    buckets go by pairs.
    """
    ring = Ring(distance, segments)
    heads = [ring.chain(i, ring.first) for i in range(ring.segments)]
    keys = prints.select(
        "fp", F.explode(F.array(*[F.struct(F.lit(i).alias("turn"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("head")) for i, m in enumerate(heads)])).alias("k")
    ).select("fp", "k.turn", "k.head")
    sizes = keys.groupBy("turn", "head").agg(F.count("*").alias("n")).where("n > 1")
    keys = materialise(keys.join(sizes, ["turn", "head"]), "buckets")
    star = distance in (2, 3)
    cold = keys.where(F.col("n") <= bucket) if star else keys
    a, b = cold.alias("a"), cold.alias("b")
    near = F.lit(False)
    for i in range(ring.segments):
        near = near | ((F.col("a.turn") == i) & ring.viable(i, F.col("a.fp"), F.col("b.fp")))
    found = a.join(
        b, (F.col("a.turn") == F.col("b.turn")) & (F.col("a.head") == F.col("b.head")) & (F.col("a.fp") < F.col("b.fp")) & near
    ).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))
    if star:
        low, high = distance // 2, distance - distance // 2
        balls = []
        for turn, mask in enumerate(heads):
            free = [1 << bit for bit in range(BITS) if not mask >> bit & 1]
            for radius in range(high + 1):
                balls += [(turn, _signed(sum(flip)), radius <= low) for flip in combinations(free, radius)]
        masks = prints.sparkSession.createDataFrame(balls, "turn int, mask long, inner boolean")  # a fixed table
        hot = keys.where(F.col("n") > bucket).join(F.broadcast(masks), "turn")
        met = hot.groupBy("turn", F.col("fp").bitwiseXOR(F.col("mask")).alias("centre")).agg(
            F.min(F.when(F.col("inner"), F.col("fp"))).alias("a"), F.collect_list("fp").alias("near")
        )
        tied = met.where(F.col("a").isNotNull() & (F.size("near") > 1)).select("a", F.explode("near").alias("b")).where("a <> b")
        found = found.unionByName(tied)
    return found.distinct()


def _components(prints: DataFrame, distance: int, bucket: int) -> DataFrame:
    """(fp, component_id) of prints(doc_id, fp)."""
    nodes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    parts = connected_components(links(nodes.select("fp"), distance, bucket=bucket))
    homes = nodes.join(parts.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component"), salt("fp"))
    least = homes.groupBy("component").agg(F.min("first").alias("component_id"))
    return salted_join(homes, least, "component").select("fp", "component_id")


def near_duplicates(
    docs: DataFrame, words: int = 3, distance: int = 2, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET
) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable) for every row.

    Null and empty texts have fingerprint zero and are linked like any other. Rows with equal
    fingerprints form one node however many they are; only distinct fingerprints are joined.
    Repeated rows and ids are kept. Empty table: empty result. Other columns are ignored.
    """
    prints = materialise(fingerprints(docs, words, id_col, text_col), "prints")
    named = _components(prints, distance, bucket)
    return salted_join(prints.withColumn("salt", salt("doc_id")), named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, words: int, distance: int, bucket: int = BUCKET) -> DataFrame:
    """The rows of docs that are the first of their component, with all their columns.

    Only ids and fingerprints take part; of the rows of a repeated doc_id all stay. Null ids form
    no group of their own: such a row goes if a row with an id is in its component.
    """
    prints = materialise(fingerprints(docs, words), "prints")
    named = _components(prints, distance, bucket)
    gone = prints.join(named, "fp").where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__gone"))
    gone = materialise(gone.distinct(), "gone")
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["__gone"]), "left_anti")


# --- groups of a given similarity: keys of least hashes, wide fingerprints, exact sets ------------------

#: Lanes of 64 bits of a wide fingerprint; keys of a text, and least hashes in a key.
LANES, KEYS, ROWS = 6, 25, 5
#: Slots of a shingle set's parities, a power of two: it rules out most pairs under the similarity among texts of up to some 500 shingles.
PARITIES = 1024
_ODD = 0x9E3779B97F4A7C15
_SEEDS = np.random.default_rng(42).integers(0, 1 << 64, (2, KEYS * ROWS, 1), dtype=np.uint64)
_MIX = _SEEDS[1] | np.uint64(1)


def _hashes(parts: list[bytes], words: int) -> np.ndarray:
    """A 64-bit hash of every shingle; a shorter text is one shingle."""
    codes = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))
    span = min(words, len(codes))
    hashes = np.full(len(codes) - span + 1, span, np.uint64)
    for k in range(span):
        hashes = hashes * np.uint64(_ODD) + codes[k : len(codes) - span + 1 + k]
    return hashes


def _parts(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def _fingerprint_of(hashes: np.ndarray, lanes: int) -> list[int]:
    found = []
    for lane in range(lanes):
        mixed = (hashes ^ (hashes >> np.uint64(30))) * np.uint64((0xBF58476D1CE4E5B9 + 2 * lane * _ODD) % (1 << 64))
        mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        mixed ^= mixed >> np.uint64(31)
        ones = np.zeros(BITS, np.int64)
        for at in range(0, len(mixed), 1 << 16):
            part = mixed[at : at + (1 << 16)]
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        found.append(int(np.packbits(ones * 2 > len(mixed), bitorder="little").view(np.int64)[0]))
    return found


def wide_fingerprint(text: str | None, words: int, lanes: int = LANES) -> list[int]:
    """Signed lanes of a SimHash of 64 bits each: every lane mixes the shingles' hashes anew. All 0 without words."""
    parts = _parts(text)
    return _fingerprint_of(_hashes(parts, words), lanes) if parts else [0] * lanes


def distance_of(similarity: float, bits: int) -> int:
    """Expected number of differing bits of two shingle sets of the Jaccard similarity."""
    return round(bits * math.acos(2 * similarity / (1 + similarity)) / math.pi)


def reach_of(similarity: float, bits: int) -> int:
    """distance_of and four deviations: of pairs of the similarity, 1 in 30,000 differs in more bits."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.ceil(bits * share + 4 * math.sqrt(bits * share * (1 - share)))


def join_keys(hashes: np.ndarray) -> np.ndarray:
    """KEYS keys of ROWS least hashes each: two sets of Jaccard similarity s have a key in common but for (1 - s^ROWS)^KEYS."""
    least = np.full(KEYS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 4096):
        np.minimum(least, ((hashes[at : at + 4096] ^ _SEEDS[0]) * _MIX).min(1), out=least)
    keys = np.zeros(KEYS, np.uint64)
    for row in least.reshape(KEYS, ROWS).T:
        keys = (keys ^ (keys >> np.uint64(29))) * np.uint64(_ODD) + row
    return keys.view(np.int64)


def _described(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, seen (hash of the text), node (hash of its words), size of the shingle set, fp and keys for every row."""

    def one(text: str | None) -> tuple:
        parts = _parts(text)
        if not parts:
            return 0, 0, [0] * LANES, np.zeros(0, np.int64)
        every = _hashes(parts, words)
        unique = np.unique(every)
        node = xxhash.xxh3_64_intdigest(b" ".join(parts))
        return _signed(node), len(unique), _fingerprint_of(every, LANES), join_keys(unique)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        long, longs = pa.int64(), pa.list_(pa.int64())
        for batch in batches:
            node, size, fp, keys = zip(*[one(t) for t in batch.column(1).to_pylist()], strict=True) if batch.num_rows else ((), (), (), ())
            found = [pa.array(node, long), pa.array(size, long), pa.array(fp, longs), pa.array(keys, longs)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *found], ["doc_id", "seen", "node", "size", "fp", "keys"])

    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("seen"))
    return rows.mapInArrow(work, "doc_id long, seen long, node long, size long, fp array<long>, keys array<long>")


def _parities(shingles: np.ndarray) -> np.ndarray:
    """For each of PARITIES slots whether an odd number of the set's shingles falls in it, in words of 64 bits."""
    slots = np.bincount(shingles.view(np.uint64) >> np.uint64(BITS - PARITIES.bit_length() + 1), minlength=PARITIES) & 1
    return np.packbits(slots.astype(np.uint8), bitorder="little").view(np.int64)


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(node, shingles, odd) of wanted(node, seen): one set and its parities for a node, however many rows have its text."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [np.unique(_hashes(_parts(t), words)) for t in batch["text"]]
            yield pd.DataFrame({"node": batch["node"], "shingles": [s.view(np.int64) for s in sets], "odd": [_parities(s) for s in sets]})

    rows = docs.select("text", F.xxhash64("text").alias("seen")).join(wanted, "seen").groupBy("node").agg(F.min("text").alias("text"))
    return rows.mapInPandas(work, "node long, shingles array<long>, odd array<long>")


def _apart(x: str, y: str, lanes: Iterable[int] = range(LANES)) -> Column:
    """Differing bits of two wide fingerprints, in the lanes."""
    return sum((F.bit_count(F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i)))) for i in lanes), F.lit(0))


def _within(x: str, y: str, reach: int) -> Column:
    """Whether two wide fingerprints differ in at most `reach` bits, with the lanes as the ring's segments.

    Some lane begins only chains within their share of the reach; a pair without such a lane is ruled out by
    single lanes and short chains, mostly by the first ones. The whole ring is the longest chain.
    """
    found = F.lit(False)
    for start in range(LANES):
        passes = F.lit(True)
        for length in range(1, LANES + 1):
            passes = passes & (_apart(x, y, [i % LANES for i in range(start, start + length)]) <= length * reach // LANES)
        found = found | passes
    return found


def _few_apart(x: str, y: str, sizes: Column, similarity: float) -> Column:
    """Whether the parities leave the similarity possible; no pair that has it is ruled out.

    A slot in which two sets differ holds a shingle that only one of them has, and of those a pair of the similarity s
    has at most a share (1 - s) / (1 + s) of both sizes.
    """
    slots = sum((F.bit_count(F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i)))) for i in range(PARITIES // BITS)), F.lit(0))
    return slots <= sizes * ((1 - similarity) / (1 + similarity)) + 1e-6


def similar_links(docs: DataFrame, nodes: DataFrame, words: int, similarity: float, bucket: int = BUCKET, tile: int = 1024) -> DataFrame:
    """Links (a, b) that connect all nodes of the similarity or more and no others; what they rest on is checked on the two shingle sets.

    nodes(node, seen, size, fp, keys). Candidates have a key in common. Each node of a key is first compared with the
    most central one, whose keys have the most nodes: a text that others were made from keeps more of its least hashes
    than they do. Then it is compared with the nearest that isn't connected to it yet, and then with all that still aren't:
    what is connected needs no comparison, so large groups don't cost all their pairs. Of the keys that two nodes share only the
    first makes them a candidate. Keys of more than `bucket` nodes are cut into tiles of `tile` by `tile`. Fingerprints
    only rule out pairs four deviations beyond the similarity, parities of the sets only pairs that don't have it: what isn't
    connected is compared inside the join, but few pairs come out of it that are no links.
    """
    keys = nodes.select("node", F.posexplode("keys").alias("turn", "head"))
    sizes = keys.groupBy("turn", "head").agg(F.count("*").alias("n")).where("n > 1")
    counted = materialise(keys.join(sizes, ["turn", "head"]), "counted")
    held = counted.groupBy("node").agg(F.sum("n").alias("held"))
    centres = counted.join(held, "node").groupBy("turn", "head").agg(F.max_by("node", F.struct("held", "node")).alias("centre"))
    shared = materialise(counted.join(centres, ["turn", "head"]), "shared")
    forget(counted)
    slim = nodes.select("node", "size", "fp")
    sets = materialise(_sets(docs, shared.select("node").distinct().join(nodes.select("node", "seen"), "node"), words), "sets")
    reach = reach_of(similarity, LANES * BITS)

    def near() -> Column:
        shorter, longer = F.least("x.size", "y.size"), F.greatest("x.size", "y.size")
        return (shorter / longer >= similarity) & _within("x.fp", "y.fp", reach)

    def checked(pairs: DataFrame, label: str) -> DataFrame:
        x, y = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
        both = pairs.join(x, "a").join(y, "b").withColumn("common", F.size(F.array_intersect("sa", "sb")))
        alike = F.col("common") / (F.size("sa") + F.size("sb") - F.col("common")) >= similarity
        return materialise(both.where(alike).select("a", "b").distinct(), label)

    def open_nodes(parts: DataFrame) -> DataFrame:
        """The nodes of every key that parts(node, component) don't connect, with the tiles that they belong to."""
        placed = shared.drop("centre").join(parts, "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component")
        mixed = placed.groupBy("turn", "head").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p <> q").select("turn", "head")
        rest = placed.join(mixed, ["turn", "head"]).join(nodes.select("node", "size", "fp", "keys"), "node").join(sets.select("node", "odd"), "node")
        tiles = F.when(F.col("n") > bucket, F.ceil(F.col("n") / tile)).otherwise(1).cast("int")
        rest = rest.withColumn("tiles", tiles).withColumn("own", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
        rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        rest = rest.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))
        earlier = F.slice("keys", F.lit(1), F.col("turn")).alias("earlier")
        return materialise(rest.select("turn", "head", "low", "high", "own", "node", "part", "size", "fp", "odd", earlier), "rest")

    def candidates(rest: DataFrame) -> DataFrame:
        """(a, b, apart) of open_nodes(), each pair once: at the first key that it shares, and of one tile in that tile alone."""
        x, y = rest.alias("x"), rest.alias("y")
        same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("turn", "head", "low", "high")]
        other = (F.col("x.part") != F.col("y.part")) & (F.col("x.node") < F.col("y.node"))
        first = ~F.exists(F.zip_with("x.earlier", "y.earlier", lambda p, q: p == q), lambda hit: hit)
        once = (F.col("x.own") != F.col("y.own")) | (F.col("x.low") == F.col("x.high"))
        alike = near() & _few_apart("x.odd", "y.odd", F.col("x.size") + F.col("y.size"), similarity)
        found = x.join(y, same[0] & same[1] & same[2] & same[3] & other & once & alike & first)
        return found.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), _apart("x.fp", "y.fp").alias("apart"))

    def as_links(parts: DataFrame) -> DataFrame:
        return parts.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))

    stars = shared.where("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    x, y = slim.alias("x"), slim.alias("y")
    stars = stars.join(x, F.col("a") == F.col("x.node")).join(y, F.col("b") == F.col("y.node")).where(near()).select("a", "b")
    links = checked(stars, "stars")
    parts = connected_components(links)
    forget(links)
    for label, chosen in (
        ("nearest", lambda pairs: pairs.groupBy("a").agg(F.min_by("b", "apart").alias("b"))),
        ("others", lambda pairs: pairs.select("a", "b").distinct()),
    ):
        rest = open_nodes(parts)
        found = checked(chosen(candidates(rest)), label)
        forget(rest)
        links = as_links(parts).unionByName(found)  # what is connected already comes as stars, not as all its links
        if label == "nearest":
            parts = connected_components(links)
            forget(found)
    forget(shared)
    forget(sets)
    return links


def keep_first_similar(docs: DataFrame, words: int = 5, similarity: float = 0.8, bucket: int = BUCKET) -> DataFrame:
    """The rows of docs that have the smallest doc_id of their group, with all their columns.

    A group is connected by pairs whose sets of shingles have the Jaccard similarity or more. Null and empty
    texts are one group. Of the rows of a repeated doc_id all stay or go; a null id goes if its group has another.
    """
    prints = materialise(_described(docs, words), "prints")
    nodes = prints.groupBy("node").agg(F.min("doc_id").alias("first"), F.any_value(F.struct("seen", "size", "fp", "keys")).alias("of"))
    nodes = materialise(nodes.select("node", "first", "of.*"), "nodes")
    parts = connected_components(similar_links(docs, nodes, words, similarity, bucket))
    homes = nodes.select("node", "first").join(parts, "node", "left").select("node", "first", F.coalesce("component", "node").alias("component"), salt("node"))
    least = homes.groupBy("component").agg(F.min("first").alias("keep"))
    named = salted_join(homes, least, "component").select("node", "keep")
    gone = salted_join(prints.select("doc_id", "node", salt("doc_id")), named, "node").where(~F.col("doc_id").eqNullSafe(F.col("keep"))).select(F.col("doc_id").alias("__gone"))
    gone = materialise(gone.distinct(), "gone")
    forget(prints)
    forget(nodes)
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["__gone"]), "left_anti")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


QUERIES = {"op1_simhash": op1_simhash}
ORACLES: dict[str, str] = {}
