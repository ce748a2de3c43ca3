"""Removal of repeated byte strings with suffix arrays built by induced sorting.

A string of SPAN bytes has a representative inside it: its least K-byte gram by hash. Equal strings
have equal representatives, so all occurrences of a string meet in the shard of that gram. Grams
that occur in one document only are left out early. In a shard, different surroundings of a gram
are laid side by side and sorted as suffixes; runs of common prefixes of SPAN bytes are equal
strings, and the least doc_id of a run decides for all its members.

Surroundings move once, packed into one compressed block for each task and shard, and carry the places they came
from; what is compared in a shard are their bytes, never hashes of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import documents

SPAN, K = 50, 20
#: Bytes of text for which there is one shard, least number of shards, bytes of one suffix array.
SHARD_TEXT, LEAST_SHARDS, _SHARD = 16 << 20, 16, 1 << 20
#: Occurrences from which a gram's surroundings are dealt by their own strings.
HOT = 100_000
#: Most bits of the filter of repeated grams, which is broadcast: 128 MB.
MAX_FILTER_BITS = 1 << 30
#: Bytes worked on at once, and entries (of the filter) or bytes (of surroundings) that a task holds before it passes them on.
_PIECE, _HELD = 1 << 20, 1 << 21
#: Bits of a place in a block of pieces, and of the length of a span where start and length are one number.
_BITS = 22
_C = 0x9E3779B97F4A7C15
_LOW = np.uint64(0xFFFFFFFF)


# --- suffix arrays --------------------------------------------------------------------------------


def _types(s: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one; the last symbol is the sentinel, and smaller."""
    n = len(s)
    differs = np.flatnonzero(s[:-1] != s[1:])
    at = np.searchsorted(differs, np.arange(n - 1))
    decided = differs[np.minimum(at, len(differs) - 1)]  # the last symbol differs from all others
    return np.append(s[decided] < s[decided + 1], True)


def _deal(into: np.ndarray, place: np.ndarray, chars: np.ndarray, items: np.ndarray, step: int) -> None:
    """Append items to their characters' buckets in order; place has each bucket's next free slot and moves by step."""
    order = np.argsort(chars, kind="stable")
    chars, items = chars[order], items[order]
    first = np.flatnonzero(np.append(True, chars[1:] != chars[:-1]))
    size = np.diff(np.append(first, len(chars)))
    nth = np.arange(len(chars)) - np.repeat(first, size)
    into[place[chars] + step * nth] = items
    place[chars[first]] += step * size


def _induce(s: np.ndarray, smaller: np.ndarray, lms: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Suffix array from leftmost-smaller suffixes in order: larger ones from the left, then smaller ones from the right.

    A bucket is worked off in waves: what it puts into itself is the next wave.
    """
    ends = np.cumsum(sizes)
    starts = ends - sizes
    sa = np.full(len(s), -1, np.int64)
    tail = ends - 1
    _deal(sa, tail, s[lms][::-1], lms[::-1], -1)
    seeds = [sa[tail[c] + 1 : ends[c]].copy() for c in range(len(sizes))]
    head = starts.copy()
    for c in range(len(sizes)):
        done = starts[c]
        while True:
            wave = sa[done : head[c]]
            done = head[c]
            if not len(wave):
                break
            wave = wave[wave > 0] - 1
            wave = wave[~smaller[wave]]
            if len(wave):
                _deal(sa, head, s[wave], wave, 1)
        wave = seeds[c]
        wave = wave[wave > 0] - 1
        wave = wave[~smaller[wave]]
        if len(wave):
            _deal(sa, head, s[wave], wave, 1)
    tail = ends - 1
    for c in range(len(sizes) - 1, -1, -1):
        done = ends[c]
        while True:
            wave = sa[tail[c] + 1 : done][::-1]
            done = tail[c] + 1
            if not len(wave):
                break
            wave = wave[wave > 0] - 1
            wave = wave[smaller[wave]]
            if len(wave):
                _deal(sa, tail, s[wave], wave, -1)
        wave = sa[starts[c] : head[c]][::-1]
        wave = wave[wave > 0] - 1
        wave = wave[smaller[wave]]
        if len(wave):
            _deal(sa, tail, s[wave], wave, -1)
    return sa


def _induce_many(s: np.ndarray, smaller: np.ndarray, lms: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """As _induce, symbol by symbol: for strings of names, whose buckets are many and small."""
    ends = np.cumsum(sizes)
    heads, tails = (ends - sizes).tolist(), (ends - 1).tolist()
    before = np.append(-1, s[:-1])  # the symbol before each suffix, if that suffix is to be induced from this one
    larger = np.append(np.where(np.append(True, smaller[:-1]), -1, before), -1).tolist()  # [-1] is for empty places
    less = np.where(np.append(False, smaller[:-1]), before, -1).tolist()
    sa = [-1] * len(s)
    for i, c in zip(lms[::-1].tolist(), s[lms[::-1]].tolist(), strict=True):
        sa[tails[c]] = i
        tails[c] -= 1
    for i in sa:  # sees what is put in further on
        c = larger[i]
        if c >= 0:
            sa[heads[c]] = i - 1
            heads[c] += 1
    tails = (ends - 1).tolist()
    for i in reversed(sa):
        c = less[i]
        if c >= 0:
            sa[tails[c]] = i - 1
            tails[c] -= 1
    return np.array(sa, np.int64)


def _sorted_suffixes(s: np.ndarray, symbols: int) -> np.ndarray:
    """Suffix array of a string of integers below `symbols` that ends in a 0 found nowhere else in it."""
    n = len(s)
    if n == 1:
        return np.zeros(1, np.int64)
    smaller = _types(s)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    sizes = np.bincount(s, minlength=symbols)
    induce = _induce if symbols * 64 <= n else _induce_many
    if len(lms) > 1:
        sa = induce(s, smaller, lms, sizes)
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        sorted_lms = sa[is_lms[sa]]
        length = np.empty(n, np.int64)
        length[lms] = np.diff(np.append(lms, n - 1)) + 1
        a, b = sorted_lms[:-1], sorted_lms[1:]
        same = length[a] == length[b]
        at, live = 0, np.flatnonzero(same)
        while len(live):
            equal = s[a[live] + at] == s[b[live] + at]
            same[live[~equal]] = False
            at += 1
            live = live[equal]
            live = live[length[a[live]] > at]
        name = np.empty(n, np.int64)
        name[sorted_lms] = np.cumsum(np.append(0, ~same))
        names = name[lms]
        different = int(names.max()) + 1
        lms = lms[np.argsort(names) if different == len(lms) else _sorted_suffixes(names, different)]
    return induce(s, smaller, lms, sizes)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of all suffixes of a byte array in order.

    Leftmost-smaller substrings are sorted by a first induction and named; the string of names, half as long
    or less, is sorted in the same way, and a second induction sorts everything: linear in all.
    """
    return _sorted_suffixes(np.append(text.astype(np.int64) + 1, 0), 257)[1:]


def common_prefixes(text: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """Permuted common prefixes: for each start in text order, the bytes shared with the suffix sorted before it, `most` at most."""
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    padded = np.append(text, np.zeros(most + 16, np.uint8))
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)[: n + most + 8]
    words = np.ascontiguousarray(words).view("<u8").reshape(-1)
    shared = np.zeros(n, np.int64)
    live = np.flatnonzero(before >= 0)
    for at in range(0, most, 8):
        apart = words[live + at] ^ words[before[live] + at]
        ends, apart = live[apart != 0], apart[apart != 0]
        lowest = (apart & (~apart + np.uint64(1))).astype(np.float64)  # a power of two: its place tells the first byte that differs
        shared[ends] = at + np.log2(lowest).astype(np.int64) // 8
        going = np.ones(len(live), bool)
        going[np.searchsorted(live, ends)] = False
        live = live[going]
    shared[live] = most
    return np.minimum(np.minimum(shared, most), np.minimum(n - np.arange(n), n - before))


# --- representatives ------------------------------------------------------------------------------


def _grams(data: np.ndarray) -> np.ndarray:
    """64-bit hashes of all K-byte grams, by doubling."""
    c = _C
    power = lambda n: np.uint64(pow(c, n, 1 << 64))
    h1 = data.astype(np.uint64) + np.uint64(1)
    h2 = h1[:-1] * power(1) + h1[1:]
    h4 = h2[:-2] * power(2) + h2[2:]
    h8 = h4[:-4] * power(4) + h4[4:]
    h16 = h8[:-8] * power(8) + h8[8:]
    h = h16[:-4] * power(4) + h4[16:]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def segments(pieces: list[bytes]) -> tuple[np.ndarray, ...]:
    """(piece, start, end, place of the representative, its hash) of each stretch of strings with one representative, and all
    bytes; places count in all bytes, end is exclusive. Strings stay within their piece."""
    data = np.frombuffer(b"".join(pieces), np.uint8)
    size = np.array([len(p) for p in pieces], np.int64)
    none = np.zeros(0, np.int64)
    if len(data) < SPAN:
        return none, none, none, none, none, data
    h = _grams(data)
    bits = np.uint64(_BITS)  # a block is shorter; the same for all blocks, so that ties fall alike
    key = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64)
    for step in (1, 2, 4, 8):
        key = np.minimum(key[:-step], key[step:])
    key = np.minimum(key[:-15], key[15:])  # least of 31 grams, the leftmost of equals
    spot = (key & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
    ends = np.cumsum(size)
    open_ = np.zeros(len(data) + 1, np.int64)
    long = size >= SPAN
    np.add.at(open_, (ends - size)[long], 1)
    np.add.at(open_, (ends - SPAN + 1)[long], -1)
    windows = np.flatnonzero(np.cumsum(open_)[: len(spot)] > 0)
    if not len(windows):
        return none, none, none, none, none, data
    spots = spot[windows]
    new = np.append(True, (spots[1:] != spots[:-1]) | (windows[1:] != windows[:-1] + 1))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(windows)) - 1
    start, end = windows[first], windows[last] + SPAN
    least = h[spots[first]]  # least hashes aren't spread evenly: mixed once more
    least = (least ^ (least >> np.uint64(32))) * np.uint64(_C)
    least ^= least >> np.uint64(32)
    return np.searchsorted(ends, start, side="right"), start, end, spots[first], least.view(np.int64), data


def _pieces(text: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes): the text, or parts of a very long one that overlap in SPAN - 1 bytes."""
    for at in range(0, max(1, len(text) - SPAN + 1), _PIECE):
        yield at, text[at : at + _PIECE + SPAN - 1]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Blocks of (ids, tags, offsets and sizes of pieces, segments()) of rows (doc_id, tag, text)."""

    def block() -> tuple:
        return np.array(ids, np.int64), np.array(tags, np.int64), np.array(offsets, np.int64), np.array([len(p) for p in pieces]), segments(pieces)

    ids, tags, offsets, pieces, held = [], [], [], [], 0
    for batch in batches:
        for doc_id, tag, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            for at, piece in _pieces(text.encode()):
                if len(piece) >= SPAN:
                    ids.append(doc_id)
                    tags.append(tag)
                    offsets.append(at)
                    pieces.append(piece)
                    held += len(piece)
                if held >= _PIECE:
                    yield block()
                    ids, tags, offsets, pieces, held = [], [], [], [], 0
    if pieces:
        yield block()


# --- blocks of columns ----------------------------------------------------------------------------


def _packed(values: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, compressed."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T
    return pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True)


def _unpacked(raw: bytes, n: int, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(raw, n * size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(kind).reshape(-1)


def _cuts(sorted_values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins, and the end."""
    if not len(sorted_values):
        return np.zeros(1, np.int64)
    return np.append(np.flatnonzero(np.append(True, sorted_values[1:] != sorted_values[:-1])), len(sorted_values))


def _shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    """Shard of a gram, by the upper half of its hash."""
    return ((h.view(np.uint64) >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


# --- the filter of repeated grams -----------------------------------------------------------------


def repeated_grams(rows: DataFrame, shards: int, width: int, hot: int) -> tuple[np.ndarray, np.ndarray]:
    """Bit map of width bits a shard of the representatives that occur under two doc_ids or more, and the hashes of
    those with `hot` occurrences or more.

    A task sends the lower halves of its hashes sorted, as compressed differences, with their counts. Hashes
    that share a bit, or both halves, with others may pass unrepeated; none is lost.
    """

    def send(h: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.argsort(h.view(np.uint64), kind="stable")
        h, ids = h[order], ids[order]
        cut = _cuts(h)
        first = cut[:-1]
        count = np.minimum(np.diff(cut), 1 << 31).astype(np.uint32)
        many = np.minimum.reduceat(ids, first) < np.maximum.reduceat(ids, first)
        h = h[first]
        shard, low = _shard_of(h, shards), (h.view(np.uint64) & _LOW).astype(np.uint32)
        bounds = _cuts(shard)
        found = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            inner = np.argsort(low[a:b], kind="stable")
            part = low[a:b][inner]
            found.append((int(shard[a]), b - a, _packed(np.diff(part, prepend=np.uint32(0))), _packed(many[a:b][inner]), _packed(count[a:b][inner])))
        yield pa.RecordBatch.from_pylist([dict(zip(("shard", "n", "low", "many", "count"), f, strict=True)) for f in found], send_schema)

    send_schema = pa.schema([("shard", pa.int32()), ("n", pa.int32()), ("low", pa.binary()), ("many", pa.binary()), ("count", pa.binary())])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, owners, held = [], [], 0
        for ids, _, _, _, (piece, _, _, _, h, _) in _scan(batches):
            hashes.append(h)
            owners.append(ids[piece])
            held += len(h)
            if held >= _HELD:
                yield from send(np.concatenate(hashes), np.concatenate(owners))
                hashes, owners, held = [], [], 0
        if held:
            yield from send(np.concatenate(hashes), np.concatenate(owners))

    def settle(shard: int, parts: list[tuple]) -> tuple:
        low = np.concatenate([np.cumsum(_unpacked(p, n, np.uint32), dtype=np.uint32) for n, p, _, _ in parts])
        many = np.concatenate([_unpacked(p, n, bool) for n, _, p, _ in parts])
        count = np.concatenate([_unpacked(p, n, np.uint32) for n, _, _, p in parts]).astype(np.int64)
        order = np.argsort(low, kind="stable")
        low, many, count = low[order], many[order], count[order]
        cut = _cuts(low)
        first = cut[:-1]
        keep = (np.diff(cut) > 1) | np.logical_or.reduceat(many, first)
        total = np.add.reduceat(count, first)
        low = low[first]
        bits = np.zeros(width, bool)
        bits[(low[keep].astype(np.uint64) * np.uint64(width) >> np.uint64(32)).astype(np.int64)] = True
        return shard, np.packbits(bits, bitorder="little").tobytes(), low[keep & (total >= hot)].tobytes()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, found in _by_shard(batches):
            yield pa.RecordBatch.from_pylist([dict(zip(("shard", "bits", "hot"), settle(shard, found), strict=True))], merge_schema)

    merge_schema = pa.schema([("shard", pa.int32()), ("bits", pa.binary()), ("hot", pa.binary())])
    sent = rows.mapInArrow(local, "shard int, n int, low binary, many binary, count binary")
    marked = _dealt(sent, shards).mapInArrow(merge, "shard int, bits binary, hot binary")
    bits, often = np.zeros(shards * width >> 3, np.uint8), [np.zeros(0, np.uint64)]
    for row in marked.toLocalIterator():  # shards * width bits in all, and one hash for `hot` occurrences
        at = row.shard * width >> 3
        bits[at : at + (width >> 3)] = np.frombuffer(row.bits, np.uint8)
        often.append(np.frombuffer(row.hot, np.uint32).astype(np.uint64) | np.uint64(row.shard) << np.uint64(32))
    return bits, np.sort(np.concatenate(often))


def _dealt(blocks: DataFrame, shards: int) -> DataFrame:
    """Blocks by shard, one partition a shard, each shard's blocks together."""
    return blocks.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard")


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """(shard, the rows of its blocks without the shard) of rows sorted by shard."""
    now, found = None, []
    for batch in batches:
        for shard, *row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if shard != now and found:
                yield now, found
                found = []
            now = shard
            found.append(tuple(row))
    if found:
        yield now, found


def _passes(bits: np.ndarray, h: np.ndarray, shards: int, width: int) -> np.ndarray:
    place = _shard_of(h, shards) * width + ((h.view(np.uint64) & _LOW) * np.uint64(width) >> np.uint64(32)).astype(np.int64)
    return (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


def _gram_key(h: np.ndarray, shards: int) -> np.ndarray:
    """Shard and lower half, as repeated_grams names hot grams."""
    return _shard_of(h, shards).astype(np.uint64) << np.uint64(32) | (h.view(np.uint64) & _LOW)


# --- shards ---------------------------------------------------------------------------------------


def earliest(segs: list[bytes], owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(segment, from, to, low): runs of SPAN-byte strings of a segment whose least owner, over all segments given, is low."""
    size = np.fromiter(map(len, segs), np.int64, len(segs))
    text = np.frombuffer(b"".join(segs), np.uint8)
    begin = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(segs)), size)
    whole_at = np.arange(len(text)) <= (begin + size - SPAN)[owner]  # a string that runs over its segment's end is none
    sa = suffix_array(text)
    chain = np.cumsum(common_prefixes(text, sa, SPAN)[sa] < SPAN)  # suffixes that share SPAN bytes with their neighbour
    whole = whole_at[sa]
    sa, chain = sa[whole], chain[whole]
    first = np.flatnonzero(np.append(True, chain[1:] != chain[:-1]))
    low = np.zeros(len(text), np.int64)
    low[sa] = np.repeat(np.minimum.reduceat(owners[owner[sa]], first), np.diff(np.append(first, len(sa))))
    at = np.flatnonzero(whole_at)
    cut = np.flatnonzero(np.append(True, (low[at[1:]] != low[at[:-1]]) | (owner[at[1:]] != owner[at[:-1]])))
    last = np.append(cut[1:], len(at)) - 1
    seg = owner[at[cut]]
    return seg, at[cut] - begin[seg], at[last] - begin[seg] + 1, low[at[cut]]


#: A block of surroundings: their number, bytes one behind the other, lengths, the gram's place in each (_ALONE: the string
#: stands for itself), documents of the block (ids, tags), and of each surrounding its document's number in the block and start.
_BLOCK = "shard int, n int, docs int, bytes int, segs binary, sizes binary, grams binary, ids binary, tags binary, doc binary, at binary"
_BLOCK_ARROW = pa.schema([(c.split()[0], {"int": pa.int32(), "binary": pa.binary()}[c.split()[1]]) for c in _BLOCK.split(", ")])
_ALONE = 255


def _block_of(shard: int, segs: list[bytes], grams: np.ndarray, ids: np.ndarray, tags: np.ndarray, at: np.ndarray) -> dict:
    """One row of _BLOCK; the surroundings of a document stand together."""
    new = np.append(True, (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1]))
    raw = b"".join(segs)
    doc = np.cumsum(new) - 1
    values = (
        shard, len(segs), int(new.sum()), len(raw), pa.compress(raw, codec="zstd", asbytes=True), _packed(np.fromiter(map(len, segs), np.uint8, len(segs))), _packed(grams.astype(np.uint8)),
        _packed(np.diff(ids[new], prepend=0)), _packed(tags[new]), _packed(np.diff(doc, prepend=0).astype(np.uint32)), _packed(at.astype(np.int64)),
    )
    return dict(zip(_BLOCK_ARROW.names, values, strict=True))


def _settle(found: list[tuple]) -> Iterator[pa.RecordBatch]:
    """All blocks of a shard -> (doc_id, tag, span): stretches of strings whose earliest doc_id is smaller than their own."""
    number: dict[bytes, int] = {}
    distinct, gram_of, owner, ids, tags, at = [], [], [], [], [], []
    for n, docs, size, segs, sizes, grams, block_ids, block_tags, doc, starts in found:
        raw = pa.decompress(segs, size, codec="zstd", asbytes=True)
        ends = np.cumsum(_unpacked(sizes, n, np.uint8), dtype=np.int64)
        places = _unpacked(grams, n, np.uint8)
        own = np.empty(n, np.int64)
        for i, (b, gram, a) in enumerate(zip(ends.tolist(), places.tolist(), [0, *ends[:-1].tolist()], strict=True)):
            seg = raw[a:b]
            k = number.setdefault(seg, len(number))
            if k == len(distinct):
                distinct.append(seg)
                gram_of.append(seg if gram == _ALONE else seg[gram : gram + K])
            own[i] = k
        owner.append(own)
        place = np.cumsum(_unpacked(doc, n, np.uint32), dtype=np.int64)
        ids.append(np.cumsum(_unpacked(block_ids, docs, np.int64))[place])
        tags.append(_unpacked(block_tags, docs, np.int64)[place])
        at.append(_unpacked(starts, n, np.int64))
    del number
    owner, ids, tags, at = (np.concatenate(x) for x in (owner, ids, tags, at))
    order = np.argsort(owner, kind="stable")
    owner, ids, tags, at = owner[order], ids[order], tags[order], at[order]
    begins = _cuts(owner)  # occurrences of the k-th different surrounding: begins[k] to begins[k + 1]
    low = np.minimum.reduceat(ids, begins[:-1])
    codes: dict[bytes, int] = {}
    code = np.fromiter((codes.setdefault(g, len(codes)) for g in gram_of), np.int64, len(gram_of))
    del codes, gram_of
    by_gram = np.argsort(code, kind="stable")
    bounds = _cuts(code[by_gram])

    def spans(seg: np.ndarray, start: np.ndarray, stop: np.ndarray, least: np.ndarray) -> pa.RecordBatch:
        """Every occurrence of the runs' surroundings under a larger doc_id."""
        count = begins[seg + 1] - begins[seg]
        run = np.repeat(np.arange(len(seg)), count)
        place = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count) + begins[seg][run]
        later = ids[place] > least[run]
        run, place = run[later], place[later]
        span = at[place] + start[run] << _BITS | stop[run] - start[run] + SPAN - 1
        return pa.RecordBatch.from_arrays([pa.array(ids[place]), pa.array(tags[place]), pa.array(span)], ["doc_id", "tag", "span"])

    alone = by_gram[bounds[:-1]][np.diff(bounds) == 1]  # the gram's one surrounding: all its strings begin under its least doc_id
    sizes = np.fromiter(map(len, distinct), np.int64, len(distinct))
    for part in np.array_split(alone, max(1, len(alone) >> 16)):
        yield spans(part, np.zeros(len(part), np.int64), sizes[part] - SPAN + 1, low[part])
    held, weight = [], 0
    groups = np.flatnonzero(np.diff(bounds) > 1)
    for i in groups.tolist():
        members = by_gram[bounds[i] : bounds[i + 1]]
        held.append(members)
        weight += int(sizes[members].sum())
        if weight >= _SHARD or i == groups[-1]:
            members = np.concatenate(held)
            seg, start, stop, least = earliest([distinct[k] for k in members.tolist()], low[members])
            yield spans(members[seg], start, stop, least)
            held, weight = [], 0


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id (a null one is the largest number), tag and text. Rows of one doc_id with different texts differ in their tags, which
    are 64-bit hashes: of a million rows of one id, some two in a hundred million tables would have a clash."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col), F.lit((1 << 63) - 1)).alias("doc_id"), F.xxhash64(text, F.col(id_col).isNull()).alias("tag"), text.alias("text"), F.col(id_col).alias("own_id"))


def removed_spans(rows: DataFrame, shard_text: int = SHARD_TEXT, hot: int = HOT) -> DataFrame:
    """(doc_id, tag, span) of stretches to remove from rows(doc_id, tag, text), in bytes; they may overlap. A span is its start, shifted
    by _BITS, and its length. An empty table has none; repeated rows have the same.

    Grams of `hot` occurrences or more don't draw their surroundings to one shard: these are dealt as
    single strings of SPAN bytes, each by its own hash.
    """
    rows = rows.select("doc_id", "tag", "text")
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(LEAST_SHARDS, -(-n_bytes // shard_text))
    width = max(1 << 10, min(MAX_FILTER_BITS, 2 * n_bytes // 15) // shards) >> 3 << 3  # two bits for each representative, which come every 15 bytes
    shared = rows.sparkSession.sparkContext.broadcast(repeated_grams(rows, shards, width, hot))

    def strings(raw: bytes, a: int, b: int, row: int, start: int) -> Iterator[tuple]:
        for i in range(a, b - SPAN + 1):
            seg = raw[i : i + SPAN]
            yield xxhash.xxh64_intdigest(seg), seg, _ALONE, row, start + i - a

    def send(held: list[tuple]) -> pa.RecordBatch:
        h, segs, grams, ids, tags, at = ([x for part in held for x in part[1]] if k == 1 else np.concatenate([part[k] for part in held]) for k in range(6))
        shard = _shard_of(h, shards)
        order = np.argsort(shard, kind="stable")
        bounds = _cuts(shard[order])
        blocks = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            part = order[a:b]
            blocks.append(_block_of(int(shard[part[0]]), [segs[i] for i in part.tolist()], grams[part], ids[part], tags[part], at[part]))
        return pa.RecordBatch.from_pylist(blocks, _BLOCK_ARROW)

    def surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, often = shared.value
        held, n = [], 0
        for ids, tags, offsets, sizes, (piece, start, end, spot, h, data) in _scan(batches):
            ok = _passes(bits, h, shards, width)
            piece, start, end, spot, h, raw = piece[ok], start[ok], end[ok], spot[ok], h[ok], data.tobytes()
            at = start - (np.cumsum(sizes) - sizes)[piece] + offsets[piece]
            if len(often):
                key = _gram_key(h, shards)
                is_hot = often[np.minimum(np.searchsorted(often, key), len(often) - 1)] == key
                single = [t for i in np.flatnonzero(is_hot).tolist() for t in strings(raw, int(start[i]), int(end[i]), int(piece[i]), int(at[i]))]
                if single:
                    hs, segs, grams, rows_, ats = zip(*single, strict=True)
                    own = np.array(rows_)
                    held.append((np.array(hs, np.uint64).view(np.int64), list(segs), np.array(grams), ids[own], tags[own], np.array(ats)))
                    n += SPAN * len(segs)
                piece, start, end, spot, h, at = (x[~is_hot] for x in (piece, start, end, spot, h, at))
            held.append((h, [raw[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)], spot - start, ids[piece], tags[piece], at))
            n += int((end - start).sum())
            if n >= 8 * _HELD:
                yield send(held)
                held, n = [], 0
        if held:
            yield send(held)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, found in _by_shard(batches):
            yield from _settle(found)

    return _dealt(rows.mapInArrow(surroundings, _BLOCK), shards).mapInArrow(settle, "doc_id long, tag long, span long")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (binary) for every row.

    A byte goes if a string of SPAN bytes over it also starts under a smaller doc_id. Null text is empty;
    a null id is larger than all others but 2^63 - 1, which it equals; rows of one id aren't smaller than each other, and repeated
    rows lose the same. Empty table: empty result. Other columns are ignored.
    """
    rows = _keyed(docs, id_col, text_col)
    lists = removed_spans(rows, **settings).groupBy("doc_id", "tag").agg(F.array_sort(F.collect_set("span")).alias("spans"))
    joined = rows.join(lists, ["doc_id", "tag"], "left").select("own_id", "text", "spans")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.encode() for t in batch.column(1).to_pylist()]
            found = batch.column(2)
            counts = found.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            flat = found.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(texts)), counts)
            far = np.int64(1) << 40  # rows side by side on one line
            start = (flat >> _BITS) + row * far
            end = start + (flat & ((1 << _BITS) - 1))
            reach = np.maximum.accumulate(end) if len(end) else end
            new = np.append(True, start[1:] > reach[:-1]) if len(end) else np.zeros(0, bool)
            first = np.flatnonzero(new)
            a, b, of = start[first] - row[first] * far, reach[np.append(first[1:], len(new))[: len(first)] - 1] - row[first] * far, row[first]
            edges = np.searchsorted(of, np.arange(len(texts) + 1))
            gone = np.bincount(of, b - a, len(texts)).astype(np.int64)
            kept = []
            for raw, x, y in zip(texts, edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if x == y:
                    kept.append(raw)
                    continue
                froms, tos = [0, *b[x:y].tolist()], [*a[x:y].tolist(), len(raw)]
                kept.append(b"".join([raw[p:q] for p, q in zip(froms, tos, strict=True)]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(gone), pa.array(np.diff(edges).astype(np.int64)), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    return joined.mapInArrow(work, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op8_induced_sorting(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(documents(spark, sf_dir))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op8_induced_sorting": op8_induced_sorting}
ORACLES: dict[str, str] = {}
