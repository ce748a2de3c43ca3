"""Language-model scores by a probabilistic suffix tree over words.

Symbols are a text's words, lower-cased in A-Z, and one end. Words of a share of FREQUENT or more of the training
tokens are symbols of their own; all others are the symbol RARE, behind which the word itself is told by its
count, and one never seen by its spelling. A context of one or two symbols is a node of the tree if its smoothed
next-symbol distribution diverges from that of the context one symbol shorter; a symbol is scored in
the longest context that is a node.

Contexts and their counts are gathered over all training texts and stay where Spark deals them: by the last symbol of a
context, so that every node meets its suffix and all tokens that it scores. A symbol of more tokens than a shard's is dealt in
pieces, by the symbol before it; what stands behind it is counted over all pieces and sent to each. Only the alphabet is
broadcast, whose size is bounded by 1/FREQUENT. What the shards hold grows with the corpus, and so does their number.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import documents, materialise, received, send_out

#: Least share of all training tokens of a symbol of its own, and of one that is taken for too common to be a context by itself: above 1,
#: so every symbol is a context.
FREQUENT, COMMON = 5e-7, 2.0
#: Nats that a context has to gain over the shorter one for each time it occurs; times that an edge must be seen; weight of the shorter context.
DIVERGENCE, SEEN, PRIOR = 0.05, 2, 0.5
#: Part of a count that rare words leave for those never seen; weight of a byte's own share in its spelling.
DISCOUNT, SPELL = 0.5, 4.0
START, END, RARE = 0, 1, 2
#: Bits of a symbol: 1/FREQUENT symbols and three more fit.
BITS = 21
_MASK = (1 << BITS) - 1
#: Bytes of text for which there is one shard, and least number of shards.
SHARD_TEXT, LEAST_SHARDS = 16 << 20, 16
#: Bytes that are worked on at once, entries that a task holds before it passes them on, words that it remembers, words that it spells at once.
_BLOCK, _HELD, _MEMO, _SPELT = 1 << 20, 1 << 20, 1 << 18, 1 << 14
#: Sender of the counts behind a symbol that is dealt in pieces.
_COUNTED = -1


def tokens_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def _blocks(texts: pa.Array) -> Iterator[list[list[bytes]]]:
    held, n = [], 0
    for text in (t for at in range(0, len(texts), 256) for t in texts.slice(at, 256).cast(pa.large_binary()).to_pylist()):
        held.append(tokens_of(text))
        n += len(text or b"") + 8
        if n >= _BLOCK:
            yield held
            held, n = [], 0
    if held:
        yield held


def is_held_out(id_col: str = "doc_id"):
    """crc32 of the id's decimal text, modulo 5, is 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 1, F.lit(False))


# --- spelling -------------------------------------------------------------------------------------


def _triples(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Every byte of the words, and an end (256) behind each, with the two before it (257 before the first), as one number; and its word."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    first = np.cumsum(size + 3) - size - 3
    s = np.full(int((size + 3).sum()), 257, np.int64)
    owner = np.repeat(np.arange(len(words)), size)
    s[np.arange(size.sum()) + 3 * owner + 2] = np.frombuffer(b"".join(words), np.uint8)
    s[first + size + 2] = 256
    key = s[:-2] << 18 | s[1:-1] << 9 | s[2:]
    real = s[2:] != 257
    return key[real], np.repeat(np.arange(len(words)), size + 1)


@dataclass
class Spelling:
    """Chances of a word's bytes, each given the two before it."""

    keys: np.ndarray
    counts: np.ndarray

    def __post_init__(self):
        self.contexts, at = np.unique(self.keys >> 9, return_inverse=True)
        self.totals = np.bincount(at, self.counts, len(self.contexts))
        own = np.bincount(self.keys & 511, self.counts, 257)
        self.own = (own + 0.5) / (own.sum() + 0.5 * 257)
        self.by_context = np.zeros(1 << 18)
        self.by_context[self.contexts] = self.totals

    def logs(self, words: list[bytes]) -> np.ndarray:
        """log10 of each word's chance."""
        key, owner = _triples(words)
        wanted, place = _distinct(key)
        n, total = _found(self.keys, self.counts, wanted), self.by_context[wanted >> 9]
        return np.bincount(owner, np.log10((n + SPELL * self.own[wanted & 511]) / (total + SPELL))[place], len(words))


def _found(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, default=0) -> np.ndarray:
    """The values of wanted keys; keys are sorted."""
    if not len(keys):
        return np.full(len(wanted), default, np.asarray(values).dtype if len(values) else float)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], default)


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, unsorted, and the place of each value among them."""
    found = pa.array(values).dictionary_encode()
    return found.dictionary.to_numpy(), found.indices.to_numpy()


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of all parts with the sums of their counts."""
    keys, place = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(place, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)


# --- counts of words ------------------------------------------------------------------------------


def gather(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, key, n): how often each word (by its XXH64) and each triple of bytes occurs in docs."""

    def rows(word: bool, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(keys), 1 << 16):
            part = slice(at, at + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys[part]), word)), pa.array(keys[part]), pa.array(counts[part])], ["word", "key", "n"])

    def flush(words: Counter) -> Iterator[pa.RecordBatch]:
        if not words:
            return
        keys = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)).view(np.int64)
        counts = np.fromiter(words.values(), np.int64, len(words))
        yield from rows(True, keys, counts)
        listed, found = list(words), []
        words.clear()
        for at in range(0, len(listed), _SPELT):
            triple, owner = _triples(listed[at : at + _SPELT])
            distinct, place = _distinct(triple)
            found.append((distinct, np.bincount(place, counts[at + owner], len(distinct)).astype(np.int64)))
        yield from rows(False, *_summed(found))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Counter()
        for batch in batches:
            for bags in _blocks(batch.column(0)):
                for bag in bags:
                    words.update(bag)
                if len(words) > _HELD // 4:
                    yield from flush(words)
        yield from flush(words)

    local = docs.select(F.col(text_col).alias("text")).mapInArrow(work, "word boolean, key long, n long")
    return local.groupBy("word", "key").agg(F.sum("n").alias("n"))


@dataclass
class Alphabet:
    """The symbols: START, END, RARE and words in falling order of their counts."""

    keys: np.ndarray  # sorted hashes of the words
    symbols: np.ndarray  # of each
    counts: np.ndarray  # of all symbols in training
    logs: np.ndarray  # log10 share of all symbols, that of a text without context
    spelling: Spelling

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hash and symbol of each word."""
        key = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)).view(np.int64)
        return key, _found(self.keys, self.symbols, key, RARE).astype(np.int64)


def alphabet(counts: DataFrame, ends: int, frequent: float = FREQUENT) -> tuple[Alphabet, dict]:
    """The alphabet and the totals of gathered counts; at most 1/frequent words and the triples of bytes reach the driver."""
    words = counts.where("word")
    seen = words.agg(F.sum("n"), F.count("*")).first()
    n_words, distinct = seen[0] or 0, seen[1]
    n_all = n_words + ends
    many = words.where(F.col("n") >= frequent * n_all).select("key", "n").toPandas().sort_values(["n", "key"], ascending=[False, True])
    triples = counts.where("NOT word").select("key", "n").toPandas().sort_values("key")
    keys, n = many["key"].to_numpy(np.int64), many["n"].to_numpy(np.int64)
    order = np.argsort(keys)
    by_symbol = np.concatenate([[ends, ends, n_words - n.sum()], n]).astype(np.int64)
    chances = (by_symbol + 0.5) / (n_all + 0.5 * (len(n) + 2))
    made = Alphabet(keys[order], (order + 3).astype(np.int32), by_symbol, np.log10(chances), Spelling(triples["key"].to_numpy(np.int64), triples["n"].to_numpy(np.float64)))
    return made, {"all": n_all, "distinct": distinct + (ends > 0), "rare": int(by_symbol[RARE]), "rare_distinct": distinct - len(n)}


# --- the tree, shard by shard ---------------------------------------------------------------------


class Tree:
    """The nodes of one shard. counts: keys (prev, before, symbol) of BITS bits each, sorted, with their counts in training.

    wide: keys (prev, symbol) with their counts for each prev of which this shard has a piece only.

    A node is a context of one symbol (prev) or two (before, prev). Its edges have been seen SEEN times; an edge has the chance
    count / (total + PRIOR), and what all edges leave over goes to the shorter context.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray, letters: Alphabet, common: float, divergence: float = DIVERGENCE, wide: tuple | None = None):
        self.root, self.levels = letters.logs, []
        too_common = letters.counts >= common
        prev, symbol = keys >> 2 * BITS, keys & _MASK
        one, place = np.unique(prev << BITS | symbol, return_inverse=True)
        one_counts = np.bincount(place, counts, len(one)).astype(np.int64)
        if wide:
            own = ~np.isin(one >> BITS, np.unique(wide[0] >> BITS))
            one, one_counts = _summed([(one[own], one_counts[own]), wide])
        lone = ~too_common[one >> BITS]
        for edges, n in ((one[lone], one_counts[lone]), (keys, counts)):
            self._grow(edges, n, divergence)

    def _grow(self, edges: np.ndarray, n: np.ndarray, divergence: float) -> None:
        context = edges >> BITS
        cut = np.flatnonzero(np.append(True, context[1:] != context[:-1])) if len(edges) else np.zeros(0, np.int64)
        if not len(edges):
            self.levels.append((edges, n.astype(float), context, n.astype(float)))
            return
        total = np.add.reduceat(n, cut)
        of = np.repeat(np.arange(len(cut)), np.diff(np.append(cut, len(edges))))
        kept = n >= SEEN
        held = np.bincount(of[kept], n[kept], len(cut))
        rest = np.log10(1 - held / (total + PRIOR))
        logs = np.log10(n / (total[of] + PRIOR))
        first = context >> BITS if self.levels else context  # the last symbol of the context
        gain = np.bincount(of[kept], n[kept] * (logs[kept] - self.shorter(first[kept], edges[kept] & _MASK)), len(cut)) + (total - held) * rest
        node = gain * np.log(10) >= divergence * total
        keep = kept & node[of]
        self.levels.append((edges[keep], logs[keep], context[cut][node], rest[node]))

    def shorter(self, prev: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """log10 chance of symbol behind prev alone, as far as the tree has grown."""
        found = self.root[symbol]
        return self._at(0, prev, symbol, found) if self.levels else found

    def _at(self, level: int, context: np.ndarray, symbol: np.ndarray, below: np.ndarray) -> np.ndarray:
        edges, logs, contexts, rest = self.levels[level]
        own = _found(edges, logs, context << BITS | symbol, 1.0)
        return np.where(own <= 0, own, below + _found(contexts, rest, context, 0.0))  # without an edge or a node: the rest, or nothing lost

    def logs(self, keys: np.ndarray) -> np.ndarray:
        """log10 chance of each (prev, before, symbol), in the longest context that is a node."""
        prev, symbol = keys >> 2 * BITS, keys & _MASK
        return self._at(1, keys >> BITS, symbol, self.shorter(prev, symbol))


def _packed(values: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, compressed."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T
    return pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True)


def _unpacked(raw: bytes, n: int, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(raw, n * size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(kind).reshape(-1)


#: Tokens that one task sends at once to one shard: who sends, their number, context and symbol, whose they are (documents by ids, tags and whether they train).
_TOKENS = "shard int, sender long, n int, docs int, prev binary, before binary, symbol binary, doc binary, ids binary, tags binary, train binary"
#: What the shard sends back: scores of the same documents.
_SCORES = "sender long, docs int, ids binary, tags binary, scores binary"
_KINDS = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
_TOKENS_ARROW, _SCORES_ARROW = (pa.schema([(c.split()[0], _KINDS[c.split()[1]]) for c in columns.split(", ")]) for columns in (_TOKENS, _SCORES))


def _mixed(symbols: np.ndarray) -> np.ndarray:
    h = (symbols.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return ((h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)) >> np.uint64(32)


def _pieces(letters: Alphabet, total: int, shards: int) -> np.ndarray:
    """Pieces in which each symbol's tokens are dealt: one has no more than a shard's share of all training tokens, if the symbols before it spread."""
    return np.clip(-(-letters.counts * shards // max(1, total)), 1, shards)


def _shards_of(prev: np.ndarray, before: np.ndarray, pieces: np.ndarray, shards: int) -> np.ndarray:
    """The shard of a token: that of prev, or one of as many in a row as prev has pieces."""
    own = (_mixed(prev) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
    return (own + _mixed(before).astype(np.int64) % pieces[prev]) % shards


def _symbols(bags: list[list[bytes]], letters: Alphabet, memo: dict[bytes, int]) -> tuple[np.ndarray, ...]:
    """symbol, prev, before and bag of every token of the bags."""
    new = set().union(*bags).difference(memo)
    if len(memo) + len(new) > _MEMO:
        memo.clear()
        new = set().union(*bags)
    words = list(new)
    memo.update(zip(words, letters.of(words)[1].tolist(), strict=True))
    size = np.fromiter(map(len, bags), np.int64, len(bags)) + 3
    begin = np.cumsum(size) - size
    s = np.full(int(size.sum()), START, np.int32)
    s[begin + size - 1] = END
    flat = np.fromiter(map(memo.__getitem__, chain.from_iterable(bags)), np.int32, int(size.sum()) - 3 * len(bags))
    owner = np.repeat(np.arange(len(bags)), size - 2)
    token = np.arange(len(owner)) + 2 * owner + 2
    s[token[s[token] != END]] = flat
    return s[token], s[token - 1], s[token - 2], owner


def _behind(rows: DataFrame, sent, total: int, shards: int) -> DataFrame:
    """For every symbol that is dealt in pieces, what stands behind it in the rows that train and how often: to each of its shards, packed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, memo = received(sent), {}
        split = _pieces(letters, total, shards) > 1
        keys, n, new, held = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0
        for batch in batches:
            for bags in _blocks(batch.column(0)):
                symbol, prev, _, _ = _symbols(bags, letters, memo)
                own = split[prev]
                new.append(np.unique(prev[own].astype(np.int64) << BITS | symbol[own], return_counts=True))
                held += len(new[-1][0])
                if held > max(_HELD, len(keys)):
                    (keys, n), new, held = _summed([(keys, n), *new]), [], 0
        keys, n = _summed([(keys, n), *new])
        for at in range(0, len(keys), 1 << 16):
            part = slice(at, at + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(keys[part]), pa.array(n[part])], ["key", "n"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(received(sent), total, shards)
        for batch in batches:
            keys, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for prev in np.unique(keys >> BITS).tolist():
                at = np.flatnonzero(keys >> BITS == prev)
                own = int(_mixed(np.array([prev]))[0]) * shards >> 32
                packed = [_packed(x[at].astype(kind)) for x, kind in ((keys >> BITS, np.int32), (keys & _MASK, np.int32), (n, np.int64))]
                for k in range(pieces[prev]):
                    values = ((own + k) % shards, _COUNTED, len(at), 0, packed[0], b"", packed[1], packed[2], b"", b"", b"")
                    yield pa.RecordBatch.from_pylist([dict(zip(_TOKENS_ARROW.names, values, strict=True))], _TOKENS_ARROW)

    found = rows.where("train").select("text").mapInArrow(count, "key long, n long")
    return found.groupBy("key").agg(F.sum("n").alias("n")).mapInArrow(spread, _TOKENS)


def _scored(rows: list[tuple], letters: Alphabet, common: float, divergence: float) -> Iterator[pa.RecordBatch]:
    """All tokens of a shard -> their documents' scores, a row for each that came in: blocks stay packed but for the one that is worked on."""

    def keys_of(row: tuple) -> np.ndarray:
        _, n, _, prev, before, symbol, *_ = row
        parts = [_unpacked(p, n, np.int32).astype(np.int64) for p in (prev, before, symbol)]
        return parts[0] << 2 * BITS | parts[1] << BITS | parts[2]

    def pairs_of(row: tuple) -> tuple[np.ndarray, np.ndarray]:
        _, n, _, prev, _, symbol, counts, *_ = row
        return _unpacked(prev, n, np.int32).astype(np.int64) << BITS | _unpacked(symbol, n, np.int32), _unpacked(counts, n, np.int64)

    counted, rows = [row for row in rows if row[0] == _COUNTED], [row for row in rows if row[0] != _COUNTED]
    keys, counts, new, held = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0
    for row in rows:
        _, n, docs, *_, doc, _, _, train = row
        learns = _unpacked(train, docs, bool)[np.cumsum(_unpacked(doc, n, np.uint32), dtype=np.int64)]
        new.append(np.unique(keys_of(row)[learns], return_counts=True))
        held += len(new[-1][0])
        if held > max(_HELD, len(keys)):
            (keys, counts), new, held = _summed([(keys, counts), *new]), [], 0
    keys, counts = _summed([(keys, counts), *new])
    del new
    tree = Tree(keys, counts, letters, common, divergence, _summed([pairs_of(row) for row in counted]) if counted else None)
    del keys, counts
    for row in rows:
        sender, n, docs, *_, doc, ids, tags, _ = row
        keys, place = np.unique(keys_of(row), return_inverse=True)  # sorted keys are found faster
        sums = np.bincount(np.cumsum(_unpacked(doc, n, np.uint32), dtype=np.int64), tree.logs(keys)[place], docs)
        yield pa.RecordBatch.from_pylist([{"sender": sender, "docs": docs, "ids": ids, "tags": tags, "scores": _packed(sums)}], _SCORES_ARROW)


def _added_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scores that came back, in the order of their senders -> (doc_id, tag, score), the parts of each document of a sender in one row."""

    def total(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        ids, tags, scores = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((tags, ids))
        ids, tags, scores = ids[order], tags[order], scores[order]
        first = np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1])))
        sums = np.add.reduceat(scores, first)
        yield pa.RecordBatch.from_arrays([pa.array(ids[first]), pa.array(tags[first]), pa.array(sums)], ["doc_id", "tag", "score"])

    now, parts = None, []
    for batch in batches:
        for sender, docs, ids, tags, scores in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if sender != now and parts:
                yield from total(parts)
                parts = []
            now = sender
            parts.append((np.cumsum(_unpacked(ids, docs, np.int64)), _unpacked(tags, docs, np.int64), _unpacked(scores, docs, np.float64)))
    if parts:
        yield from total(parts)


def tree_scores(rows: DataFrame, letters: Alphabet, sent, totals: dict, shard_text: int = SHARD_TEXT, common: float = COMMON, divergence: float = DIVERGENCE) -> DataFrame:
    """(doc_id, tag, score): log10 chances of the symbols of rows(doc_id, tag, train, text), in parts to be added up.

    Scores go back packed to who sent the tokens and are added up there, so that a document has as many rows as senders,
    however many shards its tokens are in. A sender that is run anew may hold other documents: each token still counts once.
    """
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(LEAST_SHARDS, -(-n_bytes // shard_text))
    bar = max(1.0, common * totals["all"])

    def send(sender: int, found: list[tuple], pieces: np.ndarray) -> pa.RecordBatch:
        symbol, prev, before, doc, ids, tags, train = (np.concatenate(x) for x in zip(*found, strict=True))
        shard = _shards_of(prev, before, pieces, shards)
        order = np.argsort(shard.astype(np.min_scalar_type(shards)), kind="stable")  # of two bytes, numbers are sorted by their digits
        bounds = np.append(np.searchsorted(shard[order], np.arange(shards)), len(order))
        blocks = []
        for k in np.flatnonzero(np.diff(bounds)).tolist():
            at = order[bounds[k] : bounds[k + 1]]
            new = np.diff(doc[at], prepend=-1) != 0  # documents are numbered in the order of their tokens
            own, place = doc[at[new]], np.cumsum(new) - 1
            values = (
                k, sender, len(at), len(own), *(_packed(x[at].astype(np.int32)) for x in (prev, before, symbol)), _packed(np.diff(place, prepend=0).astype(np.uint32)),
                _packed(np.diff(ids[own], prepend=0)), _packed(tags[own]), _packed(train[own]),
            )
            blocks.append(dict(zip(_TOKENS_ARROW.names, values, strict=True)))
        return pa.RecordBatch.from_pylist(blocks, _TOKENS_ARROW)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = received(sent)
        pieces = _pieces(letters, totals["all"], shards)
        memo: dict[bytes, int] = {}
        sender, found, held, n_docs = TaskContext.get().partitionId() << 32, [], 0, 0
        for batch in batches:
            ids, tags, train, at = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False), 0
            for bags in _blocks(batch.column(3)):
                symbol, prev, before, owner = _symbols(bags, letters, memo)
                part = slice(at, at + len(bags))
                found.append((symbol, prev, before, owner + n_docs, ids[part], tags[part], train[part]))
                at, n_docs, held = at + len(bags), n_docs + len(bags), held + len(owner)
                if held >= _HELD:
                    yield send(sender, found, pieces)
                    sender, found, held, n_docs = sender + 1, [], 0, 0
        if found:
            yield send(sender, found, pieces)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, now, rows_ = received(sent), None, []
        for batch in batches:
            for k, *row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if k != now and rows_:
                    yield from _scored(rows_, letters, bar, divergence)
                    rows_ = []
                now = k
                rows_.append(tuple(row))
        if rows_:
            yield from _scored(rows_, letters, bar, divergence)

    dealt = rows.select("doc_id", "tag", "train", "text").mapInArrow(deal, _TOKENS)
    if _pieces(letters, totals["all"], shards).max() > 1:  # else every symbol's tokens are in one shard
        dealt = dealt.unionByName(_behind(rows, sent, totals["all"], shards))
    scored = dealt.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard").mapInArrow(settle, _SCORES)
    return scored.repartition("sender").sortWithinPartitions("sender").mapInArrow(_added_up, "doc_id long, tag long, score double")


# --- scores of texts ------------------------------------------------------------------------------


def word_scores(rows: DataFrame, sent, rare: DataFrame, totals: dict, ends: int) -> DataFrame:
    """(doc_id, tag, rows, n_tokens, n_known, base_score, score), in parts to be added up: what word counts alone give; score is that of
    rare words behind the symbol RARE."""
    below = totals["all"] + 0.5 * (totals["distinct"] + 1)
    names = ["doc_id", "tag", "key", "n", "spelt", "rows", "n_tokens", "known", "base"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = received(sent)
        base_logs = np.log10((letters.counts + 0.5) / below)
        for batch in batches:
            ids, tags, at = batch.column(0).to_numpy(), batch.column(1).to_numpy(), 0
            for bags in _blocks(batch.column(2)):
                part = slice(at, at + len(bags))
                at += len(bags)
                bagged = [Counter(b) for b in bags]
                size = np.fromiter(map(len, bagged), np.int64, len(bagged))
                owner = np.repeat(np.arange(len(bags)), size)
                n = np.fromiter((c for b in bagged for c in b.values()), np.int64, size.sum())
                words = [w for b in bagged for w in b]
                key, symbol = letters.of(words)
                found = symbol != RARE
                base = np.bincount(owner[found], n[found] * base_logs[symbol[found]], len(bags)) + base_logs[END]
                known = np.bincount(owner[found], n[found], len(bags)).astype(np.int64) + (ends > 0)
                left = np.flatnonzero(~found)
                spelt = letters.spelling.logs([words[i] for i in left.tolist()])
                none = lambda k, kind: pa.nulls(k, kind)
                own = [pa.array(ids[part]), pa.array(tags[part])]
                mixed = ((ids[part].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)  # spreads rows without a word to look up
                of, k = owner[left], len(left)
                yield pa.RecordBatch.from_arrays(
                    [*own, pa.array(mixed), none(len(bags), pa.int64()), none(len(bags), pa.float64()), pa.array(np.ones(len(bags), np.int64)), pa.array([len(b) + 1 for b in bags], pa.int64()), pa.array(known), pa.array(base, pa.float64())], names
                )
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[part][of]), pa.array(tags[part][of]), pa.array(key[left]), pa.array(n[left]), pa.array(spelt, pa.float64()), *[none(k, kind) for kind in kinds[5:]]], names
                )

    schema = "doc_id long, tag long, key long, n long, spelt double, rows long, n_tokens long, known long, base double"
    parts = rows.select("doc_id", "tag", "text").mapInArrow(work, schema).join(rare.withColumnRenamed("n", "c"), "key", "left")
    is_word = F.col("n").isNotNull()
    own_log = F.col("n") * F.log10((F.coalesce("c", F.lit(0)) + 0.5) / F.lit(below))
    told = F.log10((F.col("c") - DISCOUNT) / F.lit(totals["rare"] + 1.0))
    new = F.lit(float(np.log10((DISCOUNT * totals["rare_distinct"] + 1) / (totals["rare"] + 1)))) + F.col("spelt")
    return parts.select(
        "doc_id", "tag", "rows", "n_tokens", F.coalesce("known", F.when(is_word & F.col("c").isNotNull(), F.col("n")), F.lit(0)).alias("n_known"),
        F.coalesce("base", own_log).alias("base_score"), F.when(is_word, F.col("n") * F.coalesce(told, new)).alias("score"),
    )


def score_texts(docs: DataFrame, training=None, id_col: str = "doc_id", text_col: str = "text", frequent: float = FREQUENT, **settings) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for every row of docs.

    training is the condition (a column) of the rows that are learnt from; without it those that aren't held out.
    Null counts as empty text, whose only token is the end. Words are told apart by 64-bit hashes. Rows are found again by
    id and text, so repeated rows get the same scores each, however docs is made; an empty table gives an empty
    result; without training rows chances are uniform; other columns are ignored.
    """
    train = ~is_held_out(id_col) if training is None else training
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.coalesce(F.col(id_col), F.lit((1 << 63) - 1)).alias("doc_id"), F.xxhash64(text, F.col(id_col).isNull()).alias("tag"), train.alias("train"), text.alias("text"), F.col(id_col).alias("own_id"),
        is_held_out(id_col).alias("held_out"),
    )
    learnt = rows.where("train")
    counts = materialise(gather(learnt), "gathered")
    ends = learnt.count()
    letters, totals = alphabet(counts, ends, frequent)
    sent = send_out(docs.sparkSession, letters)
    rare = counts.where(F.col("word") & (F.col("n") < frequent * totals["all"])).select("key", "n")
    words = word_scores(rows, sent, rare, totals, ends)
    scored = tree_scores(rows, letters, sent, totals, **settings)
    none = F.lit(None).cast("long")
    both = words.unionByName(scored.select("doc_id", "tag", none.alias("rows"), none.alias("n_tokens"), none.alias("n_known"), F.lit(None).cast("double").alias("base_score"), "score"))
    sums = both.groupBy("doc_id", "tag").agg(*[F.sum(c).alias(c) for c in ("rows", "n_tokens", "n_known", "base_score", "score")])
    found = rows.select("doc_id", "tag", "own_id", "held_out").join(sums, ["doc_id", "tag"])
    whole = lambda c: (F.col(c) / F.col("rows")).cast("long").alias(c)
    return found.select(
        F.col("own_id").alias("doc_id"), "held_out", whole("n_tokens"), whole("n_known"), F.lit(totals["all"]).cast("long").alias("train_tokens"),
        (F.col("base_score") / F.col("rows")).alias("base_score"), (F.col("score") / F.col("rows")).alias("score"),
    )


def op4_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(documents(spark, sf_dir))


QUERIES = {"op4_suffix_tree": op4_suffix_tree}
ORACLES: dict[str, str] = {}
