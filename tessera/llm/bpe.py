"""Byte-level BPE encoding and decoding over a minimal acyclic transducer of frequent words.

Frequent words are counted in the corpus, encoded once, and compiled into one automaton whose
states with equal futures are shared; the path of a word adds up to its number, which points at its
ids. Workers map the file into memory. Words that it lacks are merged exactly, many at once.
"""

from __future__ import annotations

import hashlib
import heapq
import io
import itertools
import json
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import documents, forget, materialise, received, send_out, text_or_empty

#: Least share of all letter runs that makes a word frequent: so at most 1/FREQUENT words are compiled.
FREQUENT = 1e-5
#: Fixed values of the byte-level scheme: white space (Unicode's property) and the pattern of word pieces.
_WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_PIECE = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"
#: Longest word (bytes) that is merged together with others; cells of one such block; words remembered.
_LONG, _CELLS, _MEMO = 64, 1 << 19, 150_000
_NONE = np.int32(2**31 - 1)


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 for itself, the others from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, extra = [""] * 256, 256
    for b in range(256):
        if b in printable:
            letters[b] = chr(b)
        else:
            letters[b], extra = chr(extra), extra + 1
    return letters


class Merges:
    """Vocabulary and merge ranks of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_letters()
        of = {c: b for b, c in enumerate(letters)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = model["vocab"]
        self.token_bytes = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(of[c] for c in token)
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        self.first = np.array([vocab[c] for c in letters], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] * (1 << 20) + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.of_pair = dict(zip(keys.tolist(), range(len(keys)), strict=True))

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) * (1 << 20) + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.ranks[at], _NONE)

    def merge_one(self, word: bytes) -> tuple[int, ...]:
        """Ids of one word, by a heap of pairs: n log n steps for n bytes."""
        ids = self.first[np.frombuffer(word, np.uint8)].tolist()
        left, right = list(range(-1, len(ids) - 1)), [*range(1, len(ids)), -1]
        heap = [(r, i) for i, (a, b) in enumerate(itertools.pairwise(ids)) if (r := self.of_pair.get((a << 20) + b)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = right[i] if ids[i] >= 0 else -1
            if j < 0 or self.of_pair.get((ids[i] << 20) + ids[j]) != r:
                continue
            ids[i], ids[j] = int(self.made[r]), -1
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y >= 0 and (q := self.of_pair.get((ids[x] << 20) + ids[y])) is not None:
                    heapq.heappush(heap, (q, x))
        return tuple(i for i in ids if i >= 0)

    def merge_many(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of many words: short ones of like length in blocks, each step one merge in every word."""
        found: list = [None] * len(words)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        at = 0
        while at < len(order) and len(words[order[at]]) <= _LONG:
            n = at + 1
            while n < len(order) and len(words[order[n]]) <= min(_LONG, len(words[order[at]]) + 4) and (n - at) * _LONG < _CELLS:
                n += 1
            block = order[at:n]
            for i, ids in zip(block, self._merge_block([words[i] for i in block]), strict=True):
                found[i] = ids
            at = n
        for i in order[at:]:
            found[i] = self.merge_one(words[i])
        return found

    def _merge_block(self, words: list[bytes]) -> list[tuple[int, ...]]:
        size = np.array([len(w) for w in words])
        wide = max(1, int(size.max()))
        padded = np.frombuffer(b"".join(w.ljust(wide, b"\0") for w in words), np.uint8).reshape(len(words), wide)
        columns = np.arange(wide)
        ids = np.where(columns < size[:, None], self.first[padded], -1).astype(np.int32)
        ranks = np.full((len(words), wide), _NONE, np.int32)
        if wide > 1:
            ranks[:, :-1] = self.rank(ids[:, :-1], ids[:, 1:])
        live = np.arange(len(words))
        while len(live):
            spot = ranks[live].argmin(1)
            best = ranks[live, spot]
            live, spot, best = live[best < _NONE], spot[best < _NONE], best[best < _NONE]
            if not len(live):
                break
            source = np.minimum(columns + (columns > spot[:, None]), wide - 1)
            ids[live] = np.take_along_axis(ids[live], source, 1)
            ranks[live] = np.take_along_axis(ranks[live], source, 1)
            ids[live, -1], ranks[live, -1] = -1, _NONE
            ids[live, spot] = self.made[best]
            before = np.maximum(spot - 1, 0)
            ranks[live, before] = np.where(spot > 0, self.rank(ids[live, before], ids[live, spot]), ranks[live, before])
            behind = np.minimum(spot + 1, wide - 1)
            ranks[live, spot] = np.where(spot + 1 < wide, self.rank(ids[live, spot], ids[live, behind]), _NONE)
        length = (ids >= 0).sum(1)
        return [tuple(row[:n]) for row, n in zip(ids.tolist(), length.tolist(), strict=True)]


def compile_lexicon(words: Iterable[bytes], merges: Merges) -> bytes:
    """The transducer of the words, as one file: transitions sorted by (state, byte) with target and weight, final states, ids.

    Words come in byte order; a state is frozen, and shared with an equal one, once no later word can
    reach it. A transition's weight is the number of words that end or branch off before it, so the
    weights along a word's path add up to its place in the order.
    """
    words = sorted(set(words))
    register: dict = {}
    frozen: list[tuple[bool, tuple]] = []
    path: list[list] = [[False, []]]  # of the last word: [final, [(byte, frozen state)]]
    last = b""

    def freeze(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in register:
            register[key] = len(frozen)
            frozen.append(key)
        return register[key]

    def shrink(depth: int) -> None:
        while len(path) - 1 > depth:
            node = path.pop()
            path[-1][1].append((last[len(path) - 1], freeze(node)))

    for word in words:
        common = next((i for i, (a, b) in enumerate(zip(word, last, strict=False)) if a != b), min(len(word), len(last)))
        shrink(common)
        path += [[False, []] for _ in word[common:]]
        path[-1][0], last = True, word
    shrink(0)
    root = freeze(path[0])
    ends = np.zeros(len(frozen), np.int64)  # words that end in or behind each state; children are frozen before parents
    keys, targets, weights = [], [], []
    for state, (final, arcs) in enumerate(frozen):
        count = int(final)
        for byte, to in arcs:
            keys.append(state << 8 | byte)
            targets.append(to)
            weights.append(count)
            count += ends[to]
        ends[state] = count
    ids = merges.merge_many(words)
    made = io.BytesIO()
    arrays = [
        np.array(keys, np.int64), np.array(targets, np.int32), np.array(weights, np.int32), np.array([f for f, _ in frozen], np.uint8),
        np.cumsum([0, *map(len, ids)]).astype(np.int64), np.array([i for w in ids for i in w], np.int32),
    ]
    made.write(np.array([root, *map(len, arrays)], np.int64).tobytes())
    for array in arrays:
        made.write(array.tobytes())
        made.write(bytes(-made.tell() % 8))
    return made.getvalue()


class Lexicon:
    """A compiled lexicon, mapped from a file that is unlinked at once: nothing stays behind."""

    def __init__(self, compiled: bytes):
        with tempfile.TemporaryFile() as f:
            f.write(compiled)
            f.flush()
            mapped = np.memmap(f, np.uint8, "r")
        head, at = mapped[:56].view(np.int64), 56
        self.root, arrays = int(head[0]), []
        for n, kind in zip(head[1:].tolist(), (np.int64, np.int32, np.int32, np.uint8, np.int64, np.int32), strict=True):
            size = n * np.dtype(kind).itemsize
            arrays.append(mapped[at : at + size].view(kind))
            at += size + -(at + size) % 8
        self.keys, self.targets, self.weights, self.final, self.starts, self.ids = arrays

    def find(self, words: list[bytes]) -> np.ndarray:
        """Number of each word, -1 where it isn't in the lexicon; all words walk the automaton side by side."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8)
        begin = np.cumsum(size) - size
        state, number = np.full(len(words), self.root, np.int64), np.zeros(len(words), np.int64)
        live = np.arange(len(words)) if len(self.keys) else np.zeros(0, np.int64)
        state[size > 0] = self.root if len(self.keys) else -1
        step = 0
        live = live[size[live] > 0]
        while len(live):
            key = state[live] << 8 | flat[begin[live] + step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[at] == key
            state[live[~ok]] = -1
            live, at = live[ok], at[ok]
            state[live] = self.targets[at]
            number[live] += self.weights[at]
            step += 1
            live = live[size[live] > step]
        found = (state >= 0) & (self.final[np.maximum(state, 0)] > 0) if len(self.final) else np.zeros(len(words), bool)
        return np.where(found, number, -1)

    def ids_of(self, number: int) -> tuple[int, ...]:
        return tuple(self.ids[self.starts[number] : self.starts[number + 1]].tolist())


class Codec:
    """Encoder and decoder of one worker."""

    def __init__(self, merges: Merges, lexicon: Lexicon):
        self.merges, self.lexicon = merges, lexicon
        self.pieces = regex.compile(_PIECE)
        self.special = regex.compile("|".join(map(regex.escape, sorted(merges.special, key=len, reverse=True))) or r"(?!)")
        self.memo: dict[str, tuple[int, ...]] = {}

    def _split(self, text: str) -> list[str]:
        if not any(s in text for s in self.merges.special):
            return self.pieces.findall(text)
        found, at = [], 0
        for m in self.special.finditer(text):
            found += [*self.pieces.findall(text[at : m.start()]), m[0]]
            at = m.end()
        return found + self.pieces.findall(text[at:])

    def encode(self, texts: list[str]) -> list[list[int]]:
        split = [self._split(t) for t in texts]
        new = {w for ws in split for w in ws}.difference(self.memo)
        if len(self.memo) + len(new) > _MEMO:
            self.memo.clear()
            new = {w for ws in split for w in ws}
        for s, i in self.merges.special.items():
            self.memo[s] = (i,)
        words = [w for w in new if w not in self.memo]
        raw = [w.encode() for w in words]
        numbers = self.lexicon.find(raw).tolist()
        unseen = [i for i, n in enumerate(numbers) if n < 0]
        merged = dict(zip(unseen, self.merges.merge_many([raw[i] for i in unseen]), strict=True))
        for i, (word, n) in enumerate(zip(words, numbers, strict=True)):
            self.memo[word] = merged[i] if n < 0 else self.lexicon.ids_of(n)
        return [list(itertools.chain.from_iterable(map(self.memo.__getitem__, ws))) for ws in split]

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.merges.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def frequent_words(docs: DataFrame, share: float = FREQUENT, text_col: str = "text") -> list[str]:
    """Runs of letters that make up at least the share of all runs in all texts: at most 1/share words."""
    runs = docs.select(F.explode(F.split(text_or_empty(text_col), r"[^\p{L}]+")).alias("word")).where("word <> ''")
    counts = materialise(runs.groupBy("word").agg(F.count("*").alias("n")).where("n > 1"), "words")
    total = counts.agg(F.sum("n")).first()[0] or 0  # runs that occur once only raise the total, never a word over the share
    found = [r[0] for r in counts.where(F.col("n") >= share * total).select("word").collect()]
    forget(counts)
    return found


def _codecs(docs: DataFrame, path: str, share: float, text_col: str):
    """A function that gives a worker its codec; the lexicon is broadcast, its size bounded by 1/share words."""
    merges = Merges(path)
    words = [w.encode() for w in frequent_words(docs, share, text_col)]
    compiled = compile_lexicon([v for w in words for v in (w, b" " + w)], merges)
    sent = send_out(docs.sparkSession, (merges, compiled))

    def codec() -> Codec:
        own, file = received(sent)
        return Codec(own, Lexicon(file))

    return codec


def _batches(texts: Iterable[str | None], characters: int = 1 << 20) -> Iterator[list[str]]:
    """Lists of about as many characters: a worker's word lists stay small whatever the batch."""
    held, n = [], 0
    for t in texts:
        held.append(t or "")
        n += len(held[-1])
        if n >= characters:
            yield held
            held, n = [], 0
    if held:
        yield held


def encode(docs: DataFrame, path: str | None = None, share: float = FREQUENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids, the token ids of the whole text, for every row.

    Strings of special tokens in a text become their ids. Null counts as empty text, which has no ids.
    Repeated rows are encoded each; an empty table gives an empty result; other columns are ignored.
    """
    codec = _codecs(docs, path or vocabulary_path(), share, text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec()
        for batch in batches:
            at = 0
            for texts in _batches(batch.column(1).to_pylist()):
                ids = pa.array(own.encode(texts), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), ids], ["doc_id", "ids"])
                at += len(texts)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(work, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of rows with ids; null ids give an empty text, unknown ids fail."""
    sent = send_out(tokens.sparkSession, Merges(path or vocabulary_path()))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Codec(received(sent), None)
        for batch in batches:
            texts = pa.array([own.decode(ids or []) for ids in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], ["doc_id", "text"])

    return tokens.select(F.col("doc_id").cast("long"), "ids").mapInArrow(work, "doc_id long, text string")


def digests(docs: DataFrame, path: str | None = None, share: float = FREQUENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: encode() and decode() in one pass, so that no ids move."""
    codec = _codecs(docs, path or vocabulary_path(), share, text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec()
        names = [str(i) for i in range(len(own.merges.token_bytes))]
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            out = []
            for texts in _batches(batch.column(1).to_pylist()):
                out += [(len(ids), sha(",".join(map(names.__getitem__, ids))), sha(own.decode(ids))) for ids in own.encode(texts)]
            counts, ids, texts = zip(*out, strict=True) if out else ((), (), ())
            found = [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(found, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5_transducer_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir))


QUERIES = {"op5_transducer_bpe": op5_transducer_bpe}
ORACLES: dict[str, str] = {}
