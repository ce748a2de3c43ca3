"""Toxicity scores by a small convolutional text classifier written in numpy.

Words and their affixes are hashed to 32 bits; those common in the training texts have an
embedding, a word is the sum of its parts. Filters of several widths run over the words, each
filter keeps its maximum over the whole text, and a logistic layer gives the score.

All labelled texts that aren't held out are learnt from. They are dealt into blocks; in every round each block
goes on from the same model, and Spark averages what the blocks have learnt.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Collection, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import documents, forget, materialise, received, send_out

#: Punctuation becomes a space.
_BLANK = bytes(32 if c < 48 or 57 < c < 65 or 90 < c < 97 or 122 < c < 128 else c for c in range(256))
#: Rows and bytes of text of a block.
ROWS_PER_BLOCK, BLOCK_TEXT = 8000, 24 << 20
#: Least share of the training texts of a part with an embedding; texts to pass at least, over all rounds, and least number of rounds.
COMMON_PART, PASSES, LEAST_ROUNDS = 5e-4, 40_000, 4
#: Blocks' values are summed as whole numbers of this fraction, in any order to the same sum; bins of one unit of a logit.
_FRACTION, _BINS = 2.0**32, 256
#: Words of short texts that are scored at once.
WORDS_AT_ONCE = 16_384
#: Lengths in bytes of the affixes that count as parts of a longer word.
AFFIXES = (5, 7, 9)
#: What a prefix's hash goes on from.
_PREFIX = zlib.crc32(b"^")
#: What each byte makes of an empty remainder.
_CRC = np.array([zlib.crc32(bytes([b]), 0xFFFFFFFF) ^ 0xFFFFFFFF for b in range(256)], np.uint32)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(_BLANK).split()


def parts_of(word: bytes) -> list[int]:
    """Hashes of the word, its prefixes and its suffix."""
    found = [zlib.crc32(word)]
    if len(word) > AFFIXES[0]:
        found += [zlib.crc32(word[:k], _PREFIX) for k in AFFIXES if len(word) > k]
        found.append(zlib.crc32(b"$", zlib.crc32(word[-AFFIXES[0] :])))
    return found


def _ranges(first: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """first[k] to first[k + 1] for all k in `of`, one after the other, and where each begins."""
    size = first[of + 1] - first[of]
    begin = np.cumsum(size) - size
    return np.repeat(first[of] - begin, size) + np.arange(size.sum()), begin


@dataclass
class TextCNN:
    """The classifier; fit() on texts and 0/1 labels, score() gives chances of label 1."""

    width: int = 12
    filters: int = 8
    spans: tuple[int, ...] = (1, 2, 3)
    epochs: int = 10
    batch: int = 64
    rate: float = 0.02
    min_texts: int = 3
    seed: int = 7
    parts: np.ndarray = field(default=None, repr=False)
    table: np.ndarray = field(default=None, repr=False)
    kernels: np.ndarray = field(default=None, repr=False)
    bias: np.ndarray = field(default=None, repr=False)
    out: np.ndarray = field(default=None, repr=False)
    thresholds: dict = field(default_factory=dict)
    moments: dict = field(default=None, repr=False)
    squares: np.ndarray = field(default=None, repr=False)
    step: int = 0

    def _located(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Embedding rows of the known ones of the words' parts, and where each word's begin."""
        at = np.minimum(np.searchsorted(self.parts, hashes), max(len(self.parts) - 1, 0))
        known = self.parts[at] == hashes if len(self.parts) else np.zeros(len(hashes), bool)
        return at[known].astype(np.int32), np.concatenate([[0], np.cumsum(known)])[first].astype(np.int32)

    def _embed(self, words: list[bytes]) -> np.ndarray:
        rows, first = self._located(*_lexicon_parts(words))
        made = np.zeros((len(words), self.width), np.float32)
        some = np.flatnonzero(np.diff(first))
        if len(some):
            made[some] = np.add.reduceat(self.table[rows], first[some], axis=0)
        return made

    def _offsets(self) -> list[tuple[int, int, int]]:
        """(span, shift, first column of its projections)."""
        found, at = [], 0
        for span in self.spans:
            for shift in range(span):
                found.append((span, shift, at))
                at += self.filters
        return found

    def _pool(self, projected: np.ndarray, sizes: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Maxima of all filters over each of the texts, whose words, `sizes` of them in each, have the projections; with `places` also where they are."""
        pad = max(self.spans) - 1
        begin = np.cumsum(sizes + pad) - sizes - pad  # zeros stand before every text and behind the last
        total_size = int(sizes.sum() + pad * len(sizes))
        padded = np.zeros((projected.shape[1], total_size + pad), np.float32)
        padded[:, np.arange(len(projected)) + np.repeat(pad * np.arange(1, len(sizes) + 1), sizes)] = projected.T
        best, where = [], []
        for s, span in enumerate(self.spans):
            total = 0
            for width, shift, at in self._offsets():
                if width == span:
                    total = total + padded[at : at + self.filters, shift : total_size + shift]
            peak = np.maximum.reduceat(total, begin, axis=1)
            best.append(peak.T + self.bias[s])
            if places:
                spots = np.where(total == np.repeat(peak, sizes + pad, axis=1), np.arange(total_size), total_size)
                where.append((np.minimum.reduceat(spots, begin, axis=1) - begin - pad).T)
        return np.hstack(best), np.hstack(where) if places else None

    def start(self, parts: np.ndarray) -> TextCNN:
        """Untrained values for the sorted parts."""
        rng = np.random.default_rng(self.seed)
        n_in, n_out, n_pool = self.width, self.filters * sum(self.spans), self.filters * len(self.spans)
        self.parts = parts.astype(np.uint32)
        self.table = rng.normal(0, 0.1, (len(parts), n_in)).astype(np.float32)
        self.kernels = rng.normal(0, 0.5, (n_in, n_out)).astype(np.float32)
        self.bias = np.zeros((len(self.spans), self.filters), np.float32)
        self.out = np.concatenate([rng.normal(0, 0.3, n_pool), [0.0]]).astype(np.float32)
        self.moments = {name: (np.zeros_like(getattr(self, name)), np.zeros_like(getattr(self, name))) for name in ("out", "bias", "kernels")}
        self.squares = np.zeros(len(parts), np.float32)
        self.step = 0
        return self

    def dense(self) -> list[np.ndarray]:
        """All values but the embeddings, each with its moments."""
        return [x for name in ("out", "bias", "kernels") for x in (getattr(self, name), *self.moments[name])]

    def coded(self, texts: list[str], labels: list[int]) -> tuple:
        """Texts as learn() takes them: the places of their words in a lexicon, the embedding rows of its words and where each word's begin, labels."""
        codes, hashes, first, y = _worded(texts, labels)
        return codes, *self._located(hashes, first), y

    def fit(self, texts: list[str], labels: list[int]) -> TextCNN:
        found, counts = _part_counts(texts)
        self.start(found[counts >= self.min_texts])
        block, rng = self.coded(texts, labels), np.random.default_rng(self.seed)
        for _ in range(self.epochs):
            self.learn(block, rng)
        return self

    def learn(self, block: tuple, rng: np.random.Generator, weight: tuple[float, float] = (1.0, 1.0)) -> np.ndarray:
        """One pass over a coded block, label 0 and 1 of these weights; returns the embedding rows that changed."""
        coded, rows, first, y = block
        n_in, changed = self.width, np.zeros(len(self.parts), bool)

        def adam(name: str, grad: np.ndarray) -> None:
            (m, v), value = self.moments[name], getattr(self, name)
            m += 0.1 * (grad - m)
            v += 0.001 * (grad * grad - v)
            value -= self.rate * (m / (1 - 0.9**self.step)) / (np.sqrt(v / (1 - 0.999**self.step)) + 1e-7)

        vectors = np.zeros((len(first) - 1, n_in), np.float32)
        order = rng.permutation(len(coded))
        for at in range(0, len(order), self.batch):
            self.step += 1
            chosen = order[at : at + self.batch]
            used = np.unique(np.concatenate([coded[i] for i in chosen]))
            own, begin = _ranges(first, used)
            some = first[used + 1] > first[used]
            vectors[used] = 0
            if some.any():
                vectors[used[some]] = np.add.reduceat(self.table[rows[own]], begin[some], axis=0)
            projected = vectors[used] @ self.kernels
            place = np.zeros(len(vectors), np.int32)
            place[used] = np.arange(len(used))
            g_out, g_bias, g_kernel = np.zeros_like(self.out), np.zeros_like(self.bias), np.zeros_like(self.kernels)
            sizes, codes = np.array([len(coded[i]) for i in chosen]), np.concatenate([coded[i] for i in chosen])
            pooled, where = self._pool(projected[place[codes]], sizes, places=True)
            hidden = np.maximum(pooled, 0)
            chance = 1 / (1 + np.exp(-np.clip(hidden @ self.out[:-1] + self.out[-1], -30, 30)))
            error = ((chance - y[chosen]) * np.array(weight)[y[chosen].astype(int)] / len(chosen)).astype(np.float32)
            g_out += np.append(error @ hidden, error.sum())
            back = error[:, None] * self.out[:-1] * (pooled > 0)
            g_bias += back.sum(0).reshape(g_bias.shape)
            words, pulls = [], []
            text_at = np.cumsum(sizes) - sizes
            for width, shift, col in self._offsets():
                part = slice(self.spans.index(width) * self.filters, (self.spans.index(width) + 1) * self.filters)
                spots = where[:, part] + shift
                text, of = np.nonzero((spots >= 0) & (spots < sizes[:, None]))
                if len(text):
                    touched, pull = codes[text_at[text] + spots[text, of]], back[text, part.start + of][:, None]
                    np.add.at(g_kernel.T, col + of, vectors[touched] * pull)
                    words.append(touched)
                    pulls.append(pull * self.kernels[:, col + of].T)
            adam("out", g_out + 1e-4 * self.out)
            adam("bias", g_bias)
            adam("kernels", g_kernel)
            if words:  # embeddings: Adagrad, only the rows that a maximum touched
                words, pulls = np.concatenate(words), np.concatenate(pulls)
                spread = np.repeat(np.arange(len(words)), first[words + 1] - first[words])
                hit = rows[_ranges(first, words)[0]]
                if len(hit):
                    unique, back_at = np.unique(hit, return_inverse=True)
                    grad = np.column_stack([np.bincount(back_at, pulls[spread, k], len(unique)) for k in range(n_in)]).astype(np.float32)
                    self.squares[unique] += (grad * grad).mean(1)
                    self.table[unique] -= 0.1 * grad / (np.sqrt(self.squares[unique])[:, None] + 1e-6)
                    changed[unique] = True
        return np.flatnonzero(changed)

    def scorer(self):
        """A function from texts to their scores; it remembers the projections of up to 200,000 words."""
        memo: dict[bytes, int] = {}
        kept = np.zeros((1024, self.kernels.shape[1]), np.float32)

        def some(each: list[list[bytes]]) -> np.ndarray:
            nonlocal kept
            present = set().union(*each)
            new = sorted(present.difference(memo))
            if len(memo) + len(new) > 200_000:
                memo.clear()
                new = sorted(present)
            if new:
                start = len(memo)
                while start + len(new) > len(kept):
                    kept = np.concatenate([kept, np.zeros_like(kept)])
                kept[start : start + len(new)] = self._embed(new) @ self.kernels
                memo.update(zip(new, range(start, start + len(new)), strict=True))
            sizes = np.array([len(words) for words in each])
            codes = np.fromiter(map(memo.__getitem__, chain.from_iterable(each)), np.int64, sizes.sum())
            hidden = np.maximum(self._pool(kept[codes], sizes)[0], 0)
            return 1 / (1 + np.exp(-np.clip((hidden * self.out[:-1]).sum(1) + self.out[-1], -30, 30).astype(np.float64)))  # a text's sum doesn't depend on its neighbours

        def scores(texts: list[str | None]) -> np.ndarray:
            found, each, n = [], [], 0
            for text in texts:
                words = words_of(text)
                if each and n + len(words) > WORDS_AT_ONCE:
                    found.append(some(each))
                    each, n = [], 0
                each.append(words)
                n += len(words) + max(self.spans)
            return np.concatenate([*found, some(each)]) if each else np.zeros(0)

        return scores


def is_held_out(id_col: str = "doc_id"):
    """crc32 of the id's decimal text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def _crc32(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, value: int = 0) -> np.ndarray:
    """zlib.crc32 of many stretches of the data, byte by byte over all of them."""
    order = np.argsort(-sizes, kind="stable")
    starts, falling = starts[order], -sizes[order]
    now = np.full(len(sizes), value ^ 0xFFFFFFFF, np.uint32)
    for k in range(int(sizes.max(initial=0))):
        still = np.searchsorted(falling, -k)  # those of more than k bytes
        now[:still] = _CRC[(now[:still] ^ data[starts[:still] + k]) & 255] ^ (now[:still] >> 8)
    found = np.empty_like(now)
    found[order] = now ^ np.uint32(0xFFFFFFFF)
    return found


def _lexicon_parts(words: Collection[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """parts_of() the words, one word after the other, and where each word's begin."""
    data, sizes = np.frombuffer(b"".join(words), np.uint8), np.fromiter(map(len, words), np.int64, len(words))
    starts, affixed = np.cumsum(sizes) - sizes, sizes > AFFIXES[0]
    prefixes = [np.flatnonzero(sizes > k) for k in AFFIXES]
    first = np.concatenate([[0], np.cumsum(1 + affixed + sum((sizes > k).astype(int) for k in AFFIXES))])
    parts, most = np.empty(first[-1], np.uint32), 64
    parts[first[:-1]] = _crc32(data, starts, np.where(sizes > most, 0, sizes))
    for i in np.flatnonzero(sizes > most):
        parts[first[i]] = zlib.crc32(data[starts[i] : starts[i] + sizes[i]])
    for at, (k, long) in enumerate(zip(AFFIXES, prefixes, strict=True), 1):
        parts[first[long] + at] = _crc32(data, starts[long], np.full(len(long), k), _PREFIX)
    ends = _crc32(data, (starts + sizes - AFFIXES[0])[affixed], np.full(affixed.sum(), AFFIXES[0])) ^ np.uint32(0xFFFFFFFF)
    parts[first[1:][affixed] - 1] = _CRC[(ends ^ ord("$")) & 255] ^ (ends >> 8) ^ np.uint32(0xFFFFFFFF)
    return parts, first.astype(np.int32)


def _worded(texts: list[str], labels: list[int]) -> tuple:
    """A block without a model: the places of the texts' words in a lexicon, the parts of its words and where each word's begin, labels."""
    each, lexicon = [words_of(t) for t in texts], {}
    for words in each:
        new = sorted(set(words).difference(lexicon))
        lexicon.update(zip(new, range(len(lexicon), len(lexicon) + len(new)), strict=True))
    codes = [np.fromiter(map(lexicon.__getitem__, words), np.int32, len(words)) for words in each]
    return codes, *_lexicon_parts(lexicon), np.array(labels, np.float32)


def _counted(block: tuple) -> tuple[np.ndarray, np.ndarray]:
    """The sorted parts of a _worded() block, and how many of its texts have each."""
    codes, hashes, first, _ = block
    parts, place = np.unique(hashes, return_inverse=True)
    counts, last = np.zeros(len(parts), np.int64), np.full(len(parts), -1)
    for words in codes:
        flat = place[_ranges(first, words)[0]]
        last[flat] = np.arange(len(flat))
        counts[flat[last[flat] == np.arange(len(flat))]] += 1
    return parts, counts


def _part_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The sorted parts of the texts' words, and how many texts have each."""
    return _counted(_worded(texts, [0] * len(texts)))


def _unpacked(size: int, packed: bytes) -> tuple:
    return pickle.loads(pa.decompress(packed, size, codec="zstd", asbytes=True))


def _common_parts(blocks: DataFrame, least: float) -> np.ndarray:
    """Sorted parts that at least so many of the blocks' texts have."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, packed in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                parts, counts = _counted(_unpacked(size, packed))
                for k in range(0, len(parts), 1 << 16):
                    part = slice(k, k + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array(parts[part].astype(np.int64)), pa.array(counts[part])], ["part", "n"])

    found = blocks.select("size", "packed").mapInArrow(work, "part long, n long").groupBy("part").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return np.sort(found.select("part").toArrow()["part"].to_numpy()).astype(np.uint32)


def _dealt(rows: DataFrame, blocks: int, both: bool) -> DataFrame:
    """(block, size, packed) of the rows to learn from, and (block, toxic, lang, text) of those kept back; with `both` all rows are either.

    rows(turn, doc_id, back, lang, toxic, text): a row without a text is the label of the documents with its id, which have none
    themselves. Labels and texts come to their block by one shuffle and meet there in the order of the ids.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, mark = None, [], (None, None)

        def made(block: list, size: list, packed: list, toxic: list, lang: list, text: list) -> pa.RecordBatch:
            kinds = [pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.string(), pa.string()]
            of = [pa.array(c, k) for c, k in zip((block, size, packed, toxic, lang, text), kinds, strict=True)]
            return pa.RecordBatch.from_arrays(of, ["block", "size", "packed", "toxic", "lang", "text"])

        def whole() -> pa.RecordBatch:
            raw = pickle.dumps(_worded(*map(list, zip(*held, strict=True))))
            return made([now], [len(raw)], [pa.compress(raw, codec="zstd", asbytes=True)], [None], [None], [None])

        for batch in batches:
            rest = []
            columns = [batch.column(k) for k in ("block", "doc_id", "back", "lang", "toxic")]
            texts = batch.column("text")
            for i, (block, doc, back, lang, toxic) in enumerate(zip(*[c.to_pylist() for c in columns], strict=True)):
                if toxic is None and mark[0] != doc:
                    continue  # no label: its text stays in Arrow
                text = texts[i].as_py()
                if text is None:
                    mark = doc, toxic
                    continue
                if block != now and held:
                    yield whole()
                    held = []
                now = block
                toxic = mark[1] if toxic is None else toxic
                if both or not back:
                    held.append((text, toxic))
                if both or back:
                    rest.append((block, None, None, toxic, lang, text))
            if rest:
                yield made(*map(list, zip(*rest, strict=True)))
        if held:
            yield whole()

    dealt = rows.withColumn("block", F.pmod("turn", F.lit(blocks)).cast("int")).repartitionById(blocks, F.col("block"))
    return dealt.sortWithinPartitions("block", "turn", "doc_id", "text").mapInArrow(work, "block int, size long, packed binary, toxic int, lang string, text string")


def _blocks(rows: DataFrame, model: TextCNN, blocks: int) -> DataFrame:
    """(block, size, packed): rows(turn, toxic, text), dealt by their turn; a block has the parts of all its words, whether or not the model knows them."""
    rows = rows.withColumn("doc_id", F.col("turn")).withColumn("back", F.lit(False)).withColumn("lang", F.lit(None).cast("string"))
    return _dealt(rows, blocks, False).select("block", "size", "packed")


def _round(blocks: DataFrame, model: TextCNN, turn: int, weight: tuple[float, float]) -> None:
    """One pass over all blocks, each from the model as it is, which then takes their mean: an embedding's over the blocks that changed it."""
    sent = send_out(blocks.sparkSession, model)
    columns = [f"v{i}" for i in range(model.width + 1)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block, size, packed = (c[i].as_py() for c in batch.columns)
                own = received(sent)
                codes, hashes, first, y = _unpacked(size, packed)
                changed = own.learn((codes, *own._located(hashes, first), y), np.random.default_rng([own.seed, turn, block]), weight)
                flat = np.concatenate([x.ravel() for x in own.dense()])
                flat = np.pad(flat, (0, -len(flat) % len(columns))).reshape(-1, len(columns))
                values = np.concatenate([flat, np.column_stack([own.table[changed], own.squares[changed]])])
                rows = np.concatenate([-1 - np.arange(len(flat)), changed]).astype(np.int32)  # below 0: what isn't an embedding
                whole = np.rint(values.astype(np.float64) * _FRACTION).astype(np.int64)
                for at in range(0, len(rows), 1 << 14):
                    part = slice(at, at + (1 << 14))
                    yield pa.RecordBatch.from_arrays([pa.array(rows[part]), *[pa.array(c) for c in whole[part].T.copy()]], ["row", *columns])

    learnt = blocks.mapInArrow(work, ", ".join(["row int", *[f"{c} long" for c in columns]]))
    sums = learnt.groupBy("row").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in columns])
    means = sums.select("row", *[(F.col(c) / F.col("n") / F.lit(_FRACTION)).cast("float").alias(c) for c in columns]).toArrow().sort_by("row")  # no row becomes an object of the driver
    rows, values = means["row"].to_numpy(), np.column_stack([means[c].to_numpy() for c in columns])
    sent.destroy()
    model.table[rows[rows >= 0]] = values[rows >= 0, :-1]
    model.squares[rows[rows >= 0]] = values[rows >= 0, -1]
    flat, at = values[rows < 0][::-1].ravel(), 0
    for x in model.dense():
        x[...] = flat[at : at + x.size].reshape(x.shape)
        at += x.size


def train(docs: DataFrame, labels: DataFrame, rows_per_block: int = ROWS_PER_BLOCK, block_text: int = BLOCK_TEXT, **settings) -> TextCNN:
    """Fit on all labelled rows that aren't held out, whatever their length.

    One in five of them is kept from fitting; all these set the logit shift and, for each language, the threshold of the
    best accuracy (drawn to 0.5 where rows are few). Blocks have about rows_per_block rows, and block_text bytes at most on average;
    there are `epochs` rounds at most, fewer where rows are many. Both labels weigh the same.
    Rows with a null label are left out, a null text is an empty one, rows of one id count each; labelled twice, a row counts as toxic if either is.
    Without rows of both labels every text gets the share of label 1.
    """
    marks = materialise(labels.where("toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")), "marks")
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    kept_back = F.crc32(F.concat(F.lit("calibrate "), F.col("doc_id").cast("string"))) % 5 == 0
    of = docs.where(~is_held_out() & F.col("doc_id").isNotNull()).select("doc_id", kept_back.alias("back"), lang.alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    n, n_text = np.zeros((2, 2), np.int64), 0
    sizes = of.select("doc_id", "back", F.octet_length("text").alias("size")).join(marks, "doc_id")  # no text is moved for it
    for r in sizes.groupBy("back", F.col("toxic") > 0).agg(F.count("*"), F.sum("size")).collect():
        n[int(r[0]), int(r[1])], n_text = r[2], n_text + r[3]
    model = TextCNN(**settings)
    if not n.sum(0).all():
        model.fit([], [])
        share = n[:, 1].sum() / n.sum() if n.sum() else 0.0
        model.out[:] = 0
        model.out[-1] = np.log((share + 1e-6) / (1 - share + 1e-6))
        return model
    both = not n.all()
    if both:
        n = np.stack([n.sum(0)] * 2)
    n_fit = int(n[0].sum())
    one = marks.where(~is_held_out()).select(F.col("doc_id").cast(of.schema["doc_id"].dataType), F.lit(False).alias("back"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("text"), "toxic")
    rows = of.withColumn("toxic", F.lit(None).cast("int")).unionByName(one).withColumn("turn", F.xxhash64("doc_id"))
    seen = materialise(_dealt(rows, max(1, -(-n_fit // rows_per_block), -(-n_text // block_text)), both), "labelled")
    blocks, rest = seen.where("packed IS NOT NULL").select("block", "size", "packed"), seen.where("text IS NOT NULL").select("toxic", "lang", "text")
    model.start(_common_parts(blocks, max(model.min_texts, COMMON_PART * n_fit)))
    weight = tuple((n_fit / (2 * n[0])).tolist())
    rounds = min(model.epochs, max(LEAST_ROUNDS, -(-PASSES // n_fit)))
    steps = max(1, -(-n_fit // max(1, -(-n_fit // rows_per_block)) // model.batch))
    for turn in range(rounds):
        _round(blocks, model, turn, weight)
        model.step = (turn + 1) * steps
    model.moments = model.squares = None
    _calibrate(model, rest, marks.where(~is_held_out()).agg(F.avg("toxic")).first()[0])
    forget(seen)
    return model


def _calibrate(model: TextCNN, rest: DataFrame, prior: float) -> None:
    """Shift the model's logit and set the languages' thresholds by all rows of rest, whose logits are counted in bins."""
    scored = _scored(rest.select("toxic", "lang", "text"), model, "toxic int, lang string")
    score = F.least(F.greatest("score", F.lit(1e-6)), F.lit(1 - 1e-6))
    binned = scored.select("lang", "toxic", F.round(F.log(score / (1 - score)) * _BINS).cast("int").alias("bin"))
    found = binned.groupBy("lang", "bin").agg(F.sum(F.when(F.col("toxic") > 0, 0).otherwise(1)).alias("n0"), F.sum(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("n1"))
    found = found.toArrow().to_pandas()
    every = found.groupby("bin", as_index=False)[["n0", "n1"]].sum()
    few = min(every["n0"].sum(), every["n1"].sum())
    cut = _best_cut(every, prior) * few / (few + 20)
    model.out[-1] -= np.float32(cut)
    for lang, own in found.groupby("lang"):
        few = min(own["n0"].sum(), own["n1"].sum())
        if few:
            shift = (_best_cut(own, prior) - cut) * few / (few + 20)
            model.thresholds[lang] = float(1 / (1 + np.exp(-shift)))


def _best_cut(bins: pd.DataFrame, prior: float) -> float:
    """Middle of the gap between bins of logits that gives the best accuracy where label 1 has the share prior; of equals the nearest to 0."""
    bins = bins.sort_values("bin")
    s, n0, n1 = bins["bin"].to_numpy() / _BINS, bins["n0"].to_numpy(), bins["n1"].to_numpy()
    below = np.concatenate([[0], np.cumsum(n0)]) / max(1, n0.sum())
    above = 1 - np.concatenate([[0], np.cumsum(n1)]) / max(1, n1.sum())
    gain = (1 - prior) * below + prior * above
    edges = np.concatenate([[s[0] - 1], (s[1:] + s[:-1]) / 2, [s[-1] + 1]])
    best = np.flatnonzero(gain >= gain.max() - 1e-9)
    return float(edges[best[np.abs(edges[best]).argmin()]])


def _scored(rows: DataFrame, model: TextCNN, schema: str) -> DataFrame:
    """rows with text -> the same without it and with score; the model has parts of a share of COMMON_PART or more."""
    sent = send_out(rows.sparkSession, model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = received(sent).scorer()
        for batch in batches:
            scores = pa.array(score(batch.column("text").to_pylist()), pa.float64())
            yield batch.drop_columns(["text"]).append_column("score", scores)

    return rows.mapInArrow(work, f"{schema}, score double")


def threshold(model: TextCNN):
    """The least score that is flagged, by the language in column lang; 0.5 for languages without one."""
    found = F.lit(0.5)
    for name, value in sorted(model.thresholds.items()):
        found = F.when(F.col("lang") == name, F.lit(value)).otherwise(found)
    return found


def toxicity(docs: DataFrame, model: TextCNN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted (score >= 0.5), threshold and flagged (by language) for every row.

    The whole text is scored and nothing else; null counts as empty, which scores like a text of
    unknown words. lang only picks the threshold of `flagged`. Repeated rows are scored each; an
    empty table gives an empty result; other columns are ignored. Texts of a few thousand words are
    scored together, longer ones one at a time, so memory follows the longest.
    """
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).alias("doc_id"), is_held_out(id_col).alias("held_out"), lang.alias("lang"), F.col(text_col).alias("text"))
    return _scored(rows, model, "doc_id long, held_out boolean, lang string").withColumn("threshold", threshold(model)).select(
        "doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "threshold",
        (F.col("score") >= F.col("threshold")).alias("flagged"),
    )


def keep_clean(docs: DataFrame, model: TextCNN) -> DataFrame:
    """The rows of docs that aren't flagged, with all their columns; rows pass their worker whole, so nothing is joined.

    A null text is scored as an empty one; repeated rows stay or go together; an empty table stays empty.
    """
    sent = send_out(docs.sparkSession, model)
    bars, names = dict(model.thresholds), docs.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = received(sent).scorer()
        for batch in batches:
            texts = batch.column(names.index("text")).to_pylist()
            langs = batch.column(names.index("lang")).to_pylist() if "lang" in names else [None] * len(texts)
            yield batch.filter(pa.array(score(texts) < np.array([bars.get(l, 0.5) for l in langs], np.float64), pa.bool_()))

    return docs.mapInArrow(work, docs.schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


QUERIES = {"op3_toxicity": op3_toxicity}
ORACLES: dict[str, str] = {}
