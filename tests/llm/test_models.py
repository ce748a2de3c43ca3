"""Toxicity, suffix tree, tokens and packing."""

import collections
import math
import random
import re
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe, packing, suffix_tree, toxicity


def test_toxicity_learns_held_out(spark):
    rnd = random.Random(1)
    words = ["lorem", "ipsum", "dolor", "amet", "sit", "elit", "magna", "aliqua"]
    rows, labels = [], []
    for i in range(600):
        text = [rnd.choice(words) for _ in range(rnd.randrange(5, 40))]
        bad = i % 4 == 0
        if bad:
            text.insert(rnd.randrange(len(text)), rnd.choice(["grumpface", "zorkhead"]))
        rows.append((i, " ".join(text), "en" if i % 2 else "xx", "z"))
        labels.append((i, int(bad)))
    rows += [(1000, None, None, "z"), (1001, "", "en", "z"), (None, "x", "en", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    marks = spark.createDataFrame(labels + [(5000, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, marks, 300)
    got = toxicity.toxicity(docs, model).collect()
    truth = dict(labels)
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    held = [r for r in got if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(r.held_out for r in held)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    again = toxicity.toxicity(docs, toxicity.train(docs, marks, 300)).collect()
    assert sorted((r.doc_id or -1, r.score) for r in again) == sorted((r.doc_id or -1, r.score) for r in got)
    clean = toxicity.keep_clean(docs, model)
    assert clean.columns == docs.columns and 440 < clean.count() < 470
    assert toxicity.toxicity(docs.limit(0), model).count() == 0


def test_scores_equal_a_plain_forward_pass(spark):
    """Every window of every width, word by word and filter by filter."""
    rnd = random.Random(4)
    texts = [" ".join(rnd.choice(["bad", "worse", "fine", "good", "baddest", "finery", "x"]) for _ in range(rnd.randrange(12))) for _ in range(120)]
    model = toxicity.TextCNN(epochs=2)
    model.fit(texts, [int("bad" in t.split()) for t in texts])
    row = {int(p): model.table[i] for i, p in enumerate(model.parts)}

    def plain(text):
        vectors = []
        for w in toxicity.words_of(text):
            v = np.zeros(model.width, np.float64)
            for p in toxicity.parts_of(w):
                v += row.get(p, 0)
            vectors.append(v)
        pooled, column = [], 0
        for s, span in enumerate(model.spans):
            pad = max(model.spans) - 1
            tops = [-math.inf] * model.filters
            for start in range(-pad, len(vectors) + pad - span + 1):
                for f in range(model.filters):
                    total = 0.0
                    for shift in range(span):
                        if 0 <= start + shift < len(vectors):
                            total += float(vectors[start + shift] @ model.kernels[:, column + shift * model.filters + f])
                    tops[f] = max(tops[f], total)
            pooled += [max(0.0, t + model.bias[s][f]) for f, t in enumerate(tops)]
            column += span * model.filters
        return 1 / (1 + math.exp(-(sum(h * o for h, o in zip(pooled, model.out[:-1])) + model.out[-1])))

    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, "", None, "bad " * 5000 + "unknownword"])], "doc_id long, text string")
    for r in toxicity.toxicity(docs, model).collect():
        text = [*texts, "", None, "bad " * 5000 + "unknownword"][r.doc_id]
        assert math.isclose(r.score, plain(text), rel_tol=1e-4, abs_tol=1e-5)


def test_a_repeated_id_reaches_the_driver_once(spark):
    rows = [(1, f"bad text {k}") for k in range(200)] + [(i, "fine words") for i in range(2, 60)]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i == 1)) for i in range(1, 60)], "doc_id long, toxic int")
    model = toxicity.train(docs.withColumn("lang", F.lit(None).cast("string")), marks, 50, epochs=1)
    assert toxicity.toxicity(docs, model).count() == len(rows)


def test_all_labelled_rows_are_learnt_from(spark):
    """A word of 40 toxic texts, 10 of them in each of four blocks, and one that only very long texts have."""
    rnd = random.Random(8)
    filler = [f"plain{k}" for k in range(60)]
    rows, marks = [], []
    for i in range(1200):
        text = [rnd.choice(filler) for _ in range(rnd.randrange(5, 30))]
        bad = i % 10 == 0
        if bad:
            text.insert(rnd.randrange(len(text)), "zorkhead" if i % 20 else "grumpface")
        if i % 20 == 0:
            text += ["plain1 plain2 plain3"] * 2500
        rows.append((i, " ".join(text)))
        marks.append((i, int(bad)))
    assert all(len(t) > 40_000 for i, t in rows if i % 20 == 0)
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(marks, "doc_id long, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.toxicity(docs, toxicity.train(docs, labels, 200)).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i] == dict(marks)[i] for i in held]) > 0.97
    assert all(got[i] == 1 for i in held if i % 20 == 0)


def test_rounds_over_blocks_take_the_mean(spark):
    texts, labels = ["bad words here", "fine words here", "bad again", "fine again"] * 8, [1, 0, 1, 0] * 8
    model = toxicity.TextCNN(min_texts=1).start(toxicity._part_counts(texts)[0])
    one = toxicity.pickle.dumps(model)
    rows = spark.createDataFrame([(i, y, t) for i, (t, y) in enumerate(zip(texts, labels))], "turn long, toxic int, text string")
    toxicity._round(toxicity._blocks(rows, model, 2), model, 0, (1.0, 1.0))
    found = []
    for block in (0, 1):
        own = toxicity.pickle.loads(one)
        held = sorted((i, t, y) for i, (t, y) in enumerate(zip(texts, labels)) if i % 2 == block)
        changed = own.learn(own.coded([t for _, t, _ in held], [y for *_, y in held]), np.random.default_rng([own.seed, 0, block]))
        found.append((own, set(changed.tolist())))
    assert np.allclose(model.out, (found[0][0].out + found[1][0].out) / 2, atol=1e-6)
    assert np.allclose(model.kernels, (found[0][0].kernels + found[1][0].kernels) / 2, atol=1e-6)
    for row in range(len(model.parts)):
        of = [own.table[row] for own, changed in found if row in changed] or [toxicity.pickle.loads(one).table[row]]
        assert np.allclose(model.table[row], np.mean(of, 0), atol=1e-6)


def test_a_round_makes_no_objects_of_its_rows(spark):
    """What the driver gets of a round, a value for each number of the model, takes a few times the model's memory there."""
    rnd = random.Random(11)
    texts = [" ".join(f"w{rnd.randrange(20_000)}" for _ in range(100)) for _ in range(800)]
    model = toxicity.TextCNN(min_texts=1).start(toxicity._part_counts(texts)[0])
    rows = spark.createDataFrame([(i, i % 2, t) for i, t in enumerate(texts)], "turn long, toxic int, text string")
    blocks, before = toxicity._blocks(rows, model, 2), model.table.copy()
    tracemalloc.start()
    toxicity._round(blocks, model, 0, (1.0, 1.0))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    changed = (model.table != before).any(1).sum()
    assert changed > 5_000 and peak < 5 * model.table.nbytes + 1_000_000


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.toxicity(docs, model).first().predicted == 0


def words_of(t):
    return (t or "").encode().lower().split()


class PlainTree:
    """The same model from dictionaries, one symbol at a time."""

    def __init__(self, texts, frequent, common, seen=2, prior=0.5, divergence=0.05):
        count = collections.Counter(w for t in texts for w in words_of(t))
        self.n = sum(count.values()) + len(texts)
        self.count, self.many = count, {w for w, c in count.items() if c >= frequent * self.n}
        self.rare = {w: c for w, c in count.items() if w not in self.many}
        seqs = [self.symbols(t) for t in texts]
        root = collections.Counter(x for s in seqs for x in s[2:])
        self.root = {x: math.log10((root[x] + 0.5) / (self.n + 0.5 * (len(self.many) + 2))) for x in [*self.many, "END", "RARE"]}
        often = {x: c for x, c in [*root.items(), ("START", len(texts))] if c >= max(1, common * self.n)}
        self.nodes = {}
        for length in (1, 2):
            follow = collections.defaultdict(collections.Counter)
            for s in seqs:
                for i in range(2, len(s)):
                    follow[tuple(s[i - length : i])][s[i]] += 1
            for context, next_ in follow.items():
                if length == 1 and context[0] in often:
                    continue
                total, edges = sum(next_.values()), {x: c for x, c in next_.items() if c >= seen}
                rest = math.log10(1 - sum(edges.values()) / (total + prior))
                logs = {x: math.log10(c / (total + prior)) for x, c in edges.items()}
                gain = sum(c * (logs[x] - self.log(context[1:], x)) for x, c in edges.items()) + (total - sum(edges.values())) * rest
                if gain * math.log(10) >= divergence * total:
                    self.nodes[context] = (logs, rest)
        self.bytes = collections.Counter()
        for w, c in count.items():
            past = [257, 257]
            for x in [*w, 256]:
                self.bytes[past[-2], past[-1], x] += c
                past.append(x)

    def symbols(self, t):
        return ["START", "START", *[w if w in self.many else "RARE" for w in words_of(t)], "END"]

    def log(self, context, x):
        if not context:
            return self.root[x]
        logs, rest = self.nodes.get(context, ({}, 0.0))
        return logs[x] if x in logs else rest + self.log(context[1:], x)

    def spelt(self, w):
        past, total = [257, 257], 0.0
        own, every = collections.Counter(), sum(self.bytes.values())
        for (_, _, x), c in self.bytes.items():
            own[x] += c
        for x in [*w, 256]:
            n = sum(c for (i, j, _), c in self.bytes.items() if (i, j) == (past[-2], past[-1]))
            total += math.log10((self.bytes[past[-2], past[-1], x] + 4 * (own[x] + 0.5) / (every + 0.5 * 257)) / (n + 4))
            past.append(x)
        return total

    def score(self, t):
        s = self.symbols(t)
        total = sum(self.log(tuple(s[i - 2 : i]), s[i]) for i in range(2, len(s)))
        n = sum(self.rare.values())
        for w in words_of(t):
            if w in self.rare:
                total += math.log10((self.rare[w] - 0.5) / (n + 1))
            elif w not in self.many:
                total += math.log10((0.5 * len(self.rare) + 1) / (n + 1)) + self.spelt(w)
        return total


@pytest.mark.parametrize("settings", [{}, {"frequent": 0.004, "common": 0.1}, {"frequent": 0.001, "shard_text": 100}])
def test_suffix_tree_equals_a_plain_one(spark, settings):
    rnd = random.Random(4)
    pair = {"the": ["cat", "Dog", "sun"], "cat": ["runs", "sleeps"], "dog": ["runs"]}

    def text():
        found = [rnd.choice(["the", "cat", "Dog", "runs", "é" * 3])]
        for _ in range(rnd.randrange(30)):
            found.append(rnd.choice(pair.get(found[-1].lower(), ["the", "a", "and", "odd" + str(rnd.randrange(200))])))
        return " ".join(found)

    rows = [(i, text()) for i in range(300)] + [(300, None), (301, ""), (302, "zzz qqq"), (303, "the cat"), (303, "the cat"), (None, "the cat"), ((1 << 60) + 1, "the dog runs " * 50)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, key int")
    learnt = [t for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 5 != 1]
    tree = PlainTree(learnt, settings.get("frequent", suffix_tree.FREQUENT), settings.get("common", suffix_tree.COMMON))
    assert len([c for c in tree.nodes if len(c) == 2]) > 20
    counts = collections.Counter(w for t in learnt for w in [*words_of(t), "end"])
    below = tree.n + 0.5 * (len(counts) + 1)
    want = {}
    for i, t in rows:
        tokens = [*words_of(t), "end"]
        want[i] = (len(tokens), sum(counts[w] > 0 for w in tokens), sum(math.log10((counts[w] + 0.5) / below) for w in tokens), tree.score(t))
    for shuffled in (docs, docs.repartition(7), docs.orderBy(F.desc("text"))):
        got = suffix_tree.score_texts(shuffled, **settings).collect()
        assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows) and {r.train_tokens for r in got} == {tree.n}
        for r in got:
            n, known, base, score = want[r.doc_id]
            assert (r.n_tokens, r.n_known) == (n, known) and math.isclose(r.base_score, base, rel_tol=1e-9) and math.isclose(r.score, score, rel_tol=1e-9)
    assert suffix_tree.score_texts(docs.limit(0)).count() == 0
    assert suffix_tree.score_texts(docs, F.lit(False)).count() == len(rows)


@pytest.mark.parametrize("settings", [{}, {"shard_text": 60}])
def test_common_words_are_contexts(spark, settings):
    """However common a word is: what stands behind it is counted over all shards that have a piece of it."""
    rnd = random.Random(6)
    texts = [" ".join(rnd.choice(["the cat", "the dog", "a the", "of the", f"w{rnd.randrange(40)} the"]) for _ in range(rnd.randrange(1, 12))) for _ in range(150)]
    learnt = [t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 5 != 1]
    tree = PlainTree(learnt, suffix_tree.FREQUENT, 2.0)
    assert (b"the",) in tree.nodes and tree.count[b"the"] > 0.3 * tree.n
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    for r in suffix_tree.score_texts(docs, **settings).collect():
        assert math.isclose(r.score, tree.score(texts[r.doc_id]), rel_tol=1e-9)


def test_words_are_spelt_a_few_at_a_time(spark, monkeypatch):
    """gather's memory doesn't follow the number of words that a task holds."""
    monkeypatch.setattr(suffix_tree, "_SPELT", 7)
    docs = spark.createDataFrame([(" ".join(f"word{i}" for i in range(100)) + " word3",)], "text string")
    found = {(r.word, r.key): r.n for r in suffix_tree.gather(docs).collect()}
    key, owner = suffix_tree._triples([f"word{i}".encode() for i in [*range(100), 3]])
    assert {k: n for (word, k), n in found.items() if not word} == dict(collections.Counter(key.tolist()))
    assert sum(n for (word, _), n in found.items() if word) == 101


def test_suffix_tree_is_a_distribution():
    """Behind every context the chances of all symbols sum up to one at most, and to nearly one."""
    texts = ["abra cadabra abra", "abra abra", "cad abra", "cad cadabra"] * 20
    tree = PlainTree(texts, 0.01, 2)
    for context in [(), *tree.nodes, ("cad", "cad"), ("nowhere",)]:
        total = sum(10 ** tree.log(context, x) for x in [*tree.many, "END", "RARE"])
        assert 0.6 < total <= 1 + 1e-9


TEXTS = [
    None, "", "a <|endoftext|> b", "<|endoftext|><|endoftext|>", " hello\n\n  world  ", "x\xa0 y 'S 's I've", "٣٤ 12½ é é", "\x00\x1c a\x1fb \x85 z", "a" * 3000 + " " + "ab" * 300,
    "日本語 テキスト😀😀", "    indent\tx\r\n\r\n y", " \n " * 20, "the the the",
]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.vocabulary_path())


def test_bpe_equals_the_library(spark, tokenizer):
    rnd = random.Random(1)
    texts = TEXTS + ["".join(rnd.choice("abcdefgh tth  e's\n\t.,!?12é漢 \x1c<|endoftext|>") for _ in range(rnd.randrange(80))) for _ in range(400)]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, ids int")
    ids = {r.doc_id: r.ids for r in bpe.encode(docs).collect()}
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs)).collect()}
    for i, t in enumerate(texts):
        want = tokenizer.encode(t or "", add_special_tokens=False).ids
        assert ids[i] == want and back[i] == tokenizer.decode(want, skip_special_tokens=False)
    assert bpe.digests(docs.limit(0)).count() == 0


def test_lexicon_finds_its_words_only():
    merges = bpe.Merges(bpe.vocabulary_path())
    words = sorted({w.encode() for w in ["the", "then", "other", "mother", "brother", " the", " other", "t", "éa"]})
    lexicon = bpe.Lexicon(bpe.compile_lexicon(words, merges))
    assert lexicon.find(words).tolist() == list(range(len(words)))
    assert (lexicon.find([b"", b"th", b"thenx", b"zzz"]) == -1).all()
    assert [lexicon.ids_of(i) for i in range(len(words))] == [merges.merge_one(w) for w in words]
    assert len(lexicon.final) < sum(map(len, words))  # suffixes are shared
    empty = bpe.Lexicon(bpe.compile_lexicon([], merges))
    assert (empty.find([b"a", b""]) == -1).all()


def test_packing(spark):
    rnd = random.Random(3)
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(rnd.randrange(0, 120))), "hot" if i % 3 == 0 else f"s{i % 7}") for i in range(500)]
    rows += [(600 + i, "copy of one text", "hot") for i in range(40)] + [(700, None, None), (701, "", "a"), (702, "w " * 1001, "a"), (3, "again same id", "a")]
    docs = spark.createDataFrame([(i, t, s, 0) for i, t, s in rows], "doc_id long, text string, source string, bin_id int")
    got = packing.pack(docs, 200, 2, 128).toPandas()
    assert got.n_tokens.sum() == sum(len((t or "").split()) for _, t, _ in rows) and set(got.doc_id) == {i for i, *_ in rows}
    bins = got.groupby("bin_id")
    assert (bins.n_tokens.sum() <= 200).all() and (bins.n_tokens.sum() == bins.bin_fill.first()).all()
    assert (got[got.doc_id != 702].groupby(["bin_id", "source"]).size() <= 2).all()
    assert (got[got.doc_id.between(600, 639)].groupby("bin_id").size() == 1).all()
    assert sorted(got[got.doc_id == 702].n_tokens) == [1, 200, 200, 200, 200, 200]
    for _, part in bins:
        part = part.sort_values("bin_offset")
        assert (part.bin_offset == part.n_tokens.cumsum() - part.n_tokens).all()
    assert packing.pack(docs.limit(0)).count() == 0


def plain_best_fit(sizes, sources, clusters, capacity, per_source):
    """Every item looks at every bin: the tightest one that has room and holds neither its cluster nor too many of its source."""
    bins, placed = [], []
    for size, source, cluster in zip(sizes, sources, clusters):
        fits = [
            (capacity - sum(sizes[i] for i in held), b) for b, held in enumerate(bins)
            if capacity - sum(sizes[i] for i in held) >= size and all(clusters[i] != cluster for i in held) and sum(sources[i] == source for i in held) < per_source
        ]
        b = min(fits)[1] if fits else len(bins)
        if b == len(bins):
            bins.append([])
        bins[b].append(len(placed))
        placed.append(b)
    return placed


@pytest.mark.parametrize("per_source", [1, 2, 4])
def test_blocks_equal_a_plain_best_fit(per_source):
    rnd = random.Random(per_source)
    for _ in range(60):
        n = rnd.randrange(1, 90)
        sizes = sorted((rnd.choice([0, 1, rnd.randrange(1, 100), 100]) for _ in range(n)), reverse=rnd.random() < 0.5)
        sources, clusters = [rnd.choice([0, 0, 0, rnd.randrange(9)]) for _ in range(n)], [rnd.choice([rnd.randrange(4), 10 + i]) for i in range(n)]
        assert packing.pack_block(sizes, sources, clusters, 100, per_source) == plain_best_fit(sizes, sources, clusters, 100, per_source)


def test_best_fit_takes_the_tightest_compatible_bin():
    # rooms after 60 and 50: 40 and 50; the third fits 40 best, the fourth (same cluster as the first) has to take the other
    assert packing.pack_block([60, 50, 40, 35], [0, 1, 2, 3], [0, 1, 2, 3], 100, 1) == [0, 1, 0, 1]
    assert packing.pack_block([60, 50, 40], [0, 1, 2], [0, 1, 0], 100, 1) == [0, 1, 1]
    assert packing.pack_block([60, 50, 40], [0, 1, 0], [0, 1, 2], 100, 1) == [0, 1, 1]
    assert packing.pack_block([60, 50, 40], [0, 1, 0], [0, 1, 2], 100, 2) == [0, 1, 0]


def test_parts_of_a_lexicon():
    """The parts of many words at once are those of each word."""
    rnd = random.Random(6)
    words = [bytes(rnd.randrange(256) for _ in range(rnd.randrange(1, 90))) for _ in range(300)] + [b"a" * n for n in range(1, 13)]
    parts, first = toxicity._lexicon_parts(words)
    assert [parts[a:b].tolist() for a, b in zip(first, first[1:])] == [toxicity.parts_of(w) for w in words]
    assert [len(x) for x in toxicity._lexicon_parts([])] == [0, 1]


def test_scores_do_not_depend_on_the_texts_beside():
    rnd = random.Random(7)
    texts = [" ".join(rnd.choice(["bad", "fine", "goodness", "x"]) for _ in range(rnd.randrange(9))) for _ in range(50)] + ["", None]
    model = toxicity.TextCNN(epochs=1, min_texts=1).fit(texts[:50], [int("bad" in t) for t in texts[:50]])
    score = model.scorer()
    assert np.allclose(score(texts), [score([t])[0] for t in texts], atol=1e-6) and len(score([])) == 0


def test_labels_move_no_text_twice(spark):
    """Labels and texts meet where the blocks are made, however many labels there are: no text is moved for a join."""
    rows = [(i, "some words" + (" zorkhead" if i % 3 == 0 else "")) for i in range(300)] + [(5, "a second text of one id"), (None, "no id"), (1001, "no label")]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = spark._jsparkSession.sharedState().statusStore().executionsCount()
        score = toxicity.train(docs, labels, 100).scorer()
        store = spark._jsparkSession.sharedState().statusStore()
        runs = store.executionsList()
        plans = [runs.apply(i).physicalPlanDescription() for i in range(before, runs.size())]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    moved = {found for plan in plans for found in re.findall(r"\) Exchange\s+Input \[\d+\]: \[([^\]]*\btext#[^\]]*)\]\s+Arguments: (\w+\(\w+)", plan)}
    assert moved and not any("doc_id" in by for _, by in moved)
    assert score(["some zorkhead words"])[0] > 0.5 > score(["some words"])[0]
