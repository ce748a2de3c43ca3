"""SimHash, sketches and repeated strings against brute force."""

import hashlib
import os
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import bpe, exact, packing, pii, shards, simhash, sketches, suffix_tree, suffixes, toxicity
from tessera.llm.graph import connected_components


def components(prints, distance):
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= distance
    label = np.arange(len(prints))
    while True:
        new = np.where(near, label[None, :], len(prints)).min(1)
        if (new == label).all():
            return label
        label = new


def plain_fingerprint(text, n):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_equal_the_definition():
    for text in (None, "", "One", "a b", "A b\tC d\n a b c", "é É x y z", "w " * 50):
        assert simhash.fingerprint(text, 3) % (1 << 64) == plain_fingerprint(text, 3)


@pytest.mark.parametrize("distance", [1, 2, 3, 5])
@pytest.mark.parametrize("bucket", [0, 64])
def test_links_connect_all_in_reach(spark, distance, bucket):
    rng = np.random.default_rng(distance)
    prints = rng.integers(0, 1 << 63, 150, dtype=np.uint64)
    flip = lambda: np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)
    prints = np.unique(np.concatenate([prints, *[prints[:40] ^ flip() ^ flip() for _ in range(4)]]))
    frame = spark.createDataFrame([(int(p),) for p in prints.view(np.int64)], "fp long")
    found = simhash.links(frame, distance, bucket=bucket)
    pairs = found.collect()
    assert all((a ^ b).bit_count() <= distance for a, b in ((r.a % (1 << 64), r.b % (1 << 64)) for r in pairs))
    parts = {r.node: r.component for r in connected_components(found).collect()}
    mine = [parts.get(int(p), int(p)) for p in prints.view(np.int64)]
    want = components(prints, distance)
    assert len(set(zip(mine, want.tolist(), strict=True))) == len(set(mine)) == len(set(want.tolist()))


def test_near_duplicates_of_odd_rows(spark):
    rows = [(3, "one two three four"), (1, "One  two three four"), (9, None), (8, ""), (8, " "), (5, "other words in this text"), (3, "one two three four")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fp string")
    got = sorted((r.doc_id, r.component_id, r.fingerprint) for r in simhash.near_duplicates(docs).collect())
    print_ = lambda t: f"{plain_fingerprint(t, 3):016x}"
    assert [(i, c) for i, c, _ in got] == [(1, 1), (3, 1), (3, 1), (5, 5), (8, 8), (8, 8), (9, 8)]
    assert [p for *_, p in got] == [print_("one two three four")] * 3 + [print_(rows[5][1])] + ["0" * 16] * 3
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    assert simhash.keep_first(docs, 3, 2).columns == docs.columns


def test_long_paths_become_one_component(spark):
    edges = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    rows = connected_components(edges.unionByName(spark.createDataFrame([(500, 500), (600, 601)], "a long, b long"))).collect()
    assert {r.component for r in rows if r.node <= 200} == {0} and {(r.node, r.component) for r in rows if r.node > 200} == {(600, 600), (601, 600)}


def plain_sketch(text):
    """All shingles' hashes, and those of the smallest share of 1/8, 1/4, 1/2 and 1 that holds 16 of them."""
    words = (text or "").encode().lower().split()
    m, top = [0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15], (1 << 64) - 1
    every = set()
    for i in range(max(1, len(words) - 4) if words else 0):
        x = len(part := words[i : i + 5])
        for w in part:
            x = (x * m[2] + xxhash.xxh3_64_intdigest(w)) & top
        x = ((x ^ x >> 30) * m[0]) & top
        x = ((x ^ x >> 27) * m[1]) & top
        every.add((x ^ x >> 31) >> 24)
    scale = next((h for h in (3, 2, 1) if sum(x < 1 << 40 - h for x in every) >= 16), 0)
    return every, {x for x in every if x < 1 << 40 - scale}, scale


def plain_likeness(a, b):
    """From two written fingerprints alone."""
    if not a or not b:
        return float(a == b)
    (hx, x), (hy, y) = ((int(w[0]), {int(w[i : i + 10], 16) for i in range(2, len(w), 10)}) for w in (a, b))
    x, y = ({h for h in z if h < 1 << 40 - max(hx, hy)} for z in (x, y))
    return len(x & y) / min(len(x), len(y)) if x and y else 0.0


def plain_written(text):
    every, kept, scale = plain_sketch(text)
    return f"{scale}:" + "".join(f"{h:010x}" for h in sorted(kept)) if every else ""


def test_sketches():
    a = " ".join(f"w{i}" for i in range(4000))
    b = " ".join(f"w{i}" for i in range(3000, 12000))
    x, y = sketches.sketch(a), sketches.sketch(b)
    assert abs(len(x.kept) / 3996 - 1 / 8) < 0.03
    assert abs(sketches.likeness(x, y) - 996 / 3996) < 0.08
    both = sketches.sketch(a + " " + b)
    assert len(np.setdiff1d(both.kept, sketches.merged(x, y).kept)) <= 4  # shingles over the seam
    for n in (200, 400):
        for at in range(0, 2500, 500):
            part = sketches.sketch(" ".join(a.split()[at : at + n]))
            assert sketches.likeness(part, x) == 1 and sketches.likeness(part, y) < 1
    short = sketches.sketch("w1 w2 w3 w4 w5")
    assert sketches.likeness(short, short) == 1 and sketches.likeness(short, x) in (0, 1)
    back = sketches.read(x.written())
    assert back.halvings == x.halvings and (back.kept == x.kept).all() and sketches.read("").halvings == 0


def test_edits_against_a_plain_version(spark):
    rnd = random.Random(4)
    texts = [" ".join(rnd.choice("abcdefgh") + str(rnd.randrange(9)) for _ in range(rnd.choice([0, 3, 5, 9, 40, 300]))) for _ in range(300)]
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts)] + [(5000, None), (5001, ""), (5002, "x é y"), ((1 << 60) + 1, texts[0]), ((1 << 60) + 2, texts[5] + " " + texts[0])]
    docs = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, rng string").repartition(3)
    got = {r.doc_id: r for r in sketches.against_edits(docs).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(order):
        text, after = t or "", order[(k + 1) % len(order)][1] or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        r = got[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == plain_written(text) and r.edited_fingerprint == plain_written(edited)
        assert r.near_edited == plain_likeness(r.fingerprint, r.edited_fingerprint) and r.near_next == plain_likeness(r.fingerprint, plain_written(after))
    single = sketches.against_edits(docs.where("doc_id = 5002")).collect()
    assert len(single) == 1 and single[0].near_next == 1
    assert sketches.against_edits(docs.limit(0)).count() == 0


BIG = (1 << 60) + 1


def test_ids_are_exact_beside_nulls(spark):
    """Large and null ids in one batch, on a shuffled table, through every operator that runs in Python workers."""
    rows = [(BIG, "one two three four five six"), (None, "one two three four five six"), (None, None), (BIG + 2, "other words stand here and go on"), (BIG + 4, "one two three four five six")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("s")).withColumn("lang", F.lit("en")).repartition(2, "text")
    want = sorted(str(i) for i, _ in rows)
    model = toxicity.TextCNN()
    model.fit([], [])
    for found in (
        simhash.near_duplicates(docs), toxicity.toxicity(docs, model), bpe.digests(docs), bpe.decode(bpe.encode(docs)), sketches.fingerprints(docs), sketches.against_edits(docs),
        packing.pack(docs), suffixes.remove_repeats(docs).withColumnRenamed("own_id", "doc_id"), suffix_tree.score_texts(docs), pii.report(docs), exact.exact_dedup(docs), shards.shard_records(docs),
    ):
        assert sorted(str(r.doc_id) for r in found.collect()) == want
    kept = simhash.keep_first_similar(docs).collect()
    assert sorted(str(r.doc_id) for r in kept) == [str(BIG), str(BIG + 2)]  # rows of one id, here null, go together
    assert sorted(str(r.doc_id) for r in exact.keep_first(docs.repartition(7)).collect()) == sorted([str(BIG), str(BIG + 2), "None"])


@pytest.mark.parametrize("text", [b"a", b"aaaa", b"mississippi", b"abcabcabc" * 9, bytes(random.Random(1).choices(range(3), k=700)), bytes(random.Random(2).choices(range(256), k=2000))])
def test_suffix_array(text):
    data = np.frombuffer(text, np.uint8)
    order = suffixes.suffix_array(data)
    assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
    shared = suffixes.common_prefixes(data, order, 11)
    assert shared[order].tolist() == [0] + [min(11, len(os.path.commonprefix([text[i:], text[j:]]))) for i, j in zip(order[1:].tolist(), order[:-1].tolist(), strict=True)]


def removed(rows):
    first = {}
    for i, t in rows:
        raw = (t or "").encode()
        for p in range(len(raw) - 49):
            first[raw[p : p + 50]] = min(first.get(raw[p : p + 50], i), i)
    out = []
    for i, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw) + 2, int)
        for p in range(len(raw) - 49):
            if first[raw[p : p + 50]] < i:
                gone[p + 1 : p + 51] = 1
        kept = bytes(b for b, g in zip(raw, gone[1:], strict=False) if not g)
        out.append((i, len(raw), int(gone.sum()), int((np.diff(gone) == 1).sum()), kept))
    return sorted(out)


@pytest.mark.parametrize("settings", [{}, {"hot": 2}, {"hot": 20, "shard_text": 500}])
def test_repeats_against_brute_force(spark, settings):
    rnd = random.Random(5)
    base = ["".join(rnd.choice("abcdé ") for _ in range(300)) for _ in range(8)]
    rows = []
    for i in range(50):
        a, b, p, q = rnd.choice(base), rnd.choice(base), rnd.randrange(300), rnd.randrange(200)
        rows.append((i, a[:p] + b[q : q + rnd.randrange(40, 90)] + a[p:]))
    rows += [(100, None), (101, ""), (102, "a" * 400), (103, "b" + "a" * 200), (104, "x" * 49), (105, "x" * 49), (106, "y" * 50), (107, "y" * 50), (7, base[0])]
    docs = spark.createDataFrame([(i, t, b"k") for i, t in rows], "doc_id long, text string, key binary")
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.remove_repeats(docs.repartition(3, "text"), **settings).collect())
    assert got == removed(rows)
    assert suffixes.remove_repeats(docs.limit(0)).count() == 0


def test_pieces_of_long_texts_overlap(monkeypatch, spark):
    monkeypatch.setattr(suffixes, "_PIECE", 64)
    text = "".join(random.Random(3).choice("abcdefg") for _ in range(500))
    pieces = list(suffixes._pieces(text.encode()))
    windows = {text.encode()[p : p + 50] for p in range(451)}
    assert {piece[p : p + 50] for _, piece in pieces for p in range(len(piece) - 49)} == windows
    assert all(text.encode()[at : at + len(p)] == p for at, p in pieces)


def test_repeats_in_long_texts_and_of_one_gram(monkeypatch, spark):
    rnd = random.Random(8)
    phrase = "".join(rnd.choice("uvwxyz") for _ in range(30))
    noise = lambda n: "".join(rnd.choice("abcdefghij ") for _ in range(n))
    long = noise(2_500_000)  # several pieces
    rows = [(i, noise(rnd.randrange(60)) + phrase + noise(rnd.randrange(60))) for i in range(60)]
    rows += [(70, long), (71, noise(40) + long[1_048_500:1_048_700] + phrase), (72, long[2_400_000:] + "é" + phrase * 4), (None, rows[3][1]), (None, "z" + rows[3][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = [r[1:] for r in removed([((1 << 63) - 1 if i is None else i, t) for i, t in rows])]
    for settings in ({}, {"hot": 10}):
        got = sorted(((1 << 63) - 1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.remove_repeats(docs, **settings).collect())
        assert [r[1:] for r in got] == want


def test_rows_of_one_id_whose_short_hashes_clash(spark):
    """Two texts with one 32-bit hash, both without an id: each keeps its own stretches and its own scores."""
    many = spark.range(300_000).select(F.concat(F.lit("text number "), F.col("id") * 7919).alias("text"))
    pair = many.groupBy(F.hash("text").alias("h")).agg(F.collect_list("text").alias("t")).where("size(t) > 1").first().t[:2]
    one, two = pair[0], pair[1] + ""
    rows = [(1, "a stretch of more than fifty bytes that is said again later on"), (None, one), (None, two)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(bytes(r.kept).decode() for r in suffixes.remove_repeats(docs).collect())
    assert got == sorted(t for _, t in rows)
    scored = suffix_tree.score_texts(docs.unionByName(spark.createDataFrame([(None, "x y")], docs.schema)))
    assert sorted(r.n_tokens for r in scored.where("doc_id IS NULL").collect()) == [3, 4, 4]


@pytest.mark.parametrize("bucket", [0, 64])
def test_groups_of_a_similarity(spark, bucket):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    rows, groups = [], []
    for g in range(25):
        text = [word() for _ in range(400)]
        rows.append((g * 10, " ".join(text)))
        groups.append(g * 10)
        for k in range(1, 5):  # two words changed: a similarity of about 0.95
            copy = list(text)
            for _ in range(2):
                copy[rnd.randrange(400)] = word()
            rows.append((g * 10 + k, " ".join(copy)))
    rows += [(1000, None), (1001, ""), (1001, ""), (1002, "short one"), (1003, "short one two")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, node string")
    kept = simhash.keep_first_similar(docs, bucket=bucket)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted([*groups, 1000, 1002, 1003])
    assert simhash.keep_first_similar(docs.limit(0)).count() == 0


def test_repeated_rows_have_one_set(spark):
    """400 rows of two alike texts: two nodes, two sets, one pair."""
    words = [f"w{i}" for i in range(100)]
    texts = [" ".join(words), " ".join(words[:-1] + ["other"])]
    docs = spark.createDataFrame([(i, texts[i % 2]) for i in range(400)], "doc_id long, text string")
    prints = simhash._described(docs, 5)
    nodes = prints.groupBy("node").agg(F.min("seen").alias("seen"))
    assert simhash._sets(docs, nodes, 5).count() == 2
    assert [r.doc_id for r in simhash.keep_first_similar(docs).collect()] == [0]


def test_wide_distance_estimates_similarity():
    rnd = random.Random(1)
    text = [str(rnd.random()) for _ in range(3000)]
    changed = [w if i % 40 else "other" + w for i, w in enumerate(text)]  # one word in 40: 5 shingles of 40 on either side
    a, b = (np.array(simhash.wide_fingerprint(" ".join(t), 5), np.int64).view(np.uint64) for t in (text, changed))
    assert abs(int(np.bitwise_count(a ^ b).sum()) - simhash.distance_of(35 / 45, 384)) < 25


@pytest.mark.parametrize("bucket", [0, 64])
def test_similar_groups_equal_brute_force(spark, bucket):
    """Pairs just over and just under the similarity, by the exact sets: all of the first are groups, none of the second."""
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(7))
    shingles = lambda t: {tuple(t[i : i + 5]) for i in range(len(t) - 4)}
    alike = lambda a, b: len(a & b) / len(a | b)
    texts, over, under = [], 0, 0
    while over < 80 or under < 80:
        text = [word() for _ in range(200)]
        copy = list(text)
        for _ in range(rnd.randrange(4, 9)):
            copy[rnd.randrange(200)] = word()
        s = alike(shingles(text), shingles(copy))
        if 0.8 <= s < 0.85 and over < 80:
            over += 1
        elif 0.65 <= s < 0.8 and under < 80:
            under += 1
        else:
            continue
        texts += [text, copy]
    chain = [[word() for _ in range(200)]]
    for _ in range(70):  # one large group, connected step by step
        step = list(chain[-1])
        for _ in range(3):
            step[rnd.randrange(200)] = word()
        chain.append(step)
    texts += chain
    sets = [shingles(t) for t in texts]
    first = list(range(len(texts)))
    for j in range(len(texts)):
        for i in range(j):
            if sets[i] & sets[j] and alike(sets[i], sets[j]) >= 0.8:
                a, b = sorted((first[i], first[j]))
                first = [a if f == b else f for f in first]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id for r in simhash.keep_first_similar(docs, bucket=bucket).collect()} == set(first)


def test_tiles_lose_no_link_and_candidates_come_once(spark):
    """Keys cut into tiles of 3 connect the same nodes as whole keys, with texts just over and under the similarity in each key."""
    rnd = random.Random(5)
    base = [f"w{i}" for i in range(200)]
    texts = []
    for _ in range(14):
        copy = list(base)
        for at in rnd.sample(range(200), 5):
            copy[at] = f"x{rnd.random()}"
        texts.append(" ".join(copy))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    nodes = simhash._described(docs, 5).groupBy("node").agg(F.any_value(F.struct("seen", "size", "fp", "keys")).alias("of")).select("node", "of.*").cache()
    parts = [
        sorted(map(tuple, simhash.connected_components(simhash.similar_links(docs, nodes, 5, 0.8, bucket=bucket, tile=tile)).collect()))
        for bucket, tile in ((64, 1024), (0, 3))
    ]
    assert parts[0] == parts[1]


def rows_of_tiles(spark, since):
    """Rows that the joins of open nodes have made in the executions after the first `since`."""
    store, found = spark._jsparkSession.sharedState().statusStore(), 0
    runs = store.executionsList()
    for run in map(runs.apply, range(since, runs.size())):
        nodes, values = store.planGraph(run.executionId()).allNodes(), store.executionMetrics(run.executionId())
        for node in map(nodes.apply, range(nodes.size())):
            if "Join" in node.name() and "low" in node.desc():
                metrics = [m for m in map(node.metrics().apply, range(node.metrics().size())) if m.name() == "number of output rows"]
                found += sum(int(values.apply(m.accumulatorId()).replace(",", "")) for m in metrics if values.contains(m.accumulatorId()))
    return found


def test_a_large_group_makes_few_candidates(spark):
    """300 texts made from one by random changes, most of them under the similarity to each other."""
    rnd = random.Random(3)
    base = [f"w{i}" for i in range(150)]
    shingles, texts = [], []
    for _ in range(300):
        copy = list(base)
        for at in rnd.sample(range(150), rnd.randrange(1, 7)):
            copy[at] = f"x{rnd.random()}"
        texts.append(" ".join(copy))
        shingles.append({tuple(copy[i : i + 5]) for i in range(146)})
    first = list(range(300))
    for j in range(300):
        for i in range(j):
            if len(shingles[i] & shingles[j]) / len(shingles[i] | shingles[j]) >= 0.8 and first[i] != first[j]:
                a, b = sorted((first[i], first[j]))
                first = [a if f == b else f for f in first]
    since = spark._jsparkSession.sharedState().statusStore().executionsCount()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in simhash.keep_first_similar(docs).collect()} == set(first) and len(set(first)) > 100
    assert rows_of_tiles(spark, since) < 3000  # of 44,850 pairs


def test_parities_rule_out_no_similar_pair():
    """The slots that differ are never more than the shingles that one set alone has."""
    rnd = np.random.default_rng(2)
    for n in (1, 5, 300, 5000):
        for share in (0.0, 0.1, 0.5):
            a = np.unique(rnd.integers(0, 1 << 64, n, dtype=np.uint64))
            b = np.unique(np.concatenate([a[int(n * share) :], rnd.integers(0, 1 << 64, int(n * share), dtype=np.uint64)]))
            x, y = (simhash._parities(s).view(np.uint64) for s in (a, b))
            assert len(x) == simhash.PARITIES // 64
            apart = int(np.bitwise_count(x ^ y).sum())
            assert apart <= len(np.setxor1d(a, b)) and (share or not apart)
