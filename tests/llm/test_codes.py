"""Vector codes, spelling variants and license scans against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import codes, licenses, spelling

# --- vector codes ---------------------------------------------------------------------------------


def plain_codes(rows, entries, rounds=4, parts=4):
    """Every distance of every round, in Python integers."""
    kept = [(i, [int(np.floor(1024 * np.float64(c))) for c in v], label) for i, v, label in rows]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = [[tuple(x[p * width : (p + 1) * width]) for p in range(parts)] for _, x, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    dist = lambda a, b: sum((u - v) ** 2 for u, v in zip(a, b))
    nearest = lambda x, book: min(range(len(book)), key=lambda e: (dist(x, book[e]), e))
    for _ in range(rounds):
        for p in range(parts):
            of = [nearest(c[p], books[p]) for c in cut]
            for e in range(len(books[p])):
                own = [c[p] for c, k in zip(cut, of) if k == e]
                if own:
                    books[p][e] = tuple(sum(col) // len(own) for col in zip(*own))
    digest = hashlib.sha256(",".join(str(x) for book in books for y in book for x in y).encode()).hexdigest()
    found, sums = [], Counter()
    for (i, _, label), c in zip(kept, cut):
        ks = [nearest(c[p], books[p]) for p in range(parts)]
        error = sum(dist(c[p], books[p][k]) for p, k in enumerate(ks))
        sums[label] += error
        found.append((i, "".join(f"{k:02x}" for k in ks), error, label))
    return sorted(((i, code, error, sums[label]) for i, code, error, label in found), key=str), digest


@pytest.mark.parametrize(("entries", "closest", "spread"), [(256, 16, 1.0), (8, 4, 1.0), (16, 2, 0.004), (5, 16, 300.0)])
def test_codes_equal_plain_rounds(spark, entries, closest, spread):
    rnd = random.Random(entries)
    rows = [(rnd.randrange(1 << 40) if k % 17 else None, [rnd.gauss(0, spread) for _ in range(8)], rnd.choice([1, 2, None])) for k in range(500)]
    rows += rows[:20] + [(7, [0.0] * 8, None)] * 30 + [(8, [-0.0001] * 8, 1)] * 3
    odd = [(1, None, 1), (2, [], 1), (3, [float("nan")] * 8, 1), (4, [0.0] * 7 + [float("inf")], 1), (5, [None] * 8, 1), (6, [0.5] * 4, 1)]
    docs = spark.createDataFrame([(i, v, label, "z") for i, v, label in rows + odd], "vec_id long, embedding array<double>, label int, x string")
    got = codes.compress(docs.repartition(3), entries=entries, closest=closest).collect()
    want, digest = plain_codes(rows, entries)
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in got), key=str) == want and {r.codebooks_sha256 for r in got} == {digest}


def test_codes_of_nothing_and_of_what_does_not_fit(spark):
    docs = spark.createDataFrame([(1, [1e30] * 4, 1)], "vec_id long, embedding array<float>, label int")
    assert codes.compress(docs.limit(0)).count() == 0 and codes.compress(docs.where("vec_id = 1").withColumn("embedding", F.lit(None).cast("array<float>"))).count() == 0
    with pytest.raises(ValueError, match="too large"):
        codes.compress(docs)
    with pytest.raises(ValueError, match="equal parts"):
        codes.compress(docs.withColumn("embedding", F.array(F.lit(1.0))))


def test_bounds_save_distances_and_never_change_a_result():
    rng = np.random.default_rng(3)
    x = rng.integers(-40, 40, (4000, 2)) + rng.integers(-3, 4, (4000, 1)) * 1000
    book = x[:64].copy()
    near, bounds = codes.searched(x, book, 8)
    for _ in range(6):
        first = near[:, 0]
        after = np.array([x[first == e].sum(0) // max(1, (first == e).sum()) if (first == e).any() else book[e] for e in range(64)])
        moved = np.sqrt(((after - book) ** 2).sum(1)) * (1 + codes.SLACK)
        book = after
        near, bounds, need = codes.updated(x, book, moved, near, bounds, 8)
        assert (near[:, 0] == codes.measured(x, book).argmin(1)).all()
    assert (need <= 2).mean() > 0.5


# --- spelling -------------------------------------------------------------------------------------


def edits(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(rows):
    n = Counter()
    for i, t in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}
    near = {w: [v for v in n if edits(w, v)] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
    found = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        found.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(found)


def test_variants_equal_brute_force(spark):
    rnd = random.Random(6)
    base = ["kettle", "kettles", "garden", "hardens", "ÉTUDES", "Études", "naïveté", "aaaaaa", "aaaaaaa", "abcdef", "bacdef", "mississippi"]
    rows = []
    for i in range(400):
        words = []
        for _ in range(rnd.randrange(40)):
            w = rnd.choice(base)
            if rnd.random() < 0.15:
                k = rnd.randrange(len(w))
                w = rnd.choice([w[:k] + w[k + 1 :], w[:k] + rnd.choice("aeé") + w[k:], w[:k] + "z" + w[k + 1 :]])
            words.append(w)
        rows.append((i, rnd.choice([" ", "1", "-", "ß÷×"]).join(words)))
    rows += [(None, "kettle kettle"), (5000, None), (5001, ""), (5002, "x" * 30000), (5003, "x" * 30000), (1, rows[1][1]), (1, rows[1][1])]
    rows += [(6000 + k, "x" * 30000) for k in range(6)]
    docs = spark.createDataFrame([(i, t, "w") for i, t in rows], "doc_id long, text string, word string")
    got = sorted(tuple(r) for r in spelling.spelling_variants(docs).select("word", "form", "root", "n", "n_near", "form_n").collect())
    assert got == plain_variants(rows) and sum(r[1] is not None for r in got) > 10
    assert spelling.spelling_variants(docs.limit(0)).count() == 0


def test_ways_of_several_forms_end_at_the_root(spark):
    forms = [(f"w{k}", f"w{k + 1}") for k in range(9)] + [("v", "w0"), ("u", "t")]
    got = {r.word: r.root for r in spelling.roots(spark.createDataFrame(forms, "word string, form string")).collect()}
    assert got == {**{f"w{k}": "w9" for k in range(9)}, "v": "w9", "u": "t"}


def test_words_are_not_sent_to_all_tasks_by_the_size_of_their_file(spark, tmp_path):
    spark.createDataFrame([(f"abcdefg{chr(97 + i)}", 5) for i in range(20)], "word string, n long").write.parquet(str(tmp_path / "w"))
    near = spelling.near_words(spark.read.parquet(str(tmp_path / "w")))
    assert "Broadcast" not in near._jdf.queryExecution().executedPlan().toString()
    assert near.count() == 190


WORD = st.text("abcdeéß", min_size=6, max_size=9)


@settings(max_examples=300, deadline=None)
@given(WORD, st.integers(0, 8), st.sampled_from("abcdeéßz"), st.sampled_from(["insert", "delete", "replace"]))
def test_near_words_share_a_signature(word, at, letter, kind):
    at = min(at, len(word) - 1)
    other = {"insert": word[:at] + letter + word[at:], "delete": word[:at] + word[at + 1 :], "replace": word[:at] + letter + word[at + 1 :]}[kind]
    assert set(spelling.signatures(word)) & set(spelling.signatures(other))


# --- licenses -------------------------------------------------------------------------------------


def plain_scan(rows, templates, share):
    found = []
    for i, t in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        places = [(k, label) for phrase, label in licenses.PHRASES for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
        base, labels, score = {label for _, label in places}, set(), 0.0
        for label, text in templates:
            need, reach = set(text.split()), 8
            while reach < len(text.split()):
                reach *= 2
            for k in range(0, max(1, len(words) - reach), reach):
                held = len(need & set(words[k : k + 2 * reach])) / len(need)
                if held >= share - 1e-9:
                    labels.add(label)
                    score = max(score, held)
        at = [k for k, _ in places]
        found.append((i, len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), 1.0 if base else score))
    return sorted(found, key=str)


def test_scans_equal_brute_force(spark):
    rnd = random.Random(7)
    vocabulary = sorted({w for _, t in licenses.TEMPLATES for w in t.split()}) + ["été", "日本", "x1"]
    rows = []
    for i in range(250):
        words = [rnd.choice(vocabulary) for _ in range(rnd.randrange(60))]
        for _ in range(rnd.randrange(3)):
            t = rnd.choice(licenses.TEMPLATES)[1].split()
            t[rnd.randrange(len(t))] = rnd.choice(vocabulary)
            at = rnd.randrange(len(words) + 1)
            words[at:at] = t if rnd.random() < 0.7 else rnd.choice(["CC BY cc by", "General Public License", "All Rights Reserved. all rights\nreserved"]).split(" ")
        rows.append((i, rnd.choice([" ", "\n", " -- ", "\x7f"]).join(words)))
    rows += [(None, "cc by"), (None, None), (900, ""), (901, "  all rights reserved"), (902, "all rights reserved " * 5000), (3, rows[3][1])]
    docs = spark.createDataFrame([(i, t, 1, "w") for i, t in rows], "doc_id long, text string, row_no int, words string")
    got = licenses.license_scan(docs.repartition(4)).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score").collect()
    want = plain_scan(rows, licenses.TEMPLATES, licenses.CONTAINMENT)
    assert sorted(map(tuple, got), key=str) == want and sum(r[6] != r[5] for r in want) > 20
    assert licenses.license_scan(docs.limit(0)).count() == 0
    blocks = licenses.license_blocks(docs).where("doc_id < 250").collect()
    assert all(b.containment >= licenses.CONTAINMENT and b.n_words > 0 for b in blocks)
    assert {(b.doc_id, b.label) for b in blocks} <= {(r[0], label) for r in want for label in r[6].split(",")}


def test_own_templates_and_phrases(spark):
    docs = spark.createDataFrame([(1, "Free as in Beer, to all"), (2, "free beer in all"), (3, "nothing")], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.license_scan(docs, [("beer", "free as in beer")], 0.75, [("to all", "all")]).collect()}
    assert (got[1].labels, got[1].base_labels, got[1].first_word) == ("all,beer", "all", 4) and (got[2].labels, got[2].score, got[3].score) == ("beer", 0.75, 0.0)
