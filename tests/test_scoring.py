"""Scores of blocks against plain sums."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.operators import retrieval, scoring
from tessera.plans import answers, grid

WORDS = [f"w{i}" for i in range(60)]


def plain(rows, asked, k):
    """Postings are counted for rows of one id and length together; all postings of an id are one document's."""
    held = defaultdict(Counter)
    for i, text in rows:
        t = (text or "").split()
        held[i, len(t)].update(t)
    n, mean = len(rows), sum(len((t or "").split()) for _, t in rows) / len(rows)
    df = Counter(w for c in held.values() for w in c)
    norm = defaultdict(float)
    for (i, _), c in held.items():
        norm[i] += sum(v * v for v in c.values())
    out = []
    for query, text in asked:
        want = Counter((text or "").split())
        found = {"bm25": defaultdict(float), "dense": defaultdict(float)}
        for (i, dl), c in held.items():
            for w in want.keys() & c.keys():
                idf = math.log((n - df[w] + 0.5) / (df[w] + 0.5) + 1)
                found["bm25"][i] += want[w] * idf * c[w] * 2.5 / (c[w] + 1.5 * (0.25 + 0.75 * dl / max(mean, 1.0)))
                found["dense"][i] += want[w] * c[w]
        for leg, by in found.items():
            own = math.sqrt(sum(v * v for v in want.values()))
            scored = [(round(s / (math.sqrt(norm[i]) * own) if leg == "dense" else s, 6), i) for i, s in by.items() if leg == "bm25" or i is not None]
            best = sorted(scored, key=lambda x: (-x[0], x[1] is not None, x[1] or 0))[:k]
            out += [(leg, query, i, s, r) for r, (s, i) in enumerate(best, 1)]
    return sorted(map(str, out))


@pytest.mark.parametrize("repeated", [False, True])
def test_blocks_score_like_plain_sums(spark, repeated):
    rnd = random.Random(11)
    weights = [1 / (i + 1) for i in range(60)]
    rows = [(i * 7 % 901, " ".join(rnd.choices(WORDS, weights, k=rnd.randrange(25)))) for i in range(900)]
    rows += [(5000 + i, rows[5][1]) for i in range(40)] + [(6000, None), (6001, "")]
    if repeated:  # an id of two lengths, of one length, and a null one
        rows += [(3, "w0 w1"), (3, "w0 w1 w2 w0"), (3, "w5 w0"), (None, "w0 w7"), (None, "w7"), (4, "w1")]
    asked = [(i, " ".join(rnd.choices(WORDS, weights, k=rnd.randrange(1, 9)))) for i in range(70)] + [(900, "nowhere"), (901, None), (902, "w0 w0 w0 w59")]
    docs, queries = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(asked, "query_id long, query string")
    both = sorted(str((r.leg, r.query_id, r.doc_id, r.score, r.rank)) for r in retrieval.legs(docs, queries, 4).collect())
    assert both == plain(rows, asked, 4)
    for leg, search in (("bm25", retrieval.bm25), ("dense", retrieval.term_cosine)):
        alone = sorted(str((leg, r.query_id, r.doc_id, r.score, r.rank)) for r in search(docs, queries, 4).collect())
        assert alone == [x for x in both if f"'{leg}'" in x]


def test_hits_go_to_the_texts(spark, tmp_path):
    spark.range(200).selectExpr("id AS doc_id", "concat('w', id % 7, ' w', id % 11) AS text").write.parquet(str(tmp_path / "d"))
    docs, queries = spark.read.parquet(str(tmp_path / "d")), spark.createDataFrame([(1, "w1 w2"), (2, "w3")], "query_id long, query string")
    hits = retrieval.search(docs, queries, "hybrid_rerank").join(docs, "doc_id")
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan and hits.count() == 10
    assert retrieval.search(docs.limit(0), queries, "hybrid_rerank").count() == 0 and retrieval.search(docs, queries.limit(0), "hybrid").count() == 0


def test_evidence_goes_to_the_texts(spark, tmp_path):
    spark.range(200).selectExpr("id AS doc_id", "concat('w', id % 7, ' w', id % 11) AS text").write.parquet(str(tmp_path / "d"))
    found = answers.evidence(spark.createDataFrame([(1, "w1 w2"), (2, "w3")], "query_id long, query string"), spark.read.parquet(str(tmp_path / "d")))
    assert "hashpartitioning(doc_id" not in found._jdf.queryExecution().executedPlan().toString() and found.count() == 2


def test_layers_take_the_words_of_each_form_once(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"w{i % 5} w{i % 3}") for i in range(30)], "doc_id long, text string")
    cases = spark.createDataFrame([(1, "w1", ["w1"], False), (2, "w9", ["w9"], True)], "query_id long, query string, keywords array<string>, out_of_scope boolean")
    packed = []
    monkeypatch.setattr(scoring, "_packed", lambda rows, most, id_col, f=scoring._packed: packed.append(id_col) or f(rows, most, id_col))
    assert grid.layered(docs, cases, docs.where("doc_id < 20")).count() == 5 and packed.count("doc_id") == 2


def test_best_scores_of_several_blocks():
    rng = np.random.default_rng(3)
    blocks = [rng.integers(0, 50, (4, 9)) / 7 for _ in range(5)] + [np.full((4, 9), -1.0), np.full((4, 9), -math.inf)]
    top, kept = np.full((4, 3), -math.inf), [[] for _ in range(4)]
    for n, block in enumerate(blocks):
        for q, d in zip(*scoring.best(block, top), strict=True):
            kept[q].append((-block[q, d], n * 9 + d))
    whole = np.concatenate(blocks, axis=1)
    for q in range(4):
        want = sorted((-s, d) for d, s in enumerate(whole[q]))[:3]
        assert sorted(kept[q])[:3] == want and sorted(-top[q]) == [s for s, _ in want]
    assert len(scoring.best(blocks[-2], top)[0]) == 0


def test_many_hits_are_not_sent_to_all_documents(spark, tmp_path, monkeypatch):
    spark.range(300).selectExpr("id AS doc_id", "concat('w', id % 7, ' w', id % 11) AS text").write.parquet(str(tmp_path / "d"))
    docs, queries = spark.read.parquet(str(tmp_path / "d")), spark.createDataFrame([(i, f"w{i % 7} w{i % 5}") for i in range(30)], "query_id long, query string")
    few = answers.evidence(queries, docs)
    monkeypatch.setattr(retrieval.sent, "__defaults__", (10,))
    many = answers.evidence(queries, docs)
    plans = [x._jdf.queryExecution().executedPlan().toString() for x in (few, many)]
    assert "BroadcastHashJoin" in plans[0] and "BroadcastHashJoin" not in plans[1]
    assert sorted(map(str, few.collect())) == sorted(map(str, many.collect()))
