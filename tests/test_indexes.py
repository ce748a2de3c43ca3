"""Vector cells, stored postings and collections against searching everything."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import inverted, retrieval, vectors
from tessera.sources.collection import VectorCollection


def ranked(df):
    return sorted(map(tuple, df.select("query_id", "doc_id", "score", "rank").collect()))


def test_cells_find_what_a_comparison_with_all_finds(spark, monkeypatch):
    monkeypatch.setattr(vectors, "PIECE", 40)
    rnd = random.Random(5)
    centres = [[rnd.gauss(0, 1) for _ in range(6)] for _ in range(9)]
    rows = [(i, [x + rnd.gauss(0, 0.2) for x in rnd.choice(centres)]) for i in range(400)]
    rows += [(1000 + i, centres[0]) for i in range(150)] + [(2000, [0.0] * 6), (2001, [0.0] * 6)]
    docs = spark.createDataFrame(rows + [(3000, None), (3001, [])], "doc_id long, embedding array<float>")
    asked = spark.createDataFrame([(i, rows[i * 13][1]) for i in range(20)] + [(50, [0.0] * 6), (51, None)], "query_id long, embedding array<float>")
    index = vectors.build_index(docs, cells=12, sample=300)
    assert index.rows.count() == len(rows) and index.rows.agg(F.max("piece")).first()[0] >= 3
    truth = retrieval.dense(docs.where("size(embedding) > 0"), asked.where("embedding IS NOT NULL"))
    assert ranked(vectors.ann_topk(index, asked, surely=True)) == ranked(truth)
    assert ranked(vectors.ann_topk(index, asked, probes=1, surely=True)) == ranked(truth)
    assert vectors.recall(vectors.ann_topk(index, asked.where("query_id < 20")), truth.where("query_id < 20")).first().recall >= 0.9
    plan = vectors.ann_topk(index, asked)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    nothing = vectors.build_index(docs.limit(0))
    assert vectors.ann_topk(nothing, asked).count() == 0 and vectors.ann_topk(nothing, asked, surely=True).count() == 0


def test_recall_on_the_tables(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), "embedding")
    asked = rows.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id")
    assert vectors.recall(vectors.ann_topk(vectors.build_index(rows), asked), retrieval.dense(rows, asked)).first().recall >= 0.9


def test_a_zero_vector_has_no_direction(spark):
    docs = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0])], "doc_id long, embedding array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0])], "query_id long, embedding array<double>")
    assert ranked(retrieval.dense(docs, asked)) == [(1, 1, 0.0, 2), (1, 2, 1.0, 1), (2, 1, 0.0, 1), (2, 2, 0.0, 2)]


@pytest.mark.parametrize("rows", [4, 1024])
def test_stored_postings_score_like_the_documents(spark, rows):
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(rnd.choices(words, [1 / (i + 1) for i in range(40)], k=rnd.randrange(30))) for _ in range(120)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(500, None), (501, "")], "doc_id long, text string")
    asked = spark.createDataFrame([(i, " ".join(rnd.choices(words, k=4))) for i in range(25)] + [(30, "w0 w0 w39"), (31, "nowhere"), (32, None)], "query_id long, query string")
    index = inverted.build_index(docs, rows=rows)
    assert ranked(inverted.bm25_topk(index, asked, 3)) == ranked(retrieval.bm25(docs, asked, 3))
    assert "doc_ids" not in index.blocks.select("term", "most")._jdf.queryExecution().executedPlan().toString()
    assert inverted.bm25_topk(inverted.build_index(docs.limit(0)), asked).count() == 0


def test_collections_keep_the_last_row_of_a_key(spark, tmp_path):
    held = VectorCollection(spark, str(tmp_path / "c"), buckets=8)
    assert held.read() is None and held.count() == 0
    row = lambda *r: spark.createDataFrame(list(r), "doc_id long, v string, batch int")
    held.upsert(row((1, "a", 1), (2, "a", 1), (1, "b", 2), (None, "n", 1)))
    held.upsert(row((2, "c", 3), (3, "a", 3), (1, "late", 1)))
    want = [("1", "b"), ("2", "c"), ("3", "a"), ("None", "n")]
    assert sorted((str(r.doc_id), r.v) for r in held.read().collect()) == want
    held.upsert(row((2, "c", 3), (3, "a", 3), (1, "late", 1)))
    assert sorted((str(r.doc_id), r.v) for r in held.read().collect()) == want and held.count() == 4
