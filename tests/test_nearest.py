"""Cosines of parts against a plain comparison with all."""

import math
import random

from pyspark.sql import functions as F

from tessera.operators import nearest, retrieval, vectors


def plain(rows, asked, k):
    def cosine(a, b):
        if a is None or b is None or len(a) != len(b) or None in a or None in b:
            return 0.0
        dot = sum(x * y for x, y in zip(a, b, strict=True))
        length = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        return round(dot / length, 6) + 0.0 if length else 0.0

    out = []
    for q, v in asked:
        found = sorted((-cosine(v, w), i) for i, w in rows)[:k]
        out += [(q, i, -s + 0.0, r) for r, (s, i) in enumerate(found, 1)]
    return sorted(out)


def test_parts_compare_all_with_all(spark, monkeypatch):
    monkeypatch.setattr(nearest, "VECTORS", 150)
    monkeypatch.setattr(nearest, "QUERIES", 20)
    rnd = random.Random(4)
    rows = [(i, [float(rnd.randrange(-9, 9)) for _ in range(8)]) for i in range(500)]
    rows += [(1000 + i, rows[3][1]) for i in range(60)] + [(2000, None), (2001, []), (2002, [0.0] * 8), (2003, [1.0, None] + [0.0] * 6), (2004, [1.0])]
    asked = rows[:40] + rows[560:]
    kinds = "long, embedding array<float>"
    docs, queries = spark.createDataFrame(rows, f"doc_id {kinds}"), spark.createDataFrame(asked, f"query_id {kinds}")
    found = retrieval.dense(docs, queries, 6)
    assert sorted(tuple(r) for r in found.collect()) == plain(rows, asked, 6)
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan  # neither side is sent whole to all tasks
    assert retrieval.dense(docs.limit(0), queries).count() == 0 and retrieval.dense(docs, queries.limit(0)).count() == 0


def test_a_length_is_added_up_once(spark):
    column = vectors.unit(F.col("v"))
    assert spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,)], "v array<float>").select(column.alias("u")).collect() == [([0.6, 0.8],), ([0.0, 0.0],), (None,)]
    assert column._jc.toString().count("aggregate") == 1
