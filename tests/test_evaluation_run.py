"""The evaluation run over a file of cases, by hand; typed texts split by hand."""

import json

from pyspark.sql import functions as F

from tessera.operators import dialogue, evaluation
from tessera.plans import evaluation_run


def test_run_over_a_file_of_cases(spark, tmp_path):
    long = "inhaled controller for asthma " + "word " * 30
    docs = spark.createDataFrame(
        [(1, long, "a.pdf", "S", 1, "x"), (2, long + "extra", "a.pdf", "S", 1, "x"), (3, "spirometry test", "b.pdf", "T", 1, "x"), (4, None, None, None, None, "x")],
        "doc_id long, text string, document string, section string, page_start int, query string",
    )
    cases = [
        {"id": "q1", "category": "treatment", "question": "inhaled controller", "expected_keywords": ["inhaled", "controller"]},
        {"id": "q2", "category": "diagnosis", "question": "spirometry", "expected_chunk_id": "3"},
        {"id": "q3", "category": "out_of_scope", "question": "zebra"}, {"id": "q4", "category": "out_of_scope", "question": "spirometry"},
        {"id": "q5", "category": "treatment", "question": None, "expected_keywords": ["inhaled"]},
    ]
    path, out = tmp_path / "cases.json", str(tmp_path / "out")
    path.write_text(json.dumps(cases))
    row = evaluation_run.evaluate(spark, str(path), docs, out, corpus="small").first()
    assert tuple(row) == (5, 3, round((2 / 3 + 1 / 3) / 3, 4), round((2 / 5 + 1 / 5) / 3, 4), 1, 1, 1, 1)
    got = {r.query_id: r for r in spark.read.json(f"{out}/results").collect()}
    assert (got["q1"].modes, got["q2"].modes, got["q3"].modes, got["q4"].modes, got["q5"].modes) == (["duplicate_chunks"], ["missing_context"], [], ["unrefused_out_of_scope"], ["wrong_topic"])
    assert [got[q].status for q in ("q1", "q3", "q4")] == ["PROCESSED", "REFUSED", "PROCESSED"] and got["q3"].precision_5 == 1 and got["q4"].precision_5 == 0
    assert [(h.rank, h.doc_id, h.relevant) for h in got["q2"].retrieved] == [(1, 3, True)]
    assert spark.read.json(f"{out}/config").first().corpus == "small" and spark.read.json(f"{out}/metrics").count() == 1
    none = evaluation_run.totals(evaluation_run.evaluated(docs, evaluation_run.cases_of_file(spark, str(path)).limit(0)))
    assert tuple(none.first()) == (0, 0, 0.0, 0.0, 0, 0, 0, 0)


def test_hits_of_one_place_are_duplicates(spark):
    rows = [(1, 1, 10, "one", True, False, "p"), (1, 2, 11, "two", True, False, "p"), (2, 1, 10, "one", True, False, "p"), (2, 2, 12, "two", True, False, None), (2, 3, 13, "three", True, False, None)]
    hits = spark.createDataFrame(rows, "query_id int, rank int, doc_id long, text string, relevant boolean, out_of_scope boolean, place string")
    got = {r.query_id: r.modes for r in evaluation.failure_modes(hits, 1).collect()}
    assert got == {1: ["duplicate_chunks"], 2: []}


TYPED = [
    ("1. What is asthma? 2) And  COPD?\n3. x", ["What is asthma?", "And  COPD?", "x"]), ("What? Why? how", ["What?", "Why?", "how?"]),
    ("one line\r\n\n two lines ", ["one line", "two lines"]), ("  just one? ", ["just one?"]), ("", []), (None, []), (" \n ", []), ("a 1. 2. b", ["a", "", "b"]), ("dose 2.5 mg", ["dose 2.5 mg"]),
]


def test_typed_questions(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(TYPED)], "i int, t string").select("i", dialogue.typed_questions(F.col("t")).alias("q")).orderBy("i").collect()
    assert [r.q for r in rows] == [want for _, want in TYPED]
