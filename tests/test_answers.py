import pytest
from pyspark.sql import functions as F

from tessera.operators import dialogue, evaluation, grounding, retrieval
from tessera.plans import answers
from tessera.sources import sinks
from tessera.sources.sessions import SessionStore

DOCS = [
    (1, "Inhaled corticosteroids are the preferred controller for asthma in children."),
    (2, "Spirometry helps to diagnose asthma in school children."),
    (3, "Bronchiolitis in infants needs oxygen when saturation is low."),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string").cache()


def queries(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")


@pytest.mark.parametrize("strategy", retrieval.STRATEGIES)
def test_best_hit(spark, docs, strategy):
    asked = queries(spark, "controller for asthma in children", "oxygen for infants with bronchiolitis")
    best = {r.query_id: r.doc_id for r in retrieval.search(docs, asked, strategy, 2).where("rank = 1").collect()}
    assert best == {0: 1, 1: 3}


def test_search_refuses_bad_settings(spark, docs):
    with pytest.raises(ValueError):
        retrieval.search(docs, queries(spark, "a"), "other")
    with pytest.raises(ValueError):
        retrieval.search(docs, queries(spark, "a"), "bm25", 0)


def test_fusion_ties_and_halves(spark):
    run = lambda *ids: spark.createDataFrame([(0, d, 1.0, i + 1) for i, d in enumerate(ids)], "query_id long, doc_id long, score double, rank int")
    rows = retrieval.fuse([run(7, 8), run(9, 8)], 3).orderBy("rank").collect()
    assert [(r.doc_id, r.score) for r in rows] == [(8, round(2 / 62 / (2 / 61), 6)), (7, 0.5), (9, 0.5)]


def test_status_of_each_path(spark, docs):
    asked = queries(
        spark, "can't breathe, blue lips", "asthma treatment", "Inhaler prescribed how much for school asthma children", "controller for asthma in children",
        "quantum asthma in children zebra", None,
    )
    found = {r.query_id: r for r in answers.answer(asked, docs).collect()}
    assert [found[i].status for i in range(6)] == ["REFUSAL", "CLARIFY", "CLARIFY", "SUCCESS", "NO_EVIDENCE", "CLARIFY"]
    assert found[3].recommendation.startswith("According to the evidence: Inhaled") and found[3].note == "fine"


@pytest.mark.parametrize(("top", "label", "reason"), [(0.92, "High", None), (0.80, "Moderate", None), (0.58, "Low / Not Grounded", "low_confidence"), (0.2, "Low / Not Grounded", "weak_evidence")])
def test_confidence_and_refusal(spark, top, label, reason):
    row = spark.range(1).select(grounding.confidence(F.lit(top)), grounding.refused(F.lit("asthma"), F.lit(top), F.lit(3))).first()
    assert tuple(row) == (label, reason)


def test_claims_citations_and_sweep(spark, docs):
    hits = docs.select(F.lit(0).cast("long").alias("query_id"), "doc_id", F.lit(0.9).alias("score"), "text")
    cited = spark.createDataFrame([(0, 1, "corticosteroids are preferred"), (0, 1, "cake recipes"), (0, 99, "corticosteroids")], "query_id long, doc_id long, claim string")
    rows = grounding.verified_citations(cited, hits).orderBy("doc_id", "claim").collect()
    assert [r.verified for r in rows] == [False, True, False]
    note = lambda text, cited, ok: spark.range(1).select(grounding.swept(F.lit(text), F.lit(cited), F.lit(ok))).first()[0]
    assert [note("null", 1, 1), note("x", 2, 0), note("5 mg", 2, 0), note("5 mg", 0, 0), note("5 mg", 1, 1)] == ["refused", "WARNING", "WARNING CAUTION", "CAUTION", "fine"]


@pytest.mark.parametrize("reply", ['{"recommendation": "rest"}', '```json\n{"recommendation": "rest"}\n```', 'Well: {"recommendation": "rest"} so', "rest"])
def test_parse(spark, reply):
    assert spark.createDataFrame([(reply,)], "r string").select(grounding.parsed(F.col("r"))).first()[0] == "rest"


def test_dialogue(spark):
    turns = [(1, i, "user" if i % 2 == 0 else "assistant", f"What is the topic{i} of care") for i in range(20)] + [(1, 20, "user", "what about children?"), (1, 21, "user", "is it safe")]
    rows = dialogue.history(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).where("turn >= 20").orderBy("turn")
    got = rows.select(F.size("history").alias("n"), F.col("history")[0]["seq"].alias("first"), dialogue.rewritten(F.col("text"), F.col("history")).alias("q")).collect()
    assert (got[0].n, got[0].first) == (8, 12)
    assert got[0].q == "the topic18 of care - children"
    assert got[1].q.startswith("is ") and got[1].q.endswith(" safe") and "children" in got[1].q


def test_topic_shift(spark):
    asked = ["what about its side effects", "asthma care in young children", "diabetes", "and then"]
    rows = spark.createDataFrame([(t,) for t in asked], "t string").select(dialogue.topic_shift(F.col("t"), F.lit(True)))
    assert [r[0] for r in rows.collect()] == [False, True, True, False]


def test_expansion_spelling_and_decomposition(spark):
    row = spark.range(1).select(
        dialogue.expanded(F.lit("is ICS safe")), dialogue.spelled(F.lit("astma inhalrr now")), dialogue.spelled(F.lit("broncholitis care"), ["bronchiolitis"]),
        dialogue.sub_questions(F.lit("What is the first treatment of asthma, and how is bronchiolitis diagnosed in infants?")), dialogue.sub_questions(F.lit("What is asthma?")),
    ).first()
    assert row[0] == "is ICS safe inhaled corticosteroids" and row[1] == "asthma inhaler now" and row[2] == "bronchiolitis care"
    assert row[3] == ["What is the first treatment of asthma?", "and how is bronchiolitis diagnosed in infants?"] and row[4] == ["What is asthma?"]


def test_metrics(spark):
    asked = spark.createDataFrame([(1,), (2,)], "query_id long")
    hits = spark.createDataFrame([(1, 1, False), (1, 2, True), (1, 3, True)], "query_id long, rank int, relevant boolean")
    rows = {r.query_id: tuple(r)[1:] for r in evaluation.precision_and_mrr(asked, hits, 5).collect()}
    assert rows == {1: (0.4, 0.5), 2: (0.0, 0.0)}
    cases = spark.createDataFrame([(True, True, False), (True, False, True), (False, True, False)], "should_refuse boolean, was_refused boolean, is_injection boolean")
    assert tuple(evaluation.refusal_rates(cases).first()) == (0.5, 1.0, 1.0)
    assert tuple(evaluation.refusal_rates(cases.limit(0)).first()) == (1.0, 0.0, 0.0)


def test_sessions_and_sinks(spark, tmp_path, docs):
    store = SessionStore(spark, str(tmp_path))
    store.add_conversations(spark.createDataFrame([("a", None), (None, "Mine")], "id string, title string"))
    store.add_messages(spark.createDataFrame([("a", 2, "assistant", "yes", '{"x": 1}'), ("a", 1, "user", "hi", None)], "conversation_id string, seq long, role string, content string, structured_response string"))
    assert sorted(r.title for r in store.conversations().collect()) == ["Mine", "New session"]
    assert [r.content for r in store.messages("a").collect()] == ["hi", "yes"]
    hits = retrieval.bm25(docs, queries(spark, "asthma"))
    sinks.retrieval_log(hits).write.json(str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 1


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    from tessera.streaming import telemetry

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parquet*")
    query = telemetry.request_windows(stream).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    query.awaitTermination(120)
    assert sorted(map(tuple, spark.table("w").collect())) == sorted(map(tuple, telemetry.request_windows(events).collect()))


@pytest.mark.parametrize(
    ("text", "parts"),
    [
        ("1. What is asthma 2) How is it treated", ["What is asthma", "How is it treated"]), ("What is it? How so?", ["What is it?", "How so?"]),
        ("asthma signs, and how to treat them", ["asthma signs", "how to treat them"]), ("ما هو الربو؟ كيف نعالجه؟", ["ما هو الربو؟", "كيف نعالجه؟"]),
        ("one thing", ["one thing"]), ("", []), (None, []),
    ],
)
def test_listed_questions(spark, text, parts):
    assert spark.createDataFrame([(text,)], "t string").select(dialogue.listed_questions(F.col("t"))).first()[0] == parts


def test_upsert(spark):
    vectors = lambda *rows: spark.createDataFrame(list(rows), "doc_id long, embedding array<float>")
    rows = retrieval.upsert(vectors((1, [1.0]), (2, [2.0])), vectors((2, [5.0]), (3, [3.0]), (3, [3.0]))).collect()
    assert sorted((r.doc_id, r.embedding[0]) for r in rows) == [(1, 1.0), (2, 5.0), (3, 3.0)]


def test_failure_modes_and_scores(spark):
    long, short = "word " * 40, "tiny text"
    rows = [(1, 1, 5, long, True, False), (1, 2, 5, long, False, False), (2, 1, 6, short, True, False), (3, 1, 7, long, False, False), (4, 1, 8, short, False, True)]
    hits = spark.createDataFrame(rows, "query_id long, rank int, doc_id long, text string, relevant boolean, out_of_scope boolean")
    got = {r.query_id: r.modes for r in evaluation.failure_modes(hits).collect()}
    assert got == {1: ["duplicate_chunks"], 2: ["missing_context"], 3: ["wrong_topic"], 4: ["unrefused_out_of_scope"]}
    cases = spark.createDataFrame([(0.5, False, False), (None, True, True), (None, True, False)], "precision double, out_of_scope boolean, refused boolean")
    assert evaluation.out_of_scope_score(cases, True).first()[0] == 0.5 and evaluation.out_of_scope_score(cases, False).first()[0] == 0.5


def test_response_fields(spark):
    cited = "citations array<struct<claim:string,doc_id:long,section:string,score:double,verified:boolean>>"
    rows = [("SUCCESS", "High", [("c", 1, None, 0.125, True)]), ("SUCCESS", "High", [("c", 1, "s", 0.5, False)]), ("SUCCESS", "High", None), ("REFUSAL", None, None)]
    got = grounding.response(spark.createDataFrame(rows, f"status string, confidence string, {cited}")).collect()
    assert [r.is_verified for r in got] == [True, False, True, False]
    assert got[0].citations_payload[0].asDict() == {"claim": "c", "chunk_id": 1, "source": "Guideline evidence", "score": 0.125, "is_verified": True}


def test_compound_queries_are_searched_question_by_question(spark):
    docs = spark.createDataFrame([(1, "wheeze and cough are symptoms"), (2, "spirometry confirms the diagnosis"), (3, "nothing of note here"), (4, None)], "doc_id long, text string")
    asked = "What symptoms suggest wheeze and cough, and how does spirometry confirm the diagnosis?"
    queries = spark.createDataFrame([(7, asked), (8, "spirometry")], "query_id long, query string")
    found = [tuple(r) for r in retrieval.search_questions(docs, queries, k=2).select("query_id", "rank", "doc_id").orderBy("query_id", "rank").collect()]
    assert found == [(7, 1, 1), (7, 2, 2), (8, 1, 2)]
    assert retrieval.search_questions(docs.limit(0), queries).count() == 0
    assert retrieval.search_questions(docs, queries.limit(0)).count() == 0


def test_strict_precision_wants_all_labels(spark):
    rows = spark.createDataFrame([(1, 1, True), (1, 2, False), (2, 1, True)], "query_id long, rank int, relevant boolean")
    assert [tuple(r) for r in evaluation.strict_precision(rows.where("query_id = 1"), 2).collect()] == [(1, 0.5)]
    with pytest.raises(Exception, match="2 labels expected, 1 found"):
        evaluation.strict_precision(rows, 2).collect()
    with pytest.raises(ValueError):
        evaluation.strict_precision(rows, 0)


def test_unsupported_rate(spark):
    claims = spark.createDataFrame([(True,), (False,), (True,), (True,)], "supported boolean")
    assert tuple(evaluation.unsupported_rate(claims).first()) == (4, 0.25)
    assert tuple(evaluation.unsupported_rate(claims.limit(0)).first()) == (0, 0.0)


def test_evidence_leaves_out_another_illness_for_symptoms(spark):
    rows = [(1, "asthma symptoms", "Bronchiolitis in infants", 0.9, 1), (1, "asthma symptoms", "wheeze", 0.8, 2), (2, "symptoms of bronchiolitis", "Bronchiolitis", 0.9, 1), (3, None, None, 0.9, 1)]
    hits = spark.createDataFrame(rows, "query_id long, query string, text string, score double, rank int")
    assert sorted((r.query_id, r.rank) for r in grounding.evidence(hits).collect()) == [(1, 2), (2, 1), (3, 1)]


def test_canonical_questions(spark):
    said = [(0, "user", "How does paediatric asthma present?"), (1, "assistant", "With wheeze.")]
    rows = [("asthma symptoms", []), ("  ", said), (None, []), ("Is there anything on treatment that lasts", []), ("how is it", said), ("and then we need the treatment for what about children", said)]
    df = spark.createDataFrame(rows, "q string, h array<struct<seq:int,role:string,content:string>>")
    got = [r[0] for r in df.select(dialogue.canonical(F.col("q"), F.col("h"))).collect()]
    assert got[:4] == ["What are the symptoms of asthma?", "", "", "Is there anything on treatment that lasts"]
    assert "paediatric asthma" in got[4] and got[5] == "How is paediatric asthma treated?"


def test_typed_texts_with_slots(spark):
    docs = spark.createDataFrame([(1, "An inhaled controller is given daily for asthma in children."), (2, "Spirometry is the test for asthma diagnosis.")], "doc_id long, text string")
    rows = [
        ("a", "1. Which controller for asthma?\n2. Which test for asthma?", {"diagnosed": "yes", "age_band": "under_6"}), ("b", "what is the price of bitcoin", None),
        ("c", None, {}), ("d", "asthma", {"age_band": None, "other": ""}),
    ]
    queries = spark.createDataFrame(rows, "query_id string, query string, slots map<string,string>")
    got = {(r.query_id, r.part): r for r in answers.answer_typed(queries, docs).collect()}
    assert set(got) == {("a", 0), ("a", 1), ("b", 0), ("c", 0), ("d", 0)}
    assert got["a", 0].question == "Which controller for asthma?"
    assert got["a", 1].question == "Which test for asthma? [diagnosed: yes] [2-year-old child under 6, under-5 age band, children under 6]"
    assert got["b", 0].status == "REFUSAL" and got["b", 0].question == rows[1][1] and got["b", 0].asks == []
    assert "CLARIFY" not in {r.status for r in got.values()} and not {"diagnosed", "age_group"} & set(got["a", 0].asks)
    assert got["d", 0].question == "asthma" and answers.answer_typed(queries.drop("slots").limit(0), docs).count() == 0
