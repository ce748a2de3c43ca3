import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import terminology
from tessera.plans import corpus, questions
from tessera.sources import sinks

HISTORY = "array<struct<seq:int,role:string,content:string>>"


@pytest.fixture(scope="module")
def build(spark):
    unit = "Inhaled steroids given every day reduce the number of severe attacks in children with asthma and keep their lungs growing as they should."
    pages = [("a", 1, f"Treatment\n{unit}"), ("a", 2, f"Treatment\n{unit.upper()}"), ("b", 1, f"Treatment\n{unit}"), ("b", 2, "")]
    return corpus.build(spark.createDataFrame(pages, "document string, doc_id long, text string"), size=40, overlap=0).cache()


def test_corpus_drops_copies_within_a_document_only(build):
    texts = {(r.document, r.text.lower()) for r in build.collect()}
    assert len(texts) == build.count() and {d for d, _ in texts} == {"a", "b"}
    assert {r.rule: r.n for r in corpus.violations(build).collect()} == dict.fromkeys(("no_chunks", "blank_text", "page_range", "missing_field", "repeated_id"), 0)


def test_corpus_rules_and_fingerprint(spark, build):
    assert {r.rule: r.n for r in corpus.violations(build.limit(0)).collect()}["no_chunks"] == 1
    twice = build.unionByName(build.withColumn("text", F.lit(" ")).withColumn("page_start", F.lit(0).cast("long")))
    found = {r.rule: r.n for r in corpus.violations(twice).collect()}
    assert found["repeated_id"] == found["blank_text"] == found["page_range"] == build.count()
    prints = {corpus.fingerprint(x).first()[0] for x in (build, build.repartition(3), build.where("document = 'a'"))}
    assert len(prints) == 2 and all(len(p) == 10 for p in prints)


def test_manifest_and_evaluation_are_read_back(spark, build, tmp_path):
    sinks.write_manifest(build, f"{tmp_path}/m", size=40, corpus_fingerprint=corpus.fingerprint(build).first()[0])
    assert spark.read.json(f"{tmp_path}/m/chunks").count() == build.count()
    assert spark.read.json(f"{tmp_path}/m/config").first()["size"] == 40
    metrics = spark.createDataFrame([(0.5,)], "precision double")
    sinks.write_evaluation(build.select("chunk_id"), metrics, f"{tmp_path}/e", k=5)
    assert json.loads(spark.read.text(f"{tmp_path}/e/metrics").first()[0]) == {"precision": 0.5}


def test_standalone_questions(spark):
    cases = [
        ("  asthma symptoms ", "What are the common symptoms of asthma in children?"),
        ("I keep coughing at night, could it be asthma?", "Is nocturnal coughing a symptom of asthma?"),
        ("How do I treat My Child's asthma?", "How do I treat pediatric asthma?"),
        ("What is a spacer?", "What is a spacer?"), ("كيف علاج الربو", "كيف يتم علاج الربو عند الأطفال؟"), ("طفلي بيكح", "السعال عند الأطفال"),
    ]
    rows = spark.createDataFrame(cases, "q string, want string").select(questions.standalone(F.col("q")).alias("got"), "want").collect()
    assert [r.got for r in rows] == [r.want for r in rows]


def test_processed_queries(spark):
    said = [(1, "user", "asthma treatment in children")]
    rows = [(1, "treatment of asthma", []), (2, "what about adults?", said), (3, None, said), (4, "  ", None), (5, "What is asthma? How is it treated?", [])]
    got = {r.query_id: r for r in questions.processed(spark.createDataFrame(rows, f"query_id long, query string, history {HISTORY}")).collect()}
    assert got[1].topic_shift and got[1].question == "How is pediatric asthma treated?"
    assert not got[2].topic_shift and "asthma" in got[2].question and "adults" in got[2].question
    assert all(got[i].question == "" and got[i].sub_questions == [] and got[i].topic_shift and not got[i].is_multi for i in (3, 4))
    assert got[5].is_multi and len(got[5].sub_questions) == 2


def test_terms_found_anywhere_in_a_query(spark):
    terms = spark.createDataFrame([("ربو", "asthma"), ("سعال", "cough"), ("دم", "blood"), ("صفير", "wheeze")], "term_ar string, term_en string")
    texts = [(1, "ما هو الربو والسعال والدم"), (2, "asthma ICS"), (3, None), (4, ""), (5, "رب")]
    queries = spark.createDataFrame(texts, "query_id long, query string")
    plain = {(i, a, e) for i, q in texts for a, e in (tuple(r) for r in terms.collect()) if q and len(a) >= 3 and a in q.lower()}
    for most in (0, 1000):  # joined, and by the automaton
        assert {tuple(r) for r in terminology.mentioned_terms(queries, terms, most).collect()} == plain and plain
    assert terminology.mentioned_terms(queries, terms.limit(0)).count() == 0 and terminology.mentioned_terms(queries.limit(0), terms).count() == 0
    told = {r.query_id: r for r in questions.clinical_terms(queries, terms).collect()}
    assert told[1].mapped == ["asthma", "cough"] and told[2].mapped == [] and len(told) == len(texts)
    got = {r.query_id: r.expanded for r in terminology.with_terms(queries, terms).collect()}
    assert got[1] == texts[0][1] + " asthma cough" and got[2].startswith("asthma ICS ") and got[3] is None and got[4] == ""


def test_prompt_holds_the_last_six_messages(spark):
    said = [(i, "user" if i % 2 else "assistant", f" m{i} ") for i in range(1, 9)]
    rows = spark.createDataFrame([("q", "E", said), ("q", "E", [])], f"q string, e string, h {HISTORY}")
    full, bare = [r[0] for r in rows.select(questions.prompt(F.col("q"), F.col("e"), F.col("h"))).collect()]
    assert bare == "EVIDENCE CHUNKS:\nE\n\nCLINICAL QUESTION:\nq\n\nAnswer using ONLY the evidence above. Follow the JSON structure exactly."
    past = "\n".join(("User: " if i % 2 else "Assistant: ") + f"m{i}" for i in range(3, 9))
    assert full == f"RECENT CONVERSATION HISTORY:\n{past}\n\n{bare}"
