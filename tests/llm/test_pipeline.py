"""The pipeline's stages against what they say they do."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import exact, simhash


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(3, 9)))
    rows, labels = [], []
    for i in range(400):
        text = [word() for _ in range(60)]
        bad = i % 5 == 1
        if bad:
            text[rnd.randrange(60)] = "grumpface"
        rows.append((i, " ".join(text), "en", f"s{i % 3}"))
        labels.append((i, 1, int(bad)))
    clean = [r for r in rows if r[0] % 5 != 1]
    rows += [(1000 + k, clean[k][1].replace(" ", "  "), "en", "s0") for k in range(20)]  # copies but for white space
    long = " ".join(word() for _ in range(4000))
    rows += [(2000, long, "en", "s1"), (2001, long + " tail", "en", "s1"), (3000, None, "en", "s1"), (3001, "mail me at who@there.org now", "en", "s2")]
    path = tmp_path_factory.mktemp("pipe")
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages(spark, folder):
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialise(stage(spark, docs, folder), name)
        seen[name] = docs
        if name != "packing":
            assert docs.columns == columns
    ids = {name: {r.doc_id for r in df.select("doc_id").distinct().collect()} for name, df in seen.items()}
    bad = {i for i in range(400) if i % 5 == 1}
    assert len(ids["toxicity"] & bad) <= 4 and len(ids["toxicity"]) >= 340
    assert not ids["exact_dedup"] & set(range(1000, 1020)) and ids["exact_dedup"] <= ids["toxicity"]
    assert 2000 in ids["near_dedup"] and 2001 not in ids["near_dedup"] and len(ids["exact_dedup"] - ids["near_dedup"]) == 1
    text = seen["pii"].where("doc_id = 3001").first().text
    assert text == "mail me at [email] now"
    assert ids["packing"] == ids["pii"] == ids["near_dedup"]
    last = sorted(map(tuple, corpus_pipeline.run(spark, folder).collect()))
    assert last == sorted(map(tuple, seen["packing"].collect()))


def test_stages_on_nothing(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[1:]:
        docs = stage(spark, docs, folder)
        assert docs.count() == 0
        if "lang" not in docs.columns:
            break


def test_exact_keeper_on_shuffled_rows(spark, sf_dir):
    """However the table is dealt, the rows that stay are those of the plain version, whole and with their own columns."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("row_no", F.col("doc_id") * 3).withColumn("__row_no", F.lit("x"))
    copies = docs.withColumn("doc_id", F.col("doc_id") + 10_000).withColumn("text", F.regexp_replace("text", " ", "  "))
    every = docs.unionByName(copies).unionByName(docs.limit(20))
    want = {}
    for r in every.collect():
        key = re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")
        if key not in want or r.doc_id < want[key][0]:
            want[key] = tuple(r)
    for shuffled in (every, every.repartition(7), every.orderBy(F.desc("doc_id")), every.repartition(3, "text").union(every.limit(5))):
        got = exact.keep_first(shuffled)
        assert got.columns == every.columns and sorted(map(tuple, got.collect()), key=str) == sorted(want.values(), key=str)


def test_keepers_agree_with_plain_versions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {r.doc_id for r in exact.keep_first(docs).select("doc_id").collect()}
    first = {}
    for r in docs.orderBy("doc_id").collect():
        first.setdefault(hashlib.sha256(" ".join(r.text.replace("\n", " ").split(" ")).encode()).hexdigest(), r.doc_id)
    assert kept == {r.doc_id for r in exact.exact_dedup(docs).where("kept").collect()} and len(kept) <= len(first) + 5
    near = simhash.near_duplicates(docs, 5, 3)
    assert {r.doc_id for r in near.where(F.col("doc_id") == F.col("component_id")).collect()} == {r.doc_id for r in simhash.keep_first(docs, 5, 3).select("doc_id").collect()}
