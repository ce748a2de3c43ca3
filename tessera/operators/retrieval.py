"""Ranked retrieval for batches of queries: BM25, cosine, reciprocal-rank fusion, lexical reranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import rulesets as R
from tessera.functions.text import tokens
from tessera.operators import dialogue, nearest, scoring, terminology
from tessera.operators.scoring import query_terms  # noqa: F401  others import it from here
from tessera.sources.scratch import written_once

STRATEGIES = ("dense", "bm25", "hybrid", "rerank", "dense_rerank", "hybrid_rerank", "hybrid+rerank")

#: Rows that are sent to all documents.
FEW = 20_000


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, term, tf and dl (tokens of the document); counted in the map stage before any row moves."""
    rows = docs.select(F.col(id_col).alias("doc_id"), tokens(F.col(text_col)).alias("t")).withColumn("dl", F.size("t"))
    return rows.select("doc_id", "dl", F.explode("t").alias("term")).groupBy("doc_id", "term", "dl").agg(F.count("*").alias("tf"))


def top_k(scored: DataFrame, k: int, *ties: str, key: str = "query_id") -> DataFrame:
    """The k best rows of each query with rank 1..k; Spark cuts each partition before rows are exchanged."""
    order = Window.partitionBy(key).orderBy(F.desc("score"), *[F.asc(t) for t in ties or ("doc_id",)])
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def leg(docs: DataFrame | scoring.Corpus, queries: DataFrame, name: str, k: int = 5, least: float | None = None, **settings) -> DataFrame:
    """One of scoring.LEGS, its k best for each query, written once: a result of known size, which Spark sends to the documents it is joined with."""
    scored = scoring.scores(docs, queries, k, (name,), **settings)
    kept = scored if least is None else scored.where(F.col("score") > least if name == "bm25" else F.col("score") >= least)
    return written_once(top_k(kept, k).select("query_id", "doc_id", "score", "rank"), "hits")


def bm25(docs: DataFrame | scoring.Corpus, queries: DataFrame, k: int = 5, least: float = 0.0, k1: float = R.K1, b: float = R.B) -> DataFrame:
    """query_id, doc_id, score (6 decimals) and rank of documents(doc_id, text) for queries(query_id, query).

    Scores have to exceed `least`. Null texts are empty; they count in the mean length.
    """
    return leg(docs, queries, "bm25", k, least, k1=k1, b=b)


def term_cosine(docs: DataFrame | scoring.Corpus, queries: DataFrame, k: int = 5, least: float = 0.0) -> DataFrame:
    """Cosine of term-count vectors: the dense leg where no embedding model is given."""
    return leg(docs, queries, "dense", k, least)


def legs(docs: DataFrame | scoring.Corpus, queries: DataFrame, k: int) -> DataFrame:
    """(leg, query_id, doc_id, score, rank): the k best of both legs, from one pass over the documents, written once."""
    scored = scoring.scores(docs, queries, k).where("leg <> 'bm25' OR score > 0").withColumn("key", F.struct("leg", "query_id"))
    return written_once(top_k(scored, k, key="key").select("leg", "query_id", "doc_id", "score", "rank"), "legs")


def dense(vectors: DataFrame, queries: DataFrame, k: int = 5, least: float = -1.0) -> DataFrame:
    """Cosine top-k of vectors(doc_id, embedding) for queries(query_id, embedding), a part of the vectors against a part of the queries in a task.

    A vector that is null, empty, of zeros, with a null or of another length has the cosine 0. For many vectors
    vectors.ann_topk compares with a share of them only.
    """
    scored = nearest.scores(vectors.select("doc_id", "embedding"), queries.select("query_id", "embedding"), k)
    return top_k(scored.where(F.col("score") >= least), k).select("query_id", "doc_id", "score", "rank")


def latest(rows: DataFrame, key: str = "doc_id", order: str | None = None) -> DataFrame:
    """One row of each key: that of the greatest `order` (a column); of equal ones, and without an order, the greatest by
    the other columns in turn."""
    rest = F.struct(*([order] if order else []), *[c for c in rows.columns if c not in (key, order)])
    return rows.groupBy(key).agg(F.max(rest).alias("last")).select(key, "last.*").select(*rows.columns)


def upsert(stored: DataFrame, new: DataFrame, key: str = "doc_id", order: str | None = None) -> DataFrame:
    """stored with the rows of new, which replace those of the same key; of repeated keys in new the latest stays."""
    newest = latest(new, key, order)
    return stored.join(newest.select(key), key, "left_anti").unionByName(newest)


def fuse(runs: list[DataFrame], k: int = 5, constant: int = R.RRF_K) -> DataFrame:
    """Reciprocal-rank fusion; scores are shares of the best possible one. Ties: earlier run, then rank."""
    merged = None
    for number, run in enumerate(runs):
        part = run.select("query_id", "doc_id", "rank", F.lit(number).alias("run"))
        merged = part if merged is None else merged.unionByName(part)
    best = len(runs) / (constant + 1)
    scored = merged.groupBy("query_id", "doc_id").agg(
        F.round(F.least(F.sum(1.0 / (constant + F.col("rank"))) / best, F.lit(1.0)), 6).alias("score"), F.min(F.struct("run", "rank")).alias("first")
    ).select("query_id", "doc_id", "score", F.col("first.run").alias("run"), F.col("first.rank").alias("before"))
    return top_k(scored, k, "run", "before", "doc_id").select("query_id", "doc_id", "score", "rank")


def sent(rows: DataFrame, few: int = FEW) -> DataFrame:
    """Written rows for a join with all documents: few go to the documents, more meet them. Files are no measure, texts that repeat take little room there."""
    return rows.hint("broadcast" if rows.count() <= few else "merge")


def rerank(candidates: DataFrame, docs: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """Weighted share of query words in the text, former score, and whether the query stands in it; ties keep their order."""
    asking = written_once(candidates.join(queries.select("query_id", "query"), "query_id"), "candidates")
    # the words of a text are taken once, however many ask for it
    wanted = docs.select("doc_id", "text").join(sent(asking).select("doc_id"), "doc_id", "left_semi")
    wanted = wanted.select("doc_id", F.lower("text").alias("lower"), F.array_distinct(tokens(F.col("text"))).alias("there"))
    texts = sent(asking.withColumn("asked", F.array_distinct(tokens(F.col("query"))))).join(wanted, "doc_id")
    overlap = F.size(F.array_intersect("asked", "there")) / F.greatest(F.size("asked"), F.lit(1))
    phrase = F.when(F.contains("lower", F.lower(F.trim("query"))), R.RERANK_PHRASE).otherwise(0.0)
    clipped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score")))
    scored = texts.select(
        "query_id", "doc_id", F.col("rank").alias("before"), F.round(R.RERANK_OVERLAP * overlap + R.RERANK_SCORE * clipped + phrase, 6).alias("score")
    )
    return top_k(scored, k, "before", "doc_id").select("query_id", "doc_id", "score", "rank")


def above(hits: DataFrame, least: float) -> DataFrame:
    """Hits of at least the score, ranked anew."""
    kept = hits.where(F.col("score") >= least) if least > 0 else hits
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))


def search(
    docs: DataFrame, queries: DataFrame, strategy: str = "dense", k: int = 5, candidates: int = 15, least: float = 0.0,
    expand: bool = True, terms: DataFrame | None = None,
) -> DataFrame:
    """One of STRATEGIES over documents(doc_id, text) for queries(query_id, query).

    With expand, what is searched is the query with typos corrected and the full forms of its acronyms, and for Arabic
    queries the English of terms(term_ar, term_en) that stand in it.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy}; there are {', '.join(STRATEGIES)}")
    if k < 1:
        raise ValueError("k is 1 or more")
    if expand:
        queries = terminology.with_terms(queries, terms).select("query_id", F.col("expanded").alias("query"))
    if strategy == "bm25":
        return bm25(docs, queries, k, least)
    if strategy == "dense":
        return term_cosine(docs, queries, k, least)
    if "hybrid" in strategy:
        both = legs(docs, queries, candidates)
        found = fuse([both.where(F.col("leg") == name).drop("leg") for name in scoring.LEGS], candidates if "rerank" in strategy else k)
    else:
        found = term_cosine(docs, queries, candidates)
    if "rerank" in strategy:
        found = rerank(found, docs, queries, k)
    return written_once(above(found, least), "found")


def search_questions(docs: DataFrame, queries: DataFrame, strategy: str = "hybrid_rerank", k: int = 5, each: int = 5, candidates: int = 20, expand: bool = True, terms: DataFrame | None = None) -> DataFrame:
    """query_id, doc_id, score and rank for queries(query_id, query): every question of a compound query is searched by itself, then all take turns."""
    asked = queries.select("query_id", F.posexplode(dialogue.sub_questions(F.coalesce("query", F.lit("")))).alias("question", "query"))
    hits = search(docs, asked.select(F.struct("query_id", "question").alias("query_id"), "query"), strategy, each, candidates, expand=expand, terms=terms)
    return round_robin(hits.select("query_id.*", "doc_id", "score", "rank"), k)


def vector_count(stored: DataFrame) -> DataFrame:
    """One row: how many vectors are stored."""
    return stored.agg(F.count("*").alias("n"))


def round_robin(runs: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, question, doc_id, score, rank) -> best of all questions in turn: rank by rank, question by question, each document once."""
    once = Window.partitionBy("query_id", "doc_id").orderBy("rank", "question")
    first = runs.withColumn("nth", F.row_number().over(once)).where("nth = 1").drop("nth")
    turn = Window.partitionBy("query_id").orderBy("rank", "question", "doc_id")
    return first.withColumn("position", F.row_number().over(turn)).where(F.col("position") <= k).select(
        "query_id", "doc_id", "score", F.col("position").alias("rank")
    )
