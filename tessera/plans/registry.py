"""Registered queries over the driver's tables, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import rulesets as R
from tessera.functions import text as T
from tessera.operators import chunking, cleaning, dialogue, evaluation, gates, grounding, inverted, replies, retrieval, terminology, vectors
from tessera.plans import answers, conversations, corpus, evaluation_run, grid, questions
from tessera.sources import sessions, sinks
from tessera.sources.collection import VectorCollection
from tessera.sources.scratch import fresh_path, written_once
from tessera.sources.tables import ENTITIES, table, web_pages
from tessera.sources.tables import terminology as terminology_files
from tessera.streaming import conversations as streamed
from tessera.streaming import telemetry

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _registered(sql: str | None = None):
    def keep(query):
        _QUERIES[query.__name__] = query
        if sql:
            _SQL[query.__name__] = sql
        return query

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# --- SQL building blocks --------------------------------------------------------------------------


def _tok(column: str) -> str:
    return f"list_filter(regexp_extract_all(lower(coalesce({column}, '')), '[\\p{{L}}\\p{{N}}_]+'), lambda x: regexp_full_match(x, '[a-z0-9]+'))"


def _any(column: str, patterns: list[str]) -> str:
    joined = "|".join(patterns).replace("'", "''")
    return f"regexp_matches({column}, '(?i)(?:{joined})')"


def _has(column: str, terms: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({column}), '{t.replace(chr(39), chr(39) * 2)}')" for t in terms) + ")"


def _prefix(column: str, terms: list[str]) -> str:
    # RE2's \b knows ASCII only, so the place before an Arabic term is written out
    return f"regexp_matches(lower({column}), '(?:^|[^\\p{{L}}\\p{{N}}_])(?:{'|'.join(t.replace('-', chr(92) + '-') for t in terms)})')"


_STRIP = lambda c: f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"
_COLLAPSE = lambda c: f"regexp_replace({_STRIP(c)}, '\\s+', ' ', 'g')"
_BM25 = f"""
tok AS (SELECT doc_id, {_tok('text')} AS t FROM documents),
post AS (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM tok),
tf AS (SELECT doc_id, term, dl, count(*) AS tf FROM post GROUP BY ALL),
qt AS (SELECT item_id AS query_id, unnest({_tok('text')}) AS term FROM benchmark),
qtf AS (SELECT query_id, term, count(*) AS qtf FROM qt GROUP BY ALL),
corpus AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM tok),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
scored AS (
  SELECT query_id, doc_id, round(sum(qtf * ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * (tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / greatest(mean, 1.0))))), 6) AS score
  FROM qtf JOIN tf USING (term) JOIN df USING (term), corpus GROUP BY ALL),
bm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0),
dn AS (SELECT doc_id, sqrt(sum(tf * tf)) AS dn FROM tf GROUP BY ALL),
qn AS (SELECT query_id, sqrt(sum(qtf * qtf)) AS qn FROM qtf GROUP BY ALL),
cosined AS (SELECT query_id, doc_id, round(sum(tf * qtf) / (any_value(dn) * any_value(qn)), 6) AS score
  FROM qtf JOIN tf USING (term) JOIN dn USING (doc_id) JOIN qn USING (query_id) GROUP BY query_id, doc_id),
co AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM cosined),
runs AS (SELECT query_id, doc_id, rank, 0 AS run FROM co WHERE rank <= 15 UNION ALL SELECT query_id, doc_id, rank, 1 FROM bm WHERE rank <= 15),
fused AS (SELECT query_id, doc_id, round(least(sum(1.0::DOUBLE / (60 + rank)) / (2 / 61.0::DOUBLE), 1.0), 6) AS score, min(run * 1000 + rank) AS first FROM runs GROUP BY ALL),
fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, doc_id) AS rank FROM fused),
reranked AS (
  SELECT f.query_id, f.doc_id, f.rank AS before,
    round(0.55::DOUBLE * len(list_intersect(list_distinct({_tok('b.text')}), list_distinct({_tok('d.text')}))) / greatest(len(list_distinct({_tok('b.text')})), 1)
      + 0.25::DOUBLE * greatest(0.0, least(1.0, f.score)) + CASE WHEN contains(lower(d.text), lower(trim(b.text))) THEN 0.35::DOUBLE ELSE 0 END, 6) AS score
  FROM fr f JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = f.query_id WHERE f.rank <= 15),
hr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, before, doc_id) AS rank FROM reranked)
"""


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


# --- retrieval ------------------------------------------------------------------------------------


@_registered(f"SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct FROM (SELECT doc_id, {_tok('text')} AS t FROM documents)")
def tokenize_counts(spark, sf_dir):
    t = T.tokens(F.col("text"))
    return _documents(spark, sf_dir).select("doc_id", t.alias("t")).select(
        "doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct")
    )


@_registered(f"WITH p AS (SELECT doc_id, unnest({_tok('text')}) AS term FROM documents) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM p GROUP BY ALL")
def term_df(spark, sf_dir):
    found = retrieval.postings(_documents(spark, sf_dir))
    return found.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@_registered(f"WITH {_BM25} SELECT query_id, doc_id, score, rank FROM bm WHERE rank <= 5")
def bm25_topk(spark, sf_dir):
    return retrieval.search(_documents(spark, sf_dir), _items(spark, sf_dir), "bm25", expand=False).select("query_id", "doc_id", "score", "rank")


@_registered(f"WITH {_BM25} SELECT query_id, doc_id, score, rank FROM co WHERE rank <= 5")
def cosine_topk(spark, sf_dir):
    return retrieval.search(_documents(spark, sf_dir), _items(spark, sf_dir), "dense", expand=False)


@_registered(f"WITH {_BM25} SELECT query_id, doc_id, score, rank FROM fr WHERE rank <= 5")
def hybrid_topk(spark, sf_dir):
    return retrieval.search(_documents(spark, sf_dir), _items(spark, sf_dir), "hybrid", expand=False).select("query_id", "doc_id", "score", "rank")


@_registered(f"WITH {_BM25} SELECT query_id, doc_id, score, rank FROM hr WHERE rank <= 5")
def hybrid_rerank_topk(spark, sf_dir):
    return retrieval.search(_documents(spark, sf_dir), _items(spark, sf_dir), "hybrid_rerank", expand=False).select("query_id", "doc_id", "score", "rank")


_DENSE = """
p AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, round(list_cosine_similarity(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 6) AS score
  FROM embeddings q, embeddings d WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM p)
"""


def _vectors(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return rows, rows.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id")  # the stated query set


@_registered(f"WITH {_DENSE} SELECT query_id, doc_id, score, rank FROM r WHERE rank <= 5")
def dense_topk(spark, sf_dir):
    return retrieval.dense(*_vectors(spark, sf_dir))


@_registered(f"WITH {_DENSE} SELECT query_id, doc_id, score, rank FROM r WHERE rank <= 10 AND score >= 0.3")
def dense_threshold(spark, sf_dir):
    return retrieval.dense(*_vectors(spark, sf_dir), 10, 0.3)


@_registered()
def ann_topk(spark, sf_dir):
    """The five nearest vectors of the stated queries in the cells that are probed; tests measure the recall."""
    rows, asked = _vectors(spark, sf_dir)
    return vectors.ann_topk(vectors.build_index(rows), asked)


@_registered(f"WITH {_DENSE} SELECT query_id, doc_id, score, rank FROM r WHERE rank <= 5")
def index_dense_topk(spark, sf_dir):
    """The same, searched until no cell can hold a nearer one."""
    rows, asked = _vectors(spark, sf_dir)
    return vectors.ann_topk(vectors.build_index(rows), asked, surely=True)


@_registered(f"WITH {_BM25} SELECT query_id, doc_id, score, rank FROM bm WHERE rank <= 5")
def index_bm25_topk(spark, sf_dir):
    """BM25 from a stored index of postings; the search doesn't read the documents."""
    return inverted.bm25_topk(inverted.build_index(_documents(spark, sf_dir)), _items(spark, sf_dir))


@_registered("""WITH stored AS (SELECT vec_id, label, embedding FROM embeddings WHERE vec_id % 3 <> 0),
new AS (SELECT vec_id, label + 100 * batch AS label, embedding, batch FROM embeddings, range(1, 3) AS r(batch) WHERE vec_id % 2 = 0),
last AS (SELECT * FROM new QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY batch DESC) = 1)
SELECT vec_id, label, len(embedding) AS dims FROM stored WHERE vec_id NOT IN (SELECT vec_id FROM last) UNION ALL SELECT vec_id, label, len(embedding) FROM last""")
def vector_upsert(spark, sf_dir):
    """Two batches over a collection, twice: the last row of a key wins, and a rerun changes nothing."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    batch = lambda n: rows.where("vec_id % 2 = 0").withColumn("label", F.col("label") + 100 * n).withColumn("batch", F.lit(n))
    new = batch(1).unionByName(batch(2))
    held = VectorCollection(spark, fresh_path(spark, "collection"), "vec_id", "batch")
    held.upsert(rows.where("vec_id % 3 <> 0").withColumn("batch", F.lit(0)))
    for _ in range(2):
        held.upsert(new)
    return held.read().select("vec_id", "label", F.size("embedding").cast("long").alias("dims"))


def _ranked(asked: str, candidates: int) -> str:
    """The steps of _BM25 for asked(item_id, text) in place of the items, with another number of candidates."""
    steps = _BM25.replace("FROM benchmark)", "FROM asked)").replace("JOIN benchmark b", "JOIN asked b").replace("rank <= 15", f"rank <= {candidates}")
    return f"{asked}, {steps}"


def _cut(parts: str, pattern: str) -> str:
    # RE2 has no lookahead: what stands behind a cut is put back
    flags = "gi" if pattern.startswith("(?i)") else "g"
    written = pattern.replace("(?i)", "").replace("(?=", "(")
    return f"list_filter(flatten(list_transform({parts}, lambda p: list_transform(string_split(regexp_replace(p, '{written}', concat(chr(1), '\\1'), '{flags}'), chr(1)), lambda s: {_STRIP('s')}))), lambda s: s <> '')"


def _sub_questions(rows: str) -> str:
    """The steps from rows(id columns, text) to sq(id columns, q, questions)."""
    steps, before = [f"s0 AS (SELECT *, {_STRIP('text')} AS q, [{_STRIP('text')}] AS p0 FROM {rows})"], 0
    for n, pattern in enumerate(R.SPLITS, 1):
        steps.append(f"c{n} AS (SELECT *, {_cut(f'p{before}', pattern)} AS k{n} FROM {'s' if n == 1 else 'd'}{before})")
        steps.append(f"d{n} AS (SELECT *, CASE WHEN len(k{n}) > len(p{before}) THEN k{n} ELSE p{before} END AS p{n} FROM c{n})")
        before = n
    steps.append(f"a AS (SELECT *, list_transform(list_filter(p{before}, lambda s: length(s) >= {R.SHORTEST_QUESTION}), lambda s: regexp_replace(s, '^[ .,;?]+|[ .,;?]+$', '', 'g') || '?') AS aq FROM d{before})")
    steps.append("b AS (SELECT *, list_filter(aq, lambda s, i: list_position(list_transform(aq, lambda y: lower(y)), lower(s)) = i) AS uq FROM a)")
    compound = f"len(string_split_regex(q, '\\s+')) >= {R.COMPOUND_WORDS} AND regexp_matches(q, '(?i){R.CONJUNCTIONS}') AND len(regexp_extract_all(q, '(?i){R.STARTERS}')) >= 2"
    steps.append(f"sq AS (SELECT *, CASE WHEN {compound} AND len(uq) >= 2 THEN uq ELSE [q] END AS questions FROM b)")
    return ", ".join(steps)


_ASKED = f"""item AS (SELECT item_id, coalesce(text, '') AS text FROM benchmark), {_sub_questions('item')},
asked AS (SELECT item_id * 1000 + unnest(range(len(questions))) AS item_id, unnest(questions) AS text FROM sq)"""


@_registered(f"""WITH {_ranked(_ASKED, 20)}, r AS (SELECT query_id // 1000 AS query_id, query_id % 1000 AS question, doc_id, score, rank FROM hr WHERE rank <= 5),
o AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY query_id, doc_id ORDER BY rank, question) = 1),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, question, doc_id) AS position FROM o)
SELECT query_id, doc_id, score, position AS rank FROM n WHERE position <= 5""")
def multi_question_topk(spark, sf_dir):
    return retrieval.search_questions(_documents(spark, sf_dir), _items(spark, sf_dir), expand=False)


@_registered("SELECT count(*) AS n FROM embeddings")
def vector_count(spark, sf_dir):
    return retrieval.vector_count(table(spark, sf_dir, "embeddings"))


@_registered(f"""WITH {_BM25}, both_ AS (SELECT query_id, 0 AS question, doc_id, score, rank FROM bm WHERE rank <= 5 UNION ALL SELECT query_id, 1, doc_id, score, rank FROM co WHERE rank <= 5),
o AS (SELECT * FROM both_ QUALIFY row_number() OVER (PARTITION BY query_id, doc_id ORDER BY rank, question) = 1),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, question, doc_id) AS position FROM o)
SELECT query_id, doc_id, score, position AS rank FROM n WHERE position <= 5""")
def round_robin_merge(spark, sf_dir):
    docs, items = _documents(spark, sf_dir), _items(spark, sf_dir)
    runs = retrieval.bm25(docs, items).withColumn("question", F.lit(0)).unionByName(retrieval.term_cosine(docs, items).withColumn("question", F.lit(1)))
    return retrieval.round_robin(runs)


# --- cleaning and corpus --------------------------------------------------------------------------

_LINES = """
l AS (SELECT source AS document, doc_id AS page, string_split_regex(coalesce(text, ''), '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]') AS ls FROM documents),
u AS (SELECT document, page, unnest(range(0, len(ls))) AS line_no, unnest(ls) AS line FROM l),
f AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY line_no) AS up, row_number() OVER (PARTITION BY page ORDER BY line_no DESC) AS down FROM u WHERE NOT regexp_full_match(line, '\\s*')),
z AS (SELECT u.*, coalesce(f.up <= 3 OR f.down <= 3, false) AS zone FROM u LEFT JOIN f USING (document, page, line_no)),
""" + f"""
k AS (SELECT *, regexp_replace(lower({_COLLAPSE('line')}), '\\b\\d+\\b', '#', 'g') AS key, regexp_matches({_STRIP('line')}, '(?i){R.PROTECTED}') AS kept FROM z),
n AS (SELECT document, count(DISTINCT page) AS pages FROM k GROUP BY ALL),
rec AS (SELECT document, key, count(DISTINCT page) AS n_pages FROM k WHERE zone AND NOT kept AND length({_STRIP('line')}) <= 140 GROUP BY ALL),
"""


def _rec(ratio: float) -> str:
    return f"rr AS (SELECT document, key, n_pages FROM rec JOIN n USING (document) WHERE pages >= 4 AND n_pages >= greatest(3, round_even(pages * {ratio}::DOUBLE, 0)))"


@_registered(f"WITH {_LINES} {_rec(0.04)} SELECT document, key, n_pages FROM rr")
def recurring_lines(spark, sf_dir):
    return cleaning.recurring_lines(cleaning.page_lines(_documents(spark, sf_dir)), 0.04)


_REASON = f"""CASE WHEN zone AND regexp_matches(t, '(?i){R.PAGE_NUMBER}') THEN 'page_number'
 WHEN zone AND recurs AND NOT regexp_matches(t, '(?i){R.PROTECTED}') THEN 'recurring_header_or_footer'
 WHEN regexp_matches(t, '(?i){R.TOC_LEADER}') THEN 'table_of_contents_leader'
 WHEN regexp_matches(t, '(?i){R.BIBLIOGRAPHY}') AND regexp_matches(t, '{R.BIBLIOGRAPHY_PROOF}') THEN 'bibliography_citation_reference'
 WHEN lower(t) IN ({", ".join(f"'{x}'" for x in R.NAVIGATION)}) THEN 'navigation' END"""


@_registered(f"""WITH {_LINES} {_rec(0.04)},
c AS (SELECT k.*, rr.key IS NOT NULL AS recurs, regexp_replace({_STRIP('line')}, '[ \\t]+', ' ', 'g') AS t FROM k LEFT JOIN rr USING (document, key)),
r AS (SELECT *, {_REASON} AS reason FROM c)
SELECT document, page, line_no, reason, t AS text FROM r WHERE reason IS NOT NULL AND t <> ''""")
def removal_audit(spark, sf_dir):
    lined = cleaning.page_lines(_documents(spark, sf_dir))
    marked = cleaning.classified(lined, cleaning.recurring_lines(lined, 0.04))
    return cleaning.removal_audit(marked).withColumn("line_no", F.col("line_no").cast("long"))


@_registered()
def cleaned_pages(spark, sf_dir):
    lined = cleaning.page_lines(_documents(spark, sf_dir))
    return cleaning.cleaned_pages(cleaning.classified(lined, cleaning.recurring_lines(lined, 0.04)))


_HEAD = f"""CASE WHEN t = '' OR length(t) > 120 OR regexp_matches(t, '(?i){R.TOC_LEADER}') OR regexp_matches(t, '^[•\\-–—]')
  OR (regexp_matches(t, '[.;!?]$') AND len(string_split(t, ' ')) > 6) OR len(string_split(t, ' ')) > 12 THEN false
 ELSE regexp_matches(t, '(?i){R.NUMBERED_HEADING}') OR regexp_matches(t, '(?i){R.NAMED_HEADING}') OR (upper(t) = t AND lower(t) <> t AND length(t) BETWEEN 4 AND 80)
  OR (regexp_matches(t, '^\\p{{Lu}}') AND len(string_split(t, ' ')) <= 10 AND regexp_matches(t, '(?i){R.TOPIC_HEADING}')) END"""


@_registered(f"WITH {_LINES} h AS (SELECT page, {_COLLAPSE('line')} AS t FROM z) SELECT page AS doc_id, count(*) AS n_lines, count(*) FILTER ({_HEAD}) AS n_headings FROM h GROUP BY ALL")
def heading_counts(spark, sf_dir):
    lined = cleaning.page_lines(_documents(spark, sf_dir))
    return lined.groupBy(F.col("page").alias("doc_id")).agg(F.count("*").alias("n_lines"), F.count_if(cleaning.is_heading(F.col("line"))).alias("n_headings"))


@_registered(f"""WITH s AS (SELECT doc_id, list_filter(string_split(regexp_replace({_STRIP("coalesce(text, '')")}, '([.!?])\\s+', concat('\\1', chr(1)), 'g'), chr(1)), lambda x: {_STRIP('x')} <> '') AS s FROM documents)
SELECT doc_id, len(s) AS n_sentences, coalesce(list_max(list_transform(s, lambda x: length({_STRIP('x')}))), 0) AS longest FROM s""")
def sentence_counts(spark, sf_dir):
    rows = _documents(spark, sf_dir).select("doc_id", T.sentences(F.coalesce("text", F.lit(""))).alias("s"))
    longest = F.coalesce(F.array_max(F.transform("s", F.length)), F.lit(0))
    return rows.select("doc_id", F.size("s").cast("long").alias("n_sentences"), longest.cast("long").alias("longest"))


@_registered(f"""SELECT doc_id, length(t) < 100 OR regexp_matches(t, '(?i){"|".join(R.ADMINISTRATIVE)}') OR length(regexp_replace(t, '[^\\p{{L}}]', '', 'g')) / greatest(length(t), 1) < 0.4 AS administrative
FROM (SELECT doc_id, {_STRIP("coalesce(text, '')")} AS t FROM documents)""")
def administrative_flags(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", cleaning.is_administrative(F.coalesce("text", F.lit(""))).alias("administrative"))


@_registered()
def section_chunks(spark, sf_dir):
    rows = _documents(spark, sf_dir).withColumn("document", F.concat_ws("-", "source", "doc_id"))
    return chunking.chunk(cleaning.page_lines(rows, "document"))


@_registered(f"""WITH k AS (SELECT doc_id, source, lower(upper({_COLLAPSE("coalesce(text, '')")})) AS key FROM documents)
SELECT doc_id, source FROM k QUALIFY row_number() OVER (PARTITION BY source, key ORDER BY doc_id) = 1""")
def dedup_by_source(spark, sf_dir):
    key = F.sha2(T.folded(F.coalesce("text", F.lit(""))), 256)
    return _documents(spark, sf_dir).groupBy("source", key.alias("key")).agg(F.min("doc_id").alias("doc_id")).select("doc_id", "source")


@_registered("""WITH b AS (SELECT source, doc_id // 1024 AS block, sha1(string_agg(doc_id::VARCHAR, '|' ORDER BY doc_id)) AS h FROM documents GROUP BY ALL)
SELECT source, substr(sha1(string_agg(h, '|' ORDER BY block)), 1, 10) AS fingerprint FROM b GROUP BY ALL""")
def corpus_fingerprint(spark, sf_dir):
    """Hash of hashes: ids in order within blocks of 1024, then the blocks in order, so no task gathers all ids."""
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["v"]), "|")
    ids = F.struct(F.col("doc_id").alias("k"), F.col("doc_id").cast("string").alias("v"))
    blocks = _documents(spark, sf_dir).groupBy("source", F.floor(F.col("doc_id") / 1024).alias("block")).agg(F.sha1(joined(ids)).alias("v"))
    return blocks.groupBy("source").agg(F.substring(F.sha1(joined(F.struct(F.col("block").alias("k"), "v"))), 1, 10).alias("fingerprint"))


@_registered("""SELECT 'blank_text' AS rule, count(*) AS n FROM documents WHERE regexp_full_match(coalesce(text, ''), '\\s*')
UNION ALL SELECT 'repeated_id', count(*) FROM (SELECT doc_id FROM documents GROUP BY doc_id HAVING count(*) > 1)
UNION ALL SELECT 'missing_key', count(*) FROM documents WHERE doc_id IS NULL OR source IS NULL OR lang IS NULL
UNION ALL SELECT 'wrong_length', count(*) FROM documents WHERE n_chars <> length(text)""")
def corpus_violations(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    once = docs.agg(
        F.count_if(T.stripped(F.coalesce("text", F.lit(""))) == "").alias("blank_text"),
        F.count_if(F.col("doc_id").isNull() | F.col("source").isNull() | F.col("lang").isNull()).alias("missing_key"),
        F.count_if(F.col("n_chars") != F.length("text")).alias("wrong_length"),
    ).unpivot([], ["blank_text", "missing_key", "wrong_length"], "rule", "n")
    repeated = docs.groupBy("doc_id").count().where("count > 1").agg(F.count("*").alias("n")).select(F.lit("repeated_id").alias("rule"), "n")
    return once.unionByName(repeated)


# --- dialogue -------------------------------------------------------------------------------------


@_registered("""SELECT conv_id, turn, role, len(h) AS n_history, array_to_string(h, '|') AS roles FROM (
SELECT conv_id, turn, role, coalesce(list(role || turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING), []) AS h FROM conversations)""")
def history_window(spark, sf_dir):
    rows = dialogue.history(table(spark, sf_dir, "conversations"))
    roles = F.array_join(F.transform("history", lambda m: F.concat(m["role"], m["seq"].cast("string"))), "|")
    return rows.select("conv_id", "turn", "role", F.size("history").cast("long").alias("n_history"), roles.alias("roles"))


@_registered("""SELECT conv_id, turn, last_value(CASE WHEN role = 'user' AND trim(text) <> '' THEN text END IGNORE NULLS)
OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM conversations""")
def last_user_turn(spark, sf_dir):
    return dialogue.last_user_turn(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "previous")


@_registered(f"""SELECT conv_id, turn, CASE WHEN turn = first THEN true WHEN {_has('text', R.NEW_TOPICS)} THEN true WHEN {_any('text', R.FOLLOW_UP_EN)} THEN false
ELSE {_has('text', R.SUBJECTS)} AND len(string_split_regex({_STRIP('text')}, '\\s+')) >= 4 END AS shifts
FROM (SELECT *, min(turn) OVER (PARTITION BY conv_id) AS first FROM conversations WHERE role = 'user')""")
def topic_shifts(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where("role = 'user'")
    rows = rows.withColumn("first", F.min("turn").over(Window.partitionBy("conv_id")))
    return rows.select("conv_id", "turn", dialogue.topic_shift(F.col("text"), F.col("turn") != F.col("first")).alias("shifts"))


_INSIDE = lambda words: f"(^|[^\\p{{L}}\\p{{N}}_])({words})([^\\p{{L}}\\p{{N}}_]|$)"
_REWRITTEN = f"""h AS (SELECT conv_id, turn, role, {_STRIP("text")} AS q,
coalesce(list({{'role': role, 'content': text}}) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING), []) AS m FROM conversations),
u AS (SELECT *, CASE WHEN len(list_filter(m, lambda x: x.role = 'user')) > 0 THEN list_filter(m, lambda x: x.role = 'user') ELSE m END AS pool FROM h WHERE role = 'user'),
s AS (SELECT *, list_reverse(list_filter(list_transform(pool, lambda x: {_STRIP(f"regexp_replace(x.content, '(?i){R.LEADING_WORDS}', '')")}), lambda x: length(x) > 3))[1] AS subject FROM u),
rw AS (SELECT *, CASE WHEN subject IS NOT NULL AND (len(string_split_regex(q, '\\s+')) <= 4 OR regexp_matches(lower(q), '{_INSIDE("it|that|this|these|those|they|second one")}')) THEN
  CASE WHEN regexp_matches(lower(q), '^(what|how)\\s+about\\b') THEN subject || ' - ' || regexp_replace(regexp_replace(q, '(?i)^(what|how)\\s+about\\s*', ''), '^[? ]+|[? ]+$', '', 'g')
  WHEN regexp_matches(lower(q), '{_INSIDE("it|that")}') THEN array_to_string(list_transform(regexp_extract_all(q, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+'), lambda w: CASE WHEN lower(w) IN ('it', 'that') THEN subject ELSE w END), '')
  ELSE subject || ' ' || q END ELSE q END AS query FROM s)"""


@_registered(f"WITH {_REWRITTEN} SELECT conv_id, turn, query FROM rw")
def followup_rewrites(spark, sf_dir):
    rows = dialogue.history(table(spark, sf_dir, "conversations")).where("role = 'user'")
    return rows.select("conv_id", "turn", dialogue.rewritten(F.col("text"), F.col("history")).alias("query"))


_TYPO = f"CASE lower(w) {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in R.TYPOS.items())} ELSE w END"
_FORM = f"CASE w {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in R.ACRONYMS.items())} END"


@_registered(f"""WITH y AS (SELECT conv_id, turn, array_to_string(list_transform(string_split_regex(coalesce(text, ''), '\\s+'), lambda w: {_TYPO}), ' ') AS fixed FROM conversations WHERE role = 'user'),
f AS (SELECT *, list_filter(list_transform({_tok('fixed')}, lambda w: {_FORM}), lambda x: x IS NOT NULL) AS forms FROM y),
e AS (SELECT conv_id, turn, CASE WHEN len(forms) > 0 THEN fixed || ' ' || array_to_string(forms, ' ') ELSE fixed END AS text FROM f),
{_sub_questions('e')} SELECT conv_id, turn, unnest(range(len(questions))) AS question, unnest(questions) AS query FROM sq""")
def sub_questions(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where("role = 'user'")
    asked = dialogue.sub_questions(dialogue.expanded(dialogue.spelled(F.coalesce("text", F.lit("")))))
    return rows.select("conv_id", "turn", F.posexplode(asked).alias("question", "query"))


@_registered()
def listed_questions(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where("role = 'user'")
    return rows.select("conv_id", "turn", F.posexplode(dialogue.listed_questions(F.col("text"))).alias("question", "query"))


_TOPIC = f"CASE WHEN {_has('last', R.CHILD_WORDS)} THEN '{R.CHILD_TOPIC}' ELSE '{R.TOPIC}' END"
_FOLLOWS = " ".join("WHEN {} THEN concat('{}', topic, '{}')".format(_has("q", words), *form.split("{}")) for words, form in R.FOLLOW_UP_QUESTIONS)


@_registered(f"""WITH {_REWRITTEN}, l AS (SELECT *, list_reverse(list_filter(m, lambda x: x.role = 'user' AND coalesce(x.content, '') <> ''))[1].content AS last FROM rw),
t AS (SELECT *, {_TOPIC} AS topic, regexp_matches(lower(q), '{"|".join(R.FOLLOW_UP_FORMS)}')
  OR (len(string_split_regex(q, '\\s+')) <= 5 AND NOT {_has('q', ["asthma", "what", "how", "why"])}) AS follows FROM l)
SELECT conv_id, turn, CASE WHEN q = '' THEN '' WHEN len(m) > 0 AND query <> q THEN query WHEN len(m) > 0 AND last IS NOT NULL AND follows THEN CASE {_FOLLOWS} ELSE concat(q, ' regarding ', topic) END
ELSE CASE lower(q) {" ".join(f"WHEN '{a}' THEN '{b}'" for a, b in R.TERSE.items())} ELSE q END END AS query FROM t""")
def canonical_queries(spark, sf_dir):
    rows = dialogue.history(table(spark, sf_dir, "conversations")).where("role = 'user'")
    return rows.select("conv_id", "turn", dialogue.canonical(F.col("text"), F.col("history")).alias("query"))


@_registered("""SELECT conv_id, count(*) AS n_messages, count(*) FILTER (role = 'user') AS n_user, substr(arg_min(text, turn) FILTER (role = 'user'), 1, 26) AS title FROM conversations GROUP BY ALL""")
def session_overview(spark, sf_dir):
    return sessions.overview(table(spark, sf_dir, "conversations"))


def _quoted(text: str) -> str:
    return text.replace("'", "''")


def _narratives(column: str) -> str:
    """Nested replacements of the narratives, each where its needle stands in q."""
    for needle, pattern, form in R.NARRATIVES_EN:
        column = f"CASE WHEN contains(lower(q), '{_quoted(needle)}') THEN regexp_replace({column}, '(?i){_quoted(pattern)}', '{form}', 'g') ELSE {column} END"
    return column


_SHIFT = f"""CASE WHEN q = '' OR len(m) = 0 OR {_has('q', R.NEW_TOPICS)} THEN true WHEN {_any('q', R.FOLLOW_UP_EN)} THEN false
ELSE {_has('q', R.SUBJECTS)} AND len(string_split_regex(q, '\\s+')) >= 4 END"""
_WHOLE = " ".join(f"WHEN '{_quoted(word)}' THEN '{form}'" for words, form in R.WHOLE_EN for word in words)


@_registered(f"""WITH {_REWRITTEN}, z AS (SELECT *, {_SHIFT} AS topic_shift, {_narratives('q')} AS told FROM rw)
SELECT conv_id, turn, 'en' AS language, topic_shift, CASE WHEN topic_shift THEN CASE lower(told) {_WHOLE} ELSE told END ELSE query END AS question FROM z""")
def processed_queries(spark, sf_dir):
    """The messages are English, so the SQL knows no other language."""
    rows = dialogue.history(table(spark, sf_dir, "conversations")).where("role = 'user'").withColumnRenamed("text", "query")
    return questions.processed(rows).select("conv_id", "turn", "language", "topic_shift", "question")


@_registered(f"""WITH w AS (SELECT DISTINCT unnest({_tok('text')}) AS word FROM benchmark)
SELECT conv_id, turn, count(word) AS n_terms, md5(coalesce(string_agg(word, ' ' ORDER BY word), '')) AS terms_md5
FROM conversations LEFT JOIN w ON length(word) >= 3 AND contains(lower(text), word) WHERE role = 'user' GROUP BY ALL""")
def term_mentions(spark, sf_dir):
    """Which words of the benchmark's texts stand anywhere in a user's message."""
    said = table(spark, sf_dir, "conversations").where("role = 'user'").withColumn("query_id", F.struct("conv_id", "turn"))
    words = _items(spark, sf_dir).select(F.explode(T.tokens(F.col("query"))).alias("term_ar")).distinct().withColumn("term_en", F.col("term_ar"))
    found = terminology.mentioned_terms(said.withColumnRenamed("text", "query"), words).groupBy("query_id").agg(F.array_sort(F.collect_list("term_ar")).alias("terms"))
    terms = F.coalesce("terms", F.array().cast("array<string>"))
    return said.join(found, "query_id", "left").select("conv_id", "turn", F.size(terms).cast("long").alias("n_terms"), F.md5(F.array_join(terms, " ")).alias("terms_md5"))


@_registered("""WITH h AS (SELECT conv_id, turn, role, text,
coalesce(list({'role': role, 'content': text}) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), []) AS m FROM conversations)
SELECT conv_id, turn, sha256(CASE WHEN len(m) > 0 THEN 'RECENT CONVERSATION HISTORY:' || chr(10) ||
  array_to_string(list_transform(m, lambda x: CASE x.role WHEN 'user' THEN 'User: ' ELSE 'Assistant: ' END || trim(coalesce(x.content, ''))), chr(10)) || chr(10) || chr(10) ELSE '' END
  || 'EVIDENCE CHUNKS:' || chr(10) || conv_id || chr(10) || chr(10) || 'CLINICAL QUESTION:' || chr(10) || coalesce(text, '') || chr(10) || chr(10)
  || 'Answer using ONLY the evidence above. Follow the JSON structure exactly.') AS prompt_sha256 FROM h WHERE role = 'user'""")
def prompts(spark, sf_dir):
    """A message's whole prompt, with the conversation's id in the place of evidence."""
    rows = dialogue.history(table(spark, sf_dir, "conversations")).where("role = 'user'")
    text = questions.prompt(F.coalesce("text", F.lit("")), F.col("conv_id").cast("string"), F.col("history"))
    return rows.select("conv_id", "turn", F.sha2(text, 256).alias("prompt_sha256"))


@_registered()
def corpus_build(spark, sf_dir):
    """Chunks of every document as one corpus, without copies."""
    rows = _documents(spark, sf_dir).withColumn("document", F.concat_ws("-", "source", "doc_id"))
    return corpus.build(rows).select("document", "chunk_id", "section", "page_start", "page_end", "token_count")


@_registered()
def conversation_answers(spark, sf_dir):
    """What every question of every user message is answered."""
    found = conversations.ask(table(spark, sf_dir, "conversations"), _documents(spark, sf_dir))
    return found.select("conv_id", "turn", "part", "topic_shift", "question", "status", "n_evidence", "n_verified")


# --- gates ----------------------------------------------------------------------------------------

_GATE = f"""CASE WHEN {_any('text', R.EMERGENCY)} OR {_any('text', R.RED_FLAGS)} THEN 'EMERGENCY' WHEN {_any('text', R.INJECTION)} THEN 'INJECTION'
WHEN text <> '' AND ({_any('text', R.OFF_TOPIC)} OR NOT {_has('text', R.TOPIC_TERMS)}) THEN 'OUT_OF_SCOPE' WHEN {_any('text', R.PATIENT_SCENARIO)} THEN 'PATIENT_SCENARIO' ELSE 'NONE' END"""
_AMBIGUITY = f"""CASE WHEN {_STRIP('text')} = '' THEN 'empty' WHEN {_any(_STRIP('text'), R.VAGUE)} THEN 'vague'
WHEN {_prefix('text', R.POPULATION_DEPENDENT)} AND NOT {_prefix('text', R.POPULATION_CONTEXT)} THEN 'population'
WHEN len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+')) <= 2 AND NOT {_prefix('text', R.SHORT_QUERY_TOPICS)} THEN 'short' END"""


def _texts(spark, sf_dir):
    """All texts that can be asked: items, user messages and documents, as (kind, id, text)."""
    items = table(spark, sf_dir, "benchmark").select(F.lit("item").alias("kind"), F.col("item_id").alias("id"), "text")
    said = table(spark, sf_dir, "conversations").select(F.lit("turn").alias("kind"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    docs = _documents(spark, sf_dir).select(F.lit("doc").alias("kind"), F.col("doc_id").alias("id"), "text")
    return items.unionByName(said).unionByName(docs).withColumn("text", F.coalesce("text", F.lit("")))


_TEXTS = "x AS (SELECT kind, id, coalesce(text, '') AS text FROM (SELECT 'item' AS kind, item_id AS id, text FROM benchmark UNION ALL SELECT 'turn', conv_id * 1000 + turn, text FROM conversations UNION ALL SELECT 'doc', doc_id, text FROM documents))"


@_registered(f"""WITH {_TEXTS}, g AS (SELECT *, {_GATE} AS category, {_AMBIGUITY} AS ambiguity FROM x)
SELECT kind, id, category, ambiguity, CASE WHEN category <> 'NONE' THEN 'BLOCKED' WHEN ambiguity IS NOT NULL THEN 'CLARIFY' ELSE 'PROCEED' END AS route FROM g""")
def gate_and_route(spark, sf_dir):
    q = F.col("text")
    rows = _texts(spark, sf_dir).select("kind", "id", gates.gate(q)["category"].alias("category"), gates.ambiguity(q).alias("ambiguity"))
    route = F.when(F.col("category") != "NONE", "BLOCKED").when(F.col("ambiguity").isNotNull(), "CLARIFY").otherwise("PROCEED")
    return rows.withColumn("route", route)


_KEYWORD = f"""CASE WHEN {_has('text', R.OUT_OF_SCOPE_WORDS)} THEN 'OUT_OF_SCOPE' {" ".join(f"WHEN {_has('text', w)} THEN '{n}'" for n, w in R.KEYWORD_INTENTS.items())} ELSE 'GENERAL' END"""


@_registered(f"""WITH {_TEXTS} SELECT kind, id, {_KEYWORD} AS keyword_intent,
CASE WHEN contains(lower(text), 'bronchiolitis') THEN 'BRONCHIOLITIS' WHEN contains(lower(text), 'asthma') THEN 'ASTHMA' ELSE 'OTHER' END AS condition,
CASE {" ".join(f"WHEN {_any('text', p)} THEN '{n}'" for n, p in R.VIDEOS.items())} END AS video,
CASE WHEN regexp_matches(text, '[؀-ۿ]') THEN 'ar' ELSE 'en' END AS language FROM x""")
def query_classes(spark, sf_dir):
    q = F.col("text")
    return _texts(spark, sf_dir).select(
        "kind", "id", gates.keyword_intent(q).alias("keyword_intent"), gates.condition(q).alias("condition"), gates.video(q).alias("video"), T.language(q).alias("language")
    )


_Q = _STRIP("text")
_TIER = f"""CASE WHEN {_Q} = '' THEN 'OUT_OF_SCOPE' WHEN {_any('text', R.EMERGENCY)} OR {_any('text', R.RED_FLAGS)} THEN 'EMERGENCY'
WHEN {_any('text', R.INJECTION)} OR {_any('text', R.OFF_TOPIC)} OR NOT {_has('text', R.TOPIC_TERMS)} THEN 'OUT_OF_SCOPE' ELSE 'CLINICAL' END"""
_INTENT = f"""CASE WHEN {_any(_Q, R.OVERRIDE)} THEN 'prompt_injection' WHEN tier = 'EMERGENCY' THEN 'emergency' WHEN tier = 'OUT_OF_SCOPE' THEN 'out_of_scope'
WHEN {_any(_Q, R.PERSONAL_DOSING)} THEN 'personal_dosing_decision'
WHEN {_any(_Q, R.AMBIGUOUS)} OR (len(string_split_regex({_Q}, '\\s+')) <= 3 AND lower({_Q}) IN ({", ".join(f"'{w}'" for w in R.AMBIGUOUS_WORDS)})) THEN 'ambiguous'
WHEN {_any(_Q, R.EDUCATIONAL)} THEN 'general_educational' WHEN {_any(_Q, R.MEDICATION)} THEN 'medication_or_dose_request'
WHEN {_any(_Q, R.DIAGNOSIS)} THEN 'diagnosis_or_symptoms' WHEN {_any(_Q, R.PATIENT_SPECIFIC)} THEN 'patient_specific' ELSE 'general_educational' END"""
# RE2's \b knows ASCII only: other letters become z, which no pattern of an age looks for
_AGE = lambda packs: " ".join(f"WHEN regexp_matches(regexp_replace(lower(text), '[^\\x00-\\x7F\\P{{L}}]', 'z', 'g'), '{p}') THEN '{n}'" for n, p in packs.items())
_BANDS = " ".join(f"WHEN {_any('text', R.CONCEPTS[band])} THEN '{band}'" for band in ("adults_adolescents", "children_6_11", "under_6"))


@_registered(f"""WITH {_TEXTS}, t AS (SELECT *, {_TIER} AS tier FROM x),
i AS (SELECT *, {_INTENT} AS intent, CASE {_AGE(R.CLASSIFIER_AGES)} ELSE 'all_ages' END AS classifier_age, CASE {_BANDS} {_AGE(R.QUERY_AGES)} END AS implied_age FROM t)
SELECT kind, id, intent, classifier_age, implied_age, CASE WHEN intent IN ('medication_or_dose_request', 'diagnosis_or_symptoms', 'patient_specific') THEN
  2 + (classifier_age = 'all_ages')::INT + (intent <> 'patient_specific' AND NOT {_any('text', [r"\bdiagnosed\b", r"\bknown\s+asthma\b"])})::INT + (intent = 'medication_or_dose_request')::INT
  ELSE 0 END AS n_questions FROM i""")
def intents(spark, sf_dir):
    q = F.col("text")
    return gates.with_rules(_texts(spark, sf_dir), "text").select(
        "kind", "id", "intent", gates.classifier_age(q).alias("classifier_age"), gates.implied_age(q).alias("implied_age"),
        F.size(gates.questions(q, F.col("intent"))).alias("n_questions"),
    )


# --- grounding and evaluation ---------------------------------------------------------------------


def _content(column: str) -> str:
    stop = ", ".join(f"'{w}'" for w in R.STOPWORDS_EN + R.STOPWORDS_AR)
    return f"list_filter(list_distinct(regexp_extract_all(lower({column}), '[A-Za-z؀-ۿ]+')), lambda w: length(w) > 1 AND NOT list_contains([{stop}], w))"


@_registered(f"""WITH {_BM25}, h AS (SELECT query_id, doc_id, {_content('b.text')} AS w, {_content('d.text')} AS dw FROM bm JOIN benchmark b ON b.item_id = query_id JOIN documents d USING (doc_id) WHERE rank <= 5)
SELECT query_id, doc_id, len(w) > 0 AND len(list_intersect(w, dw)) / len(w) >= 0.25 AND len(list_intersect(w, dw)) >= 1 AS supported,
round(CASE WHEN len(w) > 0 THEN len(list_intersect(w, dw)) / len(w) ELSE 0 END, 6) AS ratio, len(list_intersect(w, dw)) AS n_matched FROM h""")
def claim_support(spark, sf_dir):
    docs, items = _documents(spark, sf_dir), _items(spark, sf_dir)
    hits = retrieval.bm25(docs, items).join(docs.select("doc_id", "text"), "doc_id").join(items, "query_id")
    s = grounding.claim_support(F.col("query"), F.col("text"))
    return hits.select("query_id", "doc_id", s.alias("s")).select("query_id", "doc_id", "s.supported", "s.ratio", F.size("s.matched").cast("long").alias("n_matched"))


@_registered(f"""WITH {_BM25}, h AS (SELECT {_content('b.text')} AS w, {_content('d.text')} AS dw FROM bm JOIN benchmark b ON b.item_id = query_id JOIN documents d USING (doc_id) WHERE rank <= 5),
s AS (SELECT len(w) > 0 AND len(list_intersect(w, dw)) / len(w) >= 0.25 AND len(list_intersect(w, dw)) >= 1 AS supported FROM h)
SELECT count(*) AS n_claims, round(coalesce(count(*) FILTER (NOT supported) / nullif(count(*), 0), 0), 6) AS unsupported_rate FROM s""")
def unsupported_claims(spark, sf_dir):
    docs, items = _documents(spark, sf_dir), _items(spark, sf_dir)
    hits = retrieval.bm25(docs, items).join(docs.select("doc_id", "text"), "doc_id").join(items, "query_id")
    return evaluation.unsupported_rate(hits.select(grounding.claim_support(F.col("query"), F.col("text"))["supported"].alias("supported")))


@_registered(f"""WITH {_BM25}, h AS (SELECT query_id, doc_id, rank, {_content('b.text')} AS w, {_content('d.text')} AS dw FROM bm JOIN benchmark b ON b.item_id = query_id JOIN documents d USING (doc_id) WHERE rank <= 5)
SELECT query_id, doc_id, rank FROM h WHERE len(w) > 0 AND len(list_intersect(w, dw)) / len(w) >= 0.25 AND len(list_intersect(w, dw)) >= 1""")
def cited_evidence(spark, sf_dir):
    docs, items = _documents(spark, sf_dir), _items(spark, sf_dir)
    hits = retrieval.bm25(docs, items).join(docs.select("doc_id", "text"), "doc_id")
    claims = hits.select("query_id", "doc_id").join(items, "query_id").withColumnRenamed("query", "claim")
    return grounding.cited(hits, grounding.verified_citations(claims, hits)).select("query_id", "doc_id", "rank")


@_registered(f"""WITH {_BM25}, t AS (SELECT query_id, max(score) AS top, count(*) AS n FROM hr WHERE rank <= 5 GROUP BY ALL)
SELECT query_id, round(top, 6) AS top, CASE WHEN top > 0.8 THEN 'High' WHEN top >= 0.6 THEN 'Moderate' ELSE 'Low / Not Grounded' END AS confidence,
CASE WHEN {_any('b.text', R.PATIENT_SCENARIO)} THEN 'patient_specific' WHEN top < 0.55 THEN 'weak_evidence' WHEN top < 0.6 THEN 'low_confidence' END AS refusal
FROM t JOIN benchmark b ON b.item_id = query_id""")
def confidence_and_refusal(spark, sf_dir):
    items = _items(spark, sf_dir)
    hits = retrieval.search(_documents(spark, sf_dir), items, "hybrid_rerank", expand=False)
    top = hits.groupBy("query_id").agg(F.max("score").alias("top"), F.count("*").alias("n")).join(items, "query_id")
    return top.select("query_id", "top", grounding.confidence(F.col("top")).alias("confidence"), grounding.refused(F.col("query"), F.col("top"), F.col("n")).alias("refusal"))


@_registered(f"""WITH {_BM25}, h AS (SELECT *, first_value(score) OVER (PARTITION BY query_id ORDER BY rank) AS best FROM hr WHERE rank <= 5)
SELECT query_id, doc_id, score, rank FROM h JOIN benchmark b ON b.item_id = query_id JOIN documents d USING (doc_id) WHERE score >= 0.32 AND round(best - score, 9) <= 0.18
AND NOT (contains(lower(b.text), 'symptom') AND contains(lower(d.text), 'bronchiolitis') AND NOT contains(lower(b.text), 'bronchiolitis'))""")
def evidence_block(spark, sf_dir):
    docs, items = _documents(spark, sf_dir), _items(spark, sf_dir)
    hits = retrieval.search(docs, items, "hybrid_rerank", expand=False).join(docs.select("doc_id", "text"), "doc_id").join(items, "query_id")
    return grounding.evidence(hits).select("query_id", "doc_id", "score", "rank")


@_registered(f"""WITH {_BM25}, h AS (SELECT query_id, rank, coalesce(quality = 1, false) AS relevant FROM bm LEFT JOIN labels USING (doc_id) WHERE rank <= 5),
p AS (SELECT query_id, count(*) FILTER (relevant) AS n, min(rank) FILTER (relevant) AS first FROM h GROUP BY ALL)
SELECT item_id AS query_id, round(coalesce(n / 5, 0), 6) AS precision, round(coalesce(1 / first, 0), 6) AS reciprocal_rank FROM benchmark LEFT JOIN p ON query_id = item_id""")
def precision_and_mrr(spark, sf_dir):
    items = _items(spark, sf_dir)
    good = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("good"))
    hits = retrieval.bm25(_documents(spark, sf_dir), items).join(good, "doc_id", "left").withColumn("relevant", F.coalesce("good", F.lit(False)))
    return evaluation.precision_and_mrr(items, hits, 5)


@_registered("""SELECT round(coalesce(count(*) FILTER (quality = 0 AND toxic = 1) / nullif(count(*) FILTER (toxic = 1), 0), 1), 6) AS correct_refusal,
round(coalesce(count(*) FILTER (quality = 0 AND toxic <> 1) / nullif(count(*) FILTER (toxic <> 1), 0), 0), 6) AS false_refusal,
round(coalesce(count(*) FILTER (quality <> 0 AND toxic = 1 AND doc_id % 2 = 0) / nullif(count(*) FILTER (toxic = 1 AND doc_id % 2 = 0), 0), 0), 6) AS injection_success FROM labels""")
def refusal_rates(spark, sf_dir):
    cases = table(spark, sf_dir, "labels").select(
        (F.col("toxic") == 1).alias("should_refuse"), (F.col("quality") == 0).alias("was_refused"), ((F.col("toxic") == 1) & (F.col("doc_id") % 2 == 0)).alias("is_injection")
    )
    return evaluation.refusal_rates(cases)


@_registered(f"""WITH {_BM25}, h AS (SELECT query_id, doc_id, rank, list_distinct({_tok('text')}) AS t FROM bm JOIN documents USING (doc_id) WHERE rank <= 5)
SELECT a.query_id, a.rank AS rank, b.rank AS other, round(CASE WHEN len(a.t) = 0 OR len(b.t) = 0 THEN 0 ELSE len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))) END, 6) AS similarity
FROM h a JOIN h b ON a.query_id = b.query_id AND a.rank > b.rank""")
def result_similarity(spark, sf_dir):
    """Jaccard of the hits of one query with each other: at most ten pairs a query."""
    docs = _documents(spark, sf_dir)
    hits = retrieval.bm25(docs, _items(spark, sf_dir)).join(docs.select("doc_id", F.array_distinct(T.tokens(F.col("text"))).alias("t")), "doc_id")
    per = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "t"))).alias("h"))
    a = per.select("query_id", "h", F.explode("h").alias("a"))
    pairs = a.select("query_id", "a", F.explode(F.filter("h", lambda x: x["rank"] < F.col("a.rank"))).alias("b"))
    return pairs.select("query_id", F.col("a.rank").alias("rank"), F.col("b.rank").alias("other"), F.round(evaluation.jaccard(F.col("a.t"), F.col("b.t")), 6).alias("similarity"))


@_registered(f"""WITH {_BM25}, q AS (SELECT item_id AS query_id, list_sort({_content('text')})[1:3] AS kw FROM benchmark),
h AS (SELECT query_id, rank, len(list_filter(kw, lambda w: contains(lower(text), w))) AS m, len(kw) AS n FROM q JOIN bm USING (query_id) JOIN documents USING (doc_id) WHERE rank <= 5),
c AS (SELECT query_id, count(*) AS hits, bool_or(m >= greatest(1, least(2, n))) AS good, bool_or(m > 0) AS seen FROM h GROUP BY ALL)
SELECT CASE WHEN hits IS NULL THEN 'EMBEDDING_FAILURE' WHEN good THEN 'NONE' WHEN NOT seen THEN 'VOCABULARY_MISMATCH' ELSE 'BAD_CHUNK_BOUNDARY' END AS failure, count(*) AS n FROM q LEFT JOIN c USING (query_id) GROUP BY ALL""")
def failure_classes(spark, sf_dir):
    docs, items = _documents(spark, sf_dir), _items(spark, sf_dir)
    cases = items.select("query_id", F.slice(F.array_sort(T.content_words(F.col("query"))), 1, 3).alias("kw"))
    hits = retrieval.bm25(docs, items).join(docs.select("doc_id", "text"), "doc_id").join(cases, "query_id")
    one = F.size(F.filter("kw", lambda k: F.contains(F.lower("text"), k))) > 0
    per = hits.groupBy("query_id").agg(F.count("*").alias("hits"), F.bool_or(evaluation.relevant(F.col("kw"), F.col("text"))).alias("good"), F.bool_or(one).alias("seen"))
    failure = F.when(F.col("hits").isNull(), "EMBEDDING_FAILURE").when(F.col("good"), "NONE").when(~F.col("seen"), "VOCABULARY_MISMATCH").otherwise("BAD_CHUNK_BOUNDARY")
    return cases.join(per, "query_id", "left").groupBy(failure.alias("failure")).agg(F.count("*").alias("n"))


@_registered(f"""WITH {_BM25}, h AS (SELECT 'bm25' AS configuration, 0 AS pos, query_id, doc_id FROM bm WHERE rank <= 5 UNION ALL SELECT 'dense', 1, query_id, doc_id FROM co WHERE rank <= 5
UNION ALL SELECT 'hybrid', 2, query_id, doc_id FROM fr WHERE rank <= 5 UNION ALL SELECT 'hybrid_rerank', 3, query_id, doc_id FROM hr WHERE rank <= 5),
p AS (SELECT configuration, pos, count(*) FILTER (quality = 1) / (5.0 * (SELECT count(*) FROM benchmark)) AS precision FROM h LEFT JOIN labels USING (doc_id) GROUP BY ALL)
SELECT configuration, round(precision, 6) AS precision, round(precision - first_value(precision) OVER (ORDER BY pos), 6) AS delta FROM p""")
def strategy_deltas(spark, sf_dir):
    docs, items = _documents(spark, sf_dir), _items(spark, sf_dir)
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id").distinct().withColumn("good", F.lit(1))
    names = ("bm25", "dense", "hybrid", "hybrid_rerank")
    runs = grid.hits(grid.legs(docs, items), docs, items, names, 5)
    runs = runs.select(F.col("strategy").alias("configuration"), (F.array_position(F.array(*map(F.lit, names)), F.col("strategy")) - 1).alias("pos"), "doc_id")
    n = items.agg(F.count("*").alias("n"))
    per = runs.join(good, "doc_id", "left").groupBy("configuration", "pos").agg(F.count("good").alias("hits")).crossJoin(n)
    per = per.withColumn("precision", F.col("hits") / (5 * F.col("n")))
    first = F.first("precision").over(Window.partitionBy(F.lit(0)).orderBy("pos"))  # four rows
    return per.select("configuration", F.round("precision", 6).alias("precision"), F.round(F.col("precision") - first, 6).alias("delta"))


_MATRIX = " UNION ALL ".join(
    f"SELECT '{name}' AS configuration, {k} AS k, query_id, doc_id, rank FROM {run} WHERE rank <= {k}"
    for name, run in (("bm25", "bm"), ("dense", "co"), ("hybrid", "fr")) for k in (3, 5, 10)
)


@_registered(f"""WITH {_BM25}, g AS (SELECT doc_id FROM labels WHERE quality = 1 GROUP BY doc_id), h AS ({_MATRIX}),
p AS (SELECT configuration, k, query_id, count(g.doc_id) / k AS p, coalesce(1 / min(rank) FILTER (g.doc_id IS NOT NULL), 0) AS r FROM h LEFT JOIN g USING (doc_id) GROUP BY configuration, k, query_id)
SELECT configuration, k, round(sum(p) / (SELECT count(*) FROM benchmark), 6) AS precision, round(sum(r) / (SELECT count(*) FROM benchmark), 6) AS reciprocal_rank FROM p GROUP BY configuration, k""")
def benchmark_matrix(spark, sf_dir):
    """Strategies by cut-offs: both legs are searched once, to the deepest cut-off, and read by all strategies at all of them."""
    docs, items = _documents(spark, sf_dir), _items(spark, sf_dir)
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id").distinct().withColumn("good", F.lit(1))
    runs = written_once(grid.hits(grid.legs(docs, items), docs, items, ("bm25", "dense", "hybrid"), 10).withColumnRenamed("strategy", "configuration"), "runs")
    cuts = runs.select("*", F.explode(F.array(*map(F.lit, (3, 5, 10)))).alias("k")).where(F.col("rank") <= F.col("k")).join(good, "doc_id", "left")
    per = cuts.groupBy("configuration", "k", "query_id").agg(
        (F.count("good") / F.col("k")).alias("p"), F.coalesce(1 / F.min(F.when(F.col("good") == 1, F.col("rank"))), F.lit(0.0)).alias("r")
    )
    n = items.agg(F.count("*").alias("n"))
    return per.groupBy("configuration", "k").agg(F.sum("p").alias("p"), F.sum("r").alias("r")).crossJoin(n).select(
        "configuration", "k", F.round(F.col("p") / F.col("n"), 6).alias("precision"), F.round(F.col("r") / F.col("n"), 6).alias("reciprocal_rank")
    )


@_registered(f"""WITH {_BM25}, q AS (SELECT item_id AS query_id, list_sort({_content('text')})[1:3] AS kw FROM benchmark),
h AS (SELECT query_id, rank, d.text, len(kw) > 0 AND len(list_filter(kw, lambda w: contains(lower(d.text), w))) >= greatest(1, least(2, len(kw))) AS relevant,
  list_distinct(string_split_regex(lower(d.text), '[^\\p{{L}}\\p{{N}}_]+')) AS t FROM q JOIN bm USING (query_id) JOIN documents d USING (doc_id) WHERE rank <= 5),
g AS (SELECT query_id, count(*) FILTER (relevant) AS n, arg_min(length(text), rank) FILTER (relevant) AS first FROM h GROUP BY ALL),
w AS (SELECT DISTINCT a.query_id FROM h a JOIN h b ON a.query_id = b.query_id AND a.rank > b.rank WHERE len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))) > 0.9)
SELECT query_id, array_to_string(list_filter([CASE WHEN n = 0 THEN 'wrong_topic' END, CASE WHEN w.query_id IS NOT NULL THEN 'duplicate_chunks' END, CASE WHEN n > 0 AND first < 120 THEN 'missing_context' END], lambda x: x IS NOT NULL), ',') AS modes
FROM g LEFT JOIN w USING (query_id)""")
def failure_modes(spark, sf_dir):
    docs, items = _documents(spark, sf_dir), _items(spark, sf_dir)
    cases = items.select("query_id", F.slice(F.array_sort(T.content_words(F.col("query"))), 1, 3).alias("kw"))
    hits = retrieval.bm25(docs, items).join(docs.select("doc_id", "text"), "doc_id").join(cases, "query_id")
    flagged = hits.withColumn("relevant", evaluation.relevant_to_case(F.lit(-1), F.col("kw"), F.col("doc_id"), F.col("text"))).withColumn("out_of_scope", F.lit(False))
    return evaluation.failure_modes(flagged).withColumn("modes", F.array_join("modes", ","))


@_registered(f"""WITH {_BM25} SELECT query_id, count(*) AS n_results, round(max(score), 4) AS top_score, array_to_string(list_sort(list_distinct(list(source))), ', ') AS documents,
'' AS relevant, '' AS correct_source, '' AS duplicate, '' AS missing_context, '' AS notes FROM bm JOIN documents USING (doc_id) WHERE rank <= 5 GROUP BY query_id""")
def audit_template(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    return sinks.audit_template(retrieval.bm25(docs, _items(spark, sf_dir)).join(docs.select("doc_id", "source"), "doc_id"))


@_registered(f"""WITH {_BM25} SELECT query_id, string_agg(printf('[%d] %s (%.4f) %s', rank, doc_id::VARCHAR, round(score::DECIMAL(18, 6), 4)::DOUBLE, substr(text, 1, 400) || CASE WHEN length(text) > 400 THEN '...' ELSE '' END), chr(10) ORDER BY rank) AS panel
FROM bm JOIN documents USING (doc_id) WHERE rank <= 5 GROUP BY query_id""")
def evidence_panels(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    return grounding.panel(retrieval.bm25(docs, _items(spark, sf_dir)).join(docs.select("doc_id", "text"), "doc_id"))


@_registered()
def answers_ungated(spark, sf_dir):
    """The whole path for every item; the gate is left open, since the tables' words are none of its topic's."""
    return answers.answer(_items(spark, sf_dir), _documents(spark, sf_dir), gated=False)


@_registered()
def answers_gated(spark, sf_dir):
    return answers.answer(_items(spark, sf_dir), _documents(spark, sf_dir))


def _cases(spark, sf_dir):
    """Items as cases: all content words of an item are its keywords; every tenth is taken as out of scope."""
    return _items(spark, sf_dir).select("query_id", "query", T.content_words(F.col("query")).alias("keywords"), (F.col("query_id") % 10 == 0).alias("out_of_scope"))


_RUNS = """rr AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, before, doc_id) AS rank FROM (
  SELECT f.query_id, f.doc_id, f.rank AS before,
    round(0.55::DOUBLE * len(list_intersect(list_distinct({tb}), list_distinct({td}))) / greatest(len(list_distinct({tb})), 1)
      + 0.25::DOUBLE * greatest(0.0, least(1.0, f.score)) + CASE WHEN contains(lower(d.text), lower(trim(b.text))) THEN 0.35::DOUBLE ELSE 0 END, 6) AS score
  FROM co f JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = f.query_id WHERE f.rank <= 15)),
runs5 AS (SELECT 'dense' AS strategy, query_id, doc_id, rank FROM co WHERE rank <= 10 UNION ALL SELECT 'bm25', query_id, doc_id, rank FROM bm WHERE rank <= 10
  UNION ALL SELECT 'hybrid', query_id, doc_id, rank FROM fr WHERE rank <= 10 UNION ALL SELECT 'rerank', query_id, doc_id, rank FROM rr WHERE rank <= 10
  UNION ALL SELECT 'hybrid_rerank', query_id, doc_id, rank FROM hr WHERE rank <= 10)""".format(tb=_tok("b.text"), td=_tok("d.text"))
_CASES = f"cases AS (SELECT item_id AS query_id, {_content('text')} AS kw, item_id % 10 = 0 AS oos FROM benchmark)"


@_registered(f"""WITH {_BM25}, {_RUNS}, {_CASES},
fl AS (SELECT strategy, query_id, rank, NOT oos AND len(list_filter(kw, lambda w: contains(lower(text), w))) >= greatest(1, least(2, len(kw))) AS relevant,
  len(list_filter(kw, lambda w: contains(lower(text), w))) > 0 AS seen FROM runs5 JOIN documents USING (doc_id) JOIN cases USING (query_id)),
pk AS (SELECT strategy, k, query_id, count(*) AS n, count(*) FILTER (relevant) AS good, min(rank) FILTER (relevant) AS first, bool_or(seen) AS seen FROM fl, (VALUES (3), (5), (10)) AS c(k) WHERE rank <= k GROUP BY ALL),
pe AS (SELECT s.strategy, c.k, q.query_id, q.oos, CASE WHEN oos THEN 'OUT_OF_SCOPE' WHEN n IS NULL THEN 'EMBEDDING_FAILURE' WHEN good > 0 THEN 'NONE' WHEN NOT seen THEN 'VOCABULARY_MISMATCH' ELSE 'BAD_CHUNK_BOUNDARY' END AS class,
  CASE WHEN NOT oos THEN coalesce(good / c.k, 0) END AS p, CASE WHEN NOT oos THEN coalesce(1 / first, 0) END AS r
  FROM (SELECT DISTINCT strategy FROM runs5) s, (VALUES (3), (5), (10)) AS c(k), cases q LEFT JOIN pk ON pk.strategy = s.strategy AND pk.k = c.k AND pk.query_id = q.query_id),
ta AS (SELECT strategy, k, string_agg(class || ':' || n, ',' ORDER BY class || ':' || n) AS failures FROM
  (SELECT strategy, k, class, count(*) AS n FROM pe WHERE class <> 'NONE' GROUP BY GROUPING SETS ((strategy, k, class), (strategy, class))) GROUP BY strategy, k),
me AS (SELECT strategy, k, round(coalesce(avg(p), 0), 4) AS precision, round(coalesce(avg(r), 0), 4) AS reciprocal_rank FROM pe GROUP BY GROUPING SETS ((strategy, k), (strategy)))
SELECT me.strategy, me.k, precision, reciprocal_rank, coalesce(failures, '') AS failures FROM me LEFT JOIN ta ON me.strategy = ta.strategy AND me.k IS NOT DISTINCT FROM ta.k""")
def strategy_grid(spark, sf_dir):
    """Five strategies by three cut-offs with failures, and each strategy's totals; both legs are searched once."""
    docs, cases = _documents(spark, sf_dir), _cases(spark, sf_dir)
    asked = cases.select("query_id", "query")
    runs = written_once(grid.hits(grid.legs(docs, asked), docs, asked), "runs")
    return grid.measured(runs, docs, cases, ["strategy"])


@_registered()
def chunk_grid(spark, sf_dir):
    """Two chunk configurations by five strategies by three cut-offs, over the chunks of all documents."""
    return grid.over_chunks(_documents(spark, sf_dir), _cases(spark, sf_dir))


@_registered()
def layered_evaluation(spark, sf_dir):
    """Five layers; those after the first read the documents without lines that recur, page numbers and the like."""
    docs = _documents(spark, sf_dir)
    lined = cleaning.page_lines(docs)
    cleaned = cleaning.cleaned_pages(cleaning.classified(lined, cleaning.recurring_lines(lined, 0.04))).select(F.col("page").alias("doc_id"), F.col("cleaned_text").alias("text"))
    return grid.layered(docs, _cases(spark, sf_dir), written_once(cleaned, "cleaned"))


@_registered(f"""WITH {_BM25}, {_CASES},
h AS (SELECT c.query_id, co.rank, d.text, oos, len(kw) > 0 AND len(list_filter(kw, lambda w: contains(lower(d.text), w))) >= greatest(1, least(2, len(kw))) AS relevant,
  list_distinct(string_split_regex(lower(d.text), '[^\\p{{L}}\\p{{N}}_]+')) AS t FROM cases c JOIN co USING (query_id) JOIN documents d USING (doc_id) WHERE co.rank <= 5),
g AS (SELECT query_id, count(*) AS n, count(*) FILTER (relevant AND rank <= 3) AS n3, count(*) FILTER (relevant) AS n5, arg_min(length(text), rank) FILTER (relevant) AS first FROM h GROUP BY ALL),
w AS (SELECT DISTINCT a.query_id FROM h a JOIN h b ON a.query_id = b.query_id AND a.rank > b.rank WHERE len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))) > 0.9)
SELECT c.query_id, CASE WHEN oos AND n IS NULL THEN 'REFUSED' ELSE 'PROCESSED' END AS status,
  round(CASE WHEN NOT oos THEN coalesce(n3 / 3, 0) WHEN n IS NULL THEN 1 ELSE 0 END, 4) AS precision_3, round(CASE WHEN NOT oos THEN coalesce(n5 / 5, 0) WHEN n IS NULL THEN 1 ELSE 0 END, 4) AS precision_5,
  coalesce(n, 0) AS n_hits, CASE WHEN oos THEN CASE WHEN n IS NULL THEN '' ELSE 'unrefused_out_of_scope' END
  ELSE array_to_string(list_filter([CASE WHEN coalesce(n5, 0) = 0 THEN 'wrong_topic' END, CASE WHEN w.query_id IS NOT NULL THEN 'duplicate_chunks' END, CASE WHEN n5 > 0 AND first < 120 THEN 'missing_context' END], lambda x: x IS NOT NULL), ',') END AS modes
FROM cases c LEFT JOIN g ON g.query_id = c.query_id LEFT JOIN w ON w.query_id = c.query_id""")
def evaluation_cases(spark, sf_dir):
    """The evaluation run over all items as cases: precision, status and what went wrong for each."""
    rows = evaluation_run.evaluated(_documents(spark, sf_dir), _cases(spark, sf_dir), expand=False)
    return rows.select("query_id", "status", "precision_3", "precision_5", "n_hits", F.array_join("modes", ",").alias("modes"))


_CUT = "(\\s+)(\\d+[.)][\\s\\x01])"


@_registered(f"""WITH {_TEXTS}, q AS (SELECT kind, id, {_STRIP('text')} AS q FROM x WHERE kind <> 'doc'),
s AS (SELECT *, list_transform(list_filter(list_transform(string_split(regexp_replace(regexp_replace(q, '{_CUT}', chr(1) || '\\2', 'g'), '{_CUT}', chr(1) || '\\2', 'g'), chr(1)), lambda p: {_STRIP('p')}), lambda p: p <> ''), lambda p: {_STRIP("regexp_replace(p, '^[0-9]+[.)]', '')")}) AS items,
  list_transform(list_filter(list_transform(string_split(q, '?'), lambda p: {_STRIP('p')}), lambda p: p <> ''), lambda p: p || '?') AS asked,
  list_filter(list_transform(string_split_regex(q, '[\\n\\r]'), lambda p: {_STRIP('p')}), lambda p: p <> '') AS rows FROM q WHERE q <> ''),
c AS (SELECT kind, id, CASE WHEN len(items) > 1 THEN items WHEN len(q) - len(replace(q, '?', '')) > 1 AND len(asked) > 1 THEN asked WHEN len(rows) > 1 THEN rows ELSE [q] END AS found FROM s)
SELECT kind, id, unnest(range(len(found))) AS question, unnest(found) AS query FROM c""")
def typed_questions(spark, sf_dir):
    """Items and messages split as typed texts are."""
    rows = _texts(spark, sf_dir).where("kind <> 'doc'")
    return rows.select("kind", "id", F.posexplode(dialogue.typed_questions(F.col("text"))).alias("question", "query")).withColumn("question", F.col("question").cast("long"))

_TERM_ITEMS = "ti AS (SELECT item_id, coalesce(text, '') || ' ICS مصطلح' || item_id AS text FROM benchmark)"


@_registered(f"""WITH {_TERM_ITEMS}, tt AS (SELECT 'مصطلح' || item_id AS ar, lower(trim({_tok('text')}[1])) AS en FROM benchmark WHERE len({_tok('text')}) > 0),
ty AS (SELECT item_id, array_to_string(list_transform(string_split_regex(text, '\\s+'), lambda w: {_TYPO}), ' ') AS fixed, text FROM ti),
tf0 AS (SELECT *, list_filter(list_transform({_tok('fixed')}, lambda w: {_FORM}), lambda x: x IS NOT NULL) AS forms FROM ty),
tm AS (SELECT item_id, string_agg(DISTINCT en, ' ' ORDER BY en) AS mapped FROM ty JOIN tt ON contains(lower(ty.text), ar) GROUP BY item_id),
asked AS (SELECT item_id, fixed || ' ' || array_to_string(forms, ' ') || coalesce(' ' || mapped, '') AS text FROM tf0 LEFT JOIN tm USING (item_id)),
{_ranked("one AS (SELECT 1)", 15)} SELECT query_id, doc_id, score, rank FROM bm WHERE rank <= 5""")
def terminology_search(spark, sf_dir):
    """Items with an acronym and an Arabic term behind them, expanded by a terminology that is read from JSON files."""
    items = _items(spark, sf_dir)
    first = F.get(T.tokens(F.col("query")), F.lit(0))
    term = F.struct(first.alias("term_en"), F.concat(F.lit("مصطلح"), "query_id").alias("term_ar"), F.array().cast("array<string>").alias("synonyms_en"), F.array().cast("array<string>").alias("synonyms_ar"))
    path = fresh_path(spark, "terms")
    items.where(first.isNotNull()).select(F.array(term).alias("terms")).write.json(path)
    asked = items.withColumn("query", F.concat(F.coalesce("query", F.lit("")), F.lit(" ICS مصطلح"), "query_id"))
    return retrieval.search(_documents(spark, sf_dir), asked, "bm25", terms=terminology_files(spark, [path], whole_files=False)).select("query_id", "doc_id", "score", "rank")


@_registered("""WITH d AS (SELECT doc_id, regexp_replace(substr(coalesce(text, ''), 1, 60), '[^A-Za-z0-9 ]', '', 'g') AS t, doc_id % 6 AS shape FROM documents)
SELECT doc_id, CASE shape WHEN 5 THEN trim('plain ' || t) ELSE t END AS recommendation,
CASE shape WHEN 0 THEN t WHEN 1 THEN CASE WHEN trim(t) = '' THEN '• b' ELSE '• ' || trim(t) || chr(10) || '• b' END WHEN 2 THEN t WHEN 3 THEN 'deep' WHEN 4 THEN 'in' ELSE '' END AS evidence,
CASE shape WHEN 1 THEN 2 WHEN 5 THEN 0 ELSE 1 END AS n_citations, CASE WHEN shape = 5 THEN '' ELSE doc_id::VARCHAR END AS first_cited FROM d""")
def parsed_replies(spark, sf_dir):
    """Replies of six shapes built from the documents' first characters: whole, list, fenced object, nested, inside prose, no JSON."""
    t = F.regexp_replace(F.substring(F.coalesce("text", F.lit("")), 1, 60), "[^A-Za-z0-9 ]", "")
    cited = F.concat(F.lit('"citations": [{"claim": "c", "chunk_id": "'), F.col("doc_id").cast("string"), F.lit('"}'))
    whole = lambda rec, ev, more="]": F.concat(F.lit('{"recommendation": '), rec, F.lit(', "supporting_evidence": '), ev, F.lit(", "), cited, F.lit(more + "}"))
    text = F.concat(F.lit('"'), t, F.lit('"'))
    inner = F.concat(F.lit('{"recommendation": "'), t, F.lit('", "supporting_evidence": "deep"}'))
    nested = F.regexp_replace(inner, '"', '\\\\"')
    shape = F.col("doc_id") % 6
    reply = (
        F.when(shape == 0, whole(text, text)).when(shape == 1, whole(text, F.concat(F.lit("["), text, F.lit(', " b ", ""]')), ', "no object", {"claim": "d"}]'))
        .when(shape == 2, F.concat(F.lit("```json\n"), whole(text, F.concat(F.lit('{"text": '), text, F.lit("}"))), F.lit("\n```")))
        .when(shape == 3, whole(F.concat(F.lit('"'), nested, F.lit('"')), F.lit('""')))
        .when(shape == 4, F.concat(F.lit("Here it is: "), whole(text, F.lit('"{\\"supporting_evidence\\": \\"in\\"}"')), F.lit(" That is all.")))
        .otherwise(F.concat(F.lit("plain "), t))
    )
    rows = _documents(spark, sf_dir).select("doc_id", replies.parsed(reply).alias("p"))
    return rows.select(
        "doc_id", "p.recommendation", F.col("p.supporting_evidence").alias("evidence"), F.size("p.citations").alias("n_citations"),
        F.coalesce(F.get("p.citations", F.lit(0))["doc_id"], F.lit("")).alias("first_cited"),
    )


_UNTAGGED = r"""regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<!--.*?-->|<(?:script|style)\b.*?</(?:script|style)\s*>', '', 'g'),
  '(?i)<(?:br|/p|/h[1-6]|/li|/div|/tr|/title|/td)\b[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g')"""
_NAMED = _UNTAGGED
for _name, _sign in ENTITIES:
    _NAMED = f"replace({_NAMED}, '{_name}', '{_sign.replace(chr(39), chr(39) * 2)}')"
_WEB = f"""w AS (SELECT lower(regexp_extract(coalesce(url, ''), '^[A-Za-z]+://([^/?#]+)', 1)) AS document, page_id AS page, regexp_replace({_NAMED}, '[ \\t]*\\n[ \\t\\n]*', chr(10), 'g') AS text FROM pages)"""


@_registered(f"WITH {_WEB} SELECT document, page, len(string_split(text, chr(10))) AS n_lines, length(text) AS n_chars, sha256(text) AS text_sha256 FROM w")
def web_page_texts(spark, sf_dir):
    """What every web page shows, by host."""
    rows = web_pages(table(spark, sf_dir, "pages"))
    return rows.select("document", "page", F.size(F.split("text", "\n")).cast("long").alias("n_lines"), F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


@_registered("""SELECT conv_id, turn, role, len(h) AS n_history, array_to_string(h, '|') AS roles FROM (
SELECT conv_id, turn, role, coalesce(list(role || turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING), []) AS h FROM conversations)""")
def history_stream(spark, sf_dir):
    """The histories of all turns, taken as a stream with state."""
    rows = streamed.run_histories(spark, f"{sf_dir}/conversations.parquet")
    roles = F.array_join(F.transform("history", lambda m: F.concat(m["role"], m["seq"].cast("string"))), "|")
    return rows.select("conv_id", "turn", "role", F.size("history").cast("long").alias("n_history"), roles.alias("roles"))


@_registered()
def conversation_replies(spark, sf_dir):
    """What every question of every user message is answered with the gate left open, with citations and whole prompts as digests."""
    found = conversations.ask(table(spark, sf_dir, "conversations"), _documents(spark, sf_dir), gated=False)
    return found.select("conv_id", "turn", "part", "question", "status", "confidence", "n_evidence", "n_verified", "note", F.sha2("recommendation", 256).alias("reply_sha256"))


# --- telemetry ------------------------------------------------------------------------------------


@_registered("SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY ALL")
def request_windows(spark, sf_dir):
    return telemetry.request_windows(table(spark, sf_dir, "events"))


@_registered("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS starts FROM events),
s AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL '30 minutes' AS session_end, count(*) AS n FROM s GROUP BY user_id, session""")
def user_sessions(spark, sf_dir):
    return telemetry.user_sessions(table(spark, sf_dir, "events"))
