"""Spelling variant grouping: PartEnum signatures over letter multisets, joined exactly and verified.

A word is the binary vector of its (letter, occurrence) pairs. One edit changes at most two of them, so that two near
words agree outside two parts of a fixed partition: leaving out every two of the parts gives signatures of which
near words share one. Sharing one only makes a candidate; the edit itself is verified inside the join.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import documents, forget, materialise, text_or_empty
from tessera.llm.shards import _crc_table

#: Parts of the partition, and how many of them near words may differ in.
PARTS, APART = 8, 2
#: A run loses a letter where this divides the hash of its document and itself.
DROP = 199
#: Words have at least so many letters and occurrences; a form has at least RATIO times the occurrences of its variant.
LETTERS, OCCURRENCES, RATIO = 6, 5, 5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: Column) -> Column:
    """Only A-Z become lower case."""
    return F.translate(text, _UPPER, _LOWER)


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", letters: int = LETTERS, least: int = OCCURRENCES) -> DataFrame:
    """word and n, its occurrences in all whole texts; a null id counts as an empty one in the hash."""
    # a run of fewer letters never becomes a word, and a longer one is matched from its first letter to its last
    runs = F.regexp_extract_all(lowered(text_or_empty(text_col)), F.lit(r"[a-z\x{C0}-\x{FF}]{%d,}" % letters), F.lit(0))
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    h, size = F.crc32(F.concat_ws(":", "id", "run").cast("binary")), F.length("run")
    at = (h % size).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, size))
    found = rows.select(F.when(h % DROP == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= letters)
    return found.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def signatures(word: str) -> list[int]:
    """One hash for every two parts left out: of all (letter, occurrence) pairs in the other parts."""
    parts: list[list[str]] = [[] for _ in range(PARTS)]
    for letter, count in Counter(word).items():
        for occurrence in range(count):
            parts[(ord(letter) + occurrence) % PARTS].append(f"{letter}{occurrence}")
    listed = [",".join(sorted(p)) for p in parts]
    found = []
    for out in combinations(range(PARTS), APART):
        kept = ";".join(p for k, p in enumerate(listed) if k not in out)
        found.append(xxhash.xxh64_intdigest(f"{out}{kept}") - (1 << 63))
    return found


def _signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield batch.assign(sig=[signatures(w) for w in batch["word"]])


def near_words(vocabulary: DataFrame) -> DataFrame:
    """a, n_a, b, n_b: every two words (a < b) that one inserted, deleted or replaced code point makes equal, once."""
    signed = vocabulary.select("word", "n").mapInPandas(_signed, "word string, n long, sig array<bigint>")
    signed = signed.select(F.explode("sig").alias("sig"), "word", "n")
    a = signed.select("sig", F.col("word").alias("a"), F.col("n").alias("n_a"))
    b = signed.select("sig", F.col("word").alias("b"), F.col("n").alias("n_b"))
    verified = (F.col("a") < F.col("b")) & (F.abs(F.length("a") - F.length("b")) <= 1) & (F.levenshtein("a", "b", 1) == 1)
    # Spark takes the exploded side for as small as the words' file and would broadcast 28 rows of each word
    return a.join(b.hint("merge"), (a["sig"] == b["sig"]) & verified).select("a", "n_a", "b", "n_b").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """word and root: the last word on the way from form to form. forms has the words with a form only.

    Every step counts at least RATIO times as many occurrences, so the ways are short and have no cycles; each round
    doubles how far a word has gone.
    """
    ways = materialise(forms.select("word", F.col("form").alias("root")), "ways")
    while True:
        ahead = ways.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = materialise(ways.join(ahead.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("went")), "ways")
        forget(ways)
        ways = further
        if ways.where("went").isEmpty():
            return ways.select("word", "root")


def spelling_variants(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    letters: int = LETTERS, least: int = OCCURRENCES, ratio: int = RATIO,
) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word.

    Null and empty texts have no words; repeated rows and ids count each time; a null id is hashed as an empty one. Of near
    words with equally many occurrences the first in code-point order is the form. Words without near words
    are their own roots. Empty table: empty result. Other columns are ignored.
    """
    if letters < 2:
        raise ValueError("words have two letters at least")
    vocabulary = materialise(words(docs, id_col, text_col, letters, least), "words")
    pairs = materialise(near_words(vocabulary), "near")
    sides = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("n_other")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("n_other")))
    best = sides.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_other")).alias("n"), "other")).alias("best"))
    is_form = -F.col("best.n") >= F.col("n") * ratio
    told = vocabulary.join(best.hint("merge"), "word", "left").select(
        "word", F.when(is_form, F.col("best.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, -F.col("best.n")).alias("form_n"),
    )
    told = materialise(told, "forms")
    forget(pairs)
    forget(vocabulary)
    ends = roots(told.where("form IS NOT NULL"))
    return told.join(ends.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(documents(spark, sf_dir))


#: The same from runs hashed byte by byte and words that agree once one code point is taken out.
ORACLE_SQL = f"""
WITH RECURSIVE r AS MATERIALIZED (
  SELECT id, run, count(*) AS n FROM (
    SELECT coalesce(doc_id::VARCHAR, '') AS id,
      unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[a-zÀ-ÿ]+')) AS run
    FROM documents
  ) WHERE length(run) >= {LETTERS} GROUP BY id, run
), h AS (
  SELECT run, n, xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(0, strlen(id || ':' || run)::BIGINT), lambda i: ('0x' || substr(hex(encode(id || ':' || run)), (2 * i + 1)::BIGINT, 2))::BIGINT)),
    lambda a, x: xor(a >> 8, ({_crc_table()})[(xor(a, x) & 255) + 1])), 4294967295::BIGINT) AS h
  FROM r
), w AS MATERIALIZED (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN h % {DROP} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h
  ) WHERE length(word) >= {LETTERS} GROUP BY word HAVING sum(n) >= {OCCURRENCES}
), cut AS MATERIALIZED (
  SELECT DISTINCT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM w)
), p AS MATERIALIZED (
  SELECT a.word, b.word AS other, b.n AS n_other FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM cut c JOIN w ON c.rest = w.word
  UNION SELECT w.word, c.word, c.n FROM cut c JOIN w ON c.rest = w.word
), f AS MATERIALIZED (
  SELECT w.word, w.n, count(p.other) AS n_near, min({{'n': -p.n_other, 'o': p.other}}) FILTER (p.other IS NOT NULL) AS best
  FROM w LEFT JOIN p ON w.word = p.word GROUP BY w.word, w.n
), g AS MATERIALIZED (
  SELECT word, CASE WHEN -best.n >= {RATIO} * n THEN best.o END AS form, n, n_near, CASE WHEN -best.n >= {RATIO} * n THEN -best.n END AS form_n FROM f
), t AS (
  SELECT word, word AS at, 0 AS step FROM g
  UNION ALL SELECT t.word, g.form, step + 1 FROM t JOIN g ON t.at = g.word WHERE g.form IS NOT NULL
)
SELECT g.word, form, (SELECT arg_max(t.at, t.step) FROM t WHERE t.word = g.word) AS root, n, n_near, form_n FROM g
"""

QUERIES = {"op12_spelling_variants": op12_spelling_variants}
ORACLES = {"op12_spelling_variants": ORACLE_SQL}
