"""License scans: exact containment join of text blocks with license templates, DataFrame functions only.

Words are ordered by how many documents hold them, rarest first. A block that holds enough of a template shares a word
with it among the first few of both; only such pairs, with a block long enough and a shared word early enough,
are compared in full. Words that no template has can't count towards a containment, so blocks are kept without them.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import documents, forget, materialise, text_or_empty
from tessera.llm.spelling import lowered

#: All that separates words, once A-Z are lower case.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases that are found word by word, and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Share of a template's different words that a block has to hold.
CONTAINMENT = 0.9
#: License notices and openings of license texts, with their labels.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl-3.0", "licensed under the gnu general public license version 3"),
    ("gpl-2.0", "licensed under the gnu general public license version 2"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
)


def spaced(text: Column) -> Column:
    """The words of a text with one space before, between and behind them."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(lowered(text), GAP, " ")), F.lit(" "))


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _reach(words: int) -> int:
    """Words that blocks of a class move by: a power of two that isn't less than the template."""
    return 1 << max(3, math.ceil(math.log2(words)))


def _classes(templates: Sequence[tuple[str, str]], share: float) -> dict[int, list[tuple[str, list[str], int]]]:
    """By reach: label, different words and the least number of them that a block has to hold."""
    found: dict[int, list] = {}
    for label, text in templates:
        different = list(dict.fromkeys(text.split()))
        if different:
            found.setdefault(_reach(len(text.split())), []).append((label, different, max(1, math.ceil(share * len(different) - 1e-9))))
    return found


def word_ranks(docs: DataFrame, vocabulary: Sequence[str], text_col: str = "text") -> list[str]:
    """vocabulary in the order of the join: by number of documents that hold the word, then by the word.

    Counted over all documents; the driver gets one row for each word of the templates.
    """
    held = F.array_intersect(F.array(*map(F.lit, vocabulary)), F.split(spaced(text_or_empty(text_col)), " "))
    counts = docs.select(F.explode(held).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    n = {r.word: r.n for r in counts.collect()}
    return sorted(vocabulary, key=lambda w: (n.get(w, 0), w))


def _blocks(reach: int, found: Sequence[tuple[str, list[str], int]], order: Sequence[str]) -> Column:
    """Blocks over the column w of words, without those too short for every template of the class."""
    least, own = min(need for *_, need in found), F.array(*[F.lit(w) for w in order if any(w in words for _, words, _ in found)])

    def block(start: Column) -> Column:
        held = F.array_intersect(own, F.slice("w", start + 1, F.lit(2 * reach)))  # in the order of own
        return F.struct(F.lit(reach).alias("reach"), start.alias("start"), held.alias("words"))

    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - reach - 1), F.lit(reach))
    return F.filter(F.transform(starts, block), lambda b: F.size(b["words"]) >= least)


def _marked(docs: DataFrame, order: Sequence[str], classes: dict, phrases, id_col: str, text_col: str) -> DataFrame:
    """One row a document: numbers of words and places, base labels, and of documents that hold a word of any template's
    first few the blocks (reach, start, words of the vocabulary in order) that are long enough for one."""
    rows = docs.select(F.monotonically_increasing_id().alias("row_no"), F.col(id_col).alias("doc_id"), spaced(text_or_empty(text_col)).alias("s"))
    n_words = F.when(F.length("s") <= 2, 0).otherwise(_spaces(F.col("s")) - 1)
    # a place is where a phrase begins, so that places may overlap
    counts = [F.regexp_count("s", F.lit(f"(?<= )(?={p} )")) for p, _ in phrases]
    alike = "|".join(p for p, _ in phrases)
    first = F.regexp_extract("s", f"(?s)^(.*? )(?=(?:{alike}) )", 1)
    last = F.regexp_extract("s", f"(?s)^(.* )(?=(?:{alike}) )", 1)
    n_base = sum(counts[1:], counts[0])
    rows = rows.withColumns({"n_words": n_words.cast("long"), "n_base": n_base.cast("long")})
    base = F.array_sort(F.array_distinct(F.filter(F.array(*[F.when(c > 0, F.lit(label)) for c, (_, label) in zip(counts, phrases)]), lambda x: x.isNotNull())))
    rank = {w: i for i, w in enumerate(order)}
    rare = {w for found in classes.values() for _, words, need in found for w in sorted(words, key=rank.get)[: len(words) - need + 1]}
    split = F.split(F.trim("s"), " ")
    blocks = [_blocks(reach, found, order) for reach, found in sorted(classes.items())]
    some = F.arrays_overlap(split, F.array(*map(F.lit, sorted(rare))))
    rows = rows.select(
        "row_no", "doc_id", "n_words", "n_base", F.when(F.col("n_base") > 0, _spaces(first) - 1).cast("long").alias("first_word"),
        F.when(F.col("n_base") > 0, _spaces(last) - 1).cast("long").alias("last_word"), base.alias("base"), F.when(some, split).alias("w"),
    )
    return rows.select(*[c for c in rows.columns if c != "w"], F.when(F.col("w").isNotNull(), F.concat(*blocks)).alias("blocks"))


def _template_table(spark: SparkSession, order: Sequence[str], classes: dict) -> DataFrame:
    """A row for each word of each template's first few: reach, label, words in order, need, the word and its position."""
    rank = {w: i for i, w in enumerate(order)}
    rows = []
    for reach, found in classes.items():
        for label, words, need in found:
            listed = sorted(words, key=rank.get)
            rows += [(reach, label, listed, need, w, k) for k, w in enumerate(listed[: len(listed) - need + 1])]
    return spark.createDataFrame(rows, "reach int, label string, listed array<string>, need int, word string, at int")


def _hits(marked: DataFrame, templates: DataFrame) -> DataFrame:
    """row_no, label, start, reach and containment of every block that holds enough of a template, once."""
    b = marked.where("blocks IS NOT NULL").select("row_no", F.explode("blocks").alias("b"))
    b = b.select("row_no", "b.reach", "b.start", "b.words", F.posexplode("b.words").alias("pos", "word"))
    held, size = F.size("words"), F.size("listed")
    near = (
        (held >= F.col("need"))  # length
        & (F.col("pos") <= held - F.col("need"))  # prefix of the block; that of the template is in its table
        & (1 + F.least(size - F.col("at"), held - F.col("pos")) - 1 >= F.col("need"))  # position
    )
    # templates is a fixed list of a few hundred rows
    found = b.join(F.broadcast(templates), ["reach", "word"]).where(near)
    found = found.withColumn("common", F.size(F.array_intersect("listed", "words"))).where("common >= need")
    return found.groupBy("row_no", "label", "reach", "start").agg(F.max(F.col("common") / size).alias("containment"))


def _scanned(docs: DataFrame, templates, share: float, phrases, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    classes = _classes(templates, share)
    vocabulary = sorted({w for found in classes.values() for _, words, _ in found for w in words})
    if not vocabulary or not phrases:
        raise ValueError("at least one template and one phrase are needed")
    order = word_ranks(docs, vocabulary, text_col)
    marked = materialise(_marked(docs, order, classes, phrases, id_col, text_col), "blocks")
    return marked, _hits(marked, _template_table(docs.sparkSession, order, classes))


def license_blocks(docs: DataFrame, templates=TEMPLATES, share: float = CONTAINMENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, label, first_word, n_words and containment: every block of words that holds share of a template's words.

    Blocks of 2 x reach words begin every reach words, where reach is 8, 16, 32 .. and not less than the template, so
    that any stretch of a template's length lies within one. Cases as in license_scan.
    """
    marked, hits = _scanned(docs, templates, share, PHRASES, id_col, text_col)
    n = F.least(F.col("n_words"), F.col("start") + 2 * F.col("reach")) - F.col("start")
    return hits.join(marked.select("row_no", "doc_id", "n_words"), "row_no").select("doc_id", "label", F.col("start").cast("long").alias("first_word"), n.cast("long").alias("n_words"), "containment")


def license_scan(
    docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, share: float = CONTAINMENT,
    phrases: Sequence[tuple[str, str]] = PHRASES, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score for every row.

    labels are those of the phrases and of every template that a block holds. score is 1 where a phrase stands, else the highest
    containment found, else 0. Null and empty texts have no words; repeated rows and null ids get a row each; an empty table
    gives an empty result; other columns are ignored. Rows are numbered once, in what is written.
    """
    marked, hits = _scanned(docs, templates, share, phrases, id_col, text_col)
    told = hits.groupBy("row_no").agg(F.collect_set("label").alias("found"), F.max("containment").alias("most"))
    joined = marked.drop("blocks").join(told, "row_no", "left")
    found = F.coalesce("found", F.array().cast("array<string>"))
    return joined.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", found)), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("most", F.lit(0.0))).alias("score"),
    )


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir))


def _sql() -> str:
    """Every block against every template, without order or filters."""
    rows = ", ".join(
        f"({reach}, '{label}', {words}, {need})" for reach, found in sorted(_classes(TEMPLATES, CONTAINMENT).items()) for label, words, need in found)
    phrases = ", ".join(f"({p.split()}, '{label}')" for p, label in PHRASES)
    return rf"""
WITH t(reach, label, listed, need) AS (VALUES {rows}), f(phrase, label) AS (VALUES {phrases}),
w AS MATERIALIZED (
  SELECT row_number() OVER () AS k, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents
), places AS (
  SELECT k, i, label FROM (SELECT k, words, unnest(range(len(words))) AS i FROM w), f WHERE words[i + 1 : i + len(phrase)] = phrase
), base AS (
  SELECT k, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS labels FROM places GROUP BY k
), blocks AS MATERIALIZED (
  SELECT k, reach, list_distinct(words[i + 1 : i + 2 * reach]) AS block
  FROM (SELECT k, reach, words, unnest(range(0, greatest(1, len(words) - reach), reach)) AS i FROM w, (SELECT DISTINCT reach FROM t))
), hits AS (
  SELECT k, label, len(list_intersect(block, listed)) / len(listed) AS share FROM blocks JOIN t USING (reach) WHERE len(list_intersect(block, listed)) >= need
), found AS (
  SELECT k, list(DISTINCT label) AS labels, max(share) AS most FROM hits GROUP BY k
)
SELECT doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(base.labels, found.labels))), ','), '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(most, 0.0) END::DOUBLE AS score
FROM w LEFT JOIN base USING (k) LEFT JOIN found USING (k)
"""


QUERIES = {"op13_license_scan": op13_license_scan}
ORACLES = {"op13_license_scan": _sql()}
