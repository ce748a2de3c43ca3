"""Terms of a terminology that stand anywhere in a text: one automaton over all terms, one pass over each text."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import rulesets as R
from tessera.functions.text import language
from tessera.operators import dialogue

#: Characters of all terms up to which the automaton is broadcast; beyond it terms and texts meet at three letters.
MOST_CHARACTERS = 4_000_000


def _joined(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """Both sides meet at the first three letters of a term, so neither is broadcast and no text meets all terms."""
    rows = texts.where(F.length("q") >= R.SHORTEST_TERM)
    starts = F.sequence(F.lit(1), F.length("q") - (R.SHORTEST_TERM - 1))
    grams = F.array_distinct(F.transform(starts, lambda i: F.substr(F.col("q"), i, F.lit(R.SHORTEST_TERM))))
    rows = rows.select("query_id", "q", F.explode(grams).alias("gram"))
    known = terms.select("term_ar", "term_en", F.substring("term_ar", 1, R.SHORTEST_TERM).alias("gram"))
    return rows.join(known, "gram").where(F.contains("q", "term_ar")).select("query_id", "term_ar", "term_en")


def _scanned(texts: DataFrame, terms: DataFrame) -> DataFrame:
    found = [tuple(r) for r in terms.select("term_ar", "term_en").collect()]  # MOST_CHARACTERS at most
    sent = texts.sparkSession.sparkContext.broadcast(found)
    id_type = texts.schema["query_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, english = ahocorasick.Automaton(), {}
        for term, form in sent.value:
            automaton.add_word(term, term)
            english.setdefault(term, []).append(form)
        automaton.make_automaton()
        for batch in batches:
            rows, hits, forms = [], [], []
            for i, text in enumerate(batch.column("q").to_pylist()):
                for term in {t for _, t in automaton.iter(text)} if len(automaton) else ():
                    for form in english[term]:
                        rows.append(i)
                        hits.append(term)
                        forms.append(form)
            ids = batch.column("query_id").take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(hits, pa.string()), pa.array(forms, pa.string())], ["query_id", "term_ar", "term_en"])

    return texts.mapInArrow(work, f"query_id {id_type}, term_ar string, term_en string")


def mentioned_terms(queries: DataFrame, terms: DataFrame, most: int = MOST_CHARACTERS) -> DataFrame:
    """(query_id, term_ar, term_en) of the terms(term_ar, term_en), of three letters or more, that stand anywhere in a query.

    Texts are compared in small letters, terms as they are. Null texts and terms hold and match nothing; a repeated row
    counts once. The terms' size decides how they are found, not what is found.
    """
    texts = queries.where(F.col("query").isNotNull()).select("query_id", F.lower("query").alias("q"))
    known = terms.where(F.length("term_ar") >= R.SHORTEST_TERM).select("term_ar", "term_en").distinct()
    size = known.agg(F.sum(F.length("term_ar") + F.coalesce(F.length("term_en"), F.lit(0)))).first()[0] or 0
    return (_scanned if size <= most else _joined)(texts, known).distinct()


def with_terms(queries: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """queries(query_id, query) with `expanded`, what is searched: the query with its typos corrected, the full forms of its
    acronyms, and for Arabic queries the English of terms(term_ar, term_en) in it, by the alphabet. Null stays null."""
    full = dialogue.expanded(dialogue.spelled(F.col("query")))
    if terms is None:
        return queries.withColumn("expanded", full)
    found = mentioned_terms(queries.where(language(F.col("query")) == "ar"), terms).groupBy("query_id").agg(F.array_sort(F.collect_set("term_en")).alias("mapped"))
    mapped = F.array_join(F.coalesce("mapped", F.array().cast("array<string>")), " ")
    return queries.join(found, "query_id", "left").withColumn("expanded", F.when(mapped == "", full).otherwise(F.concat_ws(" ", full, mapped))).drop("mapped")
