"""Conversation windows, topic shifts, follow-up rewriting, query expansion and decomposition."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import rulesets as R
from tessera.functions.text import contains_any, language, lines, matches_any, stripped, tokens, word_count


def history(turns: DataFrame, last: int = 8, conv: str = "conv_id", order: str = "turn") -> DataFrame:
    """turns with `history`, the last messages before each as an array of (seq, role, content)."""
    before = Window.partitionBy(conv).orderBy(order).rowsBetween(-last, -1)
    message = F.struct(F.col(order).alias("seq"), "role", F.col("text").alias("content"))
    return turns.withColumn("history", F.collect_list(message).over(before))


def last_user_turn(turns: DataFrame, conv: str = "conv_id", order: str = "turn") -> DataFrame:
    """turns with `previous`, the last non-empty user message before each."""
    before = Window.partitionBy(conv).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    said = F.when((F.col("role") == "user") & (stripped(F.col("text")) != ""), F.col("text"))
    return turns.withColumn("previous", F.last(said, ignorenulls=True).over(before))


def topic_shift(query: Column, has_history: Column) -> Column:
    """Whether a query stands by itself."""
    follows = F.when(language(query) == "ar", matches_any(query, R.FOLLOW_UP_AR)).otherwise(matches_any(query, R.FOLLOW_UP_EN))
    return F.when(~has_history, True).when(contains_any(query, R.NEW_TOPICS), True).when(follows, False).otherwise(
        contains_any(query, R.SUBJECTS) & (word_count(query) >= 4)
    )


def anchor(messages: Column) -> Column:
    """Subject of the latest user message (of any role where no user spoke): what is left without leading question words."""
    users = F.filter(messages, lambda m: m["role"] == "user")
    pool = F.when(F.size(users) > 0, users).otherwise(messages)
    subjects = F.transform(pool, lambda m: stripped(F.regexp_replace(m["content"], "(?i)" + R.LEADING_WORDS, "")))
    return F.get(F.reverse(F.filter(subjects, lambda s: F.length(s) > 3)), F.lit(0))


def rewritten(query: Column, messages: Column) -> Column:
    """A follow-up fragment joined with the conversation's subject; other queries as they are."""
    q, subject = stripped(query), anchor(messages)
    safe = F.regexp_replace(subject, r"([\\$])", r"\\$1")
    fragment = (word_count(q) <= 4) | F.lower(q).rlike("(?U)" + R.PRONOUNS)
    about = F.regexp_replace(F.regexp_replace(q, r"(?i)^(what|how)\s+about\s*", ""), r"^[? ]+|[? ]+$", "")
    joined = (
        F.when(F.lower(q).rlike(r"^(what|how)\s+about\b"), F.concat(subject, F.lit(" - "), about))
        .when(F.lower(q).rlike(r"(?U)\b(it|that)\b"), F.regexp_replace(q, F.lit(r"(?iU)\b(it|that)\b"), safe))
        .otherwise(F.concat_ws(" ", subject, q))
    )
    return F.when(subject.isNotNull() & fragment, joined).otherwise(q)


def canonical(query: Column, messages: Column) -> Column:
    """A whole question for a follow-up (rewritten, or else by its form) or a terse query; others as they are, null as empty."""
    q = stripped(F.coalesce(query, F.lit("")))
    lower = F.lower(q)
    new = rewritten(q, messages)
    said = F.filter(messages, lambda m: (m["role"] == "user") & (F.coalesce(m["content"], F.lit("")) != ""))
    last = F.lower(F.get(F.reverse(said), F.lit(0))["content"])
    topic = F.when(contains_any(last, R.CHILD_WORDS), R.CHILD_TOPIC).otherwise(R.TOPIC)
    short = (word_count(q) <= 5) & ~contains_any(q, ["asthma", "what", "how", "why"])
    asked = F.concat(q, F.lit(" regarding "), topic)
    for words, form in reversed(R.FOLLOW_UP_QUESTIONS):
        before, after = form.split("{}")
        asked = F.when(contains_any(q, words), F.concat(F.lit(before), topic, F.lit(after))).otherwise(asked)
    terse = F.try_element_at(F.create_map(*[F.lit(x) for pair in R.TERSE.items() for x in pair]), lower)
    follows = lower.rlike("(?U)(?:" + "|".join(R.FOLLOW_UP_FORMS) + ")") | short
    return (
        F.when(q == "", "").when((F.size(messages) > 0) & (new != q), new).when((F.size(messages) > 0) & last.isNotNull() & follows, asked)
        .otherwise(F.coalesce(terse, q))
    )


def expanded(query: Column) -> Column:
    """The query with the full forms of its acronyms behind it, one for each time an acronym stands in it."""
    full = F.create_map(*[F.lit(x) for pair in R.ACRONYMS.items() for x in pair])
    forms = F.filter(F.transform(tokens(query), lambda w: F.try_element_at(full, w)), lambda f: f.isNotNull())
    return F.when(F.size(forms) > 0, F.concat_ws(" ", query, F.array_join(forms, " "))).otherwise(query)


def spelled(query: Column, known: list[str] | None = None) -> Column:
    """Whole words of the typo table corrected; with a list of known words, unknown long ones take the closest."""
    table = F.create_map(*[F.lit(x) for pair in R.TYPOS.items() for x in pair])
    fixed = F.array_join(F.transform(F.split(query, r"(?U)\s+"), lambda w: F.coalesce(F.try_element_at(table, F.lower(w)), w)), " ")
    if not known:
        return fixed

    @F.pandas_udf("string")
    def closest(texts: pd.Series) -> pd.Series:
        def one(word: str) -> str:
            if len(word) < R.FUZZY_LETTERS or word.lower() in known:
                return word
            return next(iter(difflib.get_close_matches(word.lower(), known, 1, R.FUZZY_CUTOFF)), word)

        return texts.map(lambda t: None if t is None else " ".join(map(one, t.split())))

    return closest(fixed)


def is_compound(query: Column) -> Column:
    starters = F.regexp_count(query, F.lit("(?i)" + R.STARTERS))
    return (word_count(query) >= R.COMPOUND_WORDS) & query.rlike("(?i)" + R.CONJUNCTIONS) & (starters >= 2)


def _splitter(pattern: str):
    return lambda s: F.transform(F.split(s, pattern), stripped)


def sub_questions(query: Column) -> Column:
    """Questions of a compound query in order; one that doesn't split is its only question."""
    q = stripped(query)
    parts = F.array(q)
    for pattern in R.SPLITS:
        cut = F.filter(F.flatten(F.transform(parts, _splitter(pattern))), lambda s: s != "")
        parts = F.when(F.size(cut) > F.size(parts), cut).otherwise(parts)
    long = F.filter(parts, lambda s: F.length(s) >= R.SHORTEST_QUESTION)
    asked = F.transform(long, lambda s: F.concat(F.regexp_replace(s, r"^[ .,;?]+|[ .,;?]+$", ""), F.lit("?")))
    lower = F.transform(asked, F.lower)
    unique = F.filter(asked, lambda s, i: F.array_position(lower, F.lower(s)) == i + 1)
    return F.when(is_compound(q) & (F.size(unique) >= 2), unique).otherwise(F.array(q))


def listed_questions(query: Column) -> Column:
    """Questions of a list: numbered items, or else several question marks, or else joined clauses; in English and Arabic."""
    q = stripped(F.coalesce(query, F.lit("")))
    filled = lambda parts, least: F.filter(F.transform(parts, stripped), lambda s: F.length(s) >= least)
    items = filled(F.transform(filled(F.split(q, R.NUMBERED_ITEM), 1), lambda s: F.regexp_replace(s, R.NUMBER_PREFIX, "")), 1)
    mark = F.when(language(q) == "ar", "\u061f").otherwise("?")
    marked = F.transform(filled(F.split(q, r"[?\x{061F}]"), 1), lambda s: F.concat(s, mark))
    clauses = F.when(language(q) == "ar", filled(F.split(q, R.SPLIT_AR), R.SHORTEST_PART)).otherwise(filled(F.split(q, R.SPLIT_EN), R.SHORTEST_PART))
    several = F.length(q) - F.length(F.replace(q, mark, F.lit(""))) > 1
    return (
        F.when(q == "", F.array().cast("array<string>")).when(F.size(items) > 1, items).when(several & (F.size(marked) > 1), marked)
        .when(F.size(clauses) > 1, clauses).otherwise(F.array(q))
    )


def typed_questions(query: Column) -> Column:
    """Questions of a typed text: numbered items, or else several question marks, or else lines; one that doesn't split is its only question.

    Unlike listed_questions it takes no clauses apart, and only the Latin question mark counts. Null and blank have none.
    """
    q = stripped(F.coalesce(query, F.lit("")))
    filled = lambda parts: F.filter(F.transform(parts, stripped), lambda s: s != "")
    items = F.transform(filled(F.split(q, R.TYPED_ITEM)), lambda s: stripped(F.regexp_replace(s, R.TYPED_NUMBER, "")))
    asked = F.transform(filled(F.split(q, r"[?]")), lambda s: F.concat(s, F.lit("?")))
    rows = filled(lines(q))
    return (
        F.when(q == "", F.array().cast("array<string>")).when(F.size(items) > 1, items)
        .when((F.regexp_count(q, F.lit(r"[?]")) > 1) & (F.size(asked) > 1), asked).when(F.size(rows) > 1, rows).otherwise(F.array(q))
    )
