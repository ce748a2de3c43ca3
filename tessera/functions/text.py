"""Text expressions; Java regular expressions with Unicode classes where the meaning needs them."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import rulesets as R

TOKEN = r"(?U)\b[a-z0-9]+\b"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
WORDS = r"[A-Za-z\x{0600}-\x{06FF}]+"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def collapsed(text: Column) -> Column:
    return F.regexp_replace(stripped(text), r"(?U)\s+", " ")


def folded(text: Column) -> Column:
    """Key that ignores case and the amount of white space."""
    return F.lower(F.upper(collapsed(text)))


def tokens(text: Column) -> Column:
    """Lower-case ASCII words; null text has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def content_words(text: Column) -> Column:
    """Distinct Latin or Arabic words of two letters or more that aren't stop words."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORDS), F.lit(0)))
    stop = F.array(*[F.lit(w) for w in R.STOPWORDS_EN + R.STOPWORDS_AR])
    return F.filter(F.array_except(found, stop), lambda w: F.length(w) > 1)


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), LINE_END)


def sentences(text: Column) -> Column:
    cut = F.split(stripped(text), r"(?U)(?<=[.!?])\s+")
    return F.filter(F.transform(cut, stripped), lambda s: s != "")


def word_count(text: Column) -> Column:
    """Number of pieces between white space."""
    return F.when(stripped(text) == "", 0).otherwise(F.size(F.split(stripped(text), r"(?U)\s+")))


def alternatives(pattern: str) -> list[str]:
    """The parts of a pattern between its outermost bars."""
    parts, begin, depth, at, inside = [], 0, 0, 0, False
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            at += 1
        elif inside:
            inside = c != "]"
        elif c == "[":
            inside = True
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "|" and not depth:
            parts.append(pattern[begin:at])
            begin = at + 1
        at += 1
    return [*parts, pattern[begin:]]


def _by_start(patterns: list[str]) -> str:
    """One pattern for all, which looks at a place's first letter before it tries what begins with a letter."""
    starts = [p for p in patterns if re.match(r"\w(?![?*+{])", p)]
    rest = [p for p in patterns if p not in starts]
    first = "".join(sorted({p[0].lower() for p in starts}))
    return "|".join(([f"(?=[{first}])(?:{'|'.join(starts)})"] if starts else []) + rest)


def any_of(patterns: Iterable[str]) -> str:
    """A pattern that finds what one of the patterns finds. Those that begin at a word's boundary share one test of it, so that
    inside words and at other letters a long text is passed over."""
    every = [a for p in patterns for a in alternatives(p)]
    bound = [p[2:] for p in every if re.match(r"\\b(?![?*+{])", p)]
    rest = [p for p in every if not re.match(r"\\b(?![?*+{])", p)]
    return "|".join(([rf"\b(?:{_by_start(bound)})"] if bound else []) + ([_by_start(rest)] if rest else []))


def matches_any(text: Column, patterns: Iterable[str]) -> Column:
    """Whether one of the patterns is found in the text, whatever the case."""
    return text.rlike("(?iu)(?:" + any_of(patterns) + ")")


def contains_any(text: Column, terms: Iterable[str]) -> Column:
    """Whether the text, in lower case, contains one of the terms."""
    lower, found = F.lower(text), F.lit(False)
    for term in terms:
        found = found | lower.contains(term)
    return found


def starts_word(text: Column, terms: Iterable[str]) -> Column:
    """Whether a word of the text starts with one of the terms."""
    return F.lower(text).rlike("(?U)\\b(?:" + "|".join(t.replace("-", "\\-") for t in terms) + ")")


def language(text: Column) -> Column:
    return F.when(text.rlike(r"[\x{0600}-\x{06FF}]"), "ar").otherwise("en")
