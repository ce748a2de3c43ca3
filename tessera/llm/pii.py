"""Personal data: base patterns, and information-theoretic sanitisation of what reveals them.

DataFrame functions only. The protected entities are the values that the base patterns find. From
co-occurrence in whole documents of the whole corpus, a word t discloses the share PMI(t, e) / IC(e)
of an entity e's information; words that disclose too much are generalised or removed in every text.
An entity of a single text counts too. What is seen in few different texts is discounted, so that there only
words that are rare themselves disclose it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import documents, materialise, text_or_empty

#: Kinds in the order of the contract, with their patterns. Possessive quantifiers and the look-behind change
#: no match; they keep a failing run of characters from being tried again from each of its places.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What every match of a kind holds: texts without it aren't searched with the longer pattern.
_NEEDS = {"email": "@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": r"\+[0-9]"}
#: Least letters of a term.
LETTERS = 3
#: What is taken off the number of different texts that show a term together with an entity; disclosure from which a term is
#: generalised, and removed.
DISCOUNT, GENERALISE, REMOVE = 0.75, 0.75, 0.95

#: Numbers of a block of a running sum; stretches up to which a text is cut by places, and characters of a piece by which it is cut
#: beyond (the same result).
_BLOCK, _FEW, _PIECE = 64, 256, 2048
#: A capital whose small form is two characters: texts with it are searched word by word.
_TWOFOLD = "\u0130"
_TERM = rf"\p{{L}}{{{LETTERS},}}"
#: Terms of so many of all rows, the most frequent ones first, that are set aside before texts are joined with disclosing terms.
_OFTEN, _MOST_OFTEN = 0.002, 8192
SPAN = "array<struct<start:int,ord:int,kind:string,end:int,value:string>>"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(back, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        n = F.length(_digits(m))
        return F.when((n >= 14) & (n <= 19), _luhn(_digits(m))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(m)).between(10, 15)
    return F.lit(True)


def _let(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, add) -> Column:
    """For each of the numbers what add makes of 0 and those before it; add is associative.

    Arrays grow by copies, so the walk goes in blocks of _BLOCK: the cost stays near the length of values.
    """

    def walk(block: Column, start: Column) -> Column:
        step = lambda acc, x: F.struct(add(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(block, F.struct(start.alias("at"), F.array().cast("array<int>").alias("out")), step, lambda acc: acc["out"])

    def blocks(v: Column) -> Column:
        last = F.floor(F.greatest(F.size(v) - 1, F.lit(0)) / _BLOCK).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(v, i * _BLOCK + 1, F.lit(_BLOCK)))

    def from_blocks(bs: Column) -> Column:
        totals = F.transform(bs, lambda block: F.aggregate(block, F.lit(0), lambda x, y: add(x, y)))
        return F.flatten(F.zip_with(bs, walk(totals, F.lit(0)), walk))

    return _let(values, lambda v: _let(blocks(v), from_blocks))


def _matches(text: Column, pattern: str | Column, span) -> Column:
    """span(match, start, end), where it isn't null, of all matches; the pieces between matches and the matches give the places."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    sized = lambda p, m: F.struct(F.length(p).alias("skip"), (F.length(p) + F.coalesce(F.length(m), F.lit(0))).alias("size"), m.alias("match"))
    parts = F.zip_with(F.split(text, pattern, -1), found, sized)

    def placed(ps: Column) -> Column:
        before = running(F.transform(ps, lambda p: p["size"]), lambda x, y: x + y)
        return F.zip_with(ps, before, lambda p, at: F.when(p["match"].isNotNull(), span(p["match"], at + p["skip"], at + p["size"])))  # behind the last piece is no match

    return F.filter(_let(parts, placed), lambda x: x.isNotNull())


def _found(text: Column, kind: str, ordinal: int) -> Column:
    """Spans of one kind, in code points."""

    def span(m: Column, start: Column, end: Column) -> Column:
        value = F.lower(m) if kind in ("email", "ip") else _digits(m)
        return F.when(_valid(kind, m), F.struct(start.alias("start"), F.lit(ordinal).alias("ord"), F.lit(kind).alias("kind"), end.alias("end"), value.alias("value")))

    walk = _matches(text, PATTERNS[kind], span)
    return F.when(text.rlike(_NEEDS[kind]), walk).otherwise(F.array().cast(SPAN))


def base_spans(text: Column) -> Column:
    """All base spans of a text, by start and then kind."""
    return F.array_sort(F.concat(*[_found(text, kind, i) for i, kind in enumerate(PATTERNS)]))


def _terms(text: Column) -> Column:
    """The distinct terms of a text, in small letters."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(_TERM), F.lit(0)), F.lower))


def _places(text: Column, effects: Column) -> Column:
    """Spans of all occurrences of the terms that are keys of effects, a map from term to what is done with it.

    Few terms are looked for by themselves; where they are many, every word is looked up (the same result).
    """

    def span(term: Column, start: Column, end: Column) -> Column:
        effect = F.try_element_at(effects, F.lower(term))
        return F.when(effect.isNotNull(), F.struct(start.alias("start"), F.lit(len(PATTERNS)).alias("ord"), F.lit("term").alias("kind"), end.alias("end"), effect.alias("value")))

    own = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join(F.map_keys(effects), "|"), F.lit(r")(?!\p{L})"))
    few = (F.size(effects) <= _FEW) & ~F.contains(text, F.lit(_TWOFOLD))
    return F.when(few, _let(own, lambda pattern: _matches(text, pattern, span))).otherwise(_matches(text, _TERM, span))


def _replaced(text: Column, spans: Column, by) -> Column:
    """The text with by(stretch) in the place of each stretch of spans: overlapping spans are one, with its first one's label."""
    label = lambda s: F.when(s["kind"] != "term", F.concat(F.lit("["), s["kind"], F.lit("]"))).when(s["value"] == "removed", "").otherwise("[word]")

    def opened(v: Column) -> Column:
        """The first span of each stretch, with the end of the stretch before it."""
        reach = running(F.transform(v, lambda s: s["end"]), F.greatest)
        first = F.zip_with(v, reach, lambda s, r: F.when(s["start"] >= r, F.struct(r.alias("before"), s["start"].alias("start"), label(s).alias("label"))))
        return F.filter(first, lambda x: x.isNotNull())

    def joined(firsts: Column, whole_end: Column) -> Column:
        ends = F.concat(F.transform(F.slice(firsts, 2, F.size(firsts)), lambda x: x["before"]), F.array(whole_end))
        stretches = F.zip_with(firsts, ends, lambda x, e: F.struct(x["before"].alias("before"), x["start"].alias("start"), e.alias("end"), x["label"].alias("label")))
        def parts(cut) -> Column:
            return F.array_join(F.transform(stretches, lambda s: F.concat(cut(s["before"], s["start"] - s["before"]), by(s))), "")

        by_place = parts(lambda at, n: F.substr(text, at + 1, n))  # counts from the text's beginning each time

        def by_pieces(pieces: Column) -> Column:
            """Cuts from a list of pieces of the text, so that none counts through more than a few of them."""

            def cut(at: Column, n: Column) -> Column:
                def inside(k: Column) -> Column:
                    start = F.greatest(at - k * _PIECE, F.lit(0))
                    return F.substr(F.get(pieces, k), start + 1, F.least(at + n - k * _PIECE, F.lit(_PIECE)) - start)

                first, last = F.floor(at / _PIECE).cast("int"), F.floor((at + n - 1) / _PIECE).cast("int")
                return F.when(n <= 0, "").otherwise(F.array_join(F.transform(F.sequence(first, last), inside), ""))

            return parts(cut)

        by_list = _let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0)), by_pieces)
        return F.concat(F.when(F.size(firsts) <= _FEW, by_place).otherwise(by_list), F.substr(text, whole_end + 1, F.length(text)))

    end = F.array_max(F.transform(spans, lambda s: s["end"]))
    return F.when(F.size(spans) == 0, text).otherwise(_let(opened(spans), lambda firsts: joined(firsts, end)))


def _blanked(text: Column, base: Column) -> Column:
    """The text with line feeds in the place of its entities: their own letters are no terms, and places stay."""
    return _replaced(text, base, lambda s: F.repeat(F.lit("\n"), s["end"] - s["start"]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row_no, doc_id, text_hash, base (spans) and terms (the distinct ones outside of the spans), for every row. Rows are numbered
    for what is written: the numbers hold once the result is materialised."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).withColumn("base", base_spans(F.col("text")))
    return rows.select(F.monotonically_increasing_id().alias("row_no"), "doc_id", F.xxhash64("text").alias("text_hash"), "base", _terms(_blanked(F.col("text"), F.col("base"))).alias("terms"))


def entity_classes(scanned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kind, value, class, n_entity, n_texts) of every entity, and (text_hash, class, n_entity, n_texts) of every text and class.

    Entities that stand in the same texts are one class: whatever discloses one discloses all of it alike. So a
    page of thousands of addresses meets its terms once, not once for each address.
    """
    entities = F.array_distinct(F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["value"].alias("value"))))
    held = scanned.where(F.size("base") > 0).select("text_hash", F.explode(entities).alias("e"))
    held = materialise(held.groupBy("text_hash", "e.kind", "e.value").agg(F.count("*").alias("rows")), "held")
    mixed = [F.bit_xor(F.xxhash64("text_hash", F.lit(k))) for k in range(2)]
    classes = held.groupBy("kind", "value").agg(F.struct(F.count("*").alias("n"), mixed[0].alias("x"), mixed[1].alias("y")).alias("class"), F.sum("rows").alias("n_entity"), F.count("*").alias("n_texts"))
    classes = materialise(classes, "classes")
    one = held.join(classes, ["kind", "value"]).groupBy("text_hash", "class").agg(F.max("n_entity").alias("n_entity"), F.max("n_texts").alias("n_texts"))
    return classes, one


def term_counts(scanned: DataFrame) -> DataFrame:
    """(term, n_term), the number of rows that hold it."""
    return scanned.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n_term"))


def class_terms(scanned: DataFrame, of_texts: DataFrame, counts: DataFrame, generalise: float = GENERALISE, discount: float = DISCOUNT) -> DataFrame:
    """(class, term, disclosure, n_seen, text_hash) of the terms that disclose the entities of a class by `generalise` or more.

    Counted over all rows, in whole texts: those with the term, with the entity, and with both. The last is discounted by
    how few different texts it comes from, so copies of one text prove no more than the text. What only one text (of
    text_hash) shows counts for a term that stands in no other text.
    """
    total = float(max(scanned.count(), 1))
    # PMI can't exceed log2(total / n_term), so a term of more rows than this can't reach the threshold
    most = F.pow(F.lit(total), F.lit(1 - generalise)) * F.pow(F.col("n_entity"), F.lit(generalise)) * (1 + 1e-9)
    texts = of_texts.groupBy("text_hash").agg(F.max(most).alias("most"))
    held = scanned.where(F.size("base") > 0).groupBy("text_hash").agg(F.count("*").alias("rows"), F.any_value("terms").alias("terms"))
    rare = held.join(texts, "text_hash").select("text_hash", "rows", "most", F.explode("terms").alias("term")).join(counts, "term").where(F.col("n_term") <= F.col("most"))
    both = rare.drop("most").join(of_texts, "text_hash").where(F.col("n_term") <= most)
    joint = both.groupBy("class", "term").agg(
        F.sum("rows").alias("n_joint"), F.count("*").alias("n_seen"), F.max("n_term").alias("n_term"), F.max("n_entity").alias("n_entity"), F.any_value("text_hash").alias("text_hash"))
    sure = F.col("n_joint") * (F.col("n_seen") - discount) / F.col("n_seen")
    pmi = F.log2(sure * F.lit(total) / (F.col("n_term") * F.col("n_entity")))
    information = F.log2(F.lit(total) / F.col("n_entity"))
    told = joint.where((F.col("n_seen") > 1) | (F.col("n_term") == F.col("n_joint")))
    told = told.select("class", "term", F.when(information > 0, pmi / information).otherwise(F.lit(0.0)).alias("disclosure"), "n_seen", "text_hash")
    return told.where(F.col("disclosure") >= generalise)


def disclosing_terms(scanned: DataFrame, generalise: float = GENERALISE, discount: float = DISCOUNT) -> DataFrame:
    """(kind, value, term, disclosure): what class_terms finds, for every entity."""
    classes, of_texts = entity_classes(scanned)
    return classes.join(class_terms(scanned, of_texts, term_counts(scanned), generalise, discount), "class").select("kind", "value", "term", "disclosure")


def _harmless(counts: DataFrame, effects: DataFrame, total: int) -> list[str]:
    """Frequent terms that disclose nothing. The list only saves work: other terms are joined, these needn't be."""
    often = counts.where(F.col("n_term") >= _OFTEN * total).join(effects, "term", "left_anti").orderBy(F.desc("n_term"), "term").limit(_MOST_OFTEN)
    return [r.term for r in often.select("term").collect()]


def term_spans(
    docs: DataFrame, scanned: DataFrame, terms: DataFrame, counts: DataFrame, remove: float = REMOVE, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, text_hash and extra, the spans of all occurrences of terms (as class_terms gives them), for texts that have any."""
    effect = F.when(F.max("disclosure") >= remove, "removed").otherwise("generalised").alias("effect")
    wide = materialise(terms.where("n_seen > 1").groupBy("term").agg(effect), "effects")
    harmless = _harmless(counts, wide, scanned.count())
    wide = scanned.select("row_no", F.explode(F.filter("terms", lambda t: ~t.isin(harmless))).alias("term")).join(wide, "term").select("row_no", "term", "effect")
    own = terms.where("n_seen = 1").groupBy("text_hash", "term").agg(effect).groupBy("text_hash").agg(F.collect_list(F.struct("term", "effect")).alias("own"))
    own = scanned.select("row_no", "text_hash").join(own, "text_hash").select("row_no", F.inline("own"))
    hits = wide.unionByName(own).groupBy("row_no").agg(F.map_from_entries(F.collect_set(F.struct("term", "effect"))).alias("effects"))
    # rows of one id and text say the same
    hits = scanned.select("row_no", "doc_id", "text_hash", "base").join(hits, "row_no").groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).agg(
        F.any_value("base").alias("base"), F.any_value("effects").alias("effects"))
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    hit = rows.join(hits, rows["doc_id"].eqNullSafe(hits["__id"]) & (rows["text_hash"] == hits["__hash"]))
    places = _let(_blanked(F.col("text"), F.col("base")), lambda text: _places(text, F.col("effects")))
    return hit.select("doc_id", "text_hash", places.alias("extra")).dropDuplicates(["doc_id", "text_hash"])


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **thresholds) -> DataFrame:
    """doc_id, text_hash, spans (base and term), base, for every row; null text is empty and has none.

    Rows are found again by (doc_id, hash of the text), so repeated rows get the same spans each. Empty
    table: empty result. Other columns are ignored.
    """
    remove = thresholds.pop("remove", REMOVE)
    scanned = materialise(scan(docs, id_col, text_col), "scan")
    counts = materialise(term_counts(scanned), "counts")
    terms = materialise(class_terms(scanned, entity_classes(scanned)[1], counts, **thresholds), "disclosing")
    extra = materialise(term_spans(docs, scanned, terms, counts, remove, id_col, text_col), "spans")
    e = extra.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "extra")
    joined = scanned.join(e, scanned["doc_id"].eqNullSafe(e["__id"]) & (scanned["text_hash"] == e["__hash"]), "left")
    spans = F.array_sort(F.concat("base", F.coalesce("extra", F.array().cast(SPAN))))
    return joined.select("doc_id", "text_hash", "base", spans.alias("spans"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(docs: DataFrame, **settings) -> DataFrame:
    """The counts, the digest of the base spans and the list of all spans, for every row."""
    found = detect(docs, **settings)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id", *[count(k) for k in PATTERNS], F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["kind"] == "term")).cast("long").alias("n_term"),
    )


def rewritten(text: Column, spans: Column) -> Column:
    """The text with each base span replaced by its kind in brackets, each generalised term by [word] and each removed one by nothing.

    Where spans overlap they are one stretch, which takes the replacement of the first.
    """
    return _replaced(text, spans, lambda s: s["label"])


def sanitise(docs: DataFrame, **settings) -> DataFrame:
    """docs with personal data and disclosing terms taken out of text; n_chars, if there, follows. Null texts stay null."""
    found = detect(docs, **settings).where(F.size("spans") > 0).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "spans").distinct()
    rows, f = docs.select(F.struct(*docs.columns).alias("row")), found.select(F.struct("*").alias("found"))  # so no names clash
    text, spans = F.coalesce("row.text", F.lit("")), F.col("found.spans")
    out = rows.join(f, F.col("row.doc_id").eqNullSafe(F.col("found.__id")) & (F.xxhash64(text) == F.col("found.__hash")), "left")
    out = out.select("row", spans.alias("spans"), F.when(spans.isNull(), F.col("row.text")).otherwise(rewritten(text, spans)).alias("new"))
    length = F.when(F.col("spans").isNull(), F.col("row.n_chars")).otherwise(F.length("new").cast("long")) if "n_chars" in docs.columns else None
    return out.select(*[F.col("new").alias(c) if c == "text" else length.alias(c) if c == "n_chars" else F.col("row").getField(c).alias(c) for c in docs.columns])


def op2_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(documents(spark, sf_dir))


QUERIES = {"op2_disclosure": op2_disclosure}
ORACLES: dict[str, str] = {}
