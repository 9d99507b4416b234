"""Personal data and the terms of its documents that give it away, with DataFrame functions alone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from secondcart.llm.common import exact_columns
from secondcart.llm.rows import BROADCAST_ROWS, ROW, identified
from secondcart.operators.joins import lookup_by_hot_key
from secondcart.sources.writers import materialize

# A private-use character that stands for a separator inside a chain, so that a chain is a run of
# one character class: Java matches such runs without recursion, however long they are.
MARK = "\uE000"
STAND_IN = "\uE001"

LABEL = "A-Za-z0-9-"
LOCAL = "A-Za-z0-9._%+" + MARK + "-"
# Local parts are tried from the start of their run, or from the end of the last match, only:
# every later start of the run meets the same '@'.
EMAIL = rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[{LABEL}]++{MARK}[{MARK}{LABEL}]++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = rf"[0-9][{MARK}0-9]++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
DOTS = rf"(?<=[{LABEL}])\.(?=[{LABEL}])"
GAPS = r"(?<=[0-9])[ -](?=[0-9])"
IP_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
IP_VALID = rf"^{IP_PART}(?:\.{IP_PART}){{3}}$"

KINDS = ("email", "ip", "card", "phone")
GENERALISED, REMOVED = "generalised", "removed"

TERM = r"\p{L}{3,}"
# Documents' worth of doubt in what a term says: its documents count as so many more, in which the
# entity is as frequent as anywhere. A term of one document thus tells less than one of many.
DOUBT = 2.0
# Share of an entity's information that a term reveals, from which it is generalised or removed.
GENERALISE_AT = 0.6
REMOVE_AT = 0.8


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit fits."""

    def doubled(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when((F.length(digits) - i) % 2 == 1, twice).otherwise(d)

    total = F.aggregate(
        F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda acc, i: acc + doubled(i)
    )
    return total % 10 == 0


def _valid(kind: Column, value: Column) -> Column:
    digits = _digits(value)
    n = F.length(digits)
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", value.rlike(IP_VALID))
        .when(kind == "card", F.when(n.between(12, 19), luhn(digits)).otherwise(False))
        .otherwise(n.between(9, 15))
    )


def _matches(text: Column, kind: str, pattern: str, order: int) -> Column:
    """All matches in order, each with the length of the text before it since the last match."""
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # Zipped, so that each array is made once and not again for every element of a lambda.
    zipped = F.arrays_zip(values, F.split(text, pattern, -1))

    def described(z: Column, i: Column) -> Column:
        return F.struct(
            F.lit(order).alias("order"),
            F.lit(kind).alias("kind"),
            i.alias("at"),
            F.length(z["1"]).cast("long").alias("gap"),
            z["0"].alias("value"),
        )

    # There is one piece more than there are values.
    return F.transform(F.filter(zipped, lambda z: z["0"].isNotNull()), described)


def base_matches(rows: DataFrame) -> DataFrame:
    """Every match of the four patterns: _row, order, kind, value, start, end.

    Positions are sums over the matches before, in a window over a document's own matches, so a
    document with very many of them is no worse than it is long.
    """
    text = F.col("text")
    own = F.when(F.contains(text, F.lit(MARK)), F.replace(text, F.lit(MARK), F.lit(STAND_IN)))
    none = F.expr(
        "cast(array() as array<struct<order: int, kind: string, at: int, gap: bigint,"
        " value: string>>)"
    )
    texts = {
        "email": F.regexp_replace("own", DOTS, MARK),
        "ip": F.col("own"),
        "card": F.regexp_replace("own", GAPS, MARK),
        "phone": F.col("own"),
    }
    hints = {
        "email": F.contains("own", F.lit("@")),
        "ip": F.col("own").rlike(r"[0-9]\.[0-9]"),
        "card": F.col("own").rlike(r"[0-9](?:[ -]?[0-9]){11}"),
        "phone": F.col("own").rlike(r"\+[0-9]"),
    }
    patterns = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
    hinted = (
        rows.where(text.rlike("[@0-9]"))
        .select(ROW, F.coalesce(own, text).alias("own"))
        .where(reduce(lambda a, b: a | b, hints.values()))
    )
    found = F.concat(
        *[
            F.when(hints[k], _matches(texts[k], k, patterns[k], i)).otherwise(none)
            for i, k in enumerate(KINDS)
        ]
    )
    in_order = Window.partitionBy(ROW, "order").orderBy("at")
    size = F.length("value").cast("long")
    up_to = F.sum(F.col("gap") + size).over(in_order)
    return (
        hinted.select(ROW, F.explode(found).alias("m"))
        .select(ROW, "m.*")
        .select("*", (up_to - size).alias("start"), up_to.alias("end"))
        .where(_valid(F.col("kind"), F.col("value")))
        .drop("at", "gap")
    )


def entities_of(matches: DataFrame) -> DataFrame:
    """``_row, entity`` of every match, however it is written: one row per document and entity."""
    value = F.col("value")
    entity = F.concat_ws(
        ":",
        "kind",
        F.when(F.col("kind") == "email", F.lower(value))
        .when(F.col("kind") == "ip", value)
        .otherwise(_digits(value)),
    )
    return matches.select(ROW, entity.alias("entity")).distinct()


def companies_of(entities: DataFrame) -> DataFrame:
    """``_row, company, n_entity``: entities that occur in the very same documents as one company.

    Nothing that is counted by document can tell such entities apart, and a document with very
    many entities that occur nowhere else has one company. A company is named by a digest of its
    set of documents, which does not depend on their order.
    """
    sets = entities.groupBy("entity").agg(
        F.count("*").alias("n_entity"),
        F.bit_xor(F.xxhash64(ROW)).alias("a"),
        F.bit_xor(F.xxhash64(ROW, F.lit(1))).alias("b"),
    )
    named = sets.select("entity", "n_entity", F.concat_ws(":", "n_entity", "a", "b").alias("company"))
    found = lookup_by_hot_key(entities, named, "entity", "n_entity")
    return found.select(ROW, "company", "n_entity").distinct()


def term_occurrences(rows: DataFrame) -> DataFrame:
    """Every term of ``rows``, lower-cased, with its place: _row, term, start, end."""
    values = F.regexp_extract_all("text", F.lit(TERM), F.lit(0))
    zipped = F.arrays_zip(values, F.split("text", TERM, -1))
    listed = F.filter(zipped, lambda z: z["0"].isNotNull())
    size = F.length("term").cast("long")
    up_to = F.sum(F.col("gap") + size).over(Window.partitionBy(ROW).orderBy("at"))
    return (
        rows.select(ROW, F.posexplode(listed).alias("at", "z"))
        .select(ROW, "at", F.col("z.0").alias("term"), F.length("z.1").cast("long").alias("gap"))
        .select(ROW, "term", (up_to - size).alias("start"), up_to.alias("end"))
        .withColumn("term", F.lower("term"))
    )


def document_frequency(rows: DataFrame) -> DataFrame:
    """Number of documents of the whole corpus that hold each term."""
    terms = F.array_distinct(
        F.transform(F.regexp_extract_all("text", F.lit(TERM), F.lit(0)), lambda t: F.lower(t))
    )
    return (
        rows.select(F.explode(terms).alias("term"))
        .groupBy("term")
        .agg(F.count("*").alias("n_term"))
    )


def disclosure(n_both: Column, n_term: Column, n_entity: Column, n_docs: int) -> Column:
    """Share of an entity's information that a term reveals, from counts of documents.

    A document holds the entity with P(e) = n_entity / n_docs, and if it has the term with
    P(e|t) = (n_both + DOUBT * P(e)) / (n_term + DOUBT). The term tells log2(P(e|t) / P(e)) bits
    out of the log2(1 / P(e)) that the entity itself holds: nearly 1 if the term occurs with the
    entity only and often, 0 if the two are independent. An entity of every document holds none.
    """
    p = n_entity / F.lit(float(n_docs))
    given = (n_both + DOUBT * p) / (n_term + DOUBT)
    return F.try_divide(F.log2(given / p), -F.log2(p))


def disclosing_terms(
    terms: DataFrame, companies: DataFrame, frequency: DataFrame, n_docs: int
) -> DataFrame:
    """Terms that reveal an entity of their document: _row, term, disclosure.

    ``terms(_row, term)`` has the different terms of documents with entities. Terms and entities
    meet in whole documents; pairs are counted in the tasks before they are moved.
    """
    pair = F.struct("company", "term").alias("pair")
    pairs = materialize(terms.join(companies, ROW).select(ROW, pair, "n_entity"), "pairs")
    counted = pairs.groupBy("pair", "n_entity").agg(F.count("*").alias("n_both"))
    share = disclosure(F.col("n_both"), F.col("n_term"), F.col("n_entity"), n_docs)
    telling = (
        counted.withColumn("term", F.col("pair.term"))
        .join(frequency, "term")
        .select("pair", "n_both", share.alias("disclosure"))
        .where(F.col("disclosure") >= GENERALISE_AT)
    )
    found = lookup_by_hot_key(pairs.select(ROW, "pair"), telling, "pair", "n_both")
    return (
        found.where(F.col("disclosure").isNotNull())
        .groupBy(ROW, F.col("pair.term").alias("term"))
        .agg(F.max("disclosure").alias("disclosure"))
    )


def marked_terms(rows: DataFrame, matches: DataFrame) -> DataFrame:
    """Every place of a disclosing term: _row, start, end, disclosure."""
    entities = materialize(entities_of(matches), "entities")
    companies = materialize(companies_of(entities), "companies")
    holders = companies.select(ROW).distinct()
    if holders.count() <= BROADCAST_ROWS:
        holders = F.broadcast(holders)
    with_entities = rows.select(ROW, "text").join(holders, ROW, "left_semi")
    places = materialize(term_occurrences(with_entities), "terms")
    terms = places.select(ROW, "term").distinct()
    # Written, so that counting stays below the join: every term is joined once, not in every text.
    frequency = materialize(document_frequency(rows), "frequency")
    telling = disclosing_terms(terms, companies, frequency, rows.count())
    return places.join(telling, [ROW, "term"]).select(ROW, "start", "end", "disclosure")


def clear_of_base(spans: DataFrame) -> DataFrame:
    """``spans`` without terms that overlap a base span of their document.

    Base spans that start before a term, and those that start inside it, are met in windows over
    the document's spans in order and in reverse.
    """
    is_base = F.col("order") < len(KINDS)
    forward = (
        Window.partitionBy(ROW).orderBy("start", "order").rowsBetween(Window.unboundedPreceding, -1)
    )
    backward = (
        Window.partitionBy(ROW)
        .orderBy(F.desc("start"), F.desc("order"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    before = F.coalesce(F.max(F.when(is_base, F.col("end"))).over(forward), F.lit(-1))
    after = F.min(F.when(is_base, F.col("start"))).over(backward)
    return (
        spans.withColumn("before", before)
        .withColumn("after", F.coalesce(after, F.col("end")))
        .where(is_base | ((F.col("before") <= F.col("start")) & (F.col("after") >= F.col("end"))))
        .drop("before", "after")
    )


SPAN = "struct<start: bigint, order: int, kind: string, end: bigint>"


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Spans of personal data and of terms that disclose it, one row per row of ``docs``.

    Columns: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, found. ``found`` is a
    list of (start, order, kind, end) in code points, end exclusive; ``spans`` writes it as
    ``kind:start:end`` with commas, ``base_sha256`` hashes the same for the four base kinds.
    In documents with base entities every place of a term whose corpus counts disclose one of them
    (:func:`disclosure`) is marked ``generalised`` or, above ``REMOVE_AT``, ``removed``. Terms are
    runs of three letters or more, in any case; those that overlap a base span are not marked
    again. Documents without base entities have no spans.

    A NULL text is empty. Very long texts and texts with very many matches are handled span by
    span. Rows may share ids or have none (they are numbered then); repeated rows are documents of
    their own and count as such. Equal disclosures of several entities are one. Other columns are
    ignored, whatever their names. An empty table gives an empty result.
    """
    rows = identified(exact_columns(docs, "doc_id", "text"))
    matches = materialize(base_matches(rows), "matches")
    kind = F.when(F.col("disclosure") >= REMOVE_AT, REMOVED).otherwise(GENERALISED)
    marked = marked_terms(rows, matches).select(
        ROW, "start", F.lit(len(KINDS)).alias("order"), kind.alias("kind"), "end"
    )
    base = matches.select(ROW, "start", "order", "kind", "end")
    span = F.struct("start", "order", "kind", "end").cast(SPAN)
    listed = (
        clear_of_base(base.unionAll(marked))
        .groupBy(ROW)
        .agg(F.sort_array(F.collect_list(span)).alias("all"))
    )
    is_base = lambda s: s["order"] < len(KINDS)
    of_kind = lambda kind: lambda s: s["kind"] == kind
    written = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )
    none = F.expr(f"cast(array() as array<{SPAN}>)")
    return (
        rows.select(ROW, "doc_id")
        .join(listed, ROW, "left")
        .withColumn("found", F.coalesce(F.col("all"), none))
        .withColumn("base", F.filter("found", is_base))
        .select(
            F.col("doc_id").cast("long").alias("doc_id"),
            *[
                F.size(F.filter("base", of_kind(k))).cast("long").alias(f"n_{k}")
                for k in KINDS
            ],
            F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256"),
            written(F.col("found")).alias("spans"),
            "found",
        )
    )
