"""URL filter: rules first, then naive Bayes on the words that hosts and paths are made of."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from secondcart.llm.common import exact_columns
from secondcart.llm.rows import ROW, identified
from secondcart.operators.joins import lookup_by_hot_key
from secondcart.sources.writers import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Share of a word's probability that comes from the public vocabulary, the rest is the corpus's;
# and the least that a word of the labelled names has.
PUBLIC_SHARE = 0.5
SEED_PROBABILITY = 1e-6
# Size of the corpus that an unknown run of letters is measured against. It is fixed, so that the
# split of a name does not depend on the number of pages.
TOTAL = 1e9
PRIOR_BLOCK = 0.2
SMOOTHING = 0.5
MARKUP = r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->|<[^>]*>|&#?[a-z0-9]+;"


@dataclass(frozen=True)
class Rule:
    """``allow`` or ``block`` for a host, its subdomains and paths that start with a prefix."""

    action: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def rules_of(lines: list[str]) -> list[Rule]:
    """Rules from lines such as ``block example.com/en/``."""
    out = []
    for line in lines:
        action, _, where = line.strip().partition(" ")
        host, slash, path = where.strip().partition("/")
        if action not in ("allow", "block") or not host:
            raise ValueError(f"not a rule: {line!r}")
        out.append(Rule(action, host, slash + path))
    return out


DEFAULT_RULES = [
    "allow com/",
    "block example.com/en/",
    "allow www.example.com/en/",
    "block net/es/",
    "block net/fr/",
]

# Labelled names from which naive Bayes is trained, one name per line. Words are
# separated where a reader would separate them; the names are glued together for training, so
# that they pass through the same segmentation as hosts do. Words of a site's structure, such as
# www, blog, index or page, are in no name and have no weight.
BLOCK_NAMES = """
adult video
xxx porn
free porn
sex cams
live sex chat
adult dating
escort girls
online casino
casino bonus
free spins
slots jackpot
poker bets
sports betting
bet win
lottery winner
online pharmacy
viagra pills
buy cialis
weight loss pills
diet pills
replica watches
cheap replica
link farm
link spam
seo spam
ad tracker
ads server
click ads
popup ads
track click
pixel tracker
doubleclick ads
payday loans
cheap loans
fast cash
earn money fast
crypto scam
free crypto
forex signals
torrent warez
crack keygen
free download crack
phishing login
malware download
"""
ALLOW_NAMES = """
news paper
daily news
science news
world news
city library
public library
university press
state university
school education
health journal
medical journal
open source
developer docs
software docs
wiki encyclopedia
history museum
art museum
music archive
book review
cooking recipes
travel guide
weather report
sports news
city council
government portal
research institute
math forum
physics lecture
garden club
photo album
personal diary
tech magazine
code review
data science
map atlas
film review
language learning
language dictionary
community forum
help center
product support
online shop
company about
"""


def seeds() -> list[tuple[str, list[str]]]:
    """Label and words of each labelled name."""
    return [
        (label, line.split())
        for label, block in (("block", BLOCK_NAMES), ("allow", ALLOW_NAMES))
        for line in block.strip().splitlines()
    ]


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def first_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, as a struct of its text and action; NULL if none does. Of
    equally long rules a blocking one wins."""
    order = sorted(rules, key=lambda r: (-len(r.text), r.action != "block", r.text))
    fits = [
        F.when(
            ((host == r.host) | F.endswith(host, F.lit(f".{r.host}")))
            & F.startswith(path, F.lit(r.path)),
            F.struct(F.lit(r.text).alias("text"), F.lit(r.action).alias("action")),
        )
        for r in order
    ]
    nothing = F.lit(None).cast("struct<text: string, action: string>")
    return F.coalesce(*fits, nothing)


def letters(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit("[a-z]+"), F.lit(0))


def corpus_words(pages: DataFrame) -> DataFrame:
    """``(word, n)``: how often each word occurs in the visible text of all pages."""
    visible = F.regexp_replace(F.coalesce("html", F.lit("")), MARKUP, " ")
    return (
        pages.select(F.explode(letters(visible)).alias("word"))
        .groupBy("word")
        .agg(F.count("*").alias("n"))
    )


def public_words(path: str) -> list[tuple[str, float]]:
    """Words of a public vocabulary of whole-word tokens, by Zipf's law of their ranks.

    The file's tokens are ordered by how early they were merged, that is by frequency; those that
    end a word and have three letters or more are words.
    """
    with open(path, encoding="utf-8") as f:
        ranks = json.load(f)["model"]["vocab"]
    ends = sorted((i, t.removesuffix("</w>")) for t, i in ranks.items() if t.endswith("</w>"))
    words = [w for _, w in ends if len(w) >= 3 and w.isascii() and w.isalpha() and w.islower()]
    whole = sum(1 / k for k in range(1, len(words) + 1))
    return [(w, 1 / (k * whole)) for k, w in enumerate(words, 1)]


def language_model(
    corpus: DataFrame, public: list[tuple[str, float]], known: list[str]
) -> DataFrame:
    """``(word, n)``: counts out of ``TOTAL`` from corpus and public vocabulary; words of the
    labelled names are words, however rare they are."""
    spark = corpus.sparkSession
    total = float(corpus.agg(F.sum("n")).first()[0] or 0)
    own = 1 - PUBLIC_SHARE if public else 1.0
    parts = corpus.select("word", (F.col("n") * F.lit(own * TOTAL / max(total, 1))).alias("n"))
    listed = [(w, p * PUBLIC_SHARE * TOTAL) for w, p in public]
    listed += [(w, SEED_PROBABILITY * TOTAL) for w in known]
    more = spark.createDataFrame(listed, "word string, n double")
    return parts.unionAll(more).groupBy("word").agg(F.sum("n").alias("n"))


def best_split(token: str, found: dict[tuple[int, int], float], total: float) -> list[str]:
    """Most likely way to write ``token`` as words (Viterbi over its positions).

    ``found`` has the log probability of each known word by start and length. A run of letters
    that is no word has probability 10 / total, less by ten for every letter; it may be of any
    length, and its best start is carried along.
    """
    n = len(token)
    by_end: dict[int, list[tuple[int, float]]] = {}
    for (start, size), p in found.items():
        by_end.setdefault(start + size, []).append((start, p))
    letter, opening = math.log(10.0), math.log(10.0 / total)
    best, back = [0.0] + [-math.inf] * n, [0] * (n + 1)
    run, run_start = -math.inf, 0
    for end in range(1, n + 1):
        if best[end - 1] + opening > run:
            run, run_start = best[end - 1] + opening, end - 1
        run -= letter
        best[end], back[end] = run, run_start
        for start, p in by_end.get(end, ()):
            if best[start] + p >= best[end]:
                best[end], back[end] = best[start] + p, start
    out, end = [], n
    while end:
        out.append(token[back[end] : end])
        end = back[end]
    return out[::-1]


def _split_tokens(batches, total: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tokens, split = [], []
        for row in batch.to_pylist():
            found = {(x["at"], x["len"]): x["p"] for x in row["found"]}
            tokens.append(row["token"])
            split.append(best_split(row["token"], found, total))
        yield pa.RecordBatch.from_arrays(
            [pa.array(tokens, pa.string()), pa.array(split, pa.list_(pa.string()))],
            names=["token", "words"],
        )


def segmented(tokens: DataFrame, vocabulary: DataFrame, total: float = TOTAL) -> DataFrame:
    """``(token, words)`` for every distinct token.

    Tokens meet the word counts by a join on their substrings, so neither the vocabulary nor the
    tokens have to fit anywhere; what one token gathers is bounded by its own length.
    """
    # Lengths of words, of which there are few different ones however many words there are.
    lengths = [
        r["size"] for r in vocabulary.select(F.length("word").alias("size")).distinct().collect()
    ]
    n = F.length("token")
    spans = F.flatten(
        F.transform(
            F.sequence(F.lit(1), n),
            lambda at: F.transform(
                F.filter(F.lit(sorted(lengths) or [1]), lambda size: size <= n - at + 1),
                lambda size: F.struct(
                    (at - 1).alias("at"),
                    size.alias("len"),
                    F.substring(F.col("token"), at, size).alias("word"),
                ),
            ),
        )
    )
    parts = tokens.select("token", F.explode(spans).alias("s")).select("token", "s.*")
    p = F.log(F.col("n") / F.lit(total))
    known = (
        parts.join(vocabulary, "word")
        .groupBy("token")
        .agg(F.collect_list(F.struct("at", "len", p.alias("p"))).alias("found"))
    )
    nothing = F.expr("cast(array() as array<struct<at: int, len: int, p: double>>)")
    every = tokens.join(known, "token", "left").select(
        "token", F.coalesce("found", nothing).alias("found")
    )
    return every.mapInArrow(
        lambda batches: _split_tokens(batches, total), "token string, words array<string>"
    )


def bayes_weights(counts: dict[tuple[str, str], int]) -> dict[str, float]:
    """Log odds for ``block`` of every word of the labelled names."""
    words = sorted({w for w, _ in counts})
    total = {
        label: sum(counts.get((w, label), 0) for w in words) + SMOOTHING * len(words)
        for label in ("block", "allow")
    }
    return {
        w: math.log((counts.get((w, "block"), 0) + SMOOTHING) / total["block"])
        - math.log((counts.get((w, "allow"), 0) + SMOOTHING) / total["allow"])
        for w in words
    }


def _seed_table(spark: SparkSession, labelled: list[tuple[str, list[str]]]) -> DataFrame:
    rows = [(label, "".join(words)) for label, words in labelled]
    return spark.createDataFrame(rows, "label string, token string")


def judge_urls(
    pages: DataFrame,
    rules: list[Rule],
    labelled: list[tuple[str, list[str]]] | None = None,
    public: list[tuple[str, float]] | None = None,
) -> DataFrame:
    """Verdict on every row's url: page_id, host, path, rule, verdict, score.

    The longest rule that fits decides (see :func:`first_rule`). Otherwise the words of host and
    path do: their letters are split by unigram Viterbi with the word counts of all pages' visible
    text, mixed with those of ``public`` (words and their probabilities, see
    :func:`public_words`), and multinomial naive Bayes, trained on ``labelled`` names (label and words; a bounded
    list that is given, not gathered), blocks at positive log odds. Words that no labelled name
    has say nothing.

    A url that is NULL or has no ``://`` has an empty host and path and, as no rule fits, is
    judged by the prior alone: allowed. Very long urls are judged whole, token by token. NULL and
    repeated ``page_id`` are passed on; each row is judged, and equal urls alike. Pages without html
    add no words; an empty table gives an empty result. Other columns are ignored, whatever their
    names.
    """
    spark = pages.sparkSession
    labelled = seeds() if labelled is None else labelled
    rows = identified(exact_columns(pages, "page_id", "url"), "page_id")
    host, path = host_and_path(F.col("url"))
    parsed = rows.select(ROW, "page_id", host.alias("host"), path.alias("path"))
    used = parsed.select(ROW, F.explode(letters(F.concat_ws(" ", "host", "path"))).alias("token"))
    counts = used.groupBy("token").agg(F.count("*").alias("n"))

    corpus = materialize(corpus_words(exact_columns(pages, "html")), "word-counts")
    known = sorted({w for _, words in labelled for w in words})
    vocabulary = materialize(language_model(corpus, public or [], known), "words")

    names = _seed_table(spark, labelled)
    tokens = counts.unionAll(names.select("token", F.lit(0).alias("n")))
    tokens = materialize(tokens.groupBy("token").agg(F.sum("n").alias("n")), "url-tokens")
    split = materialize(segmented(tokens.select("token"), vocabulary), "split-tokens")
    trained = (
        names.join(split, "token")
        .select("label", F.explode("words").alias("word"))
        .groupBy("word", "label")
        .count()
        .collect()  # at most the words of the labelled names
    )
    weights = bayes_weights({(r["word"], r["label"]): r["count"] for r in trained})
    table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    odds = F.aggregate(
        "words",
        F.lit(0.0),
        lambda acc, w: acc + F.coalesce(F.try_element_at(table, w), F.lit(0.0)),
    )
    scored = split.join(tokens, "token").select("token", "n", odds.alias("odds"))
    per_page = (
        lookup_by_hot_key(used, scored, "token", "n").groupBy(ROW).agg(F.sum("odds").alias("odds"))
    )
    prior = math.log(PRIOR_BLOCK / (1 - PRIOR_BLOCK))
    rule = first_rule(F.col("host"), F.col("path"), rules)
    score = F.round(F.coalesce("odds", F.lit(0.0)) + prior, 9)
    return (
        parsed.join(per_page, ROW, "left")
        .withColumn("fit", rule)
        .withColumn("score", score)
        .select(
            F.col("page_id").cast("long").alias("page_id"),
            "host",
            "path",
            F.col("fit.text").alias("rule"),
            F.coalesce("fit.action", F.when(F.col("score") > 0, "block").otherwise("allow")).alias(
                "verdict"
            ),
            "score",
        )
    )
