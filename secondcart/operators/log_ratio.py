"""Text classes by log counts of hashed words and word pairs, for all folds in one pass.

What a fold may learn from is the total of all folds less its own counts, so texts are read once to
count and once to score, whatever the number of folds. Nothing here needs Python or a fit.
"""

from __future__ import annotations

from functools import reduce
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from secondcart.sources.writers import materialize

BUCKETS = 1 << 16  # four hexadecimal digits
PAIR_FACTOR = 31
SCALE = 1000  # logarithms are whole thousandths, so that sums have no order
CLASSES = 3


def word_buckets(text: Column) -> Column:
    """Buckets of words and of pairs of neighbouring words, repeats included. A word's is the
    start of its MD5; a pair's is made of those of its words."""
    lower = F.translate(text, ascii_uppercase, ascii_lowercase)
    words = F.filter(F.split(lower, r"[\x09-\x0D ]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.conv(F.substring(F.md5(w), 1, 4), 16, 10).cast("int"))


def _with_pairs(words: Column) -> Column:
    # the last word has none after it, and NULL makes the pair NULL
    after = F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1)))
    pairs = F.zip_with(words, after, lambda a, b: (a * PAIR_FACTOR + b) % BUCKETS)
    return F.concat(words, F.filter(pairs, lambda p: p.isNotNull()))


def hashed_grams(rows: DataFrame, id_column: str) -> DataFrame:
    """One row per text: ``id_column``, ``label``, ``fold``, ``words`` (buckets in order)."""
    return rows.select(id_column, "label", "fold", word_buckets(F.col("text")).alias("words"))


def _log(part: Column, whole: Column) -> Column:
    return F.floor(F.log(part.cast("double") / whole.cast("double")) * SCALE)


def _class_counts() -> list[Column]:
    return [F.count_if(F.col("label") == c).alias(f"n{c}") for c in range(CLASSES)]


def log_counts(grams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Log counts by fold and bucket, and log priors by fold: at most ``BUCKETS`` rows and one row
    for each fold, however many texts there are."""
    names = [f"n{c}" for c in range(CLASSES)]
    # Counts are added up in the tasks before they are shuffled, so a hot word is no hot key.
    seen = grams.select("label", "fold", F.explode(_with_pairs(F.col("words"))).alias("bucket"))
    own = materialize(seen.groupBy("fold", "bucket").agg(*_class_counts()), "gram-counts")
    total = own.groupBy("bucket").agg(
        *[F.sum(n).alias(f"t{c}") for c, n in enumerate(names)]
    )
    # Every bucket of a text to score is a bucket of its fold.
    rest = own.join(total, "bucket").select(
        "fold", "bucket", *[(F.col(f"t{c}") - F.col(n)).alias(n) for c, n in enumerate(names)]
    )
    sums = _with_totals(own.groupBy("fold").agg(*[F.sum(n).alias(n) for n in names]))
    smoothed = [
        _log(F.col(f"n{c}") + 1, F.col(f"s{c}") + BUCKETS).alias(f"g{c}") for c in range(CLASSES)
    ]
    gains = rest.join(F.broadcast(sums), "fold").select("fold", "bucket", *smoothed)

    docs = _with_totals(grams.groupBy("fold").agg(*_class_counts()))
    all_docs = sum((F.col(f"s{c}") for c in range(CLASSES)), F.lit(CLASSES))
    priors = docs.select(
        "fold", *[_log(F.col(f"s{c}") + 1, all_docs).alias(f"p{c}") for c in range(CLASSES)]
    )
    return gains, priors


def _with_totals(by_fold: DataFrame) -> DataFrame:
    """Sums of all folds less the row's own, from one row per fold."""
    total = by_fold.agg(*[F.sum(f"n{c}").alias(f"t{c}") for c in range(CLASSES)])
    return by_fold.select(
        "fold",
        *[
            (total.select(f"t{c}").scalar() - F.col(f"n{c}")).alias(f"s{c}")
            for c in range(CLASSES)
        ],
    )


def log_ratio_scores(rows: DataFrame, id_column: str = "review_id") -> DataFrame:
    """Out-of-fold scores of ``rows`` (``id_column``, ``text``, ``label``, ``fold``).

    Returns ``id_column``, ``label``, ``fold``, ``score_neg``, ``score_neu``, ``score_pos`` (log
    probability up to a constant, in thousandths), ``prob_neg``, ``prob_neu``, ``prob_pos`` and
    ``prediction``; the smaller class wins a tie. Ids are unique. A text without a word has the
    score of its class priors; an unknown class (NULL label) is scored and not learnt from. An
    empty table gives an empty result.
    """
    return scores_of_grams(hashed_grams(rows, id_column), id_column)


def scores_of_grams(hashed: DataFrame, id_column: str = "review_id") -> DataFrame:
    """As :func:`log_ratio_scores`, from rows of :func:`hashed_grams`."""
    grams = materialize(hashed, "grams")
    gains, priors = log_counts(grams)
    names = ["neg", "neu", "pos"]
    # At most BUCKETS rows per fold of five numbers.
    keys = [id_column, "label", "fold"]
    scored = (
        grams.select(*keys, F.explode_outer(_with_pairs(F.col("words"))).alias("bucket"))
        .join(F.broadcast(gains), ["fold", "bucket"], "left")
        .groupBy(*keys)
        .agg(*[F.coalesce(F.sum(f"g{c}"), F.lit(0)).alias(f"g{c}") for c in range(CLASSES)])
        .join(F.broadcast(priors), "fold")
        .select(
            id_column, "label", "fold",
            *[(F.col(f"g{c}") + F.col(f"p{c}")).alias(f"score_{n}") for c, n in enumerate(names)],
        )
    )
    scores = [F.col(f"score_{n}") for n in names]
    best = F.greatest(*scores)
    parts = [F.exp((s - best) / SCALE) for s in scores]
    prediction = F.array_position(F.array(*scores), best) - 1
    return scored.withColumns(
        {f"prob_{n}": p / reduce(Column.__add__, parts) for n, p in zip(names, parts, strict=True)}
        | {"prediction": prediction.cast("int")}
    )
