"""Review sentiment by cross-fitting: every text is scored by a model that never saw it."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from secondcart.functions.binning import label_of
from secondcart.functions.lookups import POLARITY_NAMES, RATING_POLARITY, lookup
from secondcart.functions.text import consolidated_text, has_text
from secondcart.operators.models import run_parallel
from secondcart.operators.sampling import stratified_folds

TEXT_FEATURES = 1 << 15
ROWS_PER_PARTITION = 20_000
OUTPUT_COLUMNS = [
    "review_id", "order_id", "review_score", "review_creation_date", "has_text",
    "prob_neg", "prob_neu", "prob_pos", "sentiment_label", "fold",
]

# Fits on the first table and adds ``probability`` (array of one value per class) to the second.
Scorer = Callable[[DataFrame, DataFrame], DataFrame]


def polarity_label(rating: Column) -> Column:
    """Weak label from the rating: 0 negative, 1 neutral, 2 positive."""
    return lookup(rating, RATING_POLARITY)


def with_review_text(reviews: DataFrame) -> DataFrame:
    """Adds the consolidated text, its flag and the weak label."""
    text = consolidated_text(F.col("review_comment_title"), F.col("review_comment_message"))
    return reviews.withColumn("text", text).withColumns(
        {
            "has_text": has_text(F.col("text")),
            "label": polarity_label(F.col("review_score")),
        }
    )


def hashed_words(rows: DataFrame) -> DataFrame:
    """Adds ``counts``, the hashed words of the whole text. Nothing is learnt here, so it can be
    done once for all folds."""
    words = RegexTokenizer(inputCol="text", outputCol="words", pattern=r"(?U)\W+")
    counts = HashingTF(inputCol="words", outputCol="counts", numFeatures=TEXT_FEATURES)
    return counts.transform(words.transform(rows)).drop("words")


def word_table(labelled: DataFrame) -> DataFrame:
    """The hashed words of ``labelled`` with all columns but the texts, which the fits do not read,
    in partitions of a bounded number of rows, however large the source's splits are."""
    partitions = max(1, math.ceil(labelled.count() / ROWS_PER_PARTITION))
    rows = hashed_words(labelled).drop("text", "review_comment_title", "review_comment_message")
    return rows.repartition(partitions, "review_id")


def bag_of_words_scorer(train: DataFrame, rows: DataFrame) -> DataFrame:
    """Multinomial logistic regression on inversely weighted words; the length of a text is
    divided out."""
    idf = IDF(inputCol="counts", outputCol="weighted")
    unit = Normalizer(inputCol="weighted", outputCol="features")
    regression = LogisticRegression(
        family="multinomial", regParam=1e-4, standardization=False, maxIter=30, tol=1e-5
    )
    if "counts" not in rows.columns:
        train, rows = hashed_words(train), hashed_words(rows)
    model = Pipeline(stages=[idf, unit, regression]).fit(train.select("label", "counts"))
    return model.transform(rows).withColumn("probability", vector_to_array("probability"))


def batch_scorer(make_predict: Callable[[], Callable], batch_size: int = 64) -> Scorer:
    """Scorer around an external, already trained model. ``make_predict`` is called once per
    Python worker and returns a function from an array of texts to class probabilities.

    Nothing is trained here, so the training fold is not used: the scores are those of a model
    that never saw the texts only if that model was trained on other texts."""
    predict = predict_batch_udf(
        make_predict, return_type=ArrayType(FloatType()), batch_size=batch_size
    )

    def scorer(train: DataFrame, rows: DataFrame) -> DataFrame:
        return rows.withColumn("probability", predict("text").cast("array<double>"))

    return scorer


def cross_fit(
    labelled: DataFrame, folds: int, seed: int, scorer: Scorer = bag_of_words_scorer,
    parallelism: int = 2,
) -> DataFrame:
    """Out-of-fold class probabilities and predicted class of rows with a text."""
    folded = stratified_folds(labelled, "review_id", "label", folds, seed, tag="text")

    def one(fold: int) -> DataFrame:
        rest, held_out = folded.where(F.col("fold") != fold), folded.where(F.col("fold") == fold)
        return scorer(rest, held_out)

    scored = reduce(
        DataFrame.unionByName,
        [
            df.select(*folded.columns, "probability")
            for df in run_parallel([lambda k=k: one(k) for k in range(folds)], parallelism)
        ],
    )
    p = F.col("probability")
    prediction = (F.array_position(p, F.array_max(p)) - 1).cast("int")
    return scored.withColumns(
        {
            "prob_neg": p[0],
            "prob_neu": p[1],
            "prob_pos": p[2],
            "prediction": prediction,
        }
    ).drop("probability")


def sentiment_table(reviews: DataFrame, scored: DataFrame) -> DataFrame:
    """Rows with a text and their scores, then rows without one, in the fixed column order."""
    with_scores = scored.withColumn(
        "sentiment_label", label_of(F.col("prediction"), POLARITY_NAMES)
    )
    without = reviews.where(F.col("has_text") == 0)
    return (
        with_scores.select(*OUTPUT_COLUMNS)
        .unionByName(
            without.select(*OUTPUT_COLUMNS[:5]), allowMissingColumns=True
        )
        .select(*OUTPUT_COLUMNS)
    )
