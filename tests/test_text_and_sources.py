"""Review texts, cross-fitting, readers, writers and quality gates."""

from __future__ import annotations

from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from secondcart.functions.text import consolidated_text, has_text
from secondcart.operators import quality, sentiment
from secondcart.sources import readers, writers
from secondcart.sources.schemas import table_schema

PAIRS = [
    (None, None),
    ("", ""),
    (" \t", "\n\u2003 "),
    ("title", None),
    (None, "body"),
    ("\xa0a ", "\u3000 b\x1f\n"),
    ("one two", None),
]


def test_consolidated_text_strips_like_python(spark):
    df = spark.createDataFrame(PAIRS, "t string, m string")
    text = consolidated_text(F.col("t"), F.col("m"))
    got = df.select(text, has_text(text)).collect()
    for row, (title, message) in zip(got, PAIRS, strict=True):
        plain = f"{title or ''} {message or ''}".strip() or None
        assert row[0] == plain
        assert row[1] == int(plain is not None)


@pytest.fixture(scope="module")
def reviews(spark):
    words = {1: "awful broken late", 2: "bad slow", 3: "fine average", 4: "good nice", 5: "great lovely"}
    rows = [
        (i, i, 1 + i % 5, None, None, None if i % 10 == 9 else words[1 + i % 5] + f" item{i % 7}")
        for i in range(200)
    ]
    df = spark.createDataFrame(
        rows,
        "review_id long, order_id long, review_score int, review_creation_date timestamp_ntz,"
        " review_comment_title string, review_comment_message string",
    )
    return sentiment.with_review_text(df)


def test_fits_keep_words_and_no_texts(reviews, monkeypatch):
    """What the fits hold has no text, and its partitions grow in number, not in size."""
    monkeypatch.setattr(sentiment, "ROWS_PER_PARTITION", 20)
    labelled = reviews.where("has_text = 1").coalesce(1)
    words = sentiment.word_table(labelled)
    assert not {"text", "review_comment_title", "review_comment_message"} & set(words.columns)
    assert words.rdd.getNumPartitions() == -(-labelled.count() // 20)
    kept = [c for c in labelled.columns if c in words.columns and c != "review_creation_date"]
    got = sorted(map(tuple, words.select(*kept, "counts").collect()))
    want = sentiment.hashed_words(labelled).select(*kept, "counts")
    assert got == sorted(map(tuple, want.collect()))


def test_cross_fit_scores_each_text_once(reviews):
    labelled = reviews.where("has_text = 1")
    scored = sentiment.cross_fit(labelled, 2, 42).cache()
    assert scored.count() == labelled.count() == 180
    assert scored.select("review_id").distinct().count() == 180
    assert scored.where("prediction = label").count() > 150
    assert scored.where("abs(prob_neg + prob_neu + prob_pos - 1) > 1e-9").count() == 0
    sizes = [r["count"] for r in scored.groupBy("label", "fold").count().collect()]
    assert len(sizes) == 6
    table = sentiment.sentiment_table(reviews, scored)
    assert table.columns == sentiment.OUTPUT_COLUMNS
    assert table.count() == 200
    empty = table.where("has_text = 0").first()
    assert empty["prob_neg"] is None and empty["sentiment_label"] is None and empty["fold"] is None


def test_a_held_out_text_does_not_influence_its_own_model(reviews):
    """A scorer that memorises its training rows never sees the rows it scores."""
    seen = []

    def scorer(train, rows):
        seen.append((
            {r[0] for r in train.select("review_id").collect()},
            {r[0] for r in rows.select("review_id").collect()},
        ))
        return rows.withColumn("probability", F.array(F.lit(0.2), F.lit(0.3), F.lit(0.5)))

    out = sentiment.cross_fit(reviews.where("has_text = 1"), 2, 42, scorer)
    assert out.where("prediction = 2").count() == 180
    for train, held_out in seen:
        assert not train & held_out and len(train | held_out) == 180


def test_external_model_runs_in_batches(reviews):
    def make_predict():
        def predict(texts):
            good = np.array(["great" in str(t) for t in texts], dtype=np.float32)
            return np.column_stack([1 - good, np.zeros_like(good), good])

        return predict

    scored = sentiment.cross_fit(
        reviews.where("has_text = 1"), 2, 42, sentiment.batch_scorer(make_predict, 16)
    )
    wrong = scored.where((F.col("text").contains("great")) != (F.col("prediction") == 2))
    assert scored.count() == 180 and wrong.count() == 0


def test_csv_with_text_over_several_lines(spark, tmp_path):
    path = tmp_path / "reviews.csv"
    path.write_text(
        "review_id,order_id,review_score,review_comment_title,review_comment_message,"
        "review_creation_date,review_answer_timestamp\n"
        'r1,o1,5,,"said ""fine""\nand left",2018-01-18 00:00:00,2018-01-18 21:46:59\n'
        "r2,o2,1,bad,,2018-03-10 00:00:00,2018-03-11 03:05:13\n"
    )
    df = readers.read_table(spark, "reviews", str(path), "csv")
    assert df.schema == table_schema("reviews")
    rows = {r["review_id"]: r for r in df.collect()}
    assert rows["r1"]["review_comment_message"] == 'said "fine"\nand left'
    assert rows["r2"]["review_creation_date"] == datetime(2018, 3, 10)
    assert rows["r2"]["review_comment_message"] is None


def test_csv_orders_and_bad_rows(spark, tmp_path):
    header = ",".join(table_schema("orders").names)
    good = tmp_path / "good.csv"
    good.write_text(f"{header}\no1,c1,delivered,2018-01-01 10:11:12,,,,2018-01-20 00:00:00\n")
    row = readers.read_table(spark, "orders", str(good), "csv").first()
    assert row["order_purchase_timestamp"] == datetime(2018, 1, 1, 10, 11, 12)
    assert row["order_approved_at"] is None
    bad = tmp_path / "bad.csv"
    bad.write_text(f"{header}\no1,c1,delivered,yesterday,,,,\n")
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        readers.read_table(spark, "orders", str(bad), "csv").collect()
    with pytest.raises(ValueError, match="format"):
        readers.read_table(spark, "orders", str(good), "xml")


def test_csv_with_a_byte_order_mark(spark, tmp_path):
    path = tmp_path / "category.csv"
    path.write_text(
        "product_category_name,product_category_name_english\nbrinquedos,toys\n", "utf-8-sig"
    )
    assert readers.read_table(spark, "category", str(path), "csv").first()[:] == ("brinquedos", "toys")


def test_tables_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.23456)], "term string, value double")
    writers.write_table(df, str(tmp_path / "t"))
    assert readers.read_parquet(spark, str(tmp_path / "t")).first() == df.first()
    writers.write_table(df, str(tmp_path / "c"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).first()["term"] == "a"
    writers.write_result(df, str(tmp_path / "r"))
    files = list((tmp_path / "r").glob("*.csv"))
    assert len(files) == 1 and files[0].read_text() == "term,value\na,1.2346\n"
    kept = writers.materialize(df, "round-trip")
    assert kept.schema == df.schema and kept.first() == df.first()


def test_tables_between_jobs_go_to_the_shared_folder(spark):
    folder = writers.shared_folder(spark)
    configured = spark.conf.get("spark.checkpoint.dir", None)
    assert folder == (configured or spark.sparkContext.getCheckpointDir())
    table = writers.materialize(spark.range(3), "here")
    assert all(folder in path for path in table.inputFiles())


def test_quality_gates(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, "b")], "id int, s string")
    with pytest.raises(quality.QualityError, match="s"):
        quality.assert_not_null(df, ["id", "s"])
    quality.assert_not_null(df, ["id"])
    with pytest.raises(quality.QualityError, match="not unique"):
        quality.assert_unique(df, "id")
    with pytest.raises(quality.QualityError, match="3 to 2"):
        quality.assert_same_count(df, df.where("s is not null"))
