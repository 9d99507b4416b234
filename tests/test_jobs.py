"""The jobs from input files to result files."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from secondcart.__main__ import main
from secondcart.config import Config
from secondcart.functions.lookups import TREE_FEATURES
from secondcart.operators.quality import QualityError
from secondcart.plans import jobs
from secondcart.plans.study import Study
from secondcart.sources import warehouse

from dataclasses import replace

CONFIG = replace(Config().quick(), cv_folds=2, search_trials=1, bootstrap_replicates=20)


@pytest.fixture(scope="module")
def outputs(spark, folder, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("study"))
    tables = warehouse.logical_tables(spark, folder)
    jobs.study_job(
        tables, out, CONFIG, warehouse.PART_TYPE_DURABILITY,
        ("order_item_id", "product_id", "tie_supplier", "tie_price"),
        delivered_status=warehouse.DELIVERED_STATUS,
    )
    return out


def read_report(spark, out, name):
    return spark.read.option("header", True).option("inferSchema", True).csv(f"{out}/{name}")


def test_study_writes_its_tables(spark, outputs):
    base = spark.read.parquet(f"{outputs}/modeling_base")
    assert base.columns == ["customer_unique_id", "target", *TREE_FEATURES]
    assert base.count() == 1380
    funnel = read_report(spark, outputs, "cohort_funnel").first()
    assert funnel["n_sample"] == 1380 and funnel["n_positive"] == 271
    assert read_report(spark, outputs, "metrics").count() == 4
    assert read_report(spark, outputs, "ablation").count() == 9
    assert read_report(spark, outputs, "shap_importance").count() == 10
    logit = read_report(spark, outputs, "logit")
    assert logit.where("term = 'const'").first()["vif"] is None
    confusion = read_report(spark, outputs, "finalist_confusion").first()
    assert confusion["tn"] + confusion["fp"] + confusion["fn"] + confusion["tp"] == 276
    assert spark.read.parquet(f"{outputs}/roc_curve").select("model").distinct().count() == 4


def test_regression_reproduces_the_study(spark, outputs, tmp_path):
    """Same base, same split, same numbers, though nothing but the base is handed over."""
    out = str(tmp_path / "regression")
    jobs.regression_job(spark, outputs, out, CONFIG)
    a = read_report(spark, outputs, "logit").orderBy("term").collect()
    b = read_report(spark, out, "logit").orderBy("term").collect()
    assert a == b
    metrics = read_report(spark, out, "logistic_metrics").first()
    of_study = read_report(spark, outputs, "metrics").where("model = 'logistic'").first()
    for column in ("cv_ap", "auc", "ap", "threshold", "f1", "lift_top", "auc_ci95"):
        assert metrics[column] == of_study[column]


def test_regression_stops_when_not_reproduced(spark, outputs, tmp_path):
    wrong = spark.createDataFrame([("const", 99.0)], "term string, coefficient double")
    out = tmp_path / "stopped"
    with pytest.raises(QualityError, match="not reproduced"):
        jobs.regression_job(spark, outputs, str(out), CONFIG, wrong)
    assert not out.exists()


def test_sentiment_from_the_command_line(spark, folder, tmp_path):
    reviews = warehouse.document_reviews(spark, folder).select(
        F.col("review_id").cast("string").alias("review_id"),
        F.col("order_id").cast("string").alias("order_id"),
        "review_score", "review_comment_title", "review_comment_message", "review_creation_date",
        F.lit(None).cast("timestamp_ntz").alias("review_answer_timestamp"),
    )
    reviews.write.parquet(str(tmp_path / "reviews"))
    main(["sentiment", "--reviews", str(tmp_path / "reviews"), "--out", str(tmp_path / "out"), "--quick"])
    table = spark.read.parquet(str(tmp_path / "out" / "sentiment"))
    assert table.count() == 1000 and table.where("prob_pos is not null").count() == 1000
    assert read_report(spark, str(tmp_path / "out"), "sentiment_report").count() == 6


def test_sentiment_feeds_the_study(spark, folder, tmp_path):
    """The probabilities that the sentiment job writes are those of the customer table."""
    jobs.sentiment_job(warehouse.document_reviews(spark, folder), str(tmp_path), CONFIG)
    written = spark.read.parquet(str(tmp_path / "sentiment"))
    tables = warehouse.logical_tables(spark, folder) | {"sentiment": written}
    study = Study(
        tables, CONFIG, warehouse.PART_TYPE_DURABILITY,
        ("order_item_id", "product_id", "tie_supplier", "tie_price"),
        delivered_status=warehouse.DELIVERED_STATUS,
    )
    found = study.features.join(written, "order_id").select(
        "sent_pos", "prob_pos", "sent_neg", "prob_neg", "rating", "review_score"
    )
    rows = found.collect()
    assert len(rows) > 20
    for r in rows:
        assert (r.sent_pos, r.sent_neg, r.rating) == (r.prob_pos, r.prob_neg, r.review_score)
    used = study.modeling_base().where("sent_pos > 0").count()
    assert used == study.features.where("sent_pos > 0").count() == len(rows)
