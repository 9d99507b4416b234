"""Command line: ``python -m secondcart {study,regression,sentiment} ...``"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from secondcart.config import Config
from secondcart.plans import jobs
from secondcart.sources.readers import read_table, read_tables

STUDY_TABLES = ["orders", "customers", "payments", "items", "products", "category", "sentiment"]


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="secondcart", description=__doc__)
    commands = parser.add_subparsers(dest="job", required=True)

    study = commands.add_parser("study", help="cohort, features, models and explanations")
    study.add_argument("--tables", required=True, help="folder with <table>.<format>")
    sentiment = commands.add_parser("sentiment", help="cross-fitted review sentiment")
    sentiment.add_argument("--reviews", required=True, help="path of the review table")
    regression = commands.add_parser("regression", help="inference on a stored base")
    regression.add_argument("--study", required=True, help="output folder of a study")
    regression.add_argument("--expected", help="CSV with stored coefficients: term, coefficient")
    for command in (study, sentiment):
        command.add_argument("--format", default="parquet", choices=["parquet", "csv"])
    for command in (study, sentiment, regression):
        command.add_argument("--out", required=True)
        command.add_argument("--quick", action="store_true", help="fewer trials, folds, replicates")
    args = parser.parse_args(argv)

    spark = SparkSession.builder.appName(f"secondcart-{args.job}").getOrCreate()
    config = Config().quick() if args.quick else Config()
    if args.job == "study":
        paths = {name: f"{args.tables}/{name}.{args.format}" for name in STUDY_TABLES}
        jobs.study_job(read_tables(spark, paths, args.format), args.out, config)
    elif args.job == "sentiment":
        reviews = read_table(spark, "reviews", args.reviews, args.format)
        jobs.sentiment_job(reviews, args.out, config)
    else:
        expected = None
        if args.expected:
            expected = spark.read.schema("term STRING, coefficient DOUBLE").csv(
                args.expected, header=True
            )
        jobs.regression_job(spark, args.study, args.out, config, expected)


if __name__ == "__main__":
    main()
