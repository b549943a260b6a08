"""Jobs for ``spark-submit`` or ``python -m keepwell``: train, churn, check, predict, reputation, snapshot, label, migrate.

Tables are Parquet paths. Documents go to standard output, one JSON text per line.
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import SparkSession, functions as F, types as T

from keepwell.functions.risk import DEFAULT_THRESHOLD
from keepwell.operators import models as ml
from keepwell.operators import reputation as rep
from keepwell.operators import scoring
from keepwell.operators.shaping import check_payloads
from keepwell.plans import churn, dashboards, ingest, migration
from keepwell.schemas import FEEDBACK, PAYLOAD, SUBSCRIBERS
from keepwell.session import build_session, materialize
from keepwell.sources import readers, writers


def _read(spark: SparkSession, path: str):
    return readers.read_csv(spark, path) if path.endswith(".csv") else readers.read_table(spark, path)


def train(spark: SparkSession, args: argparse.Namespace) -> None:
    run = churn.train_churn(
        _read(spark, args.train),
        _read(spark, args.test),
        threshold=args.threshold,
        champion=None if args.champion == "best" else args.champion,
        model_path=args.model,
        overrides={"maxIter": args.rounds} if args.rounds else None,
    )
    if args.comparison:
        run.comparison.write.mode("overwrite").parquet(args.comparison)
    print(run.champion)


def churn_dashboard(spark: SparkSession, args: argparse.Namespace) -> None:
    model, table = ml.load_pipeline(args.model), _read(spark, args.subscribers)
    if args.customer:
        rows = ml.score(model, scoring.lookup_customer(table, args.customer))
        documents = scoring.profile_documents(rows, args.threshold)
    else:
        rows = table if args.limit is None else table.limit(args.limit)
        documents = scoring.churn_document(ml.score(model, readers.require_rows(rows, "the subscriber table")), args.threshold)
    _show(documents.select("document"), f"no customer {args.customer}")


def check(spark: SparkSession, args: argparse.Namespace) -> None:
    rows = scoring.lookup_customer(_read(spark, args.subscribers), args.customer)
    found = scoring.checked_predictions(ml.score(ml.load_pipeline(args.model), rows), args.threshold)
    _show(found.select(F.to_json(F.struct("*"))), f"no customer {args.customer}")


def predict(spark: SparkSession, args: argparse.Namespace) -> None:
    """Score JSON-line records; append predictions, and the records that don't fit to ``--rejected``."""
    as_text = T.StructType([T.StructField(name, T.StringType()) for name in PAYLOAD.fieldNames()])
    records, broken = readers.read_json_checked(spark, args.records, as_text)
    checked = materialize(check_payloads(records), "payloads")  # judged once, for both sides
    valid = checked.filter("errors IS NULL").drop("errors")
    bad = checked.filter("errors IS NOT NULL")
    bad = bad.unionByName(broken.select(F.col("text").alias("record"), F.col("reason").alias("errors")), allowMissingColumns=True)
    scored = ml.score(ml.load_pipeline(args.model), valid)
    writers.append_predictions(scoring.prediction_records(scored, args.version, args.threshold), args.predictions)
    if args.rejected:
        bad.write.mode("append").parquet(args.rejected)


def reputation(spark: SparkSession, args: argparse.Namespace) -> None:
    as_of = F.lit(args.as_of).cast("timestamp") if args.as_of else None
    _show(dashboards.reputation(readers.read_feedback(spark, args.feedback), as_of), "no feedback")


def snapshot(spark: SparkSession, args: argparse.Namespace) -> None:
    """Count every day of the feedback table, or only the days of the rows in ``--new``."""
    changed = readers.read_feedback(spark, args.new) if args.new else None
    writers.write_snapshots(readers.read_feedback(spark, args.feedback), args.snapshots, changed)


def label(spark: SparkSession, args: argparse.Namespace) -> None:
    """Keyword labels for the newest comment export; write the merged feedback table to ``--out``."""
    comments = readers.read_latest_comments(spark, args.comments).withColumn("order_id", F.monotonically_increasing_id())
    current = readers.read_feedback(spark, args.feedback) if args.feedback else ingest.empty_feedback(spark)
    batch = ingest.label_batch(comments, "order_id")
    ingest.update_feedback(current, batch, "order_id").write.parquet(args.out)
    rep.feedback_summary(spark.read.parquet(args.out)).show(truncate=False)


def migrate(spark: SparkSession, args: argparse.Namespace) -> None:
    """Merge CSV exports into the tables at ``--from`` (empty without one); write them below ``--out``."""
    for name, schema, source, merge in (
        ("subscribers", SUBSCRIBERS, args.subscribers_csv, migration.migrate_subscribers),
        ("feedback", FEEDBACK, args.feedback_csv, migration.migrate_feedback),
    ):
        if source:
            old = f"{args.current}/{name}" if args.current else None
            current = spark.read.schema(schema).parquet(old) if old else spark.createDataFrame([], schema)
            merge(spark, current, source).write.parquet(f"{args.out}/{name}")


def _show(documents, otherwise: str) -> None:
    rows = documents.collect()  # one document, or those of one customer
    for row in rows:
        print(row[0])
    if not rows:
        raise SystemExit(otherwise)


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="keepwell", description=__doc__)
    jobs = parser.add_subparsers(required=True)

    def job(run, *required: str, threshold: bool = False) -> argparse.ArgumentParser:
        sub = jobs.add_parser("churn" if run is churn_dashboard else run.__name__, help=run.__doc__)
        sub.set_defaults(run=run)
        for name in required:
            sub.add_argument(f"--{name}", required=True)
        if threshold:
            sub.add_argument("--threshold", type=float, default=DEFAULT_THRESHOLD)
        return sub

    sub = job(train, "train", "test", "model", threshold=True)
    sub.add_argument("--champion", default=ml.CHAMPION, choices=["best", "logreg", *ml.SPACES])
    sub.add_argument("--comparison")
    sub.add_argument("--rounds", type=int, help="boosting rounds, instead of those of the search spaces")
    sub = job(churn_dashboard, "subscribers", "model", threshold=True)
    sub.add_argument("--customer")
    sub.add_argument("--limit", type=int)
    job(check, "subscribers", "model", "customer", threshold=True)
    sub = job(predict, "records", "model", "predictions", threshold=True)
    sub.add_argument("--version", default="champion_gbt")
    sub.add_argument("--rejected")
    job(reputation, "feedback").add_argument("--as-of")
    job(snapshot, "feedback", "snapshots").add_argument("--new")
    job(label, "comments", "out").add_argument("--feedback")
    sub = job(migrate, "out")
    sub.add_argument("--from", dest="current")
    sub.add_argument("--subscribers-csv")
    sub.add_argument("--feedback-csv")
    return parser


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    args = _parser().parse_args(argv)
    args.run(spark or build_session(), args)


if __name__ == "__main__":
    main()
