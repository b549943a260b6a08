"""Plans and skew: what must hold for tables that don't fit one task."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registration
from keepwell.operators import links as ln
from keepwell.operators import reputation as rep

QUERIES = registration.queries()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


LAZY = [
    "sentiment_over_time", "reputation_dashboard", "feedback_summary", "recent_mentions", "clean_comments", "filter_authors",
    "extract_comment_body", "pseudonymize", "dedup_comments", "extract_summary", "extract_links", "canonical_urls",
    "dedup_urls", "links_capped", "link_labels", "dedup_keep_last", "dedup_keep_first", "parse_labels", "lexicon_labels",
    "latest_feedback", "enrich_subscribers", "data_audit", "class_weight", "stratified_folds", "usage_features",
    "confusion_matrix", "classification_report", "roc_auc", "threshold_sweep", "roc_pr_curve", "risk_levels", "risk_override",
    "churn_dashboard", "top_risk_profiles", "high_risk_customers", "validate_payload", "upsert_subscribers",
]


# Their windows without groups go over the sums of a sort's partitions, one row each.
ONE_ROW_PER_PARTITION = ("roc_auc", "threshold_sweep", "roc_pr_curve", "best_threshold")


@pytest.mark.parametrize("name", LAZY)
def test_plans(spark, sf_dir, name):
    """Rows stay in the JVM, are never crossed, and are never ranked in one task."""
    plan = plan_of(QUERIES[name](spark, sf_dir))
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "MapInPandas"):
        assert word not in plan
    # one task may only add up partial aggregates
    lines = plan.split("\n")
    for at, line in enumerate(lines):
        if "SinglePartition" in line:
            assert "HashAggregate" in lines[at + 1] or "SortAggregate" in lines[at + 1]
            above = lines[max(0, at - 3) : at]
            assert not any(re.search(r"\bWindow \[", x) for x in above) or name in ONE_ROW_PER_PARTITION


@pytest.mark.parametrize("name", ["dedup_keep_last", "dedup_keep_first", "dedup_comments", "dedup_urls", "links_capped", "latest_feedback"])
def test_ranks_are_pruned_before_the_shuffle(spark, sf_dir, name):
    plan = plan_of(QUERIES[name](spark, sf_dir))
    exchange = plan.index("Exchange hashpartitioning")
    assert "Partial" in plan[exchange:] and "WindowGroupLimit" in plan[exchange:]


@pytest.mark.parametrize("name", ["recent_mentions", "top_risk_profiles", "scan_limit"])
def test_top_rows_are_taken_per_partition(spark, sf_dir, name):
    assert "TakeOrderedAndProject" in plan_of(QUERIES[name](spark, sf_dir))


def test_one_pass_for_all_scalars(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = events.select(F.col("event_type").alias("sentiment"), F.col("ts").alias("created_at"), "props")
    plan = plan_of(rep.reputation_dashboard(rows, F.lit("2024-01-30").cast("timestamp")))
    assert plan.count("FileScan") == 1
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string>" in plan


def test_unused_columns_are_not_read(spark, sf_dir):
    plan = plan_of(QUERIES["sentiment_distribution"](spark, sf_dir))
    assert "ReadSchema: struct<event_type:string>" in plan


def test_a_hot_post_is_split(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB",
        "spark.sql.shuffle.partitions": "20",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        url = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("u"), (F.col("id") % 1000).cast("string")))
        comments = spark.range(0, 300_000, 1, 8).select(url.alias("post_url"), F.md5(F.col("id").cast("string")).alias("text"))
        posts = comments.select(F.col("post_url").alias("url")).distinct().withColumn("post_date", F.upper("url"))
        joined = ln.attach_post_date(comments, posts)
        wrong = joined.filter(F.coalesce("associated_post_date", F.lit("")) != F.upper("post_url"))
        assert wrong.count() == 0 and joined.count() == 300_000
        joined.write.format("noop").mode("overwrite").save()
        checked = joined.filter(F.length("text") > 0)
        checked.collect()
        assert "SortMergeJoin(skew=true)" in plan_of(checked)
    finally:
        for key in settings:
            spark.conf.unset(key)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
