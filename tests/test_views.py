"""The derived tables have the contents that were counted when they were designed (see FIXTURES.md)."""

import pytest
from pyspark.sql import functions as F

from keepwell.catalog import views

SF = "/root/testdata/sf0.01"


def one(df, *columns):
    return tuple(df.agg(*columns).first())


def test_feedback(spark):
    df = views.feedback(spark, SF)
    facebook = F.count_if(F.lower("source") == "facebook")
    assert one(df, F.count("*"), F.count_distinct("customer_id", "raw_text"), facebook) == (10_000, 9_355, 6_666)
    got = {r.feedback_category: tuple(r)[1:] for r in df.groupBy("feedback_category").agg(F.count("*"), F.sum("complaint_intensity")).collect()}
    assert got == {
        "churn_intent": (421, 1_267), "customer_support": (1_593, 4_772),
        "pricing": (1_981, 5_982), "service_quality": (6_005, 18_067),
    }
    old = df.filter(F.col("created_at") < views.newest(df) - F.expr("INTERVAL 7 DAYS"))
    assert old.count() == 7_668


def test_subscribers(spark):
    df = views.subscribers(spark, SF)
    charge = sum((F.coalesce(f"total_{p}_charge", F.lit(0.0)) for p in ("day", "eve", "night", "intl")), F.lit(0.0))
    calls = sum((F.col(f"total_{p}_calls") for p in ("day", "eve", "night", "intl")), F.lit(0))
    got = one(df, F.count("*"), F.sum("churn"), F.sum("number_vmail_messages"), F.sum(calls), F.count_distinct("state"))
    assert got == (1_496, 487, 13_317, 13_317, 25)
    assert one(df, F.sum(charge))[0] == pytest.approx(3_338_482_467.87, abs=0.01)


def test_scores(spark):
    df = views.scores(spark, SF)
    got = one(df, F.count("*"), F.sum("y"), F.count_if(F.col("p") >= 0.4), F.count_distinct("p"))
    assert got == (399, 341, 215, 304)
    assert one(df, F.sum("p"))[0] == pytest.approx(186.433)


def test_predictions(spark):
    df = views.predictions(spark, SF)
    assert one(df, F.count("*"), F.count_if(F.col("churn_probability") >= 0.4)) == (1_500, 898)
    assert one(df, F.sum("churn_probability"))[0] == pytest.approx(748.575)


def test_comments_and_links(spark):
    comments = views.conversation_comments(spark, SF)
    assert one(comments, F.count("*"), F.count_if(F.col("username") != "system")) == (536, 512)
    documents = views.document_comments(spark, SF)
    assert one(documents, F.count_distinct("text"), F.count_distinct(F.substring("text", 1, 50))) == (927, 785)
    assert views.links(spark, SF).count() == 1_413
    assert one(views.page_addresses(spark, SF), F.count_distinct("canonical")) == (250,)
