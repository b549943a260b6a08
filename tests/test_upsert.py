import random

import pytest
from pyspark.sql import functions as F

from keepwell.operators import dedup, upsert
from keepwell.plans import migration
from keepwell.plans.ingest import empty_feedback
from keepwell.schemas import FEEDBACK_KEY
from keepwell.sources import readers, writers

SCHEMA = "customer_id string, raw_text string, v int, seq int"
KEYS = FEEDBACK_KEY


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def random_rows(n, seed, keys=6):
    chance = random.Random(seed)
    return [(f"c{chance.randrange(keys)}", f"t{chance.randrange(3)}", chance.randrange(100), i) for i in range(n)]


def by_key(rows):
    return {r[:2]: r for r in rows}


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("threshold", ["-1", "10MB"])
def test_upserts(spark, seed, threshold):
    """With and without broadcasts."""
    old, new = by_key(random_rows(9, seed)), random_rows(60, seed + 100)
    target = spark.createDataFrame(list(old.values()), SCHEMA)
    batch = spark.createDataFrame(new, SCHEMA).repartition(5)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        updated = rows_of(upsert.upsert_update(target, batch, KEYS, ["seq"]))
        ignored = rows_of(upsert.upsert_ignore(target, batch, KEYS, ["seq"]))
        first = rows_of(upsert.upsert_update(target, batch, KEYS, ["seq"], keep="first"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert updated == sorted({**old, **by_key(new)}.values())
    assert ignored == sorted({**by_key(reversed(new)), **old}.values())
    assert first == sorted({**old, **by_key(reversed(new))}.values())


def test_hot_key(spark):
    """A third of all rows has one key."""
    rows = [("hot", "t", i, i) if i % 3 == 0 else (f"c{i}", "t", i, i) for i in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(8)
    last = dedup.keep_last(df, KEYS, ["seq"])
    assert rows_of(last) == sorted(by_key(rows).values())
    plan = last._jdf.queryExecution().executedPlan().toString()
    before_shuffle = plan[plan.index("Exchange") :]
    assert "WindowGroupLimit" in before_shuffle and "Partial" in before_shuffle


def test_empty_batch_and_empty_target(spark):
    some = spark.createDataFrame(random_rows(5, 1), SCHEMA)
    unique = dedup.keep_last(some, KEYS, ["seq"])
    none = some.limit(0)
    assert rows_of(upsert.upsert_update(unique, none, KEYS, ["seq"])) == rows_of(unique)
    assert rows_of(upsert.upsert_update(none, some, KEYS, ["seq"])) == rows_of(unique)
    assert rows_of(upsert.upsert_ignore(unique, none, KEYS, ["seq"])) == rows_of(unique)


def test_twice_is_once(spark):
    target = dedup.keep_first(spark.createDataFrame(random_rows(8, 2), SCHEMA), KEYS, ["seq"])
    batch = spark.createDataFrame(random_rows(30, 3), SCHEMA)
    for way in (upsert.upsert_update, upsert.upsert_ignore):
        once = way(target, batch, KEYS, ["seq"])
        assert rows_of(way(once, batch, KEYS, ["seq"])) == rows_of(once)


def test_order_of_rows_does_not_matter(spark):
    rows = random_rows(80, 5)
    want = rows_of(dedup.keep_last(spark.createDataFrame(rows, SCHEMA), KEYS, ["seq"]))
    for n in (1, 3, 7):
        shuffled = spark.createDataFrame(random.Random(n).sample(rows, len(rows)), SCHEMA).repartition(n)
        assert rows_of(dedup.keep_last(shuffled, KEYS, ["seq"])) == want


def test_columns_the_batch_lacks(spark):
    target = spark.createDataFrame([("a", "t", 1, "old"), ("b", "t", 2, "old")], "customer_id string, raw_text string, v int, made string")
    batch = spark.createDataFrame([("a", "t", 10, 1), ("c", "t", 30, 1)], SCHEMA)
    made = {"made": F.lit("new")}
    got = rows_of(upsert.upsert_update(target, batch, KEYS, ["seq"], made))
    assert got == [("a", "t", 10, "old"), ("b", "t", 2, "old"), ("c", "t", 30, "new")]
    got = rows_of(upsert.upsert_ignore(target, batch, KEYS, ["seq"], made))
    assert got == [("a", "t", 1, "old"), ("b", "t", 2, "old"), ("c", "t", 30, "new")]


def test_a_small_batch_leaves_the_target_unshuffled(spark, tmp_path):
    path = str(tmp_path / "target")
    spark.range(100_000).select(
        F.col("id").cast("string").alias("customer_id"), F.lit("t").alias("raw_text"), F.lit(1).alias("v"), F.lit(1).alias("seq")
    ).write.parquet(path)
    small = spark.createDataFrame(random_rows(5, 1), SCHEMA)
    new = upsert.merge_unique(spark.read.parquet(path), dedup.keep_last(small, KEYS, ["seq"]), KEYS)
    new.collect()
    plan = new._jdf.queryExecution().executedPlan().toString()
    final = plan[: plan.index("Initial Plan")] if "Initial Plan" in plan else plan
    assert "BroadcastHashJoin" in final and "SortMergeJoin" not in final


def test_stored_upserts(spark, tmp_path):
    target, out = str(tmp_path / "target"), str(tmp_path / "out")
    old, new = by_key(random_rows(6, 8)), random_rows(20, 9)
    spark.createDataFrame(list(old.values()), SCHEMA).write.parquet(target)
    batch = spark.createDataFrame(new, SCHEMA)
    writers.write_upsert(spark, target, batch, KEYS, ["seq"], out)
    assert rows_of(spark.read.parquet(out)) == sorted({**old, **by_key(new)}.values())
    writers.append_new(spark, target, batch, KEYS, ["seq"])
    assert rows_of(spark.read.parquet(target)) == sorted({**by_key(reversed(new)), **old}.values())


def test_null_keys_are_one_key(spark):
    target = spark.createDataFrame([("1", None, 1, 1), (None, None, 2, 1)], SCHEMA)
    batch = spark.createDataFrame([("1", None, 7, 2), ("1", None, 8, 3), (None, "t", 9, 2), (None, "t", 9, 3)], SCHEMA)
    for _ in range(2):
        target = spark.createDataFrame(upsert.upsert_update(target, batch, KEYS, ["seq"]).collect(), SCHEMA)
        assert sorted(map(tuple, target.collect()), key=repr) == sorted([("1", None, 8, 3), (None, None, 2, 1), (None, "t", 9, 3)], key=repr)
    assert upsert.upsert_ignore(target, batch, KEYS, ["seq"]).count() == 3


def test_keys_are_compared_as_the_target_s_types(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    batch = spark.createDataFrame([("1", "x", 1), ("01", "y", 2), ("3", "z", 1)], "k string, v string, seq int")
    assert rows_of(upsert.upsert_update(target, batch, ["k"], ["seq"])) == [(1, "y"), (2, "b"), (3, "z")]
    assert rows_of(upsert.upsert_ignore(target, batch, ["k"], ["seq"])) == [(1, "a"), (2, "b"), (3, "z")]


@pytest.mark.parametrize("seed", range(2))
def test_tables_laid_out_by_key(spark, tmp_path, seed):
    old = {k: v for k, v in by_key(random_rows(40, seed, keys=30)).items() if None not in v}
    name = f"laid_out_{seed}"
    layout = {"keys": KEYS, "buckets": 3}
    table = writers.write_bucketed(spark.createDataFrame(list(old.values()), SCHEMA), name, str(tmp_path / "0"), **layout)
    assert len(list((tmp_path / "0").glob("part-*.parquet"))) <= 3
    for step in range(2):
        new = [r for r in random_rows(15, seed + 50 + step, keys=40) if None not in r]
        batch = spark.createDataFrame(new, SCHEMA)
        for again in "ab":  # a second time changes nothing
            path = str(tmp_path / f"{step}{again}")
            table = writers.upsert_bucketed(table, batch, sequence=["seq"], name=f"{name}_{step}{again}", path=path, **layout)
        old |= by_key(new)
        assert rows_of(table) == sorted(old.values())
    same = writers.upsert_bucketed(table, batch.limit(0), sequence=["seq"], name=f"{name}_z", path=str(tmp_path / "z"), **layout)
    assert rows_of(same) == sorted(old.values())


def test_a_target_laid_out_by_key_is_not_shuffled(spark, tmp_path):
    rows = spark.range(1000).selectExpr("cast(id as string) AS k", "id AS v")
    target = writers.write_bucketed(rows, "laid_out_plan", str(tmp_path / "t"), ["k"], 8)
    session = spark.newSession()
    session.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    session.conf.set("spark.sql.adaptive.enabled", "false")
    batch = session.range(500, 1500).selectExpr("cast(id as string) AS k", "-id AS v")
    merged = upsert.bucketed_merge(session.table("laid_out_plan"), batch, ["k"])
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert target.count() == 1000 and "Bucketed: true" in plan
    assert plan.count("Exchange hashpartitioning") == 1  # the batch's; the target is read in place
    assert merged.count() == 1500 and merged.agg({"v": "sum"}).first()[0] == sum(range(500)) - sum(range(500, 1500))


def test_a_null_key_of_a_batch_is_an_error(spark, tmp_path):
    target = writers.write_bucketed(spark.createDataFrame([("a", 1)], "k string, v int"), "laid_out_null", str(tmp_path / "t"), ["k"], 2)
    batch = spark.createDataFrame([(None, 2)], "k string, v int")
    with pytest.raises(Exception, match="null"):
        writers.upsert_bucketed(target, batch, ["k"], ["v"], "laid_out_null_2", str(tmp_path / "u"), 2)


CSV = '''customer_id,feedback_category,sentiment,complaint_intensity,raw_text
a,pricing,neutral,1,"first, with comma"
b,pricing,neutral,2,"two
lines ""quoted"""
a,churn_intent,negative,4,"first, with comma"
'''


def test_migration_of_a_file_with_a_byte_order_mark(spark, tmp_path):
    file = tmp_path / "feedback.csv"
    file.write_bytes(b"\xef\xbb\xbf" + CSV.encode())
    once = migration.migrate_feedback(spark, empty_feedback(spark), str(file))
    stored = str(tmp_path / "table")
    once.write.parquet(stored)
    rows = {r.customer_id: r for r in spark.read.parquet(stored).collect()}
    assert len(rows) == 2
    assert (rows["a"].sentiment, rows["a"].complaint_intensity, rows["a"].username) == ("negative", 4, "Anonymous User")
    assert rows["b"].raw_text == 'two\nlines "quoted"'
    again = migration.migrate_feedback(spark, readers.read_feedback(spark, stored), str(file))
    assert rows_of(again) == rows_of(spark.read.parquet(stored))


def test_migration_keeps_the_last_line_of_a_split_file(spark, tmp_path):
    """The file is read in many splits; the order of lines still decides."""
    file = tmp_path / "test_big.csv"
    lines = [f"c{i % 50},{i}" for i in range(20_000)]
    file.write_text("customer_id,account_length\n" + "\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16KB")
    try:
        empty = spark.createDataFrame([], "customer_id string, account_length int")
        assert readers.read_csv(spark, str(file)).rdd.getNumPartitions() > 5
        got = migration.migrate_subscribers(spark, empty, str(tmp_path / "test*.csv")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r.customer_id, r.account_length) for r in got) == sorted((f"c{i}", 19_950 + i) for i in range(50))
