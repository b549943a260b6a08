import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from keepwell.catalog import load_all, streams
from keepwell.operators import models as ml
from keepwell.operators import reputation as rep
from keepwell.streaming import jobs

FEEDBACK = "customer_id string, raw_text string, sentiment string, created_at timestamp"
START = datetime.datetime(2024, 1, 1)


def add(spark, path, rows, schema=FEEDBACK):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def stream(spark, path, schema=FEEDBACK):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def hours(n):
    return START + datetime.timedelta(hours=n)


def test_daily_sentiment_equals_batch(spark, tmp_path):
    source, out, state = (str(tmp_path / d) for d in ("in", "out", "state"))
    tones = ["positive", "Negative", "neutral", None]
    for part in range(3):
        add(spark, source, [("c", f"t{i}", tones[(i * 7) % 4], hours(i)) for i in range(part * 48, part * 48 + 48)])

    def stored():
        rows = spark.read.schema(jobs.DAILY).parquet(out).collect()
        assert len(rows) == len({r.date for r in rows})
        return {(r.date, r.daily_sentiment_score, r.volume) for r in rows}

    jobs.stream_daily_sentiment(stream(spark, source), out, state, "3 days").awaitTermination()
    batch = {tuple(r) for r in rep.sentiment_over_time(spark.read.parquet(source)).collect()}
    assert stored() == batch and len(batch) == 6  # also the day that isn't over

    # later rows change their days; a row that is far too late is left out
    add(spark, source, [("c", "same day", "negative", hours(143)), ("c", "new", "neutral", hours(24 * 9))])
    jobs.stream_daily_sentiment(stream(spark, source), out, state, "3 days").awaitTermination()
    batch = {tuple(r) for r in rep.sentiment_over_time(spark.read.parquet(source)).collect()}
    add(spark, source, [("c", "late", "negative", hours(1))])
    jobs.stream_daily_sentiment(stream(spark, source), out, state, "3 days").awaitTermination()
    assert stored() == batch


def test_a_row_without_a_time_counts_as_now(spark, tmp_path):
    source, out, state = (str(tmp_path / d) for d in ("in", "out", "state"))
    add(spark, source, [("c", "x", "positive", None)])
    jobs.stream_daily_sentiment(stream(spark, source), out, state).awaitTermination()
    assert [(r.daily_sentiment_score, r.volume) for r in spark.read.schema(jobs.DAILY).parquet(out).collect()] == [(100, 1)]


def test_upsert_over_batches_and_restarts(spark, tmp_path):
    source, out, state = (str(tmp_path / d) for d in ("in", "out", "state"))
    add(spark, source, [("a", "x", "first", hours(1)), ("a", "x", "second", hours(2)), ("b", "y", "first", hours(1))])
    jobs.stream_upsert(stream(spark, source), out, state, ["created_at"]).awaitTermination()
    add(spark, source, [("a", "x", "third", hours(0)), ("c", "z", "first", hours(3))])
    jobs.stream_upsert(stream(spark, source), out, state, ["created_at"]).awaitTermination()
    rows = spark.read.parquet(out)
    got = {(r.customer_id, r.raw_text): r.sentiment for r in rows.collect()}
    assert rows.count() == 3 and set(got.values()) == {"first"}


def test_a_stream_with_a_new_checkpoint_goes_on_with_the_table(spark, tmp_path):
    one, two, out = (str(tmp_path / d) for d in ("one", "two", "out"))
    add(spark, one, [(f"c{i}", "t", "old", hours(i)) for i in range(10)])
    jobs.stream_upsert(stream(spark, one), out, str(tmp_path / "s1"), ["created_at"]).awaitTermination()
    add(spark, two, [(f"c{i}", "t", "new", hours(i)) for i in range(5, 15)] + [(None, "t", "new", hours(1))])
    for state in ("s2", "s3"):
        jobs.stream_upsert(stream(spark, two), out, str(tmp_path / state), ["created_at"]).awaitTermination()
        got = {r.customer_id: r.sentiment for r in spark.read.parquet(out).collect()}
        assert spark.read.parquet(out).count() == len(got) == 16
        assert [got[f"c{i}"] for i in range(15)] == ["old"] * 10 + ["new"] * 5
    with pytest.raises(Exception, match="buckets"):
        jobs.stream_upsert(stream(spark, two), out, str(tmp_path / "s4"), ["created_at"], buckets=8).awaitTermination()


def test_replacing_keeps_the_last_row_whatever_arrives_first(spark, tmp_path):
    source, out, state = (str(tmp_path / d) for d in ("in", "out", "state"))
    add(spark, source, [("a", "x", "late", hours(9)), ("b", "y", "only", hours(1))])
    jobs.stream_replace(stream(spark, source), out, state, ["created_at"]).awaitTermination()
    add(spark, source, [("a", "x", "early", hours(2)), ("b", "y", "newer", hours(3)), (None, "z", "one", hours(1))])
    jobs.stream_replace(stream(spark, source), out, state, ["created_at"]).awaitTermination()
    rows = jobs.current_rows(spark, out, stream(spark, source).schema, ["created_at"]).collect()
    assert {(r.customer_id, r.sentiment) for r in rows} == {("a", "late"), ("b", "newer"), (None, "one")} and len(rows) == 3


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    """As after a crash between the write and the commit: the last commit is lost, the batch is repeated."""
    source, out, state = (str(tmp_path / d) for d in ("in", "out", "state"))
    for part in range(2):
        add(spark, source, [(f"c{i}", "t", "first", hours(i)) for i in range(part * 3, part * 3 + 5)])
    jobs.stream_upsert(stream(spark, source), out, state, ["created_at"]).awaitTermination()
    before = sorted(map(tuple, spark.read.parquet(out).collect()))
    commits = tmp_path / "state" / "commits"
    last = max(int(f.name) for f in commits.iterdir() if f.name.isdigit())
    (commits / str(last)).unlink()
    (commits / f".{last}.crc").unlink(missing_ok=True)
    jobs.stream_upsert(stream(spark, source), out, state, ["created_at"]).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == before and len(before) == 8


@pytest.mark.parametrize("delay", [None, "2 days"])
def test_first_of_key_over_restarts(spark, tmp_path, delay):
    source, out, state = (str(tmp_path / d) for d in ("in", "out", "state"))
    add(spark, source, [("a", "x", "first", hours(1)), ("b", "y", "first", hours(1))])
    jobs.stream_first_of_key(stream(spark, source), out, state, delay=delay).awaitTermination()
    add(spark, source, [("a", "x", "second", hours(2)), ("c", "z", "first", hours(3))])
    jobs.stream_first_of_key(stream(spark, source), out, state, delay=delay).awaitTermination()
    rows = spark.read.parquet(out).collect()
    assert sorted((r.customer_id, r.sentiment) for r in rows) == [("a", "first"), ("b", "first"), ("c", "first")]


def test_scores_of_a_stream_equal_batch_scores(spark, tmp_path):
    schema = "customer_id string, state string, customer_service_calls int, churn int"
    rows = [(f"c{i}", "AB"[i % 2], i % 9, int(i % 9 > 5)) for i in range(120)]
    train = spark.createDataFrame(rows, schema)
    model = ml.train_models(train, names=["gbt_c"], n=1, folds=2, overrides={"maxIter": 2, "maxDepth": 2}).pipeline("gbt_c")
    source, out, state = (str(tmp_path / d) for d in ("in", "out", "state"))
    for part in range(3):
        add(spark, source, rows[part * 40 : part * 40 + 40], schema)
    jobs.stream_scores(stream(spark, source, schema), model, out, state, "v7").awaitTermination()
    jobs.stream_scores(stream(spark, source, schema), model, out, state, "v7").awaitTermination()
    stored = spark.read.parquet(out)
    got = {r.customer_id: r.churn_probability for r in stored.collect()}
    want = {r.customer_id: r.p for r in ml.score(model, train).select("customer_id", F.bround("churn_probability", 4).alias("p")).collect()}
    assert got == want and stored.count() == 120
    assert {r.model_version for r in stored.collect()} == {"v7"}


def test_times_without_a_zone_are_utc(spark):
    local = spark.readStream.schema("created_at timestamp_ntz, sentiment string").parquet("/root/testdata/sf0.001")
    assert jobs.daily_sentiment(local).columns == ["date", "daily_sentiment_score", "volume"]


def test_current_rows_in_state(spark, tmp_path):
    """Changes come out once, restarts go on, late and older rows change nothing, and there is one folder."""
    source, out, state = (str(tmp_path / d) for d in ("in", "out", "state"))
    schema = FEEDBACK + ", seq long"

    def run():
        rows = stream(spark, source, schema)
        jobs.stream_current(rows, out, state, ["created_at", "seq"], expire="10 days").awaitTermination()
        changes = spark.read.parquet(out)
        current = jobs.current_of_changes(changes, ["created_at", "seq"])
        got = {(r.customer_id, r.raw_text): r.sentiment for r in current.collect()}
        return got, sorted((r.customer_id, r.change, r.sentiment) for r in changes.collect())

    add(spark, source, [("a", "x", "one", hours(5), 1), ("a", "x", "two", hours(5), 2), ("b", "y", "one", hours(1), 3), ("n", None, "one", hours(1), 9)], schema)
    got, changes = run()
    assert got == {("a", "x"): "two", ("b", "y"): "one", ("n", None): "one"}
    assert changes == [("a", "insert", "two"), ("b", "insert", "one"), ("n", "insert", "one")]
    assert run()[1] == changes  # nothing new, nothing repeated
    add(spark, source, [("a", "x", "older", hours(4), 4), ("b", "y", "newer", hours(2), 5)], schema)
    got, changes = run()
    assert got[("a", "x")] == "two" and got[("b", "y")] == "newer" and ("b", "update", "newer") in changes and len(changes) == 4
    add(spark, source, [("c", "z", "much later", hours(24 * 20), 6)], schema)  # time goes on: a and b are forgotten
    run()
    add(spark, source, [("a", "x", "too late", hours(6), 7), ("b", "y", "again", hours(24 * 19), 8)], schema)
    got, changes = run()
    assert got[("a", "x")] == "two" and got[("b", "y")] == "again"
    assert ("b", "insert", "again") in changes and not any(c[2] == "too late" for c in changes)
    assert not [f for f in (tmp_path / "out").iterdir() if f.is_dir() and f.name != "_spark_metadata"]


def test_current_rows_equal_the_batch(spark, tmp_path):
    source, out, state = (str(tmp_path / d) for d in ("in", "out", "state"))
    rng, schema = random.Random(3), FEEDBACK + ", seq long"
    rows = [(rng.choice("abcde"), rng.choice("xyz"), f"s{i}", hours(rng.randrange(200)), i) for i in range(400)]
    for part in range(20):
        add(spark, source, rows[part * 20 : part * 20 + 20], schema)
    jobs.stream_current(stream(spark, source, schema), out, state, ["created_at", "seq"]).awaitTermination()
    got = {(r.customer_id, r.raw_text): r.seq for r in jobs.current_of_changes(spark.read.parquet(out), ["created_at", "seq"]).collect()}
    want = {}
    for r in rows:
        key = r[:2]
        want[key] = max(want.get(key, (START - datetime.timedelta(1), 0)), (r[3], r[4]))
    assert got == {k: v[1] for k, v in want.items()}
    folders = [f for f in (tmp_path / "out").rglob("*") if f.is_dir()]
    assert len(folders) == 1  # after 20 micro-batches: the sink's log


def test_current_rows_of_many_keys_in_few_calls(spark, tmp_path):
    """Keys share buckets, of which each is one call; each key is still on its own, nulls and blanks included."""
    source, out, state = (str(tmp_path / d) for d in ("in", "out", "state"))
    schema = FEEDBACK + ", seq long"
    keys = [(None, "x"), ("", "x"), ("null", None), ("a", '","raw_text":"b'), ("a\",\"raw_text\":\"", "b"), *((f"k{i}", "x") for i in range(300))]
    calls, order = [], ["created_at", "seq"]

    def run():
        rows = jobs.current_changes(stream(spark, source, schema), order, buckets=2)
        writer = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
        query = writer.trigger(availableNow=True).start()
        query.awaitTermination()
        calls.append(max(o.numRowsTotal for p in query.recentProgress for o in p.stateOperators))
        return spark.read.parquet(out).groupBy("change").count().collect()

    add(spark, source, [(*k, "s", hours(1), i) for i, k in enumerate(keys)], schema)
    assert {r["change"]: r["count"] for r in run()} == {"insert": len(keys)}
    add(spark, source, [(*k, "t", hours(i % 2), 1000 + i) for i, k in enumerate(keys)], schema)  # every second one is older
    later = len(keys) // 2
    assert {r["change"]: r["count"] for r in run()} == {"insert": len(keys), "update": later}
    got = {(r.customer_id, r.raw_text): r.seq for r in jobs.current_of_changes(spark.read.parquet(out), order).collect()}
    assert got == {k: 1000 + i if i % 2 else i for i, k in enumerate(keys)} and max(calls) == 2


RECORDS = "customer_id string, n int, recorded_at timestamp"
LABELS = "customer_id string, raw_text string, feedback_category string, sentiment string, complaint_intensity int, created_at timestamp"


def test_records_with_feedback_that_arrives_around_them(spark, tmp_path):
    left, right, out, state = (str(tmp_path / d) for d in ("left", "right", "out", "state"))
    end = hours(24 * 60)
    add(spark, left, [("a", 1, hours(30)), ("b", 2, hours(30)), (None, 3, hours(31)), ("a", 4, hours(100))], RECORDS)
    add(spark, right, [("a", "old", "pricing", "neutral", 1, hours(3)), ("a", "t1", "pricing", "neutral", 1, hours(20)), ("a", "t2", None, "negative", 2, hours(29))], LABELS)
    add(spark, right, [("a", "after", "pricing", "neutral", 1, hours(31)), (None, "nobody", None, None, None, hours(30))], LABELS)
    add(spark, left, [("end", 0, end)], RECORDS)
    add(spark, right, [("end", None, None, None, None, end)], LABELS)
    joined = jobs.enriched_stream(stream(spark, left, RECORDS), stream(spark, right, LABELS), delay="2 days")
    writer = joined.writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
    writer.trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(out)
    got = sorted((r.n, r.feedback_text or "") for r in rows.filter("n > 0").collect())
    assert got == [(1, "t1"), (1, "t2"), (2, ""), (3, ""), (4, "")]
    batch = jobs.enriched_stream(spark.read.schema(RECORDS).parquet(left), spark.read.schema(LABELS).parquet(right), delay="2 days")
    assert sorted((r.n, r.feedback_text or "") for r in batch.filter("n > 0").collect()) == got
    newest = {r.n: r.feedback_text for r in jobs.newest_of_record(rows.filter("n > 0")).collect()}
    assert newest == {1: "t2", 2: None, 3: None, 4: None}


def test_each_export_is_loaded_once(spark, tmp_path):
    exports, out, state = tmp_path / "exports", str(tmp_path / "out"), str(tmp_path / "state")
    exports.mkdir()
    schema = "customer_id string, text string"

    def run():
        jobs.ingest_new_files(spark, str(exports), out, state, spark.createDataFrame([], schema).schema).awaitTermination()
        rows, rejects = jobs.ingested(spark, out, spark.createDataFrame([], schema).schema)
        return sorted(r.customer_id for r in rows.collect()), sorted(r.text for r in rejects.collect())

    (exports / "one.json").write_text('{"customer_id": "a", "text": "t"}\n{broken\n')
    assert run() == (["a"], ["{broken"])
    assert run() == (["a"], ["{broken"])  # a second run adds nothing
    (exports / "two.json").write_text(json.dumps({"customer_id": "b", "text": "t"}) + "\n")
    assert run() == (["a", "b"], ["{broken"])
    commits = [f for f in (tmp_path / "state" / "commits").iterdir() if f.name.isdigit()]
    last = max(commits, key=lambda f: int(f.name))
    last.unlink()  # as after a crash between the write and the commit
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    assert run() == (["a", "b"], ["{broken"])


def test_a_micro_batch_has_a_file_for_every_core(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    rows = spark.createDataFrame([(str(i), f"t{i}", None, hours(i)) for i in range(400)], FEEDBACK)
    records = streams._stored(spark, rows, "many-records")
    writer = records.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    given = [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]
    assert len(given) == 4 and sum(given) == 400
    assert len(spark.read.parquet(str(tmp_path / "out")).inputFiles()) >= 4 * min(cores, 4)  # batches were written by several tasks


def test_a_side_of_a_join_has_a_file_for_every_core_and_one_late_row(spark):
    rows = spark.createDataFrame([(str(i), f"t{i}", None, hours(i)) for i in range(400)], FEEDBACK)
    path = streams._with_late_row(spark, rows, "many-sides", "created_at")
    assert len(spark.read.parquet(path).inputFiles()) == spark.sparkContext.defaultParallelism + 1
    late = spark.read.parquet(path).filter("customer_id = ''").collect()
    assert len(late) == 1 and late[0]["created_at"] > hours(400) and late[0]["raw_text"] is None


def test_the_aggregates_behind_records_run_once(spark, sf_dir, monkeypatch):
    class Written(Exception):
        pass

    def side(spark, rows, label, time):
        assert label == "records" and "Aggregate" not in rows._jdf.queryExecution().optimizedPlan().toString()
        raise Written

    monkeypatch.setattr(streams, "champion_path", lambda spark, sf_dir: "")
    monkeypatch.setattr(streams.ml, "load_pipeline", lambda path: None)
    monkeypatch.setattr(streams, "_with_late_row", side)
    with pytest.raises(Written):
        load_all()["stream_enriched_scores"].run(spark, sf_dir)
