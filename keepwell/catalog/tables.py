"""Queries for sources, sinks, upserts and column shaping.

Sinks write to a fresh path in the scratch area; the query returns what was stored.
"""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F, types as T

from keepwell.catalog import query, views
from keepwell.catalog.views import feedback, subscribers, with_views
from keepwell.functions import times
from keepwell.functions import text as tx
from keepwell.operators import scoring, shaping, upsert
from keepwell.operators.dedup import keep_first
from keepwell.plans import migration
from keepwell.plans.ingest import empty_feedback
from keepwell.schemas import FEEDBACK, FEEDBACK_EXPORT, FEEDBACK_KEY, SUBSCRIBERS, existing
from keepwell.session import scratch_path
from keepwell.sources import readers, writers

_SUBSCRIBER_COLUMNS = [c for c in SUBSCRIBERS.fieldNames() if c not in ("feedback_text", "feedback_category", "sentiment", "complaint_intensity")]
_SUBSCRIBERS = ", ".join(_SUBSCRIBER_COLUMNS)
_EXPORT = ", ".join(FEEDBACK_EXPORT)
_ALL_SUBSCRIBERS = with_views("subscribers", f"SELECT {_SUBSCRIBERS} FROM subscribers")


# --- sources ----------------------------------------------------------------------------------


@query("scan_subscribers", _ALL_SUBSCRIBERS)
def _(spark, sf_dir):
    return readers.require_rows(subscribers(spark, sf_dir), "subscribers")


@query("scan_feedback", with_views("feedback", f"SELECT seq, {_EXPORT}, source FROM feedback"))
def _(spark, sf_dir):
    path = scratch_path(spark, "feedback")
    feedback(spark, sf_dir).write.parquet(path)
    return readers.read_feedback(spark, path).select("seq", *FEEDBACK_EXPORT, "source")


# The bounded scan is the feature; the order by key makes its result repeatable.
@query("scan_limit", "SELECT event_id, user_id, event_type FROM events ORDER BY event_id LIMIT 1000")
def _(spark, sf_dir):
    return views.table(spark, sf_dir, "events").select("event_id", "user_id", "event_type").orderBy("event_id").limit(1000)


# The key lookup is the feature: one customer, asked for with blanks and quotes.
@query("lookup_customer", "SELECT event_id, CAST(user_id AS VARCHAR) AS customer_id, event_type FROM events WHERE user_id = 7")
def _(spark, sf_dir):
    path = scratch_path(spark, "events-by-customer")
    events = views.table(spark, sf_dir, "events")
    rows = events.select("event_id", F.col("user_id").cast("string").alias("customer_id"), "event_type")
    rows.sortWithinPartitions("customer_id").write.parquet(path)
    return scoring.lookup_customer(readers.read_table(spark, path), " \"7' ")


@query("normalize_ids", """
SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS customer_id, CAST(count(o_orderkey) AS BIGINT) AS orders
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def _(spark, sf_dir):
    key = F.col("c_custkey").cast("string")
    typed = F.concat(F.lit(" \t'"), key, F.lit("\"\n"))
    customers = views.table(spark, sf_dir, "customer").select("c_custkey", tx.clean_id(typed).alias("customer_id"))
    orders = views.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("string").alias("customer_id"))
    counts = orders.agg(F.count("*").alias("orders"))
    return customers.join(counts, "customer_id", "left").withColumn("orders", F.coalesce("orders", F.lit(0)).cast("bigint"))


@query("scan_csv_roundtrip", with_views("feedback", f"SELECT {_EXPORT} FROM feedback"))
def _(spark, sf_dir):
    path, escaped = scratch_path(spark, "feedback-csv"), scratch_path(spark, "feedback-csv-escaped")
    rows = feedback(spark, sf_dir)
    writers.export_feedback_csv(rows.filter("seq % 2 = 0"), path)
    writers.export_feedback_csv(rows.filter("seq % 2 = 1"), escaped, escaped=True)
    whole = readers.read_csv(spark, path, FEEDBACK, multi_line=True)
    return whole.unionByName(readers.read_csv(spark, escaped, FEEDBACK, escaped=True))


# Files with columns in other orders, and one file set without a column that the other has.
@query("scan_glob_csv", with_views("subscribers", f"""
SELECT {_SUBSCRIBERS.replace('area_code', 'CASE WHEN churn = 0 THEN area_code END AS area_code')} FROM subscribers"""))
def _(spark, sf_dir):
    base = scratch_path(spark, "subscriber-csv")
    rows = subscribers(spark, sf_dir)
    rows.filter("churn = 0").write.option("header", True).csv(f"{base}/test_stayed")
    left = rows.filter("churn = 1").withColumn("note", F.lit("not wanted"))
    left.select(*reversed([c for c in left.columns if c != "area_code"])).write.option("header", True).csv(f"{base}/test_left")
    return readers.read_csv(spark, f"{base}/test*/*.csv").select(*rows.columns)


# Every fifth line has a value that doesn't fit, every seventh of the others ends too early.
@query("scan_csv_rejects", with_views("feedback", """
SELECT seq, CASE WHEN seq % 5 = 0 THEN 'complaint_intensity: not a int' ELSE 'not as many values as the header has' END AS reason
FROM feedback WHERE seq % 5 = 0 OR seq % 7 = 0"""))
def _(spark, sf_dir):
    path = scratch_path(spark, "broken-csv")
    seq = F.col("seq").cast("string")
    bad = F.when(F.col("seq") % 5 == 0, F.lit("many")).otherwise(F.col("complaint_intensity").cast("string"))
    short = (F.col("seq") % 7 == 0) & (F.col("seq") % 5 != 0)
    lines = feedback(spark, sf_dir).select(
        F.col("seq"), F.when(short, seq).otherwise(F.concat_ws(",", seq, bad, F.lit("neutral"))).alias("value")
    )
    parts = lines.groupBy(F.floor(F.col("seq") / 500).alias("file")).agg(  # files of 500 lines
        F.concat_ws("\n", F.lit("customer_id,complaint_intensity,sentiment"), F.sort_array(F.collect_list("value"))).alias("value")
    )
    parts.write.partitionBy("file").text(path)
    rows, rejects = readers.read_csv_checked(spark, f"{path}/*/part-*", FEEDBACK)
    good = rows.select(F.col("customer_id").cast("bigint").alias("seq"), F.lit("kept").alias("reason"))
    cell = F.coalesce(F.get_json_object("text", "$.customer_id"), F.col("text"))
    found = rejects.select(cell.cast("bigint").alias("seq"), "reason")
    return found.join(good.select(F.col("seq").alias("_kept")), F.col("seq") == F.col("_kept"), "left_anti")


# Files that begin with a byte order mark, as some spreadsheets write them.
@query("scan_csv_mark", with_views("subscribers", "SELECT customer_id, state, churn FROM subscribers"))
def _(spark, sf_dir):
    path = scratch_path(spark, "marked-csv")
    rows = subscribers(spark, sf_dir).select(F.to_csv(F.struct("customer_id", "state", "churn")).alias("line"), "customer_id")
    parts = rows.groupBy(F.floor(F.col("customer_id").cast("int") / 200).alias("part")).agg(
        F.concat_ws("\n", F.lit("\ufeffcustomer_id,state,churn"), F.collect_list("line")).alias("value")
    )
    parts.withColumnRenamed("part", "file").write.partitionBy("file").text(path)
    return readers.read_csv(spark, f"{path}/*/part-*")


_COMMENT_ROWS = """SELECT substring(md5(username), 1, 12) AS customer_id, post_url, username, text FROM {view}"""


def _comments(spark, sf_dir, view=views.document_comments):
    rows = view(spark, sf_dir).withColumn("customer_id", tx.pseudonym(F.col("username")))
    return rows.select("customer_id", "post_url", "username", "text")


@query("scan_json_comments", with_views("document_comments", _COMMENT_ROWS.format(view="document_comments")))
def _(spark, sf_dir):
    base = scratch_path(spark, "comments-json")
    path = writers.export_comments(_comments(spark, sf_dir), base)
    return readers.read_json_lines(spark, path).drop("scraped_at", "associated_post_date")


# Many small files that each hold one JSON array.
@query("scan_json_arrays", with_views("document_comments", _COMMENT_ROWS.format(view="document_comments")))
def _(spark, sf_dir):
    path = scratch_path(spark, "comment-arrays")
    rows = _comments(spark, sf_dir)
    part = (F.crc32(F.concat_ws("|", "post_url", "text")) % 32).alias("file")
    arrays = rows.groupBy(part).agg(F.to_json(F.collect_list(F.struct(*rows.columns))).alias("value"))
    arrays.withColumn("file", F.col("file").cast("string")).write.partitionBy("file").text(path)
    return readers.read_json_comments(spark, f"{path}/*/part-*").select(*rows.columns)


@query("scan_latest_file", with_views("conversation_comments", _COMMENT_ROWS.format(view="conversation_comments")))
def _(spark, sf_dir):
    base = scratch_path(spark, "comments-runs")
    monday = datetime.datetime(2024, 1, 1, 12)
    writers.export_comments(_comments(spark, sf_dir), base, monday + datetime.timedelta(days=1))
    # Written last, so the newest by modification time whatever its name says.
    writers.export_comments(_comments(spark, sf_dir, views.conversation_comments), base, monday)
    return readers.read_latest_comments(spark, f"{base}/comments_*").drop("scraped_at", "associated_post_date")


# --- sinks ------------------------------------------------------------------------------------


@query("sink_append_comments", with_views("document_comments conversation_comments", f"""
SELECT customer_id, post_url, username, text, stamped FROM (
  SELECT *, false AS stamped FROM ({_COMMENT_ROWS.format(view="document_comments")})
  UNION ALL SELECT *, true FROM ({_COMMENT_ROWS.format(view="conversation_comments")}))"""))
def _(spark, sf_dir):
    path = scratch_path(spark, "comment-table")
    writers.append_comments(_comments(spark, sf_dir), path)
    earlier = F.lit("2024-01-01 00:00:00").cast("timestamp")
    dated = _comments(spark, sf_dir, views.conversation_comments).withColumn("scraped_at", earlier)
    writers.append_comments(dated, path)
    writers.append_comments(dated.filter("text IS NULL"), path)
    stored = readers.read_table(spark, path)
    return stored.withColumn("stamped", F.col("scraped_at") == earlier).drop("scraped_at")


@query("sink_append_subscribers", _ALL_SUBSCRIBERS)
def _(spark, sf_dir):
    path = scratch_path(spark, "subscriber-table")
    rows = subscribers(spark, sf_dir)
    writers.append_subscribers(rows.filter("churn = 1"), path)
    writers.append_subscribers(rows.filter("churn = 0"), path)
    return readers.read_table(spark, path)


# Target: the first row of every key. Batch: all rows, with the intensity raised by ten.
_FIRSTS = """(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY customer_id, raw_text ORDER BY seq) AS n
 FROM feedback WHERE sentiment <> 'negative') WHERE n = 1)"""


def _target_and_batch(spark, sf_dir):
    rows = feedback(spark, sf_dir)
    path = scratch_path(spark, "upsert-target")
    keep_first(rows.filter("sentiment <> 'negative'"), FEEDBACK_KEY, ["seq"]).write.parquet(path)
    batch = rows.withColumn("complaint_intensity", F.col("complaint_intensity") + 10).drop("created_at")
    return path, batch


@query("upsert_update", with_views("feedback", f"""
SELECT b.seq, b.customer_id, b.raw_text, CAST(b.complaint_intensity + 10 AS INTEGER) AS complaint_intensity, b.sentiment,
       strftime(t.created_at, '%Y-%m-%d %H:%M:%S.%f') AS created_at
FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY customer_id, raw_text ORDER BY seq DESC) AS n
                     FROM feedback) WHERE n = 1) b
LEFT JOIN {_FIRSTS} t USING (customer_id, raw_text)"""))
def _(spark, sf_dir):
    path, batch = _target_and_batch(spark, sf_dir)
    out = scratch_path(spark, "upserted")
    writers.write_upsert(spark, path, batch, FEEDBACK_KEY, ["seq"], out)
    stored = readers.read_table(spark, out)
    columns = ["seq", "customer_id", "raw_text", "complaint_intensity", "sentiment"]
    return stored.select(*columns, times.utc_text(F.col("created_at")).alias("created_at"))


# The same upsert into a table laid out by its keys, twice.
@query("upsert_keyed", with_views("feedback", f"""
SELECT coalesce(b.seq, t.seq) AS seq, customer_id, raw_text,
       CAST(CASE WHEN b.seq IS NULL THEN t.complaint_intensity ELSE b.complaint_intensity + 10 END AS INTEGER)
         AS complaint_intensity
FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY customer_id, raw_text ORDER BY seq DESC) AS n
                     FROM feedback WHERE sentiment <> 'neutral') WHERE n = 1) b
FULL JOIN {_FIRSTS} t USING (customer_id, raw_text)"""))
def _(spark, sf_dir):
    stored, batch = _target_and_batch(spark, sf_dir)
    columns = ["seq", *FEEDBACK_KEY, "complaint_intensity"]
    target, changed = readers.read_table(spark, stored).select(*columns), batch.filter("sentiment <> 'neutral'")
    layout = {"keys": FEEDBACK_KEY, "buckets": 8}
    path = scratch_path(spark, "by-key")
    table = writers.write_bucketed(target, f"t{path[-32:]}", path, **layout)
    for _ in range(2):  # the second time changes nothing
        path = scratch_path(spark, "by-key")
        table = writers.upsert_bucketed(table, changed, sequence=["seq"], name=f"t{path[-32:]}", path=path, **layout)
    return table.select(*columns)


@query("upsert_ignore", with_views("feedback", f"""
SELECT seq, customer_id, raw_text, complaint_intensity, sentiment FROM {_FIRSTS}
UNION ALL
SELECT seq, customer_id, raw_text, CAST(complaint_intensity + 10 AS INTEGER), sentiment FROM (
  SELECT *, row_number() OVER (PARTITION BY customer_id, raw_text ORDER BY seq) AS n FROM feedback f
  WHERE NOT EXISTS (SELECT 1 FROM {_FIRSTS} t WHERE t.customer_id = f.customer_id AND t.raw_text = f.raw_text))
WHERE n = 1"""))
def _(spark, sf_dir):
    path, batch = _target_and_batch(spark, sf_dir)
    writers.append_new(spark, path, batch, FEEDBACK_KEY, ["seq"])
    stored = readers.read_table(spark, path)
    return stored.select("seq", "customer_id", "raw_text", "complaint_intensity", "sentiment")


@query("upsert_subscribers", with_views("subscribers", """
SELECT customer_id, state, churn, CASE WHEN churn = 1 THEN customer_service_calls + 1
       ELSE customer_service_calls END AS customer_service_calls FROM subscribers"""))
def _(spark, sf_dir):
    rows = subscribers(spark, sf_dir)
    newer = rows.filter("churn = 1").withColumn("customer_service_calls", F.col("customer_service_calls") + 1)
    older = rows.filter("churn = 1").withColumn("customer_service_calls", F.lit(-1))
    batch = newer.withColumn("version", F.lit(2)).unionByName(older.withColumn("version", F.lit(1)))
    # the target lacks every second state, so that the batch both updates and inserts
    target = rows.filter((F.col("churn") == 0) | (F.col("area_code") % 2 == 0))
    merged = upsert.upsert_update(target, batch, ["customer_id"], ["version"])
    return merged.select("customer_id", "state", "churn", "customer_service_calls")


@query("migrate_idempotent", with_views("feedback", f"""
SELECT customer_id, username, feedback_category, sentiment, complaint_intensity, raw_text, 'Facebook' AS source,
       true AS same_creation
FROM (SELECT *, row_number() OVER (PARTITION BY customer_id, raw_text ORDER BY seq DESC) AS n FROM feedback)
WHERE n = 1"""))
def _(spark, sf_dir):
    export, first, second = (scratch_path(spark, f"migrate-{part}") for part in ("export", "first", "second"))
    # sorted by range, so that file names and lines follow the sequence
    writers.export_feedback_csv(feedback(spark, sf_dir).orderBy("seq"), export)
    migration.migrate_feedback(spark, empty_feedback(spark), export).write.parquet(first)
    migration.migrate_feedback(spark, readers.read_feedback(spark, first), export).write.parquet(second)
    created = readers.read_feedback(spark, first).select(*FEEDBACK_KEY, F.col("created_at").alias("_created"))
    again = readers.read_feedback(spark, second).join(created, FEEDBACK_KEY)
    same = again.withColumn("same_creation", F.col("created_at") == F.col("_created"))
    return same.select(*FEEDBACK_EXPORT, "source", "same_creation")


@query("migrate_subscribers", _ALL_SUBSCRIBERS)
def _(spark, sf_dir):
    base, first = scratch_path(spark, "migrate-subscribers"), scratch_path(spark, "migrated-subscribers")
    rows = subscribers(spark, sf_dir).withColumn("internal_note", F.lit("not for the table"))
    rows.write.option("header", True).csv(f"{base}/test_all")
    empty = spark.createDataFrame([], T.StructType([SUBSCRIBERS[c] for c in _SUBSCRIBER_COLUMNS]))
    migration.migrate_subscribers(spark, empty, f"{base}/test*").write.parquet(first)
    return migration.migrate_subscribers(spark, readers.read_table(spark, first), f"{base}/test*")


# --- shaping ----------------------------------------------------------------------------------


@query("project_whitelist", _ALL_SUBSCRIBERS)
def _(spark, sf_dir):
    rows = subscribers(spark, sf_dir).withColumn("churn", F.col("churn") == 1)
    extra = rows.withColumn("internal_score", F.lit(0.5)).withColumn("loaded_by", F.lit("job"))
    return shaping.project_whitelist(extra.select("loaded_by", "internal_score", *reversed(rows.columns)))


@query("shape_feedback", with_views("feedback", """
SELECT seq, customer_id, username, feedback_category, sentiment, complaint_intensity, raw_text, 'Facebook' AS source
FROM feedback"""))
def _(spark, sf_dir):
    raw = feedback(spark, sf_dir).withColumns(
        {
            "customer_id": F.col("customer_id").cast("bigint"),
            "username": F.concat(F.lit("\t "), F.col("username"), F.lit(" \n")),
            "complaint_intensity": F.col("complaint_intensity").cast("double"),
        }
    )
    return shaping.shape_feedback(raw, keep=["seq"]).select("seq", *FEEDBACK_EXPORT, "source")


@query("reindex_features", with_views("subscribers", """
SELECT customer_id, churn, 0 AS number_of_lines, total_day_calls, 0 AS total_weekend_calls, account_length FROM subscribers"""))
def _(spark, sf_dir):
    columns = ["churn", "number_of_lines", "total_day_calls", "total_weekend_calls", "account_length"]
    return shaping.reindex(subscribers(spark, sf_dir), columns, keep=["customer_id"])


@query("filter_churned", with_views("subscribers", f"SELECT {_SUBSCRIBERS} FROM subscribers WHERE churn = 1"))
def _(spark, sf_dir):
    return subscribers(spark, sf_dir).filter("churn = 1")


@query("defaults_applied", """
SELECT event_id, CASE WHEN event_type = 'view' THEN 'unknown' ELSE event_type END AS state, 'unknown_' || CAST(event_id AS VARCHAR)
       AS customer_id, 'Anonymous User' AS username, CASE WHEN event_type <> 'click' THEN event_type END AS sentiment
FROM events""")
def _(spark, sf_dir):
    kind = F.col("event_type")
    rows = views.table(spark, sf_dir, "events").select(
        "event_id", F.when(kind != "view", kind).alias("state"), F.when(kind != "click", kind).alias("sentiment")
    )
    ids = F.concat(F.lit("unknown_"), F.col("event_id").cast("string"))
    kept = shaping.with_defaults(rows, {"customer_id": ids, "username": shaping.ANONYMOUS, "sentiment": "neutral"})
    return shaping.with_defaults(kept, {"state": "unknown"}, fill_nulls=True)


@query("validate_payload", with_views("subscribers", """
SELECT customer_id, CASE WHEN total_day_calls % 7 = 3 THEN NULL ELSE account_length END AS account_length,
       CASE WHEN customer_service_calls % 5 = 2 THEN NULL ELSE customer_service_calls END AS customer_service_calls,
       0 AS complaint_intensity, '' AS feedback_text,
       nullif(concat_ws('; ',
         CASE WHEN total_day_calls % 7 = 3 THEN 'account_length: missing' END,
         CASE WHEN voice_mail_plan IS NULL THEN 'voice_mail_plan: missing' END,
         CASE WHEN total_day_charge IS NULL THEN 'total_day_minutes: missing' END,
         CASE WHEN total_day_charge IS NULL THEN 'total_day_charge: missing' END,
         CASE WHEN total_eve_charge IS NULL THEN 'total_eve_minutes: missing' END,
         CASE WHEN total_eve_charge IS NULL THEN 'total_eve_charge: missing' END,
         CASE WHEN total_night_charge IS NULL THEN 'total_night_minutes: missing' END,
         CASE WHEN total_night_charge IS NULL THEN 'total_night_charge: missing' END,
         CASE WHEN total_intl_charge IS NULL THEN 'total_intl_minutes: missing' END,
         CASE WHEN total_intl_charge IS NULL THEN 'total_intl_charge: missing' END,
         CASE WHEN customer_service_calls % 5 = 2 THEN 'customer_service_calls: not a number' END), '') AS errors
FROM subscribers"""))
def _(spark, sf_dir):
    rows = subscribers(spark, sf_dir)
    texts = rows.select(*[F.col(c).cast("string").alias(c) for c in existing(rows, SUBSCRIBERS.fieldNames())])
    broken = texts.withColumns(
        {
            "account_length": F.when(F.col("total_day_calls") % 7 != 3, F.col("account_length")),
            "customer_service_calls": F.when(F.col("customer_service_calls") % 5 == 2, "many").otherwise(
                F.concat(F.lit(" "), F.col("customer_service_calls"))
            ),
        }
    )
    checked = shaping.check_payloads(broken)
    return checked.select("customer_id", "account_length", "customer_service_calls", "complaint_intensity", "feedback_text", "errors")
