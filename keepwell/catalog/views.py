"""The logical tables, derived from the test tables; each once for Spark and once as a SQL view text.

Only ``SQL`` names with their dependencies are used by the twins: see ``with_views``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from keepwell.functions.urls import canonical_url
from keepwell.operators.links import extract_links
from keepwell.schemas import CALL_PERIODS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SQL: dict[str, str] = {}
_NEEDS: dict[str, tuple[str, ...]] = {}


def _sql(name: str, text: str, needs: tuple[str, ...] = ()) -> None:
    SQL[name] = text
    _NEEDS[name] = needs


def with_views(names: str, body: str) -> str:
    """``body`` after the view definitions it needs (names separated by blanks)."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS[name]:
            add(need)
        if name not in order:
            order.append(name)

    for name in names.split():
        add(name)
    return "WITH " + ",\n".join(f"{n} AS (\n{SQL[n]}\n)" for n in order) + "\n" + body


# --- feedback: one row per event -------------------------------------------------------------


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.col("event_type")
    category = (
        F.when((kind == "error") & (F.col("k") >= 80), "churn_intent")
        .when(kind == "error", "customer_support")
        .when(kind == "purchase", "pricing")
        .otherwise("service_quality")
    )
    tone = F.when(kind.isin("purchase", "signup"), "Positive").when(kind == "error", "negative").otherwise("neutral")
    return events.withColumn("k", k).select(
        F.col("event_id").alias("seq"),
        F.col("user_id").cast("string").alias("customer_id"),
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("username"),
        category.alias("feedback_category"),
        tone.alias("sentiment"),
        (1 + F.col("k") % 5).alias("complaint_intensity"),
        F.concat(kind, F.lit(":"), F.col("k").cast("string")).alias("raw_text"),
        F.element_at(F.array(F.lit("Web"), F.lit("Facebook"), F.lit("facebook")), (F.col("event_id") % 3 + 1).cast("int")).alias("source"),
        F.col("ts").cast("timestamp").alias("created_at"),
    )


_sql(
    "feedback",
    """SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS customer_id, 'user_' || CAST(user_id AS VARCHAR) AS username,
       CASE WHEN event_type = 'error' AND k >= 80 THEN 'churn_intent' WHEN event_type = 'error' THEN 'customer_support'
            WHEN event_type = 'purchase' THEN 'pricing' ELSE 'service_quality' END AS feedback_category,
       CASE WHEN event_type IN ('purchase', 'signup') THEN 'Positive' WHEN event_type = 'error' THEN 'negative'
            ELSE 'neutral' END AS sentiment,
       CAST(1 + k % 5 AS INTEGER) AS complaint_intensity, event_type || ':' || CAST(k AS VARCHAR) AS raw_text,
       CASE event_id % 3 WHEN 0 THEN 'Web' WHEN 1 THEN 'Facebook' ELSE 'facebook' END AS source, ts AS created_at
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)""",
)


def newest(df: DataFrame, column: str = "created_at") -> Column:
    """The largest time in the table, as a scalar subquery: what a live dashboard calls now."""
    return df.agg(F.max(column)).scalar()


# --- subscribers: customers with orders before a cut-off -------------------------------------

_CUT_DAYS = 270
_PERIOD_OF = {"1-URGENT": "day", "2-HIGH": "eve", "3-MEDIUM": "night"}


def subscribers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage up to 270 days before the last order; churned without an order after that."""
    orders = table(spark, sf_dir, "orders")
    cut = orders.agg(F.max("o_orderdate")).scalar() - F.expr(f"INTERVAL {_CUT_DAYS} DAYS")
    period = F.coalesce(
        *[F.when(F.col("o_orderpriority") == p, name) for p, name in _PERIOD_OF.items()], F.lit("intl")
    )
    marked = orders.select(
        "o_custkey", "o_orderkey", "o_totalprice", "o_orderdate",
        period.alias("period"), (F.col("o_orderdate") < cut).alias("past"), cut.alias("cut"),
    )
    usage = []
    for name in CALL_PERIODS:
        call = F.col("past") & (F.col("period") == name)
        usage += [
            F.sum(F.when(call, (F.col("o_orderkey") % 240).cast("double"))).alias(f"total_{name}_minutes"),
            F.count_if(call).cast("int").alias(f"total_{name}_calls"),
            F.bround(F.sum(F.when(call, F.col("o_totalprice"))), 2).alias(f"total_{name}_charge"),
        ]
    history = marked.groupBy("o_custkey").agg(
        F.count_if("past").cast("int").alias("number_vmail_messages"),
        F.datediff(F.max("cut"), F.min("o_orderdate")).alias("account_length"),
        *usage,
        F.when(F.count_if(~F.col("past")) == 0, 1).otherwise(0).alias("churn"),
    )
    calls = (
        table(spark, sf_dir, "events")
        .filter("event_type = 'error'")
        .groupBy("user_id")
        .agg(F.count("*").cast("int").alias("service_calls"))
    )
    customers = table(spark, sf_dir, "customer")
    nations = table(spark, sf_dir, "nation")
    joined = (
        history.filter("number_vmail_messages > 0")
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(calls, F.col("c_custkey") == F.col("user_id"), "left")
    )
    balance = F.col("c_acctbal")
    return joined.select(
        F.col("c_custkey").cast("string").alias("customer_id"),
        F.col("n_name").alias("state"),
        "account_length",
        (F.col("c_nationkey") + 400).alias("area_code"),
        F.when(F.col("c_mktsegment").isin("MACHINERY", "AUTOMOBILE"), "yes").otherwise("no").alias("international_plan"),
        F.when(balance >= 5000, "yes").when(balance >= 0, "no").alias("voice_mail_plan"),
        "number_vmail_messages",
        *[f"total_{p}_{kind}" for p in CALL_PERIODS for kind in ("minutes", "calls", "charge")],
        F.coalesce("service_calls", F.lit(0)).alias("customer_service_calls"),
        "churn",
    )


def _usage_sql(name: str) -> str:
    call = f"past AND period = '{name}'"
    return f"""sum(CASE WHEN {call} THEN CAST(o_orderkey % 240 AS DOUBLE) END) AS total_{name}_minutes,
       CAST(count(CASE WHEN {call} THEN 1 END) AS INTEGER) AS total_{name}_calls,
       round_even(sum(CASE WHEN {call} THEN o_totalprice END), 2) AS total_{name}_charge"""


_sql(
    "marked_orders",
    f"""SELECT o.*, o_orderdate < cut AS past, cut,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'day' WHEN '2-HIGH' THEN 'eve' WHEN '3-MEDIUM' THEN 'night'
            ELSE 'intl' END AS period
FROM orders o, (SELECT max(o_orderdate) - INTERVAL {_CUT_DAYS} DAY AS cut FROM orders) c""",
)
_sql(
    "subscribers",
    f"""SELECT CAST(c_custkey AS VARCHAR) AS customer_id, n_name AS state, account_length, c_nationkey + 400 AS area_code,
       CASE WHEN c_mktsegment IN ('MACHINERY', 'AUTOMOBILE') THEN 'yes' ELSE 'no' END AS international_plan,
       CASE WHEN c_acctbal >= 5000 THEN 'yes' WHEN c_acctbal >= 0 THEN 'no' END AS voice_mail_plan,
       number_vmail_messages,
       {", ".join(f"total_{p}_{kind}" for p in CALL_PERIODS for kind in ("minutes", "calls", "charge"))},
       coalesce(service_calls, 0) AS customer_service_calls, churn
FROM (SELECT o_custkey, CAST(count(CASE WHEN past THEN 1 END) AS INTEGER) AS number_vmail_messages,
             CAST(date_diff('day', min(o_orderdate), max(cut)) AS INTEGER) AS account_length,
             {", ".join(_usage_sql(p) for p in CALL_PERIODS)},
             CASE WHEN count(CASE WHEN NOT past THEN 1 END) = 0 THEN 1 ELSE 0 END AS churn
      FROM marked_orders GROUP BY o_custkey) h
JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN (SELECT user_id, CAST(count(*) AS INTEGER) AS service_calls FROM events WHERE event_type = 'error'
           GROUP BY user_id) e ON c_custkey = user_id
WHERE number_vmail_messages > 0""",
    needs=("marked_orders",),
)


# --- predictions and scores: fixed numbers, so that metrics need no model ---------------------


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = F.bround(((F.col("c_custkey") * 7919) % 10000) / F.lit(10000.0), 4)
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("customer_id"), share.alias("churn_probability")
    )


_sql(
    "predictions",
    """SELECT CAST(c_custkey AS VARCHAR) AS customer_id,
       round_even(((c_custkey * 7919) % 10000) / 10000.0::DOUBLE, 4) AS churn_probability FROM customer""",
)


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    joined = table(spark, sf_dir, "labels").select("doc_id", "quality").join(documents, "doc_id")
    p = F.bround((F.col("n_chars") % 1000) / F.lit(1000.0), 4)
    return joined.select("doc_id", F.col("quality").alias("y"), p.alias("p"))


_sql(
    "scores",
    """SELECT doc_id, quality AS y, round_even((n_chars % 1000) / 1000.0::DOUBLE, 4) AS p
FROM labels JOIN documents USING (doc_id)""",
)


# --- comments: conversations and documents ---------------------------------------------------


def conversation_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("conv/"), F.col("conv_id").cast("string")).alias("post_url"),
        F.col("role").alias("username"),
        "text",
        F.col("turn").alias("seq"),
    )


_sql(
    "conversation_comments",
    "SELECT 'conv/' || CAST(conv_id AS VARCHAR) AS post_url, role AS username, text, turn AS seq FROM conversations",
)


def document_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as comments; posts are few and hot, texts long and often repeated."""
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("docs/"), F.col("source")).alias("post_url"),
        F.concat(F.lit("reader_"), F.col("lang")).alias("username"),
        "text",
        F.col("doc_id").alias("seq"),
    )


_sql(
    "document_comments",
    """SELECT 'docs/' || source AS post_url, 'reader_' || lang AS username, text, doc_id AS seq FROM documents""",
)


def marked_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document comments with interface phrases and blanks around them."""
    text = F.concat(
        F.element_at(F.array(F.lit(""), F.lit(" See translation"), F.lit("Edited \t")), (F.col("seq") % 3 + 1).cast("int")),
        F.lit("  "),
        F.col("text"),
        F.element_at(F.array(F.lit(" See more"), F.lit("\n"), F.lit(" Hide translation ")), (F.col("seq") % 3 + 1).cast("int")),
    )
    return document_comments(spark, sf_dir).withColumn("text", text)


_sql(
    "marked_comments",
    """SELECT post_url, username, seq,
       CASE seq % 3 WHEN 0 THEN '' WHEN 1 THEN ' See translation' ELSE 'Edited ' || chr(9) END || '  ' || text ||
       CASE seq % 3 WHEN 0 THEN ' See more' WHEN 1 THEN chr(10) ELSE ' Hide translation ' END AS text
FROM document_comments""",
    needs=("document_comments",),
)


def comment_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as nested page boxes: the name alone, the whole comment box, the box around it."""
    name, text = F.col("role"), F.col("text")
    box = F.concat_ws("\n", F.lit("  Follow"), name, F.lit("3d"), text, F.lit("Like"), F.lit("Reply"), F.lit("12 replies"))
    return table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("conv/"), F.col("conv_id").cast("string")).alias("post_url"),
        name.alias("username"),
        F.array(name, box, F.concat(box, F.lit("\n"), box)).alias("containers"),
        F.col("turn").alias("seq"),
    )


# --- links: every href of the pages, as feed links --------------------------------------------


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed links of a host: post, reel, permalink and other URLs with tracking parts."""
    pages = table(spark, sf_dir, "pages").withColumn("host", F.regexp_extract("url", "^https?://([^/?#]+)", 1))
    hrefs = extract_links(pages.select("page_id", "host", "html")).withColumnRenamed("url", "href")
    path = F.element_at(
        F.array(F.lit("/posts"), F.lit("/reel"), F.lit("/about"), F.lit("/posts")), (F.col("position") % 4 + 1).cast("int")
    )
    label = F.substr(F.col("href"), F.lit(2))
    kind = (F.col("page_id") + F.col("position")) % 6
    return hrefs.select(
        "host",
        "page_id",
        "position",
        F.concat(F.lit("https://"), F.col("host"), path, F.col("href"), F.lit("?ref="), F.col("page_id").cast("string")).alias("url"),
        F.when(kind == 0, F.lit("")).when(kind == 1, F.concat(F.lit("Playback "), label)).when(kind == 2, label).alias("aria_label"),
        F.when(kind == 0, F.concat(label, F.lit(" h"))).alias("title"),
        F.when(kind == 3, F.lit(" ")).when(kind == 4, F.lit("Video 1")).otherwise(F.concat(F.lit(" "), label)).alias("text"),
        F.when(kind == 3, F.concat(label, F.lit(" around "))).when(kind == 5, F.lit("")).alias("parent_text"),
    )


_sql(
    "hrefs",
    """SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host,
       unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href,
       CAST(unnest(range(len(regexp_extract_all(html, 'href="([^"]*)"', 1)))) AS INTEGER) AS position
FROM pages""",
)
_sql(
    "links",
    """SELECT host, page_id, position,
       'https://' || host || CASE position % 4 WHEN 1 THEN '/reel' WHEN 2 THEN '/about' ELSE '/posts' END || href ||
         '?ref=' || CAST(page_id AS VARCHAR) AS url,
       CASE kind WHEN 0 THEN '' WHEN 1 THEN 'Playback ' || label WHEN 2 THEN label END AS aria_label,
       CASE kind WHEN 0 THEN label || ' h' END AS title,
       CASE kind WHEN 3 THEN ' ' WHEN 4 THEN 'Video 1' ELSE ' ' || label END AS text,
       CASE kind WHEN 3 THEN label || ' around ' WHEN 5 THEN '' END AS parent_text
FROM (SELECT *, substring(href, 2) AS label, (page_id + position) % 6 AS kind FROM hrefs)""",
    needs=("hrefs",),
)


def page_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "url", canonical_url(F.col("url")).alias("canonical"))


# --- labeller answers -------------------------------------------------------------------------


def label_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON answers, one per event: broken, without results, with a null, with several items, plain."""
    shape = F.col("event_id") % 50
    full = F.concat(
        F.lit('{"results":[{"feedback_category":"pricing","sentiment":"negative","complaint_intensity":'),
        (1 + F.col("event_id") % 5).cast("string"),
        F.lit("}]}"),
    )
    answer = (
        F.when(shape == 0, "{bad")
        .when(shape == 1, '{"x":1}')
        .when(shape == 2, '{"results":[{"sentiment":null}]}')
        .when(shape == 3, '{"results":[{"sentiment":"positive"},{"complaint_intensity":4}]}')
        .when(shape == 4, '{"results":"none"}')
        .when(shape == 5, '{"results":[{"sentiment":"neutral"},7,{"sentiment":"positive"}]}')
        .when(shape == 6, "[1]")
        .otherwise(full)
    )
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        F.col("user_id").cast("string").alias("customer_id"),
        F.lit("Anonymous User").alias("username"),
        F.col("event_type").alias("raw_text"),
        answer.alias("answer"),
    )


_sql(
    "label_answers",
    """SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS customer_id, 'Anonymous User' AS username,
       event_type AS raw_text,
       CASE event_id % 50 WHEN 0 THEN '{bad' WHEN 1 THEN '{"x":1}' WHEN 2 THEN '{"results":[{"sentiment":null}]}'
         WHEN 3 THEN '{"results":[{"sentiment":"positive"},{"complaint_intensity":4}]}'
         WHEN 4 THEN '{"results":"none"}'
         WHEN 5 THEN '{"results":[{"sentiment":"neutral"},7,{"sentiment":"positive"}]}'
         WHEN 6 THEN '[1]'
         ELSE '{"results":[{"feedback_category":"pricing","sentiment":"negative","complaint_intensity":' ||
              CAST(1 + event_id % 5 AS VARCHAR) || '}]}' END AS answer
FROM events""",
)
