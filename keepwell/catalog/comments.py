"""Comment, link, label and de-duplication queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from keepwell.catalog import query, views
from keepwell.catalog.views import feedback, with_views
from keepwell.functions import text as tx
from keepwell.functions import urls
from keepwell.operators import comments as cm
from keepwell.operators.lexicon import lexicon_join, words
from keepwell.operators import dedup, labels
from keepwell.operators import links as ln
from keepwell.plans import ingest

# White space for the twins, whose regular expressions are ASCII by default.
_S = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _strip(column: str) -> str:
    return f"regexp_replace({column}, '^{_S}+|{_S}+$', '', 'g')"


def _clean(column: str) -> str:
    for phrase in tx.UI_PHRASES:
        column = f"regexp_replace({column}, '{_S}*{phrase}{_S}*', ' ', 'g')"
    return f"trim(regexp_replace({column}, '{_S}+', ' ', 'g'), ' ')"


_CLEANED = f"""SELECT post_url, username, seq, {_clean('text')} AS text FROM marked_comments
WHERE length({_strip('text')}) >= 3"""


@query("clean_comments", with_views("marked_comments", f"""
SELECT post_url, username, seq, text FROM ({_CLEANED}) WHERE text <> ''"""))
def _(spark, sf_dir):
    return cm.drop_blank(cm.clean_comments(views.marked_comments(spark, sf_dir)))


_BLOCKED = ("system",)


@query("filter_authors", with_views("conversation_comments document_comments", r"""
SELECT post_url, username, seq
FROM (SELECT * FROM conversation_comments UNION ALL SELECT * FROM document_comments
      UNION ALL SELECT post_url, CAST(seq AS VARCHAR) || CASE seq % 4 WHEN 0 THEN 'd' WHEN 1 THEN '' WHEN 2 THEN ' / x'
                                                    ELSE ' Privacy' END, text, seq FROM document_comments)
WHERE length(username) >= 3 AND username <> 'system' AND NOT regexp_matches(username, '^\p{Nd}+[dhwmy]?$')
  AND NOT contains(lower(username), 'facebook.com') AND NOT contains(lower(username), 'privacy')
  AND NOT contains(username, '/')"""))
def _(spark, sf_dir):
    documents = views.document_comments(spark, sf_dir)
    endings = F.array(F.lit("d"), F.lit(""), F.lit(" / x"), F.lit(" Privacy"))
    noise = F.concat(F.col("seq").cast("string"), F.element_at(endings, (F.col("seq") % 4 + 1).cast("int")))
    rows = dedup.union_batches(
        [views.conversation_comments(spark, sf_dir), documents, documents.withColumn("username", noise)]
    )
    return cm.filter_authors(rows, _BLOCKED).select("post_url", "username", "seq")


@query("union_batches", with_views("conversation_comments document_comments", """
SELECT post_url, username, text, seq FROM conversation_comments
UNION ALL SELECT post_url, username, text, seq FROM document_comments"""))
def _(spark, sf_dir):
    return dedup.union_batches([views.conversation_comments(spark, sf_dir), views.document_comments(spark, sf_dir)])


# The comment of a box is the middle one, without the lines that are buttons, ages or counts.
@query("extract_comment_body", rf"""
SELECT 'conv/' || CAST(conv_id AS VARCHAR) AS post_url, role AS username, turn AS seq,
       (SELECT string_agg(line, ' ' ORDER BY i) FROM (
          SELECT {_strip('part')} AS line, i
          FROM (SELECT unnest(string_split(text, chr(10))) AS part,
                       unnest(range(len(string_split(text, chr(10))))) AS i))
        WHERE line <> '' AND NOT contains(line, role) AND line NOT IN ({', '.join(f"'{line}'" for line in tx.UI_LINES)})
          AND NOT regexp_matches(line, '^\p{{Nd}}+[dhwmy]?$') AND NOT contains(lower(line), 'replied')
          AND NOT contains(lower(line), 'replies')
          AND NOT (contains(line, 'See translation') AND length(line) < 20)) AS text
FROM conversations""")
def _(spark, sf_dir):
    return cm.extract_bodies(views.comment_boxes(spark, sf_dir))


@query("pseudonymize", with_views("conversation_comments document_comments", """
SELECT DISTINCT username, substring(md5(username), 1, 12) AS customer_id
FROM (SELECT username || ' ' || CAST(seq AS VARCHAR) AS username FROM document_comments
      UNION ALL SELECT username FROM conversation_comments)"""))
def _(spark, sf_dir):
    names = views.document_comments(spark, sf_dir).select(
        F.concat("username", F.lit(" "), F.col("seq").cast("string")).alias("username")
    )
    rows = dedup.union_batches([names, views.conversation_comments(spark, sf_dir).select("username")])
    return cm.pseudonymize(rows.distinct())


@query("dedup_comments", with_views("marked_comments", f"""
SELECT post_url, customer_id, seq, text
FROM (SELECT *, row_number() OVER (PARTITION BY post_url, customer_id, text ORDER BY seq) AS n
      FROM (SELECT *, substring(md5(username), 1, 12) AS customer_id FROM ({_CLEANED})))
WHERE n = 1"""))
def _(spark, sf_dir):
    cleaned = cm.pseudonymize(cm.clean_comments(views.marked_comments(spark, sf_dir)))
    return cm.dedup_comments(cleaned, ["seq"]).select("post_url", "customer_id", "seq", "text")


@query("extract_summary", with_views("feedback", """
SELECT count(n) AS posts_processed, count(*) - count(n) AS posts_skipped,
       CAST(coalesce(sum(n), 0) AS BIGINT) AS comments
FROM (SELECT DISTINCT raw_text FROM feedback)
LEFT JOIN (SELECT raw_text, count(*) AS n FROM feedback WHERE complaint_intensity = 5 GROUP BY 1) USING (raw_text)"""))
def _(spark, sf_dir):
    rows = feedback(spark, sf_dir).withColumnRenamed("raw_text", "post_url")
    return cm.extract_summary(rows, rows.filter("complaint_intensity = 5"))


# --- links ------------------------------------------------------------------------------------

_KIND = """CASE WHEN contains(url, '/posts/') THEN 'post' WHEN contains(url, '/reel/') THEN 'reel'
     WHEN contains(url, '/permalink.php') THEN 'permalink' END"""
_POSTS = f"""SELECT host, page_id, position, url, string_split(url, '?')[1] AS canonical, kind
FROM (SELECT *, {_KIND} AS kind FROM links) WHERE kind IS NOT NULL"""
_COLUMNS = ["host", "page_id", "position", "url", "canonical", "kind"]


@query("extract_links", with_views("hrefs", "SELECT page_id, position, href AS url FROM hrefs"))
def _(spark, sf_dir):
    return ln.extract_links(views.table(spark, sf_dir, "pages").select("page_id", "html"))


@query("canonical_urls", with_views("links", f"""{_POSTS}
UNION ALL SELECT NULL, page_id, NULL, url, string_split(url, '?')[1], {_KIND} FROM pages"""))
def _(spark, sf_dir):
    posts = ln.post_links(views.links(spark, sf_dir)).select(*_COLUMNS)
    pages = views.page_addresses(spark, sf_dir).withColumn("kind", urls.link_kind(F.col("url")))
    return dedup.union_batches([posts, pages])


@query("dedup_urls", with_views("links", f"""
SELECT {', '.join(_COLUMNS)} FROM (
  SELECT *, row_number() OVER (PARTITION BY canonical ORDER BY page_id, position) AS n FROM ({_POSTS})) WHERE n = 1"""))
def _(spark, sf_dir):
    posts = ln.post_links(views.links(spark, sf_dir)).select(*_COLUMNS)
    return ln.dedup_urls(posts, ["page_id", "position"])


@query("links_capped", with_views("links", f"""
SELECT {', '.join(_COLUMNS)} FROM (
  SELECT *, row_number() OVER (PARTITION BY host ORDER BY page_id, position) AS m FROM (
    SELECT *, row_number() OVER (PARTITION BY host, canonical ORDER BY page_id, position) AS n FROM ({_POSTS}))
  WHERE n = 1) WHERE m <= 10"""))
def _(spark, sf_dir):
    posts = ln.post_links(views.links(spark, sf_dir)).select(*_COLUMNS)
    own = ln.dedup_urls(posts, ["page_id", "position"], scope=["host"])
    return ln.links_capped(own, ["host"], ["page_id", "position"], 10)


_LABELS = f"""SELECT host, page_id, position, url, CASE WHEN chosen = '' THEN 'Recent Post' ELSE chosen END AS post_date
FROM (SELECT *, CASE WHEN label = '' OR contains(lower(label), 'video')
             THEN CASE WHEN parent_text IS NULL THEN 'Recent Post' WHEN parent_text <> '' THEN {_strip('parent_text')}
                       ELSE label END
             ELSE label END AS chosen
      FROM (SELECT *, {_strip("coalesce(CASE WHEN coalesce(own, '') = '' OR contains(lower(own), 'playback') THEN text ELSE own END, '')")} AS label
            FROM (SELECT *, CASE WHEN coalesce(aria_label, '') <> '' THEN aria_label ELSE title END AS own FROM links)))"""


@query("link_labels", with_views("links", _LABELS))
def _(spark, sf_dir):
    return ln.with_date_labels(views.links(spark, sf_dir)).select("host", "page_id", "position", "url", "post_date")


@query("attach_post_date", with_views("links", f"""
SELECT c.seq, c.post_url, l.post_date AS associated_post_date
FROM (SELECT page_id * 1000 + position AS seq, CASE WHEN position = 0 THEN 'gone' ELSE url END AS post_url FROM links) c
LEFT JOIN (SELECT url, post_date FROM (
    SELECT *, row_number() OVER (PARTITION BY url ORDER BY page_id, position) AS n FROM ({_LABELS})) WHERE n = 1) l
  ON c.post_url = l.url"""))
def _(spark, sf_dir):
    links = ln.with_date_labels(views.links(spark, sf_dir))
    one_per_url = dedup.keep_first(links, ["url"], ["page_id", "position"])
    comments = links.select(
        (F.col("page_id") * 1000 + F.col("position")).alias("seq"),
        F.when(F.col("position") == 0, "gone").otherwise(F.col("url")).alias("post_url"),
    )
    return ln.attach_post_date(comments, one_per_url)


# --- de-duplication ---------------------------------------------------------------------------

_FEEDBACK = "seq, customer_id, username, feedback_category, sentiment, complaint_intensity, raw_text, source"


def _ranked(order: str, keys: str = "customer_id, raw_text", columns: str = _FEEDBACK) -> str:
    return f"""SELECT {columns} FROM (
  SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS n FROM feedback) WHERE n = 1"""


@query("dedup_keep_last", with_views("feedback", _ranked("seq DESC")))
def _(spark, sf_dir):
    return dedup.keep_last(feedback(spark, sf_dir), ["customer_id", "raw_text"], ["seq"]).drop("created_at")


@query("dedup_keep_first", with_views("feedback", _ranked("seq")))
def _(spark, sf_dir):
    return dedup.keep_first(feedback(spark, sf_dir), ["customer_id", "raw_text"], ["seq"]).drop("created_at")


# --- labels -----------------------------------------------------------------------------------

_RESULT_ROWS = """SELECT seq, customer_id, username, raw_text, item, malformed FROM (
  SELECT *, unnest(CASE WHEN malformed THEN ['{}'] ELSE items[1:bad - 1] END) AS item FROM (
    SELECT *, coalesce(list_position(list_transform(items, lambda x: json_type(x) = 'OBJECT'), false),
                       len(items) + 1) AS bad FROM (
      SELECT *, NOT json_valid(answer) AS malformed,
             CASE WHEN json_valid(answer) THEN CASE WHEN json_type(answer, '$.results') = 'ARRAY'
                  THEN CAST(json_extract(answer, '$.results[*]') AS VARCHAR[]) END END AS items FROM label_answers)))"""


def _item(name: str, default: str, kind: str) -> str:
    return f"""CASE WHEN NOT list_contains(json_keys(item), '{name}') THEN {default}
     ELSE CAST(json_extract_string(item, '$.{name}') AS {kind}) END AS {name}"""


@query("parse_labels", with_views("label_answers", f"""
SELECT seq, customer_id, username, raw_text, 'Facebook' AS source,
       {_item('feedback_category', "'service_quality'", 'VARCHAR')}, {_item('sentiment', "'neutral'", 'VARCHAR')},
       {_item('complaint_intensity', '1', 'INTEGER')} FROM ({_RESULT_ROWS})"""))
def _(spark, sf_dir):
    rows, _ = ingest.label_batch_from_answers(views.label_answers(spark, sf_dir), "seq")
    return rows


@query("parse_labels_quarantine", with_views("label_answers", """
SELECT seq, answer, CASE event_kind WHEN 4 THEN 'results is not a list' WHEN 5 THEN 'not an object at 2'
                                    ELSE 'not an object' END AS reason
FROM (SELECT seq, answer, seq % 50 AS event_kind FROM label_answers
      WHERE json_valid(answer) AND (json_type(answer) <> 'OBJECT' OR json_type(answer, '$.results') = 'VARCHAR'
            OR list_contains(list_transform(CAST(json_extract(answer, '$.results[*]') AS VARCHAR[]),
                             lambda x: json_type(x)), 'UBIGINT')))"""))
def _(spark, sf_dir):
    _, quarantine = labels.parse_labels(views.label_answers(spark, sf_dir))
    return quarantine.select("seq", "answer", "reason")


# Words that occur in the test texts.
_WORDS = {
    "pricing": ("license", "der"),
    "service_quality": ("the",),
    "customer_support": ("idiot", "que"),
    "churn_intent": ("ción", "password"),
}
_WORDS_SQL = " ".join(
    "WHEN " + " OR ".join(f"contains(lower(raw_text), '{w}')" for w in _WORDS[c]) + f" THEN '{c}'"
    for c in labels.PRIORITY
)


@query("lexicon_labels", with_views("conversation_comments document_comments", f"""
SELECT kind, seq, customer_id, CASE {_WORDS_SQL} ELSE 'service_quality' END AS feedback_category,
       'neutral' AS sentiment, 1 AS complaint_intensity, length(raw_text) AS size
FROM (SELECT post_url AS kind, seq, substring(md5(username), 1, 12) AS customer_id, {_strip('text')} AS raw_text
      FROM (SELECT * FROM conversation_comments UNION ALL SELECT * FROM document_comments))
WHERE raw_text <> ''"""))
def _(spark, sf_dir):
    rows = dedup.union_batches([views.conversation_comments(spark, sf_dir), views.document_comments(spark, sf_dir)])
    comments = rows.select(
        F.struct("post_url", "seq").alias("at"), tx.pseudonym(F.col("username")).alias("customer_id"),
        F.col("username"), tx.strip(F.col("text")).alias("raw_text"),
    ).filter(~tx.is_blank(F.col("raw_text")))
    labelled = labels.lexicon_labels(comments, _WORDS)
    return labelled.select(
        F.col("at.post_url").alias("kind"), F.col("at.seq").alias("seq"), "customer_id",
        "feedback_category", "sentiment", "complaint_intensity", F.length("raw_text").cast("bigint").alias("size"),
    )


_PHRASE_WORDS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+')"
_CATEGORIES = ("pricing", "customer_support", "churn_intent")


def _phrase_lexicon(spark, sf_dir):
    """Phrases of one to three words, as conversations begin, with a category and a priority by their lengths."""
    rows = views.table(spark, sf_dir, "conversations")
    n = (1 + F.col("conv_id") % 3).cast("int")
    rows = rows.select(words(F.col("text")).alias("own"), n.alias("n")).filter(F.size("own") >= F.col("n"))
    phrase = F.array_join(F.slice("own", F.lit(1), F.col("n")), " ")
    category = F.element_at(F.array(*[F.lit(c) for c in _CATEGORIES]), (F.length("phrase") % 3 + 1).cast("int"))
    return rows.select(phrase.alias("phrase")).distinct().select("phrase", category.alias("category"), (F.length("phrase") % 5).alias("priority"))


@query("lexicon_join", f"""
WITH own AS (SELECT {_PHRASE_WORDS.format('text')} AS words, 1 + conv_id % 3 AS n FROM conversations),
lexicon AS (
  SELECT phrase, ['pricing', 'customer_support', 'churn_intent'][length(phrase) % 3 + 1] AS category, length(phrase) % 5 AS priority
  FROM (SELECT DISTINCT array_to_string(words[1:n], ' ') AS phrase FROM own WHERE len(words) >= n)),
worded AS (SELECT doc_id, {_PHRASE_WORDS.format("coalesce(text, '')")} AS words FROM documents),
grams AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + n - 1], ' ') AS phrase
  FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM worded) s CROSS JOIN (SELECT unnest([1, 2, 3]) AS n) k
  WHERE i + n - 1 <= len(words)),
best AS (
  SELECT doc_id, phrase, category FROM grams JOIN lexicon USING (phrase)
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY priority, phrase) = 1)
SELECT doc_id, coalesce(category, 'service_quality') AS feedback_category, phrase AS matched_phrase
FROM documents LEFT JOIN best USING (doc_id)""")
def _(spark, sf_dir):
    comments = views.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("raw_text"))
    return lexicon_join(comments, _phrase_lexicon(spark, sf_dir), "doc_id").drop("raw_text")


@query("custom_labeler", with_views("conversation_comments", f"""
SELECT post_url, username, seq, CASE WHEN contains(raw_text, '?') THEN 'customer_support' ELSE 'pricing' END
         AS feedback_category,
       CASE WHEN length(raw_text) > 200 THEN 'negative' ELSE 'neutral' END AS sentiment,
       CAST(1 + length(raw_text) % 5 AS INTEGER) AS complaint_intensity
FROM (SELECT *, {_strip('text')} AS raw_text FROM conversation_comments)"""))
def _(spark, sf_dir):
    def by_length(batch):
        asks = batch["raw_text"].str.contains("?", regex=False)
        size = batch["raw_text"].str.len()
        return batch.assign(
            feedback_category=asks.map({True: "customer_support", False: "pricing"}),
            sentiment=(size > 200).map({True: "negative", False: "neutral"}),
            complaint_intensity=(1 + size % 5).astype("int32"),
        )

    comments = views.conversation_comments(spark, sf_dir)
    comments = comments.withColumn("raw_text", tx.strip(F.col("text"))).drop("text")
    return labels.label_comments(comments, by_length).drop("raw_text")


# --- the whole way from comment boxes to the feedback table ------------------------------------


_BODIES = rf"""SELECT 'conv/' || CAST(conv_id AS VARCHAR) AS post_url, role AS username, turn AS seq,
       (SELECT string_agg(line, ' ' ORDER BY i) FROM (
          SELECT {_strip('part')} AS line, i
          FROM (SELECT unnest(string_split(text, chr(10))) AS part,
                       unnest(range(len(string_split(text, chr(10))))) AS i))
        WHERE line <> '' AND NOT contains(line, role)) AS text
FROM conversations WHERE role <> 'system'"""


@query("feedback_ingest", f"""
WITH comments AS (
  SELECT substring(md5(username), 1, 12) AS customer_id, username, post_url, seq, {_clean('text')} AS raw_text
  FROM ({_BODIES}) WHERE length(text) >= 3),
firsts AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY post_url, customer_id, raw_text ORDER BY seq)
                 AS n FROM comments) WHERE n = 1 AND raw_text <> ''),
batch AS (
  SELECT * FROM (SELECT * EXCLUDE n, row_number() OVER (PARTITION BY customer_id, raw_text ORDER BY post_url, seq) AS n
                 FROM firsts) WHERE n = 1)
SELECT customer_id, username, CASE {_WORDS_SQL} ELSE 'service_quality' END AS feedback_category, 'neutral' AS sentiment,
       1 AS complaint_intensity, raw_text, 'Facebook' AS source, true AS created FROM batch""")
def _(spark, sf_dir):
    boxes = views.comment_boxes(spark, sf_dir)
    posts = boxes.select(F.col("post_url").alias("url")).distinct().withColumn("post_date", F.lit("Recent Post"))
    authors = cm.filter_authors(boxes, _BLOCKED)
    found = ingest.collect_comments(authors, posts, ["seq"])
    order = F.struct("post_url", "seq").alias("order_id")
    batch = ingest.label_batch(
        found.withColumn("order_id", order), "order_id", labeler=None, lexicon=_WORDS
    )
    table = ingest.update_feedback(ingest.empty_feedback(spark), batch, "order_id")
    return table.withColumn("created", F.col("created_at").isNotNull()).drop("created_at")
