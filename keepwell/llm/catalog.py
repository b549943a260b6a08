"""The registered queries of this package, and the SQL twins of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepwell.llm.bpe import encoding_digests
from keepwell.llm.collocations import collocations
from keepwell.llm.common import read, tokenizer_file
from keepwell.llm.html_text import extract_main_text
from keepwell.llm.lexical import ranked_search
from keepwell.llm.licences import COPYRIGHT_LINE, KNOWN, SPELLINGS, TEXTS, scan_licences
from keepwell.llm.merkle import fingerprint_edits
from keepwell.llm.minhash import near_duplicates
from keepwell.llm.mixing import mix_sources
from keepwell.llm.packing import pack_documents
from keepwell.llm.quality_classifier import score_quality
from keepwell.llm.quality_rules import quality_rules
from keepwell.llm.scoring import remainder_is
from keepwell.llm.token_counts import count_tokens
from keepwell.llm.toxicity import score_toxicity


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"), width=3, percent=85, bands=48, per_band=8)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(read(spark, sf_dir, "pages"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(read(spark, sf_dir, "documents"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    held_out = remainder_is(F.col("doc_id"), 3, 1)
    scored = score_toxicity(docs, labels, train=~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted", "evidence", "matched")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(read(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    held_out = remainder_is(F.col("doc_id"), 5, 0)
    scored = score_quality(docs, labels, train=~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op11_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_digests(read(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_html_text": op2_html_text,
    "op3_license_scan": op3_license_scan,
    "op4_mix_sources": op4_mix_sources,
    "op5_toxicity": op5_toxicity,
    "op6_token_counts": op6_token_counts,
    "op7_document_fingerprints": op7_document_fingerprints,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_quality_rules": op10_quality_rules,
    "op11_bpe_encoding": op11_bpe_encoding,
    "op12_ranked_search": op12_ranked_search,
    "op13_collocations": op13_collocations,
}

#: Words as the operators take them: runs without ASCII white space.
_WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1_SQL = f"""
WITH RECURSIVE worded AS (SELECT doc_id, {_WORDS.format(text=_LOWER)} AS words FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 1),
      lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])) END AS own
  FROM worded),
each AS (SELECT doc_id, len(own) AS n, unnest(own) AS shingle FROM sets),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, any_value(x.n) AS n_a, any_value(y.n) AS n_b, count(*) AS n_both
  FROM each x JOIN each y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common WHERE 100 * n_both >= 85 * (n_a + n_b - n_both)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id, doc_id AS other FROM sets
  UNION SELECT reach.doc_id, ways.b FROM reach JOIN ways ON ways.a = reach.other),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, len(own)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN least USING (doc_id)"""


def _canonical_sql(text: str) -> str:
    words = f"regexp_replace(lower({text}), '{COPYRIGHT_LINE}', '', 'g')"
    spaced = f"' ' || trim(regexp_replace({words}, '[^\\p{{L}}\\p{{N}}]+', '  ', 'g')) || ' '"
    for other, usual in SPELLINGS.items():
        spaced = f"replace({spaced}, ' {other.replace(' ', '  ')} ', ' {usual.replace(' ', '  ')} ')"
    return f"trim(replace({spaced}, '  ', ' '))"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list_sql(entries: tuple[tuple[str, str], ...]) -> str:
    return "VALUES " + ", ".join(f"({_quoted(a)}, {_quoted(b)})" for a, b in entries)


# Whole texts are looked up among the texts, lines among texts and notices.
OP3_SQL = f"""
WITH whole(license_id, text) AS ({_list_sql(TEXTS)}),
listed(license_id, text) AS ({_list_sql(KNOWN)}),
known AS (SELECT {_canonical_sql("text")} AS form, min(license_id) AS license_id FROM whole GROUP BY 1),
every AS (SELECT DISTINCT {_canonical_sql("text")} AS form, license_id FROM listed),
forms AS (SELECT doc_id, {_canonical_sql("coalesce(text, '')")} AS form FROM documents),
lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
found AS (
  SELECT doc_id, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS line_licenses
  FROM lines JOIN every ON {_canonical_sql("line")} = every.form GROUP BY doc_id)
SELECT doc_id, sha256(forms.form) AS digest, license_id, coalesce(line_licenses, '') AS line_licenses
FROM forms LEFT JOIN known USING (form) LEFT JOIN found USING (doc_id)"""

_FINGERPRINT_WORD = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+[\x20\x09-\x0D]*|[\x20\x09-\x0D]+"


def _leaves_sql(line: str) -> str:
    words = f"list_transform(regexp_extract_all({line}, '{_FINGERPRINT_WORD}'), lambda w: w || CASE WHEN md5(w) < '4' THEN chr(10) ELSE '' END)"
    runs = f"list_filter(string_split(array_to_string({words}, ''), chr(10)), lambda run: run <> '')"
    return f"list_transform({runs}, lambda run: left(md5(run), 8))"


def _tree_sql(text: str) -> str:
    """A struct of the root, the fingerprint, all leaves, and the hashes of sections and of their paragraphs."""
    lines = "string_split(part, chr(10))"
    hash_ = f"sha256(array_to_string(list_transform({lines}, lambda line: sha256(line)), ','))"
    paragraphs = f"list_transform({lines}, lambda line: left(sha256(line), 8) || array_to_string({_leaves_sql('line')}, ''))"
    parts = f"string_split({text}, chr(10) || chr(10))"
    root = f"sha256(array_to_string(list_transform({parts}, lambda part: {hash_}), ','))"
    sections = f"list_transform({parts}, lambda part: left({hash_}, 16) || '=' || array_to_string({paragraphs}, ','))"
    return f"""struct_pack(root := {root}, print := {root} || ':' || array_to_string({sections}, ';'),
      leaves := flatten(list_transform(string_split({text}, chr(10)), lambda line: {_leaves_sql("line")})),
      sections := list_transform({parts}, lambda part: left({hash_}, 16)),
      paragraphs := list_transform({parts}, lambda part: list_transform({lines}, lambda line: left(sha256(line), 8))))"""


def _differs_sql(a: str, b: str) -> str:
    """From 0, where two lists begin to differ; -1 if they don't."""
    same = f"list_transform(range(1, greatest(len({a}), len({b})) + 1), lambda i: {a}[i] IS NOT DISTINCT FROM {b}[i])"
    return f"CASE WHEN list_contains({same}, false) THEN list_position({same}, false) - 1 ELSE -1 END::BIGINT"


# Likeness is counted over all leaves here, not down the branches.
OP7_SQL = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
following AS (
  SELECT doc_id, text, length(text) AS n_chars,
    coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC)) AS next_text
  FROM texts),
edited AS (
  SELECT *, left(text, n_chars - n_chars // 3) || left(next_text, n_chars // 3) AS edited_text FROM following),
rooted AS (
  SELECT doc_id, n_chars, sha256(edited_text) AS edited_sha256, {_tree_sql("text")} AS own,
    {_tree_sql("edited_text")} AS edited, {_tree_sql("next_text")} AS following
  FROM edited),
leafs AS (
  SELECT doc_id, 'own' AS kind, unnest(own.leaves) AS leaf FROM rooted
  UNION ALL SELECT doc_id, 'edited', unnest(edited.leaves) FROM rooted
  UNION ALL SELECT doc_id, 'next', unnest(following.leaves) FROM rooted),
counted AS (SELECT doc_id, kind, leaf, count(*) AS n FROM leafs GROUP BY ALL),
common AS (
  SELECT x.doc_id, y.kind, sum(least(x.n, y.n)) AS n FROM counted x JOIN counted y ON x.doc_id = y.doc_id AND x.leaf = y.leaf
  WHERE x.kind = 'own' AND y.kind <> 'own' GROUP BY ALL),
placed AS (SELECT *, {_differs_sql("own.sections", "edited.sections")} AS edit_section FROM rooted),
near AS (
  SELECT p.*, coalesce(2.0::DOUBLE * e.n / nullif(len(own.leaves) + len(edited.leaves), 0), 0.0) AS to_edited,
    coalesce(2.0::DOUBLE * f.n / nullif(len(own.leaves) + len(following.leaves), 0), 0.0) AS to_next,
    coalesce(own.paragraphs[edit_section + 1], []) AS own_lines, coalesce(edited.paragraphs[edit_section + 1], []) AS edited_lines
  FROM placed p LEFT JOIN common e ON e.doc_id = p.doc_id AND e.kind = 'edited'
  LEFT JOIN common f ON f.doc_id = p.doc_id AND f.kind = 'next')
SELECT doc_id, n_chars, edited_sha256, own.print AS fingerprint, edited.print AS edited_fingerprint,
  CASE WHEN own.root = edited.root THEN 1.0 ELSE to_edited END::DOUBLE AS near_edited,
  CASE WHEN own.root = following.root THEN 1.0 ELSE to_next END::DOUBLE AS near_next, edit_section,
  CASE WHEN edit_section < 0 THEN -1 ELSE {_differs_sql("own_lines", "edited_lines")} END::BIGINT AS edit_paragraph
FROM near"""

_TERMS = r"regexp_extract_all({text}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP12_SQL = f"""
WITH each AS (SELECT row_number() OVER () AS slot, doc_id, {_TERMS.format(text=_LOWER)} AS terms FROM documents),
counted AS (SELECT slot, doc_id, len(terms) AS n, unnest(terms) AS term FROM each WHERE len(terms) > 0),
held AS (SELECT slot, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*) AS tf FROM counted GROUP BY slot, term),
sizes AS (SELECT count(*) AS docs, sum(len(terms))::BIGINT AS words FROM each WHERE len(terms) > 0),
weights AS (
  SELECT term, floor(1000 * ln((2.0::DOUBLE * any_value(docs) + 2) / (2.0::DOUBLE * count(*) + 1)))::BIGINT AS w
  FROM held, sizes GROUP BY term),
asked AS (SELECT DISTINCT item_id, unnest({_TERMS.format(text=_LOWER)}) AS term FROM benchmark),
scored AS (
  SELECT item_id, slot, any_value(doc_id) AS doc_id,
    sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // words))))::BIGINT AS score
  FROM asked JOIN held USING (term) JOIN weights USING (term), sizes GROUP BY item_id, slot),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM scored WHERE score > 0)
SELECT item_id, place::INTEGER AS rank, doc_id, score FROM ranked WHERE place <= 10"""

OP13_SQL = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces),
sizes AS (SELECT lang, sum(len(words))::BIGINT AS n FROM worded GROUP BY lang),
starts AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM worded),
grams AS (
  SELECT lang, k, array_to_string(words[i:i + k - 1], ' ') AS phrase, words[i:i + k - 1] AS parts
  FROM starts CROSS JOIN (SELECT unnest([1, 2, 3]) AS k) AS w WHERE i + k - 1 <= len(words)),
counts AS (SELECT lang, k, phrase, any_value(parts) AS parts, count(*)::BIGINT AS f FROM grams GROUP BY ALL),
frequent AS (SELECT lang, k, phrase, parts, f FROM counts WHERE k > 1 AND f >= 10),
longer AS (
  SELECT lang, array_to_string(parts[j:j + 1], ' ') AS phrase, max(f) AS f
  FROM frequent CROSS JOIN (SELECT unnest([1, 2]) AS j) AS w WHERE k = 3 GROUP BY 1, 2),
kept AS (
  SELECT c.* FROM frequent c LEFT JOIN longer USING (lang, phrase)
  WHERE c.k = 3 OR longer.f IS NULL OR 100 * longer.f < 50 * c.f),
cuts AS (
  SELECT kept.lang, kept.phrase, kept.f AS a, cut, x.f AS l, y.f AS r,
    ((1000000 * kept.f::HUGEINT * kept.f) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM kept CROSS JOIN (SELECT unnest([1, 2]) AS cut) AS k
  JOIN counts x ON x.lang = kept.lang AND x.k = cut AND x.phrase = array_to_string(kept.parts[:cut], ' ')
  JOIN counts y ON y.lang = kept.lang AND y.k = kept.k - cut AND y.phrase = array_to_string(kept.parts[cut + 1:], ' ')
  WHERE cut < kept.k),
least AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS place FROM cuts),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM least WHERE place = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN sizes USING (lang) WHERE rank <= 2000"""

ORACLES: dict[str, str] = {
    "op1_minhash_near_dedup": OP1_SQL,
    "op3_license_scan": OP3_SQL,
    "op7_document_fingerprints": OP7_SQL,
    "op12_ranked_search": OP12_SQL,
    "op13_collocations": OP13_SQL,
}
