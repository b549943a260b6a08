"""Quality rules, quality classifier and toxicity against plain versions and held-out labels."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from keepwell.llm.common import read
from keepwell.llm.quality_classifier import STATISTICS, fit, score_quality, statistics
from keepwell.llm.quality_rules import base_counts, bucket_weights, quality_rules
from keepwell.llm.scoring import remainder_is
from keepwell.llm import toxicity
from keepwell.llm.toxicity import Index, Terms, build_index, count_terms, score_toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def every():
    return F.col("doc_id").isNotNull()


def plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    runs = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if runs[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


REPEATS = [
    "a b c a b c", "a a a a", "a b c d a b", "x\nx\n\nx\n y\n y", "a b c x a b c y a b c", "| a | b # & <p> $% **", "a b a b a b",
    "   a\x0bb\x1cc", "a b c d e a b c d f b c d e",
]


def test_base_counts(spark, odd_docs):
    rows = [(i, text) for i, text in enumerate(REPEATS + [" ".join("ab"[i * i % 7 % 2] for i in range(4000))])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").union(odd_docs.select("doc_id", "text"))
    docs = docs.withColumn("doc_id", F.xxhash64("doc_id", "text"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = base_counts(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        assert tuple(r[1:6]) == plain_counts(texts[r["doc_id"]]), texts[r["doc_id"]]


def test_weights_are_the_ratio_of_smoothed_shares(spark):
    docs = spark.createDataFrame([(1, "good fine good"), (2, "junk ### junk"), (3, "fine junk")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (3, 0)], "doc_id long, quality int")
    weights = bucket_weights(docs, labels, 64, 1.0)

    def buckets(text):
        units = re.findall(r"[^\W_]+|[^\w\s]+", text)
        pairs = list(zip(units, units[1:]))
        frame = spark.createDataFrame([(u, None) for u in units] + pairs, "u string, v string")
        one = F.when(F.col("v").isNull(), F.xxhash64("u")).otherwise(F.xxhash64("u", "v"))
        return [r[0] for r in frame.select(F.pmod(one, F.lit(64))).collect()]

    raw, target = Counter(b for t in ("good fine good", "junk ### junk", "fine junk") for b in buckets(t)), Counter(buckets("good fine good"))
    n_raw, n_target = 64 + sum(raw.values()), 64 + sum(target.values())
    want = [round(1e6 * math.log((1 + target[b]) / n_target * n_raw / (1 + raw[b]))) for b in range(64)]
    assert np.allclose(weights, want, atol=1)
    scored = {r["doc_id"]: r for r in quality_rules(docs, labels, buckets=64, least_words=0, threshold=0.0).collect()}
    for i, text in ((1, "good fine good"), (2, "junk ### junk")):
        assert math.isclose(scored[i]["score"], np.mean([weights[b] for b in buckets(text)]) / 1e6, abs_tol=1e-6)
    assert all(r["kept"] == (r["score"] >= 0) for r in scored.values())


def test_texts_are_dealt_by_id_however_few_labels(spark, monkeypatch):
    """The plan, and so the disk that a text takes, is the same for few labels and for many."""
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(9)], "doc_id long, text string")
    labels, plans = spark.createDataFrame([(1, 1)], "doc_id long, quality int"), []
    collect = type(docs).collect
    monkeypatch.setattr(type(docs), "collect", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or collect(df))
    bucket_weights(docs, labels, 64, 1.0)
    assert any("rightHint=(strategy=merge)" in p for p in plans)


def test_rules_on_odd_documents(odd_docs, odd_labels, no_docs):
    got = quality_rules(odd_docs, odd_labels).collect()
    assert len(got) == odd_docs.count()
    assert all(r["base_failed"] and not r["kept"] and r["score"] is None for r in got if r["doc_id"] in (3, 4, 5))
    assert quality_rules(no_docs, odd_labels).collect() == []
    assert {r["score"] for r in quality_rules(odd_docs, odd_labels.limit(0)).collect()} == {0.0, None}


def held_out(spark, scored, labels, column):
    rows = scored.join(labels.select("doc_id", F.col(column).alias("truth")), "doc_id").filter("held_out").collect()
    return np.array([(r["truth"], r["predicted"], r["score"]) for r in rows])


def test_quality_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels, rest = read(spark, sf, "documents"), read(spark, sf, "labels"), remainder_is(F.col("doc_id"), 5, 0)
    scored = score_quality(docs, labels, ~rest).withColumn("held_out", rest)
    found = held_out(spark, scored, labels, "quality")
    assert (found[:, 0] == found[:, 1]).mean() > 0.95
    assert found[found[:, 0] == 1, 2].min() > found[found[:, 0] == 0, 2].mean()


def test_toxicity_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels, rest = read(spark, sf, "documents"), read(spark, sf, "labels"), remainder_is(F.col("doc_id"), 3, 1)
    scored = score_toxicity(docs, labels, ~rest).withColumn("held_out", rest)
    found = held_out(spark, scored, labels, "toxic")
    assert (found[:, 0] == found[:, 1]).mean() > 0.93 and found[found[:, 0] == 0, 1].mean() < 0.02
    evidence = [r for r in scored.collect() if r["evidence"]]
    assert all(a["similarity"] >= b["similarity"] for r in evidence for a, b in zip(r["evidence"], r["evidence"][1:]))


def test_the_discriminant_is_the_closed_form(spark):
    rng = np.random.default_rng(4)
    words = ["alpha", "beta!", "gamma,", "Delta", "e5", "zeta|", "###", "fjord", "é"]
    rows = [(i, " ".join(rng.choice(words[: 5 + 4 * (i % 2)], rng.integers(5, 60))), i % 2) for i in range(120)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    model = fit(docs, labels, "quality", every(), 0.05)
    x = np.vstack([statistics(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())])) for _, t, _ in rows])
    y, d = np.array([r[2] for r in rows]), len(STATISTICS)
    scale, logs = x.std(0) + 1e-6, []
    for c in (0, 1):
        z = (x[y == c] - x[y == c].mean(0)) / scale
        cov, n = z.T @ z / len(z), len(z)
        part = 0.05 + 0.95 * d / (n + d)
        cov = (1 - part) * cov + part * max(np.trace(cov) / d, 1e-3) * np.eye(d)
        own = (x - x[y == c].mean(0)) / scale
        logs.append(math.log((y == c).mean()) - 0.5 * (np.linalg.slogdet(cov)[1] + (own @ np.linalg.inv(cov) * own).sum(1)))
    assert np.allclose(model.scores(x), 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700))), atol=1e-5)


def test_scores_of_odd_documents(odd_docs, odd_labels, no_docs):
    for scorer, label in ((score_quality, "quality"), (score_toxicity, "toxic")):
        rows = scorer(odd_docs, odd_labels, every(), ("doc_id", "text", "source")).collect()
        assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
        assert len({r["score"] for r in rows if not r["text"]}) == 1
        assert [r["text"] for r in rows].count(None) == 2
        assert scorer(no_docs, odd_labels, every()).collect() == []
        assert len({r["score"] for r in scorer(odd_docs, odd_labels.limit(0), every()).collect()}) == 1
        one = odd_labels.filter(F.col(label) == 1)
        assert len({r["score"] for r in scorer(odd_docs, one, every()).collect()}) == 1


def random_rows(rng, many, terms, weight):
    lists = [np.sort(rng.choice(terms, rng.integers(1, 9), False)) for _ in range(many)]
    lists[10:20] = [lists[10]] * 10
    begin = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    return toxicity.weighed(begin, np.concatenate(lists), rng.integers(1, 4, begin[-1]), weight)


@pytest.mark.parametrize("terms,at_once,postings", [(40, 64, 4_000_000), (400, 7, 300)])
def test_the_nearest_are_exact(monkeypatch, terms, at_once, postings):
    monkeypatch.setattr(toxicity, "AT_ONCE", at_once)
    monkeypatch.setattr(toxicity, "POSTINGS", postings)
    rng = np.random.default_rng(5)
    weight, names = rng.random(terms) + 1, pa.array([f"t{i}" for i in range(terms)], pa.string())
    rows = random_rows(rng, 300, terms, weight)
    index = Index(names, weight, rows, np.arange(300), rng.integers(0, 2, 300), np.ones(300), 0.1, 16, 5)
    dense = np.zeros((300, terms))
    for i in range(300):
        dense[i, rows.term[rows.begin[i] : rows.begin[i + 1]]] = rows.value[rows.begin[i] : rows.begin[i + 1]]
    found = list(index.votes(rows, list(range(300))))
    assert len(found) == 300
    for q, (share, at, near) in enumerate(found):
        scores = dense @ dense[q]
        scores[q] = 0
        want = sorted((i for i in range(300) if scores[i] > 1e-12), key=lambda i: (-round(scores[i], 12), i))[:5]
        assert at.tolist() == want and np.allclose(near, scores[want])
        assert math.isclose(share, (near @ index.label[at] + 0.01) / (near.sum() + 0.1))


def test_forms_of_a_word_share_terms():
    counts = count_terms("Pathetically pathetic, patheticness 12 idiot")
    assert counts["path~"] == 3 and counts["path~2"] == 1 and counts["path~3"] == 1 and counts["pathetic"] == 1
    assert counts["idio~"] == 1 and "idio~2" not in counts and "12" not in counts


def test_empty_index(spark, no_docs, odd_labels):
    packed, slope, shift = build_index(no_docs, odd_labels, "toxic", every(), 10, 3, 4, 16.0)
    index = packed.index()
    assert index.terms.names.to_pylist() == [] and 0 < index.base < 1 and (slope, shift) == (1.0, 0.0)


@pytest.mark.parametrize("text,zero", [("", True), ("a b", False)])
def test_statistics_of_a_text(text, zero):
    row = statistics(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
    assert row.shape == (1, len(STATISTICS)) and np.isfinite(row).all()
    assert pa.array(row.ravel()).null_count == 0 and (zero == (row[0, STATISTICS.index("longest")] == np.log(10)))


def test_toxicity_keeps_the_terms_of_both_classes(spark):
    """Neutral and clean terms find neighbours, and terms that label 1 has only twice as often tell the classes apart."""
    rng = np.random.default_rng(11)
    words = [a + b + c for a in "bdfg" for b in "aeiou" for c in ("lk", "mn", "rt", "st")]
    rows = []
    for i in range(240):
        toxic = int(i % 3 == 0)
        shares = np.where(np.arange(len(words)) < 40, 2.0 if toxic else 1.0, 1.0 if toxic else 2.0)
        rows.append((i, " ".join(rng.choice(words, 40, p=shares / shares.sum())), toxic))
    docs = spark.createDataFrame([r[:2] for r in rows] + [(999, "nothing else is known")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    index = build_index(docs, labels, "toxic", every(), 4000, 8, 32, 16.0)[0].index()
    having = Counter(t for _, text, _ in rows for t in count_terms(text))
    assert set(index.terms.names.to_pylist()[: index.terms.size]) == {t for t, n in having.items() if n >= 2} and len(index.ids) == 240
    rest = remainder_is(F.col("doc_id"), 3, 1)
    got = {r["doc_id"]: r for r in score_toxicity(docs, labels, ~rest, threshold=0.5).withColumn("rest", rest).collect()}
    assert not got[999]["evidence"] and not got[999]["matched"]
    assert all(len(r["evidence"]) == 8 and r["matched"] == sorted(r["matched"]) for i, r in got.items() if i != 999)
    found = [(y, got[i]["predicted"]) for i, _, y in rows if got[i]["rest"]]
    assert np.mean([p == y for y, p in found]) > 0.75 and np.mean([p for y, p in found if y]) > 0.5


def test_numbered_counts_are_the_counted_terms():
    texts = [
        "Pathetically pathetic, patheticness 12 idiot the THE The thoughtful thoughts thoughtless unknown", "", "the " * 9, "12 ?",
        "réeuxment Réeuxpa réeuxvi İstanbul ΣΑΣ ßtraße 日本語テキストです", "pathological patho thoug",
    ]
    every_term = sorted(set().union(*map(count_terms, texts)))
    for step in (1, 2, 3):
        names = every_term[::step]
        begin, term, n = Terms(pa.array(names, pa.string())).counted(texts)
        for i, text in enumerate(texts):
            got = {names[t]: c for t, c in zip(term[begin[i] : begin[i + 1]].tolist(), n[begin[i] : begin[i + 1]].tolist())}
            assert got == {t: c for t, c in count_terms(text).items() if t in names}
            assert (np.diff(term[begin[i] : begin[i + 1]]) > 0).all()


def test_scores_are_those_of_a_plain_version(spark):
    """Vocabulary, weights, cosines, neighbours, votes and calibration, each by loops over all examples."""
    rng = np.random.default_rng(3)
    words = [a + b + c + d for a in "bd" for b in "aei" for c in ("lk", "mnop") for d in ("", "est", "ingly")]
    rows = []
    for i in range(90):
        shares = np.where(np.arange(len(words)) % 3 == 0, 3.0 if i % 3 == 0 else 1.0, 1.0)
        rows.append((i, " ".join(rng.choice(words, rng.integers(3, 30), p=shares / shares.sum())), int(i % 3 == 0)))
    rows += [(90, rows[0][1], 1), (91, "", 0), (92, None, 1), (93, "zzz only here", 0)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in score_toxicity(docs, labels, F.col("doc_id") % 4 != 1, k=5).collect()}

    texts = {i: t or "" for i, t, _ in rows}
    known = [(i, y) for i, _, y in rows if i % 4 != 1]
    counts = {i: count_terms(t) for i, t in texts.items()}
    families = {i: toxicity.family(t) for i, t in texts.items()}
    n1, n0 = (len({families[i] for i, y in known if y == c}) for c in (1, 0))
    weight = {}
    for t in set().union(*(counts[i] for i, _ in known)):
        one, zero = (len({families[i] for i, y in known if y == c and t in counts[i]}) for c in (1, 0))
        n, both = n1 + n0, one + zero
        if both >= 2:
            apart = max(abs(one * (n0 - zero) - zero * (n1 - one)) - n / 2, 0)
            weight[t] = (math.log(n / both) + 1) * (1 + n * apart * apart / max(both * (n - both) * n1 * n0, 1) / 16)

    def vector(i):
        raw = {t: (1 + math.log(c)) * weight[t] for t, c in counts[i].items() if t in weight}
        size = math.sqrt(sum(v * v for v in raw.values()))
        return {t: v / size for t, v in raw.items()}

    vectors = {i: vector(i) for i in texts}
    plain = [y for i, y in known if not vectors[i]]
    base = (sum(plain) + (sum(y for _, y in known) + 0.5) / (len(known) + 1)) / (len(plain) + 1)
    used = [(i, y) for i, y in known if vectors[i]]

    def near(q, without=None):
        each = [(round(sum(v * vectors[i].get(t, 0) for t, v in vectors[q].items()), 10), y, i) for i, y in used if i != without]
        return sorted([x for x in each if x[0] > 0], key=lambda x: -x[0])

    def share(q, without=None):
        best = near(q, without)[:5]
        return (sum(s * y for s, y, _ in best) + 0.1 * base) / (sum(s for s, _, _ in best) + 0.1), best

    ties = {q for q in texts for best in [near(q)] if len(best) > 5 and best[4][0] == best[5][0] and {y for s, y, _ in best if s == best[4][0]} == {0, 1}}
    assert not ties
    shares = np.array([share(i, i)[0] for i, _ in used])
    slope, shift = toxicity.calibrate(shares, np.array([y for _, y in used]), np.ones(len(used)))
    for q in texts:
        vote, best = share(q)
        assert math.isclose(got[q]["score"], toxicity.calibrated(vote if vectors[q] else base, slope, shift) if vectors[q] else toxicity.calibrated(base, slope, shift), abs_tol=1e-6)
        assert np.allclose([e["similarity"] for e in got[q]["evidence"]], [s for s, _, _ in best])
        assert got[q]["predicted"] == int(got[q]["score"] >= 0.7)
