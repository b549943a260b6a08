"""Byte-pair encoding, ranked search and collocations against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from keepwell.llm import collocations as col
from keepwell.llm import lexical
from keepwell.llm.bpe import Bpe, decode_ids, encode_documents, encoder, encoding_digests
from keepwell.llm.catalog import QUERIES
from pyspark.sql import functions as F

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


# --- byte-pair encoding ---------------------------------------------------------------------------


def _want(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    decoded = library.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


ODD = [
    "", " ", "\n\t ", "Hello, World! it's we'll they've I'D 12345 x", "a<|endoftext|>b <|startoftext|>", "<|endoftext|", "<| x",
    "ΣΑΣ ΟΔΟΣ İstanbul ß ŉ ǆ ﬁ", "日本語 テキスト😀👍🏽 é é  x y\u0085z", "a\tb\rc\x0bd\x1ce", "''''''s 't'RE", "﻿​̀x",
    "x" * 700, "ab" * 3000 + "é" * 500, "word " * 3 + "#" * 200 + "\n" * 5, "ñandú Ÿ ǅ ɏ Ɏ ʼn", "\x00\x7f ~!",
]


def test_ids_and_texts_are_the_librarys(library):
    own = Bpe(PATH, most=10)
    assert own.digests(ODD) == [_want(library, text) for text in ODD]
    assert own.encode(ODD) == [library.encode(text, add_special_tokens=False).ids for text in ODD]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_any_text(library, texts):
    assert encoder(PATH).digests(texts) == [_want(library, text) for text in texts]


def test_one_tree_for_all_words_and_one_for_each(library):
    """Trees kept in one array give what a tree for each word gives, and what trying all pairs gives."""
    merges, rng = encoder(PATH).merges, random.Random(5)
    own = encoder(PATH)
    words = ["".join(rng.choice("aeinrst") for _ in range(rng.randrange(1, 40))).encode() for _ in range(300)]
    plains = []
    for word in words:
        ids = [*own.first[np.frombuffer(word, np.uint8)].tolist()[:-1], int(own.last[word[-1]])]
        plain = list(ids)
        while True:
            ranks = [(merges.rank.get(a << 32 | b, math.inf), i) for i, (a, b) in enumerate(zip(plain, plain[1:]))]
            best = min(ranks, default=(math.inf, 0))
            if best[0] == math.inf:
                break
            plain[best[1] : best[1] + 2] = [int(merges.made[best[0]])]
        assert merges.apply(ids) == plain
        plains.append(plain)
    assert dict(own.merged(words)) == dict(enumerate(plains))


def test_long_texts_go_in_windows(library):
    text = " ".join(f"word{i} é{i % 7}\n" for i in range(3000)) + "z" * 3000
    own = encoder(PATH)
    got = [[], []]
    for window in own.windows([text, "b a"], at_once=500):
        for number, parts in window:
            got[number] += [int(i) for part in parts for i in own.ids_of[part].split()]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in (text, "b a")]


def test_encoding_of_tables(spark, library, odd_docs, no_docs):
    got = encoding_digests(odd_docs, PATH, keep=("doc_id", "text")).collect()
    assert len(got) == odd_docs.count()
    assert all((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == _want(library, r["text"]) for r in got)
    assert encoding_digests(no_docs, PATH).collect() == []
    encoded = encode_documents(odd_docs, PATH, keep=("doc_id", "text"))
    back = decode_ids(encoded.withColumnRenamed("text", "original"), PATH, keep=("original",)).collect()
    assert sorted(((r[0] or "", r[1]) for r in back)) == sorted(
        (t or "", library.decode(library.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False)) for t, in odd_docs.select("text").collect()
    )


def test_op11_on_a_whole_table(spark, sf_dir, library):
    texts = dict(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op11_bpe_encoding"](spark, sf_dir).collect()}
    assert got == {i: _want(library, text) for i, text in texts.items()}


# --- ranked search --------------------------------------------------------------------------------


def _terms(text):
    lower = "".join(c.lower() if c.isascii() else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def _ranked(docs, items, most=10):
    counted = [(i, Counter(_terms(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n_docs, length = len(counted), sum(sum(c.values()) for _, c in counted)
    having = Counter(t for _, c in counted for t in c)
    out, asked = [], {}
    for item, text in items:
        if item is not None:
            asked.setdefault(item, set()).update(_terms(text))
    for item, terms in asked.items():
        scores = []
        for doc, c in counted:
            m = 100 - 90 + (90 * sum(c.values()) * n_docs) // length
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * having[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m))
                for t in terms if t in c
            )
            if score > 0:
                scores.append((-score, doc is None, doc or 0))
        out += [(item, rank, None if none else doc, -s) for rank, (s, none, doc) in enumerate(sorted(scores)[:most], 1)]
    return sorted(out, key=repr)


def _rows(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def test_search_with_ties_repeats_nulls_and_long_texts(spark, odd_docs, no_docs):
    items = [(1, "one TWO three"), (1, "ten"), (2, "nothing-here"), (3, None), (None, "one"), (4, "word5 word7 of"), (5, "日本 l'été x")]
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    docs = [tuple(r) for r in odd_docs.select("doc_id", "text").collect()]
    for most, at_once in ((10, 200), (2, 1)):
        assert _rows(lexical.ranked_search(odd_docs, asked, most, at_once)) == _ranked(docs, items, most)
    assert _rows(lexical.ranked_search(no_docs, asked)) == [] and _rows(lexical.ranked_search(odd_docs, asked.limit(0))) == []
    assert lexical.ranked_search(no_docs, asked).dtypes == lexical.ranked_search(odd_docs, asked).dtypes


def test_search_over_random_texts(spark):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    docs = [(i, " ".join(rng.choices(words, [1 / (j + 1) for j in range(400)], k=rng.randrange(1, 300)))) for i in range(400)]
    docs += [(1000 + i, docs[3][1]) for i in range(60)] + [(2000, "w9 " * 700), (2001, "w9 " * 255)]
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 25)))) for i in range(40)] + [(99, docs[3][1]), (98, "w9")]
    got = lexical.ranked_search(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string"), at_once=17
    )
    assert _rows(got) == _ranked(docs, items)


def test_no_bound_is_below_a_score():
    rng = random.Random(2)
    terms = [f"t{i}".encode() for i in range(500)]
    docs = [Counter(rng.choices(terms, k=rng.randrange(1, 4000))) for _ in range(60)] + [Counter({terms[0]: 100_000, terms[1]: 254})]
    sizes = np.array([len(d) for d in docs])
    flat, counts = [t for d in docs for t in d], np.array([n for d in docs for n in d.values()], np.int64)
    sketch, width = lexical.sketches(sizes, lexical.hashed(flat), counts)
    ends, at = np.concatenate([[0], np.cumsum(2 * width)]), np.concatenate([[0], np.cumsum(sizes)])
    asked = {t: i for i, t in enumerate(rng.sample(terms, 80))}
    weights = np.array([[rng.randrange(9000) for _ in asked] for _ in range(7)], np.int64)
    block = lexical.Block(list(range(7)), asked, weights, len(docs), int(counts.sum()))
    for i, d in enumerate(docs):
        n = np.array([sum(d.values())])
        own = sketch[ends[i] : ends[i + 1]].reshape(1, -1)
        bound = block.bounds(own, int(width[i]), n, lexical.hashed(list(asked)), weights.T.astype(np.float32))[0]
        exact = block.exact(b" ".join(flat[at[i] : at[i + 1]]), counts[at[i] : at[i + 1]].astype("<u4").tobytes(), int(n[0]))
        assert (bound >= exact).all()


def test_most_documents_arent_scored(spark):
    """What the sketches are for: fewer than half of 3,000 texts are scored in full, though their words are all alike rare."""
    rng = random.Random(4)
    words = [f"v{i}" for i in range(20_000)]
    found = [Counter(w.encode() for w in rng.choices(words, k=100)) for _ in range(3000)]
    docs = spark.createDataFrame([(i, " ".join(w.decode() for w in c.elements())) for i, c in enumerate(found)], "doc_id long, text string")
    index = lexical.build_index(docs).coalesce(1)
    asked = {0: set(list(found[5])[:20])}
    number = {t: i for i, t in enumerate(sorted(asked[0]))}
    block = lexical.Block([0], number, np.full((1, len(number)), 5000, np.int64), 3000, 300_000)
    scored, exact = [], block.exact
    block.exact = lambda *a: scored.append(1) or exact(*a)
    best = lexical.Best(1, 10)
    for batch in index.toArrow().to_batches():
        lexical._search_batch(block, best, batch, lexical.hashed(list(number)), block.weights.T.astype(np.float32))
    assert max(best.heaps[0])[2] == -5 and len(scored) < 1500


# --- collocations ---------------------------------------------------------------------------------


def _phrases(rows, least=10, percent=50, most=2000):
    counts, sizes = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang] += len(words)
            own = counts.setdefault(lang, Counter())
            own.update(tuple(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        longer = Counter()
        for p, a in candidates.items():
            if len(p) == 3:
                for inner in (p[:2], p[1:]):
                    longer[inner] = max(longer[inner], a)
        scored = []
        for p, a in candidates.items():
            if len(p) == 2 and longer[p] and 100 * longer[p] >= percent * a:
                continue
            cuts = [(math.floor(Fraction(1_000_000 * a * a, f[p[:k]] * f[p[k:]])), k) for k in range(1, len(p))]
            score, k = min(cuts)
            scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, rank, p.decode(), -a, left, right, sizes[lang], -s) for rank, (s, a, p, left, right) in enumerate(sorted(scored)[:most], 1)]
    return sorted(out)


def _found(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.fixture(scope="module")
def phrase_rows():
    rng = random.Random(8)
    words = ["the", "of", "New", "york", "city", "é", "x-y", "10", "in", "Ä", *[f"q{i}" for i in range(60)]]
    rows = []
    for i in range(500):
        parts = rng.choices(words, [30, 20, 12, 5, 5, 4, 3, 2, 9, 2, *[1] * 60], k=rng.randrange(0, 60))
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", "!", "\r\n"]) for w in parts)
        rows.append((rng.choice(["en", "en", "en", "de", None, "und"]), text + "New York City"))
    return [*rows, ("en", None), ("fr", ""), (None, "..;;"), *[("en", "solo phrase here")] * 30, ("de", "a b c " * 4000)]


@pytest.mark.parametrize(("least", "percent", "most", "split", "at_once"), [(10, 50, 2000, None, 3_000_000), (3, 80, 25, 3, 300)])
def test_phrases(spark, phrase_rows, least, percent, most, split, at_once):
    docs = spark.createDataFrame(phrase_rows, "lang string, text string").repartition(3).withColumn("part", F.lit("clash"))
    got = col.collocations(docs, least, percent, most, split, most_bits=15, at_once=at_once)
    assert _found(got) == _phrases(phrase_rows, least, percent, most)


def test_no_phrases(spark, odd_docs, no_docs):
    rows = [tuple(r) for r in odd_docs.select("lang", "text").collect()]
    assert _found(col.collocations(odd_docs, least=2)) == _phrases(rows, 2)
    assert _found(col.collocations(no_docs)) == []


def test_stripes_are_merged_elementwise(spark):
    """Many rows of one part, over several batches, and rows of other parts between them."""
    rows = [("en", "the", i % 2, 1, [f"w{i % 2 + 2 * (i % 50)}", f"w{i % 2 + 100}"], [1, 2]) for i in range(5000)]
    rows += [("en", f"p{i}", 0, i, [], []) for i in range(50)] + [("de", "the", 0, 4, ["x"], [9])]
    merged = col.merge_stripes(spark.createDataFrame(rows, col.STRIPES), 10).collect()
    the = [r for r in merged if (r["lang"], r["prefix"]) == ("en", "the")]
    assert sum(r["total"] for r in the) == 5000 * 4 and len(the) == 2
    entries = {w: n for r in the for w, n in zip(r["next"], r["n"])}
    want = Counter()
    for r in rows[:5000]:
        want.update(dict(zip(r[4], r[5])))
    assert entries == dict(want)
    assert {r["prefix"]: (r["total"], r["next"]) for r in merged if r["prefix"].startswith("p")} == {f"p{i}": (i, []) for i in range(50)}
    assert [(r["total"], r["next"]) for r in merged if r["lang"] == "de"] == [(13, [])]


def test_scores_are_exact_beyond_64_bits(spark):
    big = 9_999_999_999_989
    row = spark.createDataFrame([(big, big, big + 1)], "a long, l long, r long").select(col._score("l", "r")).first()
    assert row[0] == 1_000_000 * big * big // (big * (big + 1))
