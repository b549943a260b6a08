import ast
import struct
import zlib
from collections import Counter
from pathlib import Path

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from keepwell.llm import catalog
from keepwell.llm.common import DOCUMENT_COLUMNS, read
from tests.llm import plain
from tests.oracle import connect, difference

ROOT = Path(corpus_pipeline.__file__).parent
SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(catalog.ORACLES))
def test_twins(spark, name):
    assert difference(catalog.QUERIES[name](spark, SF), connect(SF), catalog.ORACLES[name]) is None


def test_one_query_per_operator():
    numbers = sorted(int(name[2:].split("_")[0]) for name in catalog.QUERIES)
    assert numbers == list(range(1, 14)) and set(catalog.ORACLES) <= set(catalog.QUERIES)


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n not in ("op12_ranked_search", "op13_collocations")])
def test_every_query_has_a_row_per_input_row_or_more(spark, name):
    table = "pages" if name.startswith("op2") else "documents"
    assert catalog.QUERIES[name](spark, SF).count() >= read(spark, SF, table).count()


def test_stages_follow_one_another(spark):
    docs = read(spark, SF, "documents")
    seen = {r["doc_id"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        rows = docs.collect()
        assert rows and {r["doc_id"] for r in rows} <= seen, name
        seen = {r["doc_id"] for r in rows}
        if name != "packing":
            assert tuple(docs.columns) == DOCUMENT_COLUMNS
            docs = spark.createDataFrame(rows, docs.schema)
    assert "sequence_id" in docs.columns


def test_the_pipeline_keeps_most_documents(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert len({r["doc_id"] for r in rows}) > 100


def planted(spark):
    """The small table with copies, near copies, toxic texts, and rows without id, text or words."""
    rows = [tuple(r) for r in read(spark, SF, "documents").select(*DOCUMENT_COLUMNS).collect()]
    long = [r for r in rows if r[1] and 80 < len(r[1].split()) < 400][:12]
    more = [(5000 + i, r[1], *r[2:]) for i, r in enumerate(long)]
    more += [(6000 + i, r[1] + " and one more", *r[2:]) for i, r in enumerate(long)]
    more += [(7000 + i, f"{r[1]} idiot scum, you idiot, pathetic trash clown, moron loser", *r[2:]) for i, r in enumerate(long)]
    more += [(8000, None, "en", "src1", 0), (8001, "", "en", "src1", 0), (8002, "...", None, None, 3)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    return spark.createDataFrame(rows + more, schema).repartition(3)


def test_each_stage_decides_like_its_plain_version(spark):
    docs = planted(spark)
    labels = {}
    for r in read(spark, SF, "labels").collect():
        labels.setdefault(r["doc_id"], []).append((r["toxic"], r["quality"]))
    stages, rows = dict(corpus_pipeline.STAGES), docs.collect()

    def known(which, divisor, rest, best):
        place = {r["doc_id"]: i for i, r in enumerate(rows)}
        return [(place[i], best(y[which] for y in found)) for i, found in labels.items() if i in place and plain.in_training(i, divisor, rest)]

    def step(name, keeps):
        """The stage's rows, which are those that the plain version keeps; they go on to the next."""
        got = stages[name](spark, spark.createDataFrame(rows, docs.schema).repartition(3), SF).collect()
        assert sorted(map(tuple, got), key=repr) == sorted((tuple(r) for r, keep in zip(rows, keeps) if keep), key=repr), name
        return [r for r, keep in zip(rows, keeps) if keep]

    texts = [r["text"] or "" for r in rows]
    scores = plain.toxicity_scores(texts, known(0, 3, 1, max))
    assert min(abs(s - 0.7) for s in scores) > 1e-6
    before, rows = rows, step("toxicity", [s < 0.7 for s in scores])
    lost = {r["doc_id"] for r in before} - {r["doc_id"] for r in rows}
    assert lost and len(lost) < 60
    scores = plain.quality_scores([r["text"] or "" for r in rows], known(1, 5, 0, max))
    rows = step("quality", [s >= 0.3 for s in scores])
    order = sorted(range(len(rows)), key=lambda i: rows[i]["doc_id"])
    rows = [rows[i] for i in order]
    groups = plain.near_groups([r["text"] for r in rows])
    rows = step("near_duplicates", [groups[i] == i for i in range(len(rows))])
    assert not {r["doc_id"] for r in rows} & set(range(5000, 7000)) - {r["doc_id"] for r in rows if r["doc_id"] < 5000}

    mixed = stages["mixing"](spark, spark.createDataFrame(rows, docs.schema), SF).collect()
    texts = {r["doc_id"]: tuple(r) for r in rows}
    taken = Counter(r["doc_id"] for r in mixed)
    assert all(tuple(r) == texts[r["doc_id"]] for r in mixed) and max(taken.values()) <= 2  # whole rows, none more than twice
    sizes = {i: len(plain.WORD.findall(t[1] or "")) for i, t in texts.items()}
    per_source = Counter()
    for i, t in texts.items():
        per_source[t[3]] += sizes[i]
    weights = {s: (5, 2, 1)[n % 3] for n, s in enumerate(sorted(per_source, key=lambda s: (s is None, s)))}
    target, open_, rest = {}, dict(weights), 1.5 * sum(per_source.values())
    while open_:
        share = {s: rest * w / sum(open_.values()) for s, w in open_.items()}
        full = [s for s in open_ if share[s] > 2 * per_source[s]]
        if not full:
            target |= share
            break
        for s in full:
            target[s] = 2 * per_source[s]
            rest -= target[s]
            del open_[s]
    for source, want in target.items():
        own = [i for i, t in texts.items() if t[3] == source]
        assert abs(sum(sizes[i] * taken[i] for i in own) - want) <= max(sizes[i] for i in own), source

    packed = stages["packing"](spark, spark.createDataFrame(mixed, docs.schema), SF).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for r in mixed:
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        for piece, start in enumerate(range(0, len(ids), 4096)):
            part = ids[start : start + 4096]
            want[r["doc_id"], piece, start, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed) == want
    bins = {}
    for r in packed:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in bins.values():
        ends = [0, *(a + n for a, n in sorted(own))]
        assert [a for a, _ in sorted(own)] == ends[:-1] and ends[-1] <= 4096
    total = sum(r["length"] for r in packed)
    assert len(bins) <= -(-total // 4096) * 1.1 + 2


def test_stages_on_odd_documents(spark, odd_docs, no_docs):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd_docs, SF).count() > 0, name
        assert stage(spark, no_docs, SF).count() == 0, name


def test_nothing_else_imports_the_package():
    for path in ROOT.rglob("*.py"):
        inside = "llm" in path.parts or path.name in ("corpus_pipeline.py", "__spark_entry__.py")
        if not inside:
            names = [n.module or "" for n in ast.walk(ast.parse(path.read_text())) if isinstance(n, ast.ImportFrom)]
            names += [a.name for n in ast.walk(ast.parse(path.read_text())) if isinstance(n, ast.Import) for a in n.names]
            assert not any("llm" in name.split(".") or name == "corpus_pipeline" for name in names), path
