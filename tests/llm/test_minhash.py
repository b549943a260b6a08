import random
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from keepwell.llm import minhash
from keepwell.llm.components import components
from keepwell.llm.minhash import near_duplicates, shingle_sets, word_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, width):
    words = WORD.findall(lowered(text))
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute_force(rows, width, percent):
    """Size of the set and least reachable id per row, in order."""
    sets = [shingles(text, width) for _, text in rows]
    near = {i: set() for i in range(len(rows))}
    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            near[i].add(j), near[j].add(i)
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo += new
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((rows[i][0], len(sets[i]), min(ids) if ids else None))
    return out


def copies(seed, groups=25):
    rng, rows = random.Random(seed), []
    for _ in range(groups):
        base = [rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randrange(400)) for _ in range(rng.randrange(1, 90))]
        for _ in range(rng.randrange(1, 9)):
            words = list(base)
            for _ in range(rng.randrange(0, 5)):
                words[rng.randrange(len(words))] = f"new{rng.randrange(9)}"
            rows.append((len(rows) * 3 % 211 if rng.random() < 0.95 else None, rng.choice([" ", "\n", "  "]).join(words)))
    return rows


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_same_components_as_all_pairs(spark, width, percent):
    rows = copies(width) + [(900, None), (901, ""), (902, " \t"), (903, "Two Words"), (904, "two words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = near_duplicates(docs, width, percent).collect()
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found), key=repr)
    assert got == sorted(brute_force(rows, width, percent), key=repr)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)


def test_a_chain_is_one_component_though_its_ends_are_unlike(spark):
    words = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join([f"x{j}" for j in range(i * 4)] + words[i * 4 :])) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in near_duplicates(docs, 3, 85).collect()}
    assert found == {i: c for i, _, c in brute_force(rows, 3, 85)} and set(found.values()) == {0}


def test_one_row_of_each_component_is_first(spark, odd_docs):
    found = near_duplicates(odd_docs, keep=("lang", "source")).collect()
    assert len(found) == odd_docs.count()
    by_id = {}
    for row in found:
        by_id.setdefault((row["component_id"], row["text"] if row["component_id"] is None else ""), []).append(row["first"])
    assert all(sum(firsts) == 1 for firsts in by_id.values())
    assert {r["component_id"] for r in found if r["doc_id"] in (1, 2)} == {1}
    assert [r["n_shingles"] for r in found if r["doc_id"] in (3, 4, 5)] == [0, 0, 0]
    assert {r["component_id"] for r in found if r["doc_id"] in (6, 7)} == {6}


def test_no_documents(no_docs):
    assert near_duplicates(no_docs).collect() == []


def test_words_split_over_parts_hash_alike():
    text = ("Ab  cd\x0bef gh \x1c " * 50 + "z" * 300).encode()
    data = np.frombuffer(text + b"ab" + b"", np.uint8)
    offsets = np.array([0, len(text), len(text), len(data)])
    whole, counts = word_hashes(data, offsets)
    parts, same = word_hashes(data, offsets, most=7)
    assert (whole == parts).all() and (counts == same).all()
    assert counts.tolist() == [len(WORD.findall(text.decode())), 0, 1] and whole[0] == whole[-1]
    assert len(set(whole.tolist())) == len(set(WORD.findall(lowered(text.decode())))) 


def test_sets_are_distinct_shingles():
    texts = ["a b a b a b", "a", "", "a b c"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    sets, ends = shingle_sets(data, offsets, 3)
    assert np.diff(ends).tolist() == [2, 1, 0, 1] and len(sets) == 4


def test_components_of_a_long_path_a_star_and_a_ring(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(200, 201), (201, 202), (202, 200), (7, 7)]
    found = components(spark.createDataFrame(edges, "a long, b long")).collect()
    want = {i: 0 for i in range(41)} | {100 + i: 100 for i in range(60)} | {200: 200, 201: 200, 202: 200}
    assert {r["node"]: r["component"] for r in found} == want and len(found) == len(want)
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_a_small_graph_needs_no_shuffle(spark, monkeypatch):
    """Its rounds are a task each, however many partitions its edges have; a larger one is dealt out, to the same components."""
    from keepwell.llm import components as graph

    rng, stored, plans = random.Random(5), graph.materialize, []
    edges = spark.createDataFrame([(rng.randrange(400), rng.randrange(400)) for _ in range(300)], "a long, b long").repartition(20)

    def planned(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stored(df, label)

    monkeypatch.setattr(graph, "materialize", planned)
    own = spark.conf
    before = own.get("spark.sql.autoBroadcastJoinThreshold")
    own.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        edges = stored(edges, "edges")
        small = sorted(map(tuple, components(edges).collect()))
        assert plans and not any("Exchange" in plan for plan in plans)
        plans.clear()
        monkeypatch.setattr(graph, "SMALL", 0)
        assert sorted(map(tuple, components(edges).collect())) == small
        assert all("Exchange hashpartitioning" in plan for plan in plans)
    finally:
        own.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_rows_of_one_component_are_never_paired(spark):
    """8,000 near copies and three texts that almost match them: pairs in proportion to rows, not to their square."""
    from keepwell.llm.minhash import meeting

    rows = spark.range(8003).crossJoin(spark.range(20).withColumnRenamed("id", "shingle")).selectExpr(
        "id AS rep", "100L AS n", "CASE WHEN id < 8000 THEN 0 ELSE id END AS component", "50L AS after", "shingle"
    )
    only_copies = rows.filter("rep < 8000").withColumn("shingle", F.col("shingle") + 100)
    met = meeting(rows.unionByName(only_copies), F.lit(True))
    assert met.count() == 20 * (8000 * 3 + 3)
    assert met.filter("component_a = component_b").isEmpty() and met.dropDuplicates(["shingle", "rep_a", "rep_b"]).count() == met.count()


def test_different_components_meet_once_per_shingle(spark):
    from keepwell.llm.minhash import meeting

    rng = random.Random(4)
    rows = [(rep, 10, rng.choice([1, 1, 1, 2, 3, 5, 8, 13, 21, 40 + rep]), 5, rng.randrange(12)) for rep in range(300)]
    frame = spark.createDataFrame(rows, "rep long, n long, component long, after long, shingle long")
    got = sorted((r["shingle"], *sorted((r["rep_a"], r["rep_b"]))) for r in meeting(frame, F.lit(True)).collect())
    assert got == sorted((a[4], a[0], b[0]) for a, b in combinations(rows, 2) if a[4] == b[4] and a[2] != b[2])


def test_a_group_of_near_copies_gives_few_pairs(spark, monkeypatch):
    """Links inside a group are found with a few of its texts; only what stays apart is paired with all others."""
    rng, base, pairs, rows = random.Random(5), [f"w{i}" for i in range(200)], [], []
    for i in range(250):  # those with two changes are linked with all such, others with the few that have one in common
        words = list(base)
        for place in rng.sample(range(5, 200, 6), 2 if i % 5 > 2 else 3):
            words[place] = f"n{i}x{place}"
        rows.append((i, " ".join(words)))
    crossing = minhash.crossing

    def counted(*given):
        found = crossing(*given)
        pairs.append(found.count())
        return found

    monkeypatch.setattr(minhash, "crossing", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_duplicates(docs).collect()]
    want = brute_force(rows, 5, 80)
    assert sorted(got) == sorted(want) and sum(pairs) < 5 * len(rows)
