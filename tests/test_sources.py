import datetime
import json
import os

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from keepwell import session
from keepwell.operators import shaping
from keepwell.schemas import FEEDBACK, SUBSCRIBERS, conform
from keepwell.sources import readers, writers


def test_missing_file_is_an_error(spark, tmp_path):
    with pytest.raises(AnalysisException):
        readers.read_csv(spark, str(tmp_path / "none.csv"))


def test_csv_by_name(spark, tmp_path):
    file = tmp_path / "rows.csv"
    file.write_text("\ufeffaccount_length,extra,customer_id,churn\n12,x,a,1\nmany,y,b,0\n5,z\n,,c,\n", encoding="utf-8")
    rows, rejects = readers.read_csv_checked(spark, str(file))
    assert rows.columns == ["customer_id", "account_length", "churn"]
    assert [tuple(r) for r in rows.orderBy("customer_id").collect()] == [("a", 12, 1), ("c", None, None)]
    found = {r.reason: r.text for r in rejects.collect()}
    assert found["not as many values as the header has"] == "5,z"
    assert json.loads(found["account_length: not a int"]) == {"account_length": "many", "extra": "y", "customer_id": "b", "churn": "0"}
    with pytest.raises(Exception, match="rows.csv"):
        readers.read_csv(spark, str(file)).collect()
    with pytest.raises(Exception, match="rows.csv"):
        readers.read_csv(spark, str(file)).select("customer_id").collect()


def test_csv_files_with_different_headers(spark, tmp_path):
    (tmp_path / "test_1.csv").write_text("customer_id,churn\na,1\n")
    (tmp_path / "test_2.csv").write_text("\ufeffchurn,customer_id,state\n0,b,X\n", encoding="utf-8")
    (tmp_path / "test_3.csv").write_text("customer_id,churn\nc,0\n")
    (tmp_path / "test_4.csv").write_text("")
    rows = readers.read_csv(spark, str(tmp_path / "test*.csv"))
    assert rows.columns == ["customer_id", "state", "churn"]
    assert sorted(map(tuple, rows.collect())) == [("a", None, 1), ("b", "X", 0), ("c", None, 0)]
    assert readers.read_csv(spark, str(tmp_path / "test_4.csv")).count() == 0


def test_json_rejects(spark, tmp_path):
    file = tmp_path / "lines.json"
    file.write_text('{"customer_id": "a", "text": "t"}\n{broken\n{"customer_id": "b", "scraped_at": "no time"}\n')
    rows, rejects = readers.read_json_checked(spark, str(file))
    assert [r.customer_id for r in rows.collect()] == ["a"]
    assert sorted(r.text for r in rejects.collect()) == ['{"customer_id": "b", "scraped_at": "no time"}', "{broken"]
    with pytest.raises(Exception, match="lines.json"):
        readers.read_json_lines(spark, str(file)).collect()


def test_escaped_breaks(spark, tmp_path):
    texts = ["two\nlines", "back\\slash", "\\n no break", "a\r\nb\\", "\\\\\n", 'q"uo,te']
    rows = [(str(i), "u", "pricing", "neutral", 1, t) for i, t in enumerate(texts)]
    schema = "customer_id string, username string, feedback_category string, sentiment string, complaint_intensity int, raw_text string"
    path = str(tmp_path / "out")
    writers.export_feedback_csv(spark.createDataFrame(rows, schema), path, escaped=True)
    got = {r.customer_id: r.raw_text for r in readers.read_csv(spark, path, FEEDBACK, escaped=True).collect()}
    assert got == {str(i): t for i, t in enumerate(texts)}


def test_csv_text_with_line_breaks_and_quotes(spark, tmp_path):
    texts = ['a "b" c', "two\nlines", "comma, here", "back\\slash", "", "  kept blanks  "]
    rows = [(str(i), "u", "pricing", "neutral", 1, t) for i, t in enumerate(texts)]
    schema = "customer_id string, username string, feedback_category string, sentiment string, complaint_intensity int, raw_text string"
    path = str(tmp_path / "out")
    writers.export_feedback_csv(spark.createDataFrame(rows, schema), path)
    got = {r.customer_id: r.raw_text for r in readers.read_csv(spark, path, FEEDBACK, multi_line=True).collect()}
    assert got == {str(i): t or None for i, t in enumerate(texts)}  # CSV has no empty text


def test_json_array(spark, tmp_path):
    file = tmp_path / "comments_1.json"
    comments = [
        {"customer_id": "a", "post_url": "p", "username": "ام", "text": "two\nlines", "scraped_at": "2026-06-20T13:07:23.251884"},
        {"customer_id": "b", "text": None, "associated_post_date": "2 d"},
    ]
    file.write_text(json.dumps(comments, ensure_ascii=False, indent=2), encoding="utf-8")
    rows = readers.read_json_comments(spark, str(file)).orderBy("customer_id").collect()
    assert (rows[0].username, rows[0].text, rows[0].scraped_at.microsecond) == ("ام", "two\nlines", 251884)
    assert (rows[1].associated_post_date, rows[1].text) == ("2 d", None)


def test_latest_file(spark, tmp_path):
    for name, age in (("comments_a.json", 30), ("comments_b.json", 10), ("comments_c.json", 20), ("other.json", 0)):
        file = tmp_path / name
        file.write_text("[]")
        stamp = 1_700_000_000 - age
        os.utime(file, (stamp, stamp))
    assert readers.latest_path(spark, str(tmp_path / "comments_*.json")).endswith("comments_b.json")


def test_empty_table_is_an_error(spark):
    empty = spark.createDataFrame([], SUBSCRIBERS)
    with pytest.raises(readers.EmptyTable, match="subscribers"):
        readers.require_rows(empty, "subscribers")


def test_append_comments(spark, tmp_path):
    path = str(tmp_path / "comments")
    then = datetime.datetime(2024, 1, 1)
    rows = spark.createDataFrame([("a", "p", "u", "t", then), ("b", "p", "u", "t", None)], "customer_id string, post_url string, username string, text string, scraped_at timestamp")
    assert writers.append_comments(rows.limit(0), path) is False and not os.path.exists(path)
    assert writers.append_comments(rows, path) is True
    assert writers.append_comments(rows.drop("scraped_at"), path) is True
    stored = spark.read.parquet(path)
    assert stored.count() == 4 and stored.filter("scraped_at IS NULL").count() == 0
    assert stored.filter(F.col("scraped_at") == F.lit(then)).count() == 1


def test_scans_push_down(spark, sf_dir):
    df = readers.read_table(spark, f"{sf_dir}/customer.parquet").filter("c_mktsegment = 'MACHINERY'").select("c_custkey")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(c_mktsegment,MACHINERY)" in plan
    assert "ReadSchema: struct<c_custkey:bigint,c_mktsegment:string>" in plan


def test_scratch_follows_the_cluster(spark):
    root = session.scratch_root(spark)
    assert root == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    assert session.scratch_path(spark, "x") != session.scratch_path(spark, "x")


class Unset:
    """A session of a cluster, or a local one, that names no folder."""

    def __init__(self, master):
        self.sparkContext = type("Context", (), {"master": master, "applicationId": "app-1"})
        self.conf = type("Conf", (), {"get": staticmethod(lambda name, default=None: default)})


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[3,2,1000]", "k8s://x"])
def test_a_cluster_must_name_a_shared_folder(master):
    with pytest.raises(session.NoSharedFolder):
        session.scratch_root(Unset(master))


def test_one_process_has_a_folder_of_its_own():
    assert session.scratch_root(Unset("local[*]")) == session.scratch_root(Unset("local")) == "/tmp/keepwell-app-1"


# --- shaping ----------------------------------------------------------------------------------


def test_conform(spark):
    df = spark.createDataFrame([("1", "x")], "complaint_intensity string, extra string")
    row = conform(df, FEEDBACK, {"source": "Facebook"}).first()
    assert (row.complaint_intensity, row.source, row.username) == (1, "Facebook", None)
    assert conform(df, FEEDBACK).columns == FEEDBACK.fieldNames()


def test_whitelist(spark):
    df = spark.createDataFrame([("x", True, 5, "a")], "note string, churn boolean, area_code int, customer_id string")
    out = shaping.project_whitelist(df)
    assert out.columns == ["customer_id", "area_code", "churn"] and out.first().churn == 1


def test_reindex(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    out = shaping.reindex(df, ["c", "x", "a"])
    assert out.columns == ["c", "x", "a"] and tuple(out.first()) == (3, 0, 1)


def test_defaults(spark):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    assert shaping.with_defaults(df, {"b": "x", "c": "y"}).first().asDict() == {"a": 1, "b": None, "c": "y"}
    assert shaping.with_defaults(df, {"b": "x"}, fill_nulls=True).first().b == "x"


def test_payloads(spark):
    good = {c: "1" for c in SUBSCRIBERS.fieldNames() if c not in ("churn", "feedback_category", "sentiment")}
    good["complaint_intensity"] = good["feedback_text"] = None
    cases = [good, {**good, "area_code": "12.5"}, {**good, "state": None}, {**good, "total_day_minutes": " 2.5 ", "complaint_intensity": "x"}]
    schema = ", ".join(f"{c} string" for c in good)
    df = spark.createDataFrame([tuple(c.values()) for c in cases], schema)
    valid, bad = shaping.validate_payloads(df)
    row = valid.first()
    assert valid.count() == 1 and (row.complaint_intensity, row.feedback_text, row.area_code) == (0, "", 1)
    assert sorted(r.errors for r in bad.collect()) == [
        "area_code: not a number", "complaint_intensity: not a number", "state: missing",
    ]
    without = df.drop("state", "complaint_intensity")
    assert {r.errors for r in shaping.check_payloads(without).collect()} >= {"state: missing"}


def _bytes_read(spark):
    return sum(x.getBytesRead() for x in spark._jvm.org.apache.hadoop.fs.FileSystem.getAllStatistics())


def test_csv_is_read_once(spark, tmp_path):
    """Looking for headers reads a first buffer of each split, not the data."""
    line = "customer {},{},some text to fill the line up to a hundred signs or so, and some more of it, and more\n"
    for i in range(3):
        (tmp_path / f"big_{i}.csv").write_text("customer_id,churn\n" + "".join(line.format(j, j % 2).replace(" ", "_").replace(",some", "some").replace("so,", "so").replace("it,", "it") for j in range(40_000)))
    size = sum(f.stat().st_size for f in tmp_path.iterdir())
    own = spark.newSession()
    own.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    before = _bytes_read(spark)
    found = readers._headers(own, str(tmp_path / "big_*.csv"), header=True)
    assert [(names, len(files)) for names, files in found] == [(["customer_id", "churn"], 3)]
    looked = _bytes_read(spark) - before
    assert 0 < looked < size / 3
    before = _bytes_read(spark)
    rows, _ = readers.read_csv_checked(own, str(tmp_path / "big_*.csv"), SUBSCRIBERS)
    rows.write.parquet(str(tmp_path / "out"))
    assert _bytes_read(spark) - before < 1.5 * size


def test_first_lines_of_many_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(readers, "FILES_AT_ONCE", 3)
    for i in range(8):
        (tmp_path / f"f{i}.csv").write_text("\n\n" * (i % 2) + ("customer_id,churn\na,1\n" if i % 3 else "churn,customer_id\n0,b\n"))
    (tmp_path / "empty.csv").write_text("")
    rows = readers.read_csv(spark, str(tmp_path / "*.csv"))
    assert sorted(map(tuple, rows.collect())) == [("a", 1)] * 5 + [("b", 0)] * 3


def test_small_files_are_looked_up_together(spark, tmp_path, monkeypatch):
    """No job of its own for a small file, whatever stands before its header."""
    monkeypatch.setattr(readers, "_first_line", lambda *_: pytest.fail("a small file was looked up alone"))
    for i in range(40):
        before, header = ("", "\r\n\n", "\ufeff", "\n\ufeff")[i % 4], ("customer_id,churn", "churn,customer_id")[i % 2]
        row = f"c{i},1" if i % 2 == 0 else f"1,c{i}"
        (tmp_path / f"f {i}.csv").write_text(f"{before}{header}\r\n{row}\r\n", encoding="utf-8", newline="")
    (tmp_path / "blank.csv").write_text("\n\n")
    rows = readers.read_csv(spark, str(tmp_path / "*.csv"))
    assert sorted(map(tuple, rows.collect())) == sorted((f"c{i}", 1) for i in range(40))
