import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from recordspark.operators import contracts as K
from recordspark.operators import dimensions as D
from recordspark.operators import quality as Q
from recordspark.runtime import Cut
from recordspark.sources import files as S
from recordspark.sources import objects as O
from recordspark.streaming import ingest

DIM = "dim_key long, k string, v string, n int, valid_from timestamp, valid_to timestamp, is_current boolean"


def step(spark, dim, rows, day):
    return D.scd2_next(dim, spark.createDataFrame(rows, "k string, v string, n int"), "k", ["v"], ["n"], F.lit(day).cast("timestamp"), Cut(spark, "t"))


def test_scd2_scenario(spark):
    dim = spark.createDataFrame([], DIM)
    dim = step(spark, dim, [("a", "1", 1), ("b", None, 1), ("c", "1", 1)], "2025-01-01")
    again = step(spark, dim, [("a", "1", 1), ("b", None, 1), ("c", "1", 1)], "2025-02-01")
    assert again.exceptAll(dim).count() == 0 and dim.exceptAll(again).count() == 0  # a rerun changes nothing
    dim = step(spark, dim, [("a", "2", 1), ("b", None, 5)], "2025-02-01")
    dim = step(spark, dim, [("a", "2", 2), ("b", None, 5), ("c", "1", 9)], "2025-03-01")
    got = {(r.dim_key, r.k, r.v, r.n, r.valid_from.month, r.valid_to.month if r.valid_to else None, r.is_current) for r in dim.collect()}
    assert got == {(1, "a", "1", 1, 1, 2, False), (2, "b", None, 5, 1, None, True), (3, "c", "1", 1, 1, 2, False), (4, "a", "2", 2, 2, None, True), (5, "c", "1", 9, 3, None, True)}


def test_numbers_follow_the_key(spark, cut):
    got = D.number_rows(spark.range(1000).select(F.concat(F.lit("k"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("k")).orderBy(F.rand(1)), "k", "n", cut)
    assert [r.n for r in got.orderBy("k").collect()] == list(range(1, 1001))


@pytest.mark.parametrize(
    ("rows", "current", "want"),
    [
        ([("2025-01-01", True), ("2025-01-03", True)], None, "2025-01-03"), ([("2025-01-01", True), ("2025-01-02", False), ("2025-01-03", True)], None, "2025-01-01"),
        ([("2025-01-01", True), (None, False)], None, None), ([("2025-01-01", True)], "2025-02-01", None), ([], None, None), ([("2025-01-02", False), ("2025-01-02", True)], None, None),
    ],
)
def test_watermark(spark, rows, current, want):
    df = spark.createDataFrame(rows, "s string, ok boolean")
    assert D.next_watermark(df, "s", F.col("ok"), current).first().watermark == want


def test_append_and_upsert(spark):
    a, b = spark.createDataFrame([(1, "x", 1)], "k int, v string, t int"), spark.createDataFrame([(1, "y", 1), (2, "z", 1), (2, "z", 1)], "k int, v string, t int")
    assert [tuple(r) for r in D.append_absent(a, b, "k").collect()] == [(2, "z", 1)]
    assert {tuple(r) for r in D.upsert_latest(a, b, ["k"], "t").collect()} == {(1, "y", 1), (2, "z", 1)}


def test_contract_reasons(spark):
    cols = "order_id string, match_id string, purchased_at string, qty string, total string, purchaser_name string, purchaser_email string, source_file string, reasons string"
    ok = ("T-1", "MTCH-1", "2025-01-01T00:00:00Z", "2", "5.0", "Ann", "a@b.c", "f", None)
    rows = [ok, ("X", *ok[1:3], "11", "-1", " ", "a@b", "f", None), ("T-2", *ok[1:7], "f", None), ("T-2", *ok[1:7], "f", None), ("T-3", *ok[1:4], None, *ok[5:7], "g", None)]
    got = [r.reason for r in K.judge(spark.createDataFrame(rows, cols), K.CONTRACTS["ticketing_orders"]).orderBy("order_id").collect()]
    assert got[0] is None and got[1] == got[2] == "order_id: not unique in its file" and got[3] == "total: column missing"
    assert got[4] == "order_id: must start with T-; purchaser_email: must look like an e-mail address; purchaser_name: empty; qty: must be a whole number from 1 to 10; total: must be positive"
    assert K.judge(spark.createDataFrame([], cols), K.CONTRACTS["ticketing_orders"]).count() == 0


def test_file_table_replays(spark, tmp_path):
    t = K.FileTable(spark, str(tmp_path / "raw"))
    rows = lambda *r: spark.createDataFrame(list(r), "payload string, source_file string")
    t.load(rows(("a", "f 1.csv"), ("b", "f2.csv")), ["f 1.csv", "f2.csv"])
    t.load(rows(("c", "f 1.csv")), ["f 1.csv"])
    t.load(rows(("c", "f 1.csv")), ["f 1.csv", "f2.csv"])
    assert [tuple(r) for r in t.read().select("payload", "source_file").collect()] == [("c", "f 1.csv")]


def test_gate_fails_on_a_duplicate(spark):
    df = spark.createDataFrame([(1,), (1,)], "k int")
    results = Q.run_checks([Q.Check("unique", "error", lambda: Q.duplicates(df, "k")), Q.Check("late", "warn", lambda: Q.stale(df.limit(0).withColumn("t", F.current_timestamp()), "t", F.current_timestamp(), 26))])
    assert results[1][2] == 1
    with pytest.raises(Q.GateError, match="unique"):
        Q.gate(results)
    Q.gate(results[1:])
    with pytest.raises(ValueError):
        Q.run_checks([Q.Check("x", "fatal", lambda: df)])


def test_files_and_objects(spark, tmp_path):
    (tmp_path / "orders_2025-01.jsonl").write_text('{"Id": "1", "SystemModstamp": "2025-01-01"}\n\n{"Id": "2", "SystemModstamp": "2025-03-01", "new": 1}\n')
    (tmp_path / "subs.csv").write_text('id,name\n1,"A, B"\n2,\n')
    (tmp_path / "subs2.csv").write_text("id,zip\n3,01234\n")
    assert S.read_json_lines(spark, str(tmp_path / "orders_2025-01.jsonl")).count() == 2
    got = {(r.id, r.name, r.zip) for r in S.read_csv(spark, [str(tmp_path / "subs.csv"), str(tmp_path / "subs2.csv")]).collect()}
    assert got == {("1", "A, B", None), ("2", "", None), ("3", None, "01234")}
    files = S.list_files(spark, str(tmp_path), "*.csv")
    assert S.unseen(files, files.limit(1)).count() == 1 and S.unseen(files, files, force=True).count() == 2
    O.register(spark)
    folder = tmp_path / "api" / "Contact"
    folder.mkdir(parents=True)
    (folder / "a.jsonl").write_text("".join(json.dumps({"Id": str(i), "SystemModstamp": f"2025-0{i}-01"}) + "\n" for i in range(1, 6)))
    df = spark.read.format("objects").option("folder", str(tmp_path / "api")).option("kind", "Contact").load()
    assert sorted(r.id for r in df.filter("modified_at > '2025-03-01'").collect()) == ["4", "5"]
    assert O.parse_query(O.query_text("Contact", "2025-01-01", 7)) == ("Contact", "2025-01-01", 7)
    with pytest.raises(ValueError):
        O.parse_query("SELECT Id FROM Contact")


def test_stream_appends_once(spark, tmp_path):
    src, fact, bad = (str(tmp_path / x) for x in ("in", "fact", "bad"))
    (tmp_path / "in").mkdir()
    line = lambda i, s="S-1": json.dumps({"event_id": f"E-{i}", "subscriber_id": s, "campaign_id": "C-1", "event_type": "send", "occurred_at": "2025-01-01T00:00:00Z"})
    cols = ["event_id", "subscriber_id", "campaign_id", "event_type", "occurred_at"]
    for name, rows in (("a", [line(1), line(2), line(3, "X")]), ("b", [line(2), line(4)])):
        (tmp_path / "in" / f"{name}.jsonl").write_text("\n".join(rows) + "\n")
        ingest.run_available(ingest.json_stream(spark, src, cols), K.CONTRACTS["email_events"], "event_id", fact, bad, str(tmp_path / "cp"))
    assert sorted(r.event_id for r in spark.read.parquet(fact).collect()) == ["E-1", "E-2", "E-4"]
    assert [r.event_id for r in spark.read.parquet(bad).collect()] == ["E-3"]


def test_stream_windows(spark, tmp_path):
    rows = [("E1", dt.datetime(2025, 1, 1, 0, 1), "open"), ("E1", dt.datetime(2025, 1, 1, 0, 1), "open"), ("E2", dt.datetime(2025, 1, 1, 0, 7), "open")]
    spark.createDataFrame(rows, "event_id string, at timestamp, kind string").write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("event_id string, at timestamp, kind string").parquet(str(tmp_path / "e"))
    q = ingest.windowed_counts(stream, "at", "kind", "5 minutes", "10 minutes").writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.n for r in spark.table("w").collect()) == [1, 2]
    q = ingest.distinct_events(stream, "event_id", "at", "10 minutes").writeStream.format("memory").queryName("u").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("u").count() == 2
