"""Sources, sinks and streams: files, upserts, newest-file choice, and streams that equal their batch twins."""

import os

from pyspark.sql import functions as F

from quantloom.sources import tables as T
from quantloom.streaming import events as S


def test_parsing(spark):
    df = spark.createDataFrame([("1.2B",), ("3M",), ("-4.5K",), ("7",), ("—",), (None,), ("x",)], "t string")
    assert [r[0] for r in df.select(T.abbreviated(F.col("t"))).collect()] == [1.2e9, 3e6, -4500.0, 7.0, None, None, None]
    df = spark.createDataFrame([("12%",), ("0.5",), ("30",), ("-",)], "t string")
    assert [r[0] for r in df.select(T.growth(F.col("t"))).collect()] == [0.12, 0.5, 0.3, None]
    df = spark.createDataFrame([("1,234.5",), ("-",), ("N/A",), (" 7 ",)], "t string")
    assert [r[0] for r in df.select(T.number("t")).collect()] == [1234.5, None, None, 7.0]
    df = spark.createDataFrame([("2024Q1",), ("Q3/2023",), ("bad",)], "t string")
    assert [str(r[0]) for r in df.select(T.quarter_label(F.col("t"))).collect()] == ["2024-03-31", "2023-09-30", "None"]


def test_files_and_upserts(spark, tmp_path):
    at = str(tmp_path)
    with open(f"{at}/x.csv", "w") as f:
        f.write("a,b\n1,x\n-,y\n")
    assert [tuple(r) for r in T.csv(spark, f"{at}/x.csv", "a int, b string", "-").collect()] == [(1, "x"), (None, "y")]
    for day in ("2024-01-01", "2024-03-01", "2024-02-01"):
        os.mkdir(f"{at}/prices-{day}")
    assert T.newest(spark, at).endswith("2024-03-01") and T.newest(spark, at, today="2024-01-01").endswith("2024-01-01") and T.newest(spark, f"{at}/none") is None
    old = spark.createDataFrame([("a", "rsi", 1), ("b", "rsi", 2)], "t string, i string, v int")
    new = spark.createDataFrame([("a", "rsi", 9), ("a", "bb", 3)], "t string, i string, v int")
    assert sorted(tuple(r) for r in T.upsert(old, new, ["t", "i"]).collect()) == [("a", "bb", 3), ("a", "rsi", 9), ("b", "rsi", 2)]
    T.write_table(old, f"{at}/t", ["t"])
    T.write_table(new, f"{at}/t", ["t"])
    assert spark.read.parquet(f"{at}/t").count() == 2
    assert T.headers(spark.createDataFrame([(1, 2, 3)], ["a ", "b", "a"])).columns == ["a", "b", "a_2"]


def test_streams_equal_batches(spark, sf, tmp_path):
    rows = spark.read.schema(S.EVENT_SCHEMA).parquet(f"{sf}/events.parquet")
    rows.repartitionByRange(4, "ts").write.parquet(f"{tmp_path}/in")
    stream = lambda: S.source(spark, f"{tmp_path}/in")
    got = S.run_once(S.tumbling(stream(), late="400 days"), "tumble", "complete", f"{tmp_path}/c1")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, S.tumbling(rows).collect()))
    got = S.run_once(S.sliding(stream(), late="400 days"), "slide", "complete", f"{tmp_path}/c2")
    assert got.count() == S.sliding(rows).count()
    got = S.run_once(S.distinct_events(stream().unionByName(stream()), "400 days"), "dedup", "append", f"{tmp_path}/c3")
    assert got.count() == rows.count()
    got = S.run_once(S.ewma(S.source(spark, f"{tmp_path}/in", 10), 0.5), "ewma", "append", f"{tmp_path}/c4").toPandas()
    assert len(got) == rows.count()
    x = rows.toPandas().sort_values(["user_id", "ts", "event_id"])
    want = x.groupby("user_id")["value"].transform(lambda v: v.ewm(alpha=0.5, adjust=False).mean())
    assert abs(got.sort_values(["user_id", "ts", "event_id"])["ewma"].to_numpy() - want.to_numpy()).max() < 1e-9
    pairs = S.run_once(S.matched(stream().filter("event_type = 'view'"), stream().filter("event_type <> 'view'"), "1 hour", "400 days"), "pairs", "append", f"{tmp_path}/c5")
    v, o = rows.filter("event_type = 'view'"), rows.filter("event_type <> 'view'").select(F.col("user_id").alias("u2"), F.col("ts").alias("ts2"))
    assert pairs.count() == v.join(o, F.expr("u2 = user_id AND ts2 >= ts AND ts2 <= ts + interval 1 hour")).count()
    dim = spark.createDataFrame([("view", 1)], "event_type string, w int")
    assert S.run_once(S.enriched(stream(), dim, "event_type"), "rich", "append", f"{tmp_path}/c6").count() == rows.count()


def test_upsert_sink(spark, tmp_path):
    at = f"{tmp_path}/t"
    assert S.current(spark, at) is None
    S.upsert_table(spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, v string"), at, ["k"])
    S.upsert_table(spark.createDataFrame([(2, "c"), (3, "d"), (None, "m")], "k int, v string"), at, ["k"])
    want = [(1, "a"), (2, "c"), (3, "d"), (None, "m")]
    assert sorted(map(tuple, S.current(spark, at).collect()), key=str) == want
    # A batch that crashed before its commit leaves the table as it was, and the next one takes its place.
    os.mkdir(f"{at}/v-000000003")
    with open(f"{at}/v-000000003/part-0.parquet", "w") as f:
        f.write("half")
    assert sorted(map(tuple, S.current(spark, at).collect()), key=str) == want
    S.upsert_table(spark.createDataFrame([(3, "e")], "k int, v string"), at, ["k"])
    assert (3, "e") in map(tuple, S.current(spark, at).collect()) and S.current(spark, at).count() == 4
    assert sorted(x for x in os.listdir(at) if x.startswith("v-")) == ["v-000000002", "v-000000003"]
