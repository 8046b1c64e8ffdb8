"""Each retail query against its SQL, on the smallest data; operators on small frames."""

import os

import duckdb
import pytest

from ledgerloom.plans import analytics, checks, cleaning, loads, marts, products, retail, suites, workbook  # noqa: F401

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return float(v) if type(v).__name__ == "Decimal" else str(v) if hasattr(v, "isoformat") else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("key", sorted(retail.QUERIES))
def test_query_equals_sql(spark, duck, key):
    df = retail.QUERIES[key](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*cols).collect()), key=repr)
    want = sorted((tuple(map(plain, r)) for r in duck.execute("SELECT " + ", ".join(chr(34) + c + chr(34) for c in cols) + f" FROM ({retail.SQL[key]})").fetchall()), key=repr)
    assert got == want


def test_stream_equals_batch(spark, tmp_path):
    from ledgerloom.plans.views import view
    from ledgerloom.streaming import events

    batch = view(spark, SF, "v_events")
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    for name, f in (("kpis", events.realtime_kpis), ("sessions", events.session_metrics)):
        events.to_console(f(stream), name, str(tmp_path / name), "memory", {"availableNow": True}).awaitTermination(120)
        assert sorted(map(tuple, spark.table(name).collect()), key=repr) == sorted(map(tuple, f(batch).collect()), key=repr)


def test_late_rows_in_append_mode(spark, tmp_path):
    """An on-time row, one late within the watermark, one beyond it, and a far later one that closes the windows."""
    from ledgerloom.streaming import events

    schema = "event_id long, kind string, ts timestamp, user_id long, session_id string, country string, device_type string, page_url string, value decimal(18,2)"
    row = lambda i, t: (i, "purchase", t, i, f"s{i}", "DE", "mobile", "/", None)
    import datetime as d

    at = lambda h, m: d.datetime(2024, 1, 1, h, m)
    # a batch filters late rows by the watermark that its predecessor started with
    for k, rows in enumerate(([row(1, at(10, 0)), row(2, at(10, 20))], [row(3, at(10, 12))], [row(4, at(10, 0))], [row(5, at(15, 0))], [row(6, at(15, 1))])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"k={k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = events.to_parquet(events.realtime_kpis(stream).select("window_start", "total_events"), str(tmp_path / "out"), str(tmp_path / "ck"), (), {"availableNow": True})
    q.awaitTermination(120)
    got = {r["window_start"].strftime("%H:%M"): r["total_events"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"10:00": 1, "10:12": 1, "10:20": 1}


def test_jdbc_round_trip(spark, tmp_path):
    from ledgerloom.sources import files

    url = f"jdbc:derby:{tmp_path}/db;create=true"
    driver = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    rows = spark.range(1, 101).selectExpr("id", "id * 2 AS twice")
    files.sink_jdbc(rows, url, "numbers", mode="overwrite", **driver)
    files.sink_jdbc(rows.where("id > 90"), url, "numbers", **driver)
    back = files.scan_jdbc(spark, url, "numbers", "id", 4, **driver)
    assert back.rdd.getNumPartitions() == 4 and back.count() == 110
    files.sink_jdbc(rows.limit(0), url, "no_rows", mode="overwrite", **driver)
    assert files.scan_jdbc(spark, url, "no_rows", "id", 4, **driver).count() == 0


def test_foreach_batch_skips_empty(spark, tmp_path):
    from ledgerloom.streaming import events

    spark.range(10).write.parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    events.to_batches(stream.where("id < 0"), lambda b, i: seen.append(i), str(tmp_path / "a"), trigger={"availableNow": True}).awaitTermination(60)
    assert seen == []


def test_updates_with_repeated_keys(spark):
    from pyspark.sql import functions as F

    from ledgerloom.operators import loading as L

    target = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "id int, v string, at int")
    updates = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1), (3, "w", 0)], "id int, v string, at int")
    rows = lambda df: sorted(tuple(r)[:2] for r in df.collect())
    assert rows(L.merge_scd1(target, updates, ["id"], [F.desc("at")])) == [(1, "a"), (2, "y"), (3, "z")]
    assert rows(L.insert_ignore(target, updates, ["id"], [F.desc("at")])) == [(1, "a"), (2, "b"), (3, "z")]
    assert rows(L.merge_scd1_partial(target, updates, ["id"], [], [F.desc("at")])) == [(1, "a"), (2, "b"), (3, "z")]
    day = lambda x: F.lit(x).cast("date")
    history = target.select("id", "v", day("2020-01-01").alias("effective_from"), day(None).alias("effective_to"), F.lit(True).alias("is_current"))
    same = target.where("id = 1")
    assert L.merge_scd2(history, same, ["id"], ["v"], "2021-01-01").count() == 2
    assert L.merge_scd2(history, same, ["id"], ["v"], "2021-01-01", only_changed=False).count() == 3


def test_tiers_follow_the_fixed_edges(spark):
    from ledgerloom.functions import columns as C
    from ledgerloom.operators import cleaning as K

    df = spark.createDataFrame([(75.25,), (500.0,), (9999999.99,), (-50.0,), (0.0,), (None,)], "x double")
    assert [r[0] for r in df.select(C.bucketize_right_closed(df.x, *K.ORDER_VALUE)).collect()] == ["Low", "High", "Very High", None, None, None]
    assert [r[0] for r in df.limit(2).select(C.tier(df.x, [], ["only"])).collect()] == ["only", "only"]


def test_checks_on_missing_columns_and_empty_tables(spark):
    from ledgerloom.operators import suites as S

    df = spark.createDataFrame([(1, None)], "id int, email string").limit(0)
    specs = [{"check": "not_null", "column": "no"}, {"check": "not_null", "column": "id"}, {"check": "unique", "column": "id"}, {"check": "primary_key", "column": "id"}, {"check": "outliers", "column": "id"}, {"check": "freshness", "column": "email", "max_age_hours": 1}, {"check": "not_empty"}]
    got = {r["rule_name"]: (r["passed"], r["error"]) for r in S.run_checks(df, specs, "t", "2024-01-01 00:00:00").collect()}
    assert got == {"not_null_no": (False, "column not found"), "not_null_id": (True, None), "unique_id": (True, None), "primary_key_id": (True, None), "outliers_id": (True, None), "freshness_email": (False, None), "table_not_empty": (False, None)}
    assert [S.gate(x) for x in (0.95, 0.9, 0.7, 0.2)] == ["load", "load", "quarantine", "fail"]
    assert S.validate_schema(df, {"id": "bigint", "name": "string"}) == ["column id is int, not bigint", "missing column name"]
    with pytest.raises(ValueError):
        S.run_checks(df, [], "t", "2024-01-01")


def test_global_ranks_equal_windows(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from ledgerloom.operators import windows as W

    df = spark.range(1000).selectExpr("id", "CASE WHEN id % 50 = 0 THEN NULL ELSE id * 7919 % 101 END AS x")
    got = {r["id"]: r for r in W.global_ranks(df, "x", "id").collect()}
    w = Window.orderBy(F.desc_nulls_last("x"))
    for r in df.select("id", F.rank().over(w).alias("rank"), F.dense_rank().over(w).alias("dense_rank"), F.row_number().over(w.orderBy(F.desc_nulls_last("x"), F.desc("id"))).alias("row_number")).collect():
        g = got[r["id"]]
        assert (g["rank"], g["dense_rank"], g["row_number"]) == (r["rank"], r["dense_rank"], r["row_number"])
    tiles = spark.range(1, 251).select(W.tile(F.col("id"), F.lit(250), 100).alias("a"), F.ntile(100).over(Window.orderBy("id")).alias("b"))
    assert tiles.where("a <> b").count() == 0
    assert W.global_ranks(df.limit(0), "x").count() == 0
