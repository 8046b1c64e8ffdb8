"""Loads that break off, marts that fail, streams that are late, batches that come twice, ranks with hot ties."""

import datetime as d
from decimal import Decimal

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

ONCE = {"availableNow": True}
DERBY = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}


# ------------------------------------------------------------------ incremental loads


@pytest.mark.parametrize(
    ("kind", "values"),
    [
        ("int", [1, 9, 10, 11, 100]),
        ("decimal(10,2)", [Decimal("-2.50"), Decimal("9.00"), Decimal("10.00"), Decimal("11.25"), Decimal("100.00")]),
        ("date", [d.date(1999, 9, 9), d.date(1999, 10, 1), d.date(1999, 11, 1), d.date(2000, 1, 1), d.date(10000 - 1, 1, 1)]),
        ("timestamp", [d.datetime(2024, 1, 1, 9), d.datetime(2024, 1, 1, 10), d.datetime(2024, 1, 1, 11), d.datetime(2024, 1, 1, 11, 0, 0, 1), d.datetime(2024, 1, 2)]),
    ],
)
def test_marks_keep_their_type(spark, tmp_path, kind, values):
    from ledgerloom.operators import incremental as I

    rows = spark.createDataFrame([(v, k) for k, v in enumerate(values)] + [(None, 99)], f"x {kind}, k int")
    path = str(tmp_path)
    for upto in range(1, len(values) + 1):
        part = rows.where((F.col("k") < upto) | F.col("x").isNull())
        assert I.incremental_load(part, f"{path}/t", f"{path}/c", "t", "x") == 1
        assert I.incremental_load(part, f"{path}/t", f"{path}/c", "t", "x") == 0
    got = I.loaded(spark, f"{path}/t", f"{path}/c", "t")
    assert sorted(r["x"] for r in got.collect()) == values
    assert I.loaded(spark, f"{path}/t", f"{path}/c", "t", after=3).count() == len(values) - 3
    with pytest.raises(ValueError, match="its mark"):
        I.incremental_load(rows.withColumn("x", F.col("x").cast("string")), f"{path}/t", f"{path}/c", "t", "x")


def test_a_load_that_breaks_off_adds_nothing_twice(spark, tmp_path, monkeypatch):
    from ledgerloom.operators import incremental as I

    path, commit = str(tmp_path), I.commit
    load = lambda n: I.incremental_load(spark.range(1, n + 1), f"{path}/t", f"{path}/c", "t", "id")
    assert load(9) == 9

    def crash(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(I, "commit", crash)
    with pytest.raises(RuntimeError):
        load(12)
    seen = lambda: sorted(r["id"] for r in I.loaded(spark, f"{path}/t", f"{path}/c", "t").collect())
    assert seen() == list(range(1, 10))  # rows without a mark are not seen
    monkeypatch.setattr(I, "commit", commit)
    assert load(11) == 2 and seen() == list(range(1, 12))  # and are written over
    assert load(11) == 0 and load(12) == 1 and seen() == list(range(1, 13))


def test_ties_with_the_mark(spark, tmp_path):
    from ledgerloom.operators import incremental as I

    rows = lambda *xs: spark.createDataFrame(list(xs), "at int, id int")
    for keys, want in ((None, [1, 2, 4]), (["id"], [1, 2, 3, 4])):
        path = f"{tmp_path}/{len(keys or [])}"
        I.incremental_load(rows((5, 1), (6, 2)), f"{path}/t", f"{path}/c", "t", "at", keys)
        I.incremental_load(rows((5, 1), (6, 2), (6, 3)), f"{path}/t", f"{path}/c", "t", "at", keys)
        I.incremental_load(rows((6, 2), (6, 3), (7, 4)), f"{path}/t", f"{path}/c", "t", "at", keys)
        assert sorted(r["id"] for r in I.loaded(spark, f"{path}/t", f"{path}/c", "t").collect()) == want
    assert I.loaded(spark, f"{path}/none", f"{path}/none", "t") is None


def test_replay_of_batches_with_deletes(spark, tmp_path):
    from ledgerloom.operators import incremental as I

    path = str(tmp_path)
    put = lambda n, at, rows: I.append_batch(spark.createDataFrame(rows, "id int, v string, gone boolean").drop("gone"), path, n, at, F.col("id").isin([r[0] for r in rows if r[2]]))
    put(1, "2024-01-01 00:00:00", [(1, "a", False), (2, "b", False), (3, "c", False)])
    put(2, "2024-01-03 00:00:00", [(1, "x", False), (2, None, True)])  # late: batch 3 came in before it
    put(3, "2024-01-02 00:00:00", [(1, "y", False), (2, "back", False)])
    put(4, "2024-01-04 00:00:00", [(3, None, True), (4, "new", False), (4, "new", False)])
    put(5, "2024-01-04 00:00:00", [(4, "tie", False)])
    read = lambda **k: {r["id"]: r["v"] for r in I.snapshot_read_at(spark, path, ["id"], **k).collect()}
    assert read(at="2024-01-01 12:00:00") == {1: "a", 2: "b", 3: "c"}
    assert read(at="2024-01-02 12:00:00") == {1: "y", 2: "back", 3: "c"}
    assert read(at="2024-01-03 12:00:00") == {1: "x", 3: "c"}  # what came in last counts
    assert read(batch=3) == {1: "y", 2: "back", 3: "c"} and read(batch=2) == {1: "x", 3: "c"}  # what was meant to come last counts
    assert read() == {1: "x", 4: "tie"} and read(at="2023-01-01 00:00:00") == {}
    assert "PartitionFilters: [_batch" in I.snapshot_read_at(spark, path, ["id"], batch=2)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    put(5, "2024-01-04 00:00:00", [(4, "again", False)])  # a repeated batch replaces itself
    assert read() == {1: "x", 4: "again"}


# ------------------------------------------------------------------ jobs and marts


def test_steps_are_counted_by_the_write(spark, tmp_path):
    from ledgerloom.operators import jobs as J

    chain = J.Steps(spark.range(100)).then("even", lambda x: x.where("id % 2 = 0")).then("none", lambda x: x.where("id < 0")).then("still none", lambda x: x.distinct())
    assert chain.write(f"{tmp_path}/out", f"{tmp_path}/log") == [("even", 100, 50), ("none", 50, 0), ("still none", 0, 0)]
    assert spark.read.parquet(f"{tmp_path}/log").count() == 3 and J.Steps(spark.range(3)).write(f"{tmp_path}/none") == []


def test_marts_follow_what_they_read(spark, tmp_path):
    from ledgerloom.operators import jobs as J

    root, state = str(tmp_path), {"n": 10, "broken": False}
    source = lambda name: spark.range(state["n"])

    def half(read):
        if state["broken"]:
            raise RuntimeError("no half today\nsecond line")
        return read("all").where("id % 2 = 0")

    marts = [J.Mart("quarter", ("half",), lambda read: read("half").where("id % 4 = 0")), J.Mart("half", ("all",), half), J.Mart("all", (), lambda read: read("numbers")), J.Mart("other", ("all",), lambda read: read("all"))]
    assert [m.name for m in J.in_order(marts)] == ["all", "half", "quarter", "other"]
    assert set(J.refresh(spark, root, marts, source).values()) == {"success"}
    state.update(n=100, broken=True)
    assert J.refresh(spark, root, marts, source) == {"all": "success", "half": "failed", "quarter": "skipped", "other": "success"}
    rows = {m.name: J.current(spark, root, m.name).count() for m in marts}
    assert rows == {"all": 100, "half": 5, "quarter": 3, "other": 100}  # what failed or waits keeps its old table, whole
    state["broken"] = False
    J.refresh(spark, root, marts, source)
    assert {m.name: J.current(spark, root, m.name).count() for m in marts} == {"all": 100, "half": 50, "quarter": 25, "other": 100}
    log = {(r["job_name"], r["status"]): r for r in spark.read.parquet(f"{root}/_log").collect()}
    assert log["half", "failed"]["error_message"] == "no half today" and log["quarter", "skipped"]["error_message"] == "waits for half" and log["other", "success"]["records_processed"] in (10, 100)
    with pytest.raises(ValueError, match="never written"):
        J.current(spark, root, "unknown")
    with pytest.raises(ValueError, match="reads itself"):
        J.in_order([J.Mart("a", ("b",), half), J.Mart("b", ("a",), half)])
    sly = [J.Mart("a", (), lambda read: read("numbers")), J.Mart("b", (), lambda read: read("a"))]
    assert J.refresh(spark, f"{root}/sly", sly, source) == {"a": "success", "b": "failed"}


# ------------------------------------------------------------------ ranks


@pytest.mark.parametrize("parts", [2, 8, 40])
def test_orders_of_several_measures(spark, parts):
    from ledgerloom.operators import windows as W

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        # a third of the first measure is one value, a third of the second null, the third has two decimals
        df = spark.range(900).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 7 ELSE id * 7919 % 101 END AS a", "CASE WHEN id % 3 = 1 THEN NULL ELSE cast(id * 31 % 57 AS int) END AS b", "cast(id * 17 % 400 / 100.0 AS decimal(9,2)) AS c", "concat('r', id) AS other")
        kinds = ("rank", "dense_rank", "row_number", "running_sum", "rows", "distinct")
        wanted = {f"{m}_{k}": (m, k) for m in "abc" for k in kinds}
        got = {r["id"]: r for r in W.global_orders(df, "id", wanted).collect()}
        assert len(got) == 900 and got[5]["other"] == "r5"
        for m in "abc":
            own, each = Window.orderBy(F.desc_nulls_last(m)), Window.orderBy(F.desc_nulls_last(m), F.desc("id"))
            last = df.select(F.dense_rank().over(own).alias("x")).agg(F.max("x")).first()[0]
            for r in df.select("id", m, F.rank().over(own).alias("rank"), F.dense_rank().over(own).alias("dense_rank"), F.row_number().over(each).alias("row_number"), F.sum(m).over(own.rangeBetween(Window.unboundedPreceding, 0)).alias("running_sum")).collect():
                g = got[r["id"]]
                assert [g[f"{m}_{k}"] for k in kinds[:3]] == [r[k] for k in kinds[:3]]
                assert g[f"{m}_running_sum"] == (r["running_sum"] if r[m] is not None else None) and (g[f"{m}_rows"], g[f"{m}_distinct"]) == (900, last)
        assert W.global_orders(df.limit(0), "id", wanted).count() == 0
        x = W.global_orders(df.withColumn("a", F.col("a").cast("double")), "other", {"r": ("a", "row_number"), "k": ("c", "rank")})
        assert sorted(r["r"] for r in x.collect()) == list(range(1, 901))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_ranks_take_one_shuffle(spark):
    from ledgerloom.plans import products, retail  # noqa: F401

    text = retail.QUERIES["product_performance_mart"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert text.count("Exchange ") <= 15


# ------------------------------------------------------------------ pairs, suites, quarantine


def test_pairs_of_large_baskets(spark, monkeypatch):
    from ledgerloom.operators import affinity as A

    monkeypatch.setattr(A, "PART", 4)
    lines = [(b, i) for b in range(6) for i in range(b * 5)] + [(0, 3), (1, 1), (1, 1), (None, 1), (2, None)]
    df = spark.createDataFrame(lines, "b int, i int")
    baskets = {}
    for b, i in lines:
        if b is not None and i is not None:
            baskets.setdefault(b, set()).add(i)
    want = {}
    for s in baskets.values():
        for x in s:
            for y in s:
                if x < y:
                    want[x, y] = want.get((x, y), 0) + 1
    for least in (1, 3, 5):
        got = {(r["item_1"], r["item_2"]): r["times_bought_together"] for r in A.affinity(df, "b", "i", least).collect()}
        assert got == {k: n for k, n in want.items() if n >= least}
    distinct = df.dropna().distinct()
    assert A.pairs(A.prune(distinct, "i", 4), "b", "i").count() < A.pairs(distinct, "b", "i").count() == sum(want.values())
    assert A.affinity(df.limit(0), "b", "i", 1).count() == 0


def test_tasks_of_pairs_grow_with_the_pairs(spark, monkeypatch):
    from pyspark.sql import functions as F

    from ledgerloom.operators import affinity as A

    monkeypatch.setattr(A, "PAIRS", 100, raising=False)
    df = spark.range(4000).select((F.col("id") / 4).cast("long").alias("b"), F.col("id").alias("i"))
    for part in (256, 2):  # baskets whole, and dealt into parts
        monkeypatch.setattr(A, "PART", part)
        made = A.pairs(df, "b", "i").groupBy(F.spark_partition_id()).count().collect()
        assert sum(r["count"] for r in made) == 6000
        assert len(made) >= 40 and max(r["count"] for r in made) <= 400


def test_suites_share_one_pass(spark):
    from ledgerloom.operators import suites as S

    a = spark.createDataFrame([(1, "x", 5), (1, None, 6), (2, 'q":null', 7), (None, "x", None)], "id int, name string, ref int")
    b = spark.createDataFrame([(5,), (7,), (7,), (None,)], "id long")
    run = {
        "a": (a, [{"check": "unique", "column": "id"}, {"check": "primary_key", "columns": ["id", "name"]}, {"check": "referential", "column": "ref", "reference": "b", "reference_column": "id"}, {"check": "not_null", "column": "name"}, {"check": "referential", "column": "id", "reference": "c", "reference_column": "n"}, {"check": "completeness", "columns": ["id", "name"]}]),
        "b": (b, [{"check": "unique", "column": "id"}, {"check": "primary_key", "column": "id"}, {"check": "not_empty"}]),
    }
    got = S.run_suites(run, "2024-01-01 00:00:00", {"c": spark.createDataFrame([(1,), (1,), (9,)], "n long")})
    values = {(r["dataset"], r["rule_name"]): r["actual_value"] for r in got.collect()}
    assert values == {("a", "unique_id"): 0.666667, ("a", "primary_key_id_name"): 0.5, ("a", "referential_integrity_ref"): 0.666667, ("a", "not_null_name"): 0.75, ("a", "referential_integrity_id"): 0.666667, ("a", "completeness_check"): 0.75, ("b", "unique_id"): 0.666667, ("b", "primary_key_id"): 0.25, ("b", "table_not_empty"): 1.0}


def test_a_suite_scans_each_table_once(spark):
    from ledgerloom.plans import suites

    text = suites.warehouse(lambda t: __import__("ledgerloom.plans.views", fromlist=["view"]).view(spark, "/root/testdata/sf0.001", t))._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert text.count("FileScan parquet") == 5 and "NestedLoop" not in text


def test_all_reasons_in_one_write(spark, tmp_path):
    from ledgerloom.operators import quality as Q

    df = spark.createDataFrame([(1, 5.0, "a"), (2, -1.0, None), (3, None, "b"), (4, 0.5, "c")], "id int, x double, s string")
    counts = Q.write_quarantined(df, {"positive": F.col("x") > 0, "named": F.col("s").isNotNull()}, f"{tmp_path}/q")
    rows = {r["id"]: (r["outcome"], r["reasons"]) for r in spark.read.parquet(f"{tmp_path}/q").collect()}
    assert counts == {"good": 2, "quarantined": 2} and rows == {1: ("good", []), 2: ("quarantined", ["positive", "named"]), 3: ("quarantined", ["positive"]), 4: ("good", [])}
    assert Q.write_quarantined(df.limit(0), {"positive": F.col("x") > 0}, f"{tmp_path}/none") == {"good": 0, "quarantined": 0}


# ------------------------------------------------------------------ streams


def read_stream(spark, df, path, **options):
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).options(**options).parquet(path)


def test_a_batch_counts_once(spark, tmp_path):
    from ledgerloom.streaming import ledger as T

    url = f"jdbc:derby:{tmp_path}/db;create=true"
    rows = spark.range(10).selectExpr("id", "id * 2 AS twice")
    table = lambda name="t": sorted(r["id"] for r in spark.read.format("jdbc").options(url=url, dbtable=name, **DERBY).load().collect())
    put = lambda n, df=rows, **k: T.append_once(df, n, url, "t", "q", **k, **DERBY)
    assert put(0) and table() == list(range(10))
    assert not put(0) and table() == list(range(10))  # a repeated id leaves the table as it was
    assert not put(1, rows.limit(0))

    def crash():
        raise RuntimeError("between rows and ledger")

    with pytest.raises(RuntimeError):
        put(2, between=crash)
    assert table() == list(range(10))  # neither rows nor entry
    assert put(2, rows.where("id < 3")) and table() == sorted([*range(10), 0, 1, 2])
    assert T.append_once(rows.limit(1), 0, url, "t", "other query", **DERBY)
    entries = spark.read.format("jdbc").options(url=url, dbtable=T.LEDGER, **DERBY).load()
    assert sorted((r["QUERY_NAME"], r["BATCH_ID"], r["ROWS_ADDED"]) for r in entries.collect()) == [("other query", 0, 1), ("q", 0, 10), ("q", 2, 3)]
    s = read_stream(spark, spark.range(20).repartition(4), f"{tmp_path}/in", maxFilesPerTrigger=1)
    for _ in range(2):  # a second start finds all batches done
        T.to_jdbc(s, url, "streamed", "s", f"{tmp_path}/ck", trigger=ONCE, **DERBY).awaitTermination(120)
    assert table("streamed") == list(range(20))


def test_a_failing_query_stops_the_others(spark, tmp_path):
    from ledgerloom.streaming import events as S
    from ledgerloom.streaming import ledger as T

    s = read_stream(spark, spark.range(40).repartition(4), f"{tmp_path}/in", maxFilesPerTrigger=1)
    seen = []

    def second(batch, number):
        seen.append(number)
        if len(seen) == 2:
            raise RuntimeError("second batch refused")

    quick = {"processingTime": "100 milliseconds"}
    starts = {"steady": lambda: S.to_parquet(s, f"{tmp_path}/a", f"{tmp_path}/ck-a", (), quick), "weak": lambda: S.to_batches(s, second, f"{tmp_path}/ck-b", trigger=quick)}
    with pytest.raises(T.QueryFailed, match="query weak failed") as e:
        T.supervise(spark, starts)
    assert e.value.query == "weak" and e.value.others == ["steady"] and len(seen) == 2 and not spark.streams.active
    ok = {"one": lambda: S.to_parquet(s, f"{tmp_path}/c", f"{tmp_path}/ck-c", (), ONCE), "two": lambda: S.to_parquet(s, f"{tmp_path}/d", f"{tmp_path}/ck-d", (), ONCE)}
    assert T.supervise(spark, ok) == {"one": 40, "two": 40}

    def broken():
        raise RuntimeError("no start")

    with pytest.raises(T.QueryFailed, match="no start") as e:
        T.supervise(spark, {"steady": lambda: S.to_parquet(s, f"{tmp_path}/e", f"{tmp_path}/ck-e", (), quick), "never": broken})
    assert e.value.others == ["steady"] and not spark.streams.active


def events(spark, times):
    rows = [(k, "purchase", t, k, f"s{k}", "DE", "mobile", f"/{k % 5}", None) for k, t in enumerate(times)]
    return spark.createDataFrame(rows, "event_id long, kind string, ts timestamp, user_id long, session_id string, country string, device_type string, page_url string, value decimal(18,2)")


def test_anomalies_on_a_stream(spark, tmp_path):
    from ledgerloom.streaming import events as S

    at = lambda h, m, s=0: d.datetime(2024, 1, 1, h, m, s)
    busy = [at(10, 1)] + [at(10, 3, s) for s in range(9)] + [at(10, 7)] + [at(10, 12, s) for s in range(2)]
    late = [at(10, 2)]  # within the watermark: its minute is still open
    ends = [at(11, 0)]  # closes the windows of ten o'clock
    too_late = [at(10, 3, 30)] * 30
    batches = [busy, late, ends, [at(11, 1)], too_late, [at(12, 0)], [at(12, 30)]]
    for k, b in enumerate(batches):
        events(spark, b).coalesce(1).write.parquet(f"{tmp_path}/in/k={k}")
    s = spark.readStream.schema(events(spark, busy).schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    S.to_parquet(S.rolling_anomaly(s, 1.5), f"{tmp_path}/out", f"{tmp_path}/ck", (), ONCE).awaitTermination(180)
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()))
    want = sorted(map(tuple, S.rolling_anomaly(events(spark, busy + late + ends + [at(11, 1)]), 1.5).collect()))
    assert got == want and got == [(at(10, 3), 9, 3.0)]


def test_sketches_in_state(spark, tmp_path):
    from ledgerloom.plans.views import view
    from ledgerloom.streaming import events as S

    many = spark.range(40_000).selectExpr("id AS event_id", "'page_view' AS kind", "timestamp_seconds(1704067200 + id % 240) AS ts", "id % 9000 AS user_id", "concat('s', id % 7) AS session_id", "'DE' AS country", "'mobile' AS device_type", "concat('/', id % 3000) AS page_url", "cast(null AS decimal(18,2)) AS value")
    s = read_stream(spark, many.repartition(4), f"{tmp_path}/in")
    for name, f, column in (("kpis", S.realtime_kpis, "unique_users"), ("sessions", S.session_metrics, "pages_viewed")):
        S.to_console(f(s, error=0.02), f"rough_{name}", f"{tmp_path}/{name}", "memory", ONCE).awaitTermination(180)
        keys = ["window_start", *(["session_id"] if name == "sessions" else [])]
        exact = {tuple(r[k] for k in keys): r for r in f(many).collect()}
        rough = {tuple(r[k] for k in keys): r for r in spark.table(f"rough_{name}").collect()}
        assert rough.keys() == exact.keys() and all(abs(r[column] - exact[k][column]) <= 0.1 * exact[k][column] and r["window_end"] == exact[k]["window_end"] for k, r in rough.items())
    orders = view(spark, "/root/testdata/sf0.001", "v_orders").select("order_id", "customer_id", "total_amount", "status", "payment_method", F.lit(2).cast("long").alias("items_count"), F.col("order_date").cast("timestamp").alias("ts"))
    so = read_stream(spark, orders, f"{tmp_path}/orders")
    for error in (None, 0.02):
        name = f"orders_{error is None}"
        S.to_console(S.order_metrics(so, error=error), name, f"{tmp_path}/{name}", "memory", ONCE).awaitTermination(180)
        got, want = ({r["window_start"]: r for r in x.collect()} for x in (spark.table(name), S.order_metrics(orders)))
        assert got.keys() == want.keys() and all(got[k] == want[k] if error is None else abs(got[k]["unique_customers"] - want[k]["unique_customers"]) <= 1 for k in got)


# ------------------------------------------------------------------ pages, outliers


def test_pages_end_at_an_empty_one(spark, tmp_path):
    from ledgerloom.sources import files

    pages = [(0, [(1,), (2,)]), (1, [(3,), (4,)]), (2, []), (3, [(5,), (6,)])]
    spark.createDataFrame(pages, "page long, items array<struct<id: long>>").withColumn("file", F.col("page")).write.partitionBy("file").json(f"{tmp_path}/p")
    read = lambda size: sorted(r["id"] for r in files.scan_paged_json(spark, f"{tmp_path}/p", "id: long", "items", size).collect())
    assert read(2) == [1, 2, 3, 4] and read(3) == [1, 2]


def test_outliers_at_three_deviations(spark):
    from ledgerloom.operators import quality as Q

    df = spark.createDataFrame([(v,) for v in [10, 12, 11, 13, 10, 12] * 3 + [1000]] + [(None,)], "value int")
    assert [r["value"] for r in Q.outliers_zscore(df, "value").collect()] == [1000]
    assert Q.outliers_zscore(df.where("value = 10"), "value").count() == 0 and Q.outliers_zscore(df.limit(0), "value").count() == 0


def test_enriched_tables_are_stored_until_their_tables_change(spark, tmp_path):
    import shutil

    from ledgerloom.plans import views as V

    for t in ("orders", "lineitem", "part"):
        shutil.copy(f"/root/testdata/sf0.001/{t}.parquet", tmp_path)
    first = V.view(spark, str(tmp_path), "e_items").inputFiles()
    assert V.view(spark, str(tmp_path), "e_items").inputFiles() == first
    rows = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").limit(100)
    rows.coalesce(1).write.parquet(f"{tmp_path}/new")
    shutil.copy(next(iter((tmp_path / "new").glob("*.parquet"))), tmp_path / "lineitem.parquet")
    (tmp_path / ".lineitem.parquet.crc").unlink(missing_ok=True)
    assert V.view(spark, str(tmp_path), "e_items").count() == 100 and V.view(spark, str(tmp_path), "e_items").inputFiles() != first


# ------------------------------------------------------------------ marts


def shuffled(df):
    """Names of the columns that an exchange moves, for each in the plan."""
    import re

    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"Exchange (?:hashpartitioning\((.*?), \d+\))", plan)


def test_lines_meet_by_product_and_order_before_they_are_summed(spark):
    from ledgerloom.plans import products, retail
    from ledgerloom.plans import views as V

    sf = "/root/testdata/sf0.001"
    v = lambda name, stored=None: V.view(spark, sf, name, stored)
    # what is stored holds no column that follows from others
    assert set(spark.read.parquet(*v("e_items").inputFiles()).columns) == {*V.VIEWS["v_items"][1], "cost"}
    assert not {"shipping_method", "delivered_on", "order_size_tier", "is_weekend"} & set(spark.read.parquet(*v("e_orders").inputFiles()).columns)
    assert v("e_items").columns == V.enriched_items(v).columns and v("e_orders").columns == V.enriched_orders(v).columns
    # one shuffle of lines by product alone, none by product and what is counted once
    keys = shuffled(products.product_mart(v)) + shuffled(products.performance(v("e_items"))) + shuffled(retail.QUERIES["mv_product_performance"](spark, sf))
    assert keys and not [k for k in keys if "product_id" in k and "," in k]


def test_orders_of_several_customers_count_once(spark, tmp_path):
    import shutil

    from ledgerloom.plans import retail

    for t in ("lineitem", "part", "customer"):
        shutil.copyfile(f"/root/testdata/sf0.001/{t}.parquet", tmp_path / f"{t}.parquet")
    o = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    o.unionByName(o.where("o_orderkey % 3 = 0").withColumn("o_custkey", F.col("o_custkey") + F.lit(1).cast("long"))).unionByName(o.where("o_orderkey % 5 = 0")).coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    v = lambda name: __import__("ledgerloom.plans.views", fromlist=["view"]).view(spark, str(tmp_path), name)
    x = v("e_items").join(v("v_orders").select("order_id", "customer_id"), "order_id")
    want = {tuple(r) for r in x.groupBy("product_id").agg(F.countDistinct("order_id"), F.countDistinct("customer_id"), F.count(F.lit(1))).collect()}
    got = retail.QUERIES["product_performance_summary"](spark, str(tmp_path)).select("product_id", "unique_orders", "unique_customers", "times_ordered")
    assert {tuple(r) for r in got.collect()} == want


def test_paged_json_lands_many_pages_a_file(spark, tmp_path):
    from ledgerloom.plans import loads, retail
    from ledgerloom.sources import files

    df = retail.QUERIES["scan_paged_json"](spark, "/root/testdata/sf0.001")
    assert len(df.inputFiles()) <= 2 * int(spark.conf.get("spark.sql.shuffle.partitions")) + 2
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.json").write_text('{"page":0,"items":[{"id":1},{"id":2}]}\n{"page":1,"items":[{"id":3}]}\n')
    (tmp_path / "p" / "b.json").write_text('{"page":2,"items":[{"id":4},{"id":5}]}\n')
    assert sorted(r["id"] for r in files.scan_paged_json(spark, f"{tmp_path}/p", "id: long", "items", 2, lines=True).collect()) == [1, 2, 3]
    assert loads is not None


def test_warehouse_suite_checks_lines(spark):
    from ledgerloom.plans import retail

    out = retail.QUERIES["dq_suite_warehouse"](spark, "/root/testdata/sf0.001").groupBy("dataset").count().collect()
    assert {r["dataset"]: r["count"] for r in out} == {"d_customers": 5, "d_products": 6, "d_orders": 10, "g_daily": 4, "g_calendar": 2, "d_items": 6}


def test_quantiles_of_counts_equal_percentile(spark):
    from ledgerloom.operators import suites

    for values in ([], [3.0], [1.0, 2.0], [5.0] * 40 + [1.0, 9.0], [float(i * i % 97) / 7 for i in range(500)], [float("inf"), -1.0, float("-inf"), 4.0, 4.5]):
        df = spark.createDataFrame([(x,) for x in values], "x double")
        want = df.agg(F.percentile("x", [0.25, 0.5, 0.75])).first()[0]
        got = suites.counted_quantiles(df.groupBy("x").agg(F.count(F.lit(1)).alias("k")), [0.25, 0.5, 0.75])
        assert got == want


def test_category_mart_counts_ids_apart_from_sums(spark):
    from ledgerloom.plans import products as P

    # product 3 has no category, 2 no brand, 4 no price; order 2 has two rows of different customers, order 4 no customer
    frames = {
        "e_items": spark.sql("SELECT order_id, product_id, 1 AS quantity, CAST(product_id + 1 AS DECIMAL(18,2)) AS total_price, 1.00BD AS profit_amount, 5 AS discount_percent, CAST(NULL AS DECIMAL(18,2)) AS discount_amount FROM VALUES (1L, 1L), (1L, 1L), (1L, 2L), (2L, 1L), (2L, 3L), (3L, 3L), (3L, 4L), (4L, 4L) AS t(order_id, product_id)"),
        "v_orders": spark.sql("SELECT * FROM VALUES (1L, 7L, DATE '2001-02-03'), (2L, 7L, DATE '2001-02-09'), (2L, 8L, DATE '2001-02-10'), (3L, 8L, DATE '2001-03-01'), (4L, NULL, DATE '2001-03-02') AS t(order_id, customer_id, order_date)"),
        "v_products": spark.sql("SELECT * FROM VALUES (1L, 'a', 'x', 2.00BD), (2L, 'a', NULL, 3.00BD), (3L, NULL, 'y', 4.00BD), (4L, 'a', 'x', NULL) AS t(product_id, category, brand, price)"),
    }
    out = P.category_mart(lambda name: frames[name])
    got = {(r["category"], r["month"]): r for r in out.collect()}
    counts = lambda r: [r[c] for c in ("product_count", "brand_count", "total_orders", "unique_customers", "total_units_sold")]
    assert {k: counts(r) for k, r in got.items()} == {("a", 2): [2, 1, 2, 2, 5], (None, 2): [1, 1, 1, 2, 2], ("a", 3): [1, 1, 2, 1, 2], (None, 3): [1, 1, 1, 1, 1]}
    assert (got["a", 2]["avg_price"], got["a", 2]["avg_order_value"], got["a", 3]["avg_price"], got["a", 2]["total_discounts"]) == (2.2, 2.2, None, None)
    assert float(got["a", 3]["revenue_growth_pct"]) == (10 - 11) / 11 * 100
    # no row of sums for each kind of id
    assert "Expand" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_profile_asks_about_every_column(spark):
    from ledgerloom.plans import retail, suites  # noqa: F401  it registers the query
    from ledgerloom.plans import views as V

    got = {r["rule_name"] for r in retail.QUERIES["dq_profile_auto"](spark, "/root/testdata/sf0.001").collect()}
    numbers = ("order_id", "customer_id", "total_amount", "shipping_amount", "tax_amount")
    assert got == {*(f"not_null_{c}" for c in V.VIEWS["d_orders"][1]), *(f"outliers_{c}" for c in numbers), "no_future_dates_order_date"}


def test_marts_leave_no_shuffle_files(spark, tmp_path):
    import time

    from ledgerloom.operators import jobs as J
    from ledgerloom.sources.scratch import materialize

    def held():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}

    before = held()
    mart = J.Mart("a", (), lambda read: materialize(read("x").groupBy("k").count()).groupBy("count").agg(F.max("k")))
    assert J.refresh(spark, str(tmp_path), [mart], lambda name: spark.range(1000).selectExpr("id % 7 AS k")) == {"a": "success"}
    until = time.time() + 10
    while held() - before and time.time() < until:  # they go in the background
        time.sleep(0.1)
    assert not held() - before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_favourites_move_once(spark):
    from ledgerloom.plans import products as P

    rows = [(1, "x", "p"), (1, "y", "p"), (1, "y", "q"), (2, "b", None), (2, "a", "r"), (3, None, None)]
    out = P.favourites(spark.createDataFrame(rows, "id int, a string, b string"), "id", {"a": "fa", "b": "fb"})
    assert len(shuffled(out)) == 1
    got = {r["id"]: (r["fa"], r["fb"]) for r in out.collect()}
    assert got[1] == ("y", "p") and got[2][0] == "a" and got[3] == (None, None)


def test_customers_and_orders_of_a_category_count_once(spark):
    from ledgerloom.plans import products as P

    frames = {
        "e_items": spark.sql("SELECT * FROM VALUES (1L, 1L), (1L, 2L), (1L, 3L), (2L, 1L), (3L, 3L), (9L, 1L), (3L, 9L) AS t(order_id, product_id)"),
        "v_products": spark.sql("SELECT * FROM VALUES (1L, 'a'), (2L, 'a'), (3L, NULL) AS t(product_id, category)"),
    }
    # order 2 has rows of two customers and one without; order 9 and product 9 are unknown
    o = spark.sql("SELECT * FROM VALUES (1L, 7L, 2L), (2L, 7L, 2L), (2L, 8L, 2L), (2L, NULL, 2L), (3L, 8L, 3L) AS t(order_id, customer_id, month)")
    out = P.order_counts(lambda name: frames[name], o, ["category", "month"])
    assert {tuple(r) for r in out.collect()} == {("a", 2, 2, 2), (None, 2, 1, 1), (None, 3, 1, 1)}
