"""Suites of quality checks: a list of dictionaries in, a row per check out.

A check names its kind under ``check``, mostly a ``column``, and may set ``threshold``
(least share of rows that hold), ``severity`` and what its kind needs. All checks of a run
share one pass over each table and one shuffle, but for those of outliers.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.sources.scratch import materialize

# Patterns of e-mail addresses and phone numbers, weights of severities, cuts of the gate.
EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
PHONE = r"^[\+]?[(]?[0-9]{3}[)]?[-\s\.]?[0-9]{3}[-\s\.]?[0-9]{4,6}$"
WEIGHTS = {"low": 0.25, "medium": 0.5, "high": 0.75, "critical": 1.0}
LOAD_AT, QUARANTINE_AT = 0.9, 0.7

TYPES = {
    "not_null": "completeness", "completeness": "completeness", "unique": "uniqueness", "primary_key": "uniqueness", "values_in_set": "validity", "range": "validity", "regex": "validity", "email_format": "validity", "phone_format": "validity",
    "freshness": "timeliness", "no_future_dates": "timeliness", "referential": "integrity", "cross_field": "consistency", "outliers": "accuracy", "custom": "custom", "not_empty": "completeness",
}


def rule_name(spec: dict) -> str:
    what = spec.get("name") or spec.get("column") or "_".join(spec.get("columns", []))
    kind = {"primary_key": "primary_key", "completeness": "completeness_check", "referential": "referential_integrity", "not_empty": "table_not_empty"}.get(spec["check"], spec["check"])
    return kind if kind in ("completeness_check", "table_not_empty") else f"{kind}_{what}"


def share(holds: Column, of: Column | None = None) -> Column:
    """Share of the rows in question that hold; 1 where there are none."""
    asked = F.count(F.lit(1)) if of is None else F.count_if(of)
    hit = F.count_if(F.coalesce(holds if of is None else holds & of, F.lit(False)))
    return F.coalesce(F.try_divide(hit.cast("double"), asked.cast("double")), F.lit(1.0))


def _row_tests(spec: dict, as_of: str, df: DataFrame) -> list[tuple[Column, Column]] | None:
    """What a check that looks at one row at a time asks: pairs of (holds, of which rows)."""
    kind, c, every = spec["check"], F.col(spec["column"]) if "column" in spec else None, F.lit(True)
    filled = c.isNotNull() if c is not None else None
    if kind == "not_null":
        return [(filled, every)]
    if kind == "completeness":
        return [(F.col(x).isNotNull(), every) for x in spec.get("columns") or df.columns]
    if kind == "values_in_set":
        return [(c.isin(*spec["valid_values"]), filled)]
    if kind == "range":
        inside = F.lit(True)
        if spec.get("min_value") is not None:
            inside &= c >= spec["min_value"]
        if spec.get("max_value") is not None:
            inside &= c <= spec["max_value"]
        return [(inside, filled)]
    if kind in ("regex", "email_format", "phone_format"):
        pattern = {"email_format": EMAIL, "phone_format": PHONE}.get(kind) or spec["pattern"]
        return [(c.cast("string").rlike(f"^(?:{pattern})"), filled)]
    if kind == "no_future_dates":
        return [(c <= F.lit(as_of).cast("timestamp"), filled)]
    if kind == "cross_field":
        return [(F.expr(spec["condition"]), every)]
    if kind == "custom":
        return [(spec["holds"](df), every)]
    if kind == "not_empty":
        return [(every, every)]
    return None


def _keys(spec: dict) -> list[str]:
    return spec.get("columns") or [spec["column"]]


def _key_text(columns: list[str]) -> Column:
    """Key columns as one text, different for different keys; numbers of any width agree. A single null is the empty text."""
    if len(columns) == 1:
        return F.coalesce(F.concat(F.lit("="), F.col(columns[0]).cast("string")), F.lit(""))
    return F.to_json(F.struct(*[F.col(c).cast("string").alias(f"k{i}") for i, c in enumerate(columns)]), {"ignoreNullFields": "false"})


def counted_quantiles(k: DataFrame, at: list[float]) -> list[float] | None:
    """Exact quantiles, interpolated as ``percentile`` does, of values ``x`` that occur ``k`` times; None without any.

    Ranges of values are counted first, a row each; only the ranges that hold a rank asked
    for are put in order, each by a task of its own. ``k`` is read twice.
    """
    ranges = max(int(k.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2)
    parts = k.repartitionByRange(ranges, "x").groupBy(F.spark_partition_id().alias("p")).agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.sum("k").alias("n")).orderBy("lo").collect()
    total = sum(p["n"] for p in parts)
    if not total:
        return None
    places = [q * (total - 1) for q in at]
    ranks = sorted({f(x) for x in places for f in (math.floor, math.ceil)})
    before, wanted = 0, []
    for p in parts:
        if inside := [r - before for r in ranks if before <= r < before + p["n"]]:
            wanted.append((before, p["lo"], p["hi"], inside))
        before += p["n"]
    part = F.coalesce(*[F.when((F.col("x") >= lo) & (F.col("x") <= hi), F.lit(i)) for i, (_, lo, hi, _) in enumerate(wanted)])
    through = F.sum("k").over(Window.partitionBy("part").orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = k.withColumn("part", part).where("part is not null").withColumn("through", through)
    hit = F.lit(False)
    for i, (_, _, _, inside) in enumerate(wanted):
        for r in inside:
            hit |= (F.col("part") == i) & (F.col("through") > r) & (F.col("through") - F.col("k") <= r)
    found = [(wanted[x["part"]][0] + x["through"] - x["k"], wanted[x["part"]][0] + x["through"], x["x"]) for x in rows.where(hit).collect()]  # a row a rank at most
    value = {r: next(x for lo, hi, x in found if lo <= r < hi) for r in ranks}
    out = []
    for x in places:
        a, b = value[math.floor(x)], value[math.ceil(x)]
        out.append(a if a == b else (math.ceil(x) - x) * a + (x - math.floor(x)) * b)
    return out


def _outliers(spec: dict, df: DataFrame) -> DataFrame:
    """One row (``v``): the share within the fences. Counts of different values come first: quartiles and the share both come from them."""
    k = materialize(df.select(F.col(spec["column"]).cast("double").alias("x")).where("x is not null").groupBy("x").agg(F.count(F.lit(1)).alias("k")))
    if spec.get("method", "iqr") == "iqr":
        low, high = counted_quantiles(k, [0.25, 0.75]) or (None, None)
        lo, hi = (F.lit(None).cast("double"),) * 2 if low is None else (F.lit(low - 1.5 * (high - low)), F.lit(high + 1.5 * (high - low)))
        fenced = k.withColumns({"lo": lo, "hi": hi})
    else:
        b = df.select(F.col(spec["column"]).cast("double").alias("x")).agg((F.avg("x") - 3 * F.stddev_samp("x")).alias("lo"), (F.avg("x") + 3 * F.stddev_samp("x")).alias("hi"))
        fenced = k.crossJoin(F.broadcast(b))
    inside = F.coalesce((F.col("x") >= F.col("lo")) & (F.col("x") <= F.col("hi")), F.lit(True))
    return fenced.agg(F.coalesce(F.try_divide(F.sum(F.when(inside, F.col("k")).otherwise(0)).cast("double"), F.sum("k").cast("double")), F.lit(1.0)).alias("v"))  # one row


_KEYED = ("unique", "primary_key", "referential")


def run_suites(tables: dict[str, tuple[DataFrame, list[dict]]], as_of: str, references: dict[str, DataFrame] | None = None) -> DataFrame:
    """``dataset, rule_name, check_type, severity, expected_threshold, actual_value, passed, error``: a row for each check of each dataset.

    All checks of all datasets share one pass over each table and one shuffle. A row goes
    out once with the answers of all checks that look at rows, which add up before the
    shuffle, and once with each key that is checked; keys of a referenced table, which may be
    one of the datasets, go to the same place and mark theirs as known. Only checks of
    outliers need a pass of their own.

    A column that the table lacks fails its check, with an error; a table without rows
    holds everywhere but where freshness or rows are asked for.
    """
    if not tables or not all(specs for _, specs in tables.values()):
        raise ValueError("no checks")
    references = dict(references or {})
    own, asked, missing, tests, ages, wanted = [], 0, set(), {}, {}, {}  # wanted: referenced table -> [(lane, column)]
    lanes: dict[str, list[tuple[int, dict]]] = {d: [] for d in tables}
    slots: dict[str, list[tuple[Column, Column]]] = {d: [] for d in tables}
    times: dict[str, list[str]] = {d: [] for d in tables}
    lane_of: dict[tuple[str, int], int] = {}
    for d, (df, specs) in tables.items():
        for i, s in enumerate(specs):
            if any(c not in df.columns for c in [*([s["column"]] if "column" in s else []), *s.get("columns", [])]):
                missing.add((d, i))
            elif s["check"] == "freshness":
                ages[d, i] = len(times[d])
                times[d].append(s["column"])
            elif s["check"] in _KEYED:
                lane_of[d, i] = asked
                lanes[d].append((asked, s))
                if s["check"] == "referential":
                    wanted.setdefault(s["reference"], []).append((asked, s["reference_column"]))
                asked += 1
            elif s["check"] == "outliers":
                own.append((d, i, _outliers(s, df)))
            else:
                found = _row_tests(s, as_of, df)
                if found is None:
                    raise ValueError(f"unknown check {s['check']!r}")
                tests[d, i] = (len(slots[d]), len(found))
                slots[d] += found

    number = {d: k for k, d in enumerate(tables)}
    lane_type = "array<struct<lane: int, key: string, own: int, known: int>>"

    def spread(df: DataFrame, d: str | None, of: list[tuple[int, str]]) -> DataFrame:
        each = [F.struct(F.lit(k).alias("lane"), F.when(F.col(c).isNotNull(), _key_text([c])).alias("key"), F.lit(0).alias("own"), F.lit(1).alias("known")) for k, c in of]
        if d is not None:
            each.append(F.struct(F.lit(-1 - number[d]).alias("lane"), F.lit(None).cast("string").alias("key"), F.lit(0).alias("own"), F.lit(0).alias("known")))
            for k, s in lanes[d]:
                whole = F.lit(True)
                for c in _keys(s):
                    whole &= F.col(c).isNotNull()
                # a primary key with a null counts, marked, as broken; other checks don't ask about nulls
                key = _key_text(_keys(s)) if s["check"] == "primary_key" else F.when(whole, _key_text([s["column"]]))
                each.append(F.struct(F.lit(k).alias("lane"), key.alias("key"), F.lit(1).alias("own"), (~whole).cast("int").alias("known")))
        answers = [F.coalesce(x, F.lit(False)) for h, o in (slots[d] if d else []) for x in (h & o, o)]
        seen = [F.col(c).cast("timestamp") for c in (times[d] if d else [])]
        row = df.select(F.array(*[a.cast("int") for a in answers]).cast("array<int>").alias("h"), F.array(*seen).cast("array<timestamp>").alias("t"), F.array(*each).cast(lane_type).alias("lanes"))
        # answers travel with the row's own lane alone
        return row.select("h", "t", F.inline("lanes")).select("lane", "key", "own", "known", F.when(F.col("lane") < 0, F.col("h")).alias("h"), F.when(F.col("lane") < 0, F.col("t")).alias("t"))

    parts = [spread(df, d, wanted.pop(d, [])) for d, (df, _) in tables.items()]
    parts += [spread(references[r], None, of) for r, of in wanted.items()]
    everything = parts[0]
    for p in parts[1:]:
        everything = everything.unionByName(p)
    most, latest = max(2 * len(x) for x in slots.values()), max(len(x) for x in times.values())
    # keys count before they move; a row without a key asks nothing of a check of unique or referenced values
    met = everything.where((F.col("lane") < 0) | F.col("key").isNotNull()).groupBy("lane", "key").agg(F.sum("own").alias("k"), F.max("known").alias("known"), *[F.sum(F.get("h", F.lit(j))).alias(f"h{j}") for j in range(most)], *[F.max(F.get("t", F.lit(j))).alias(f"t{j}") for j in range(latest)])

    def ratio(hit: Column, of: Column) -> Column:
        return F.coalesce(F.try_divide(F.coalesce(hit, F.lit(0)).cast("double"), F.coalesce(of, F.lit(0)).cast("double")), F.lit(1.0))

    values = []
    for d, (_, specs) in tables.items():
        mine = F.col("lane") == -1 - number[d]
        slot = lambda j, mine=mine: F.max(F.when(mine, F.col(f"h{j}")))  # noqa: E731  one group a dataset
        for i, s in enumerate(specs):
            name = f"v{number[d]}_{i}"
            if (d, i) in ages:
                last = F.max(F.when(mine, F.col(f"t{ages[d, i]}")))
                values.append((F.timestamp_diff("SECOND", last, F.lit(as_of).cast("timestamp")).cast("double") / 3600).alias(name))
            elif (d, i) in tests:
                at, many = tests[d, i]
                each = [ratio(slot(2 * j), slot(2 * j + 1)) for j in range(at, at + many)]
                v = sum(each[1:], each[0]) / many
                values.append((F.coalesce((slot(2 * at + 1) > 0).cast("double"), F.lit(0.0)) if s["check"] == "not_empty" else v).alias(name))
            elif (d, i) in lane_of:
                here = (F.col("lane") == lane_of[d, i]) & (F.col("k") > 0)
                total = F.sum(F.when(here, F.col("k")))
                if s["check"] == "unique":
                    hit = F.count_if(here)
                elif s["check"] == "primary_key":
                    hit = F.sum(F.when(here & (F.col("k") == 1) & (F.col("known") == 0), F.col("k")))
                else:
                    hit = F.sum(F.when(here & (F.col("known") > 0), F.col("k")))
                values.append(ratio(hit, total).alias(name))
    row = met.agg(*values or [F.count(F.lit(1)).alias("_n")])
    for d, i, one in own:
        row = row.crossJoin(one.withColumnRenamed("v", f"v{number[d]}_{i}"))  # one row each
    out = []
    for d, (_, specs) in tables.items():
        for i, s in enumerate(specs):
            lost = (d, i) in missing
            threshold = float(s.get("threshold", s.get("max_age_hours", 1.0)))
            v = F.lit(0.0) if lost else F.col(f"v{number[d]}_{i}")
            ok = F.lit(False) if lost else F.coalesce(v <= threshold if s["check"] == "freshness" else v >= threshold, F.lit(False))
            out.append(F.struct(F.lit(d).alias("dataset"), F.lit(rule_name(s)).alias("rule_name"), F.lit(TYPES[s["check"]]).alias("check_type"), F.lit(s.get("severity", "medium")).alias("severity"), F.lit(threshold).alias("expected_threshold"), F.round(v, 6).alias("actual_value"), ok.alias("passed"), F.lit("column not found" if lost else None).cast("string").alias("error")))
    return row.select(F.inline(F.array(*out)))


def run_checks(df: DataFrame, specs: list[dict], dataset: str, as_of: str, references: dict[str, DataFrame] | None = None) -> DataFrame:
    """The suite of one dataset; see ``run_suites``."""
    return run_suites({dataset: (df, specs)}, as_of, references)


def profile(df: DataFrame) -> list[dict]:
    """Checks by type: no nulls anywhere, no outliers in numbers, no later dates."""
    specs: list[dict] = []
    for f in df.schema:
        kind = f.dataType.typeName()
        specs.append({"check": "not_null", "column": f.name, "threshold": 0.95, "severity": "medium"})
        if kind in ("integer", "long", "short", "double", "float") or kind.startswith("decimal"):
            specs.append({"check": "outliers", "column": f.name, "threshold": 0.95, "severity": "low"})
        if kind in ("date", "timestamp", "timestamp_ntz"):
            specs.append({"check": "no_future_dates", "column": f.name, "severity": "medium"})
    return specs


def score(results: DataFrame) -> DataFrame:
    """Score of each dataset, weighted by severity, its checks and its critical failures."""
    w = F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv])[F.col("severity")]
    hit = F.col("passed")
    return results.groupBy("dataset").agg(
        F.round(F.sum(F.when(hit, w).otherwise(0.0)) / F.sum(w), 6).alias("overall_score"), F.count(F.lit(1)).alias("checks"), F.count_if(hit).alias("passed_checks"), F.count_if(~hit).alias("failed_checks"), F.count_if(~hit & (F.col("severity") == "critical")).alias("critical_failures")
    )


def overall(results: DataFrame) -> DataFrame:
    """One row over all datasets: checks, rates, mean score, critical failures, and healthy or degraded."""
    s = score(results)
    o = s.agg(F.count(F.lit(1)).alias("datasets"), F.sum("checks").alias("total_checks"), F.sum("passed_checks").alias("passed"), F.sum("failed_checks").alias("failed"), F.round(F.avg("overall_score"), 6).alias("average_score"), F.sum("critical_failures").alias("critical_failures"))
    return o.select("*", F.round(F.col("passed") / F.col("total_checks"), 6).alias("pass_rate"), (F.col("critical_failures") > 0).alias("has_critical_failures"), F.when(F.col("failed") == 0, "healthy").otherwise("degraded").alias("overall_status"))


def gate(average_score: float) -> str:
    """Where a batch of that score goes."""
    return "load" if average_score >= LOAD_AT else "quarantine" if average_score >= QUARANTINE_AT else "fail"


def validate_schema(df: DataFrame, expected: dict[str, str]) -> list[str]:
    """What is missing or of another type."""
    have = {f.name: f.dataType.simpleString() for f in df.schema}
    return [f"missing column {c}" if c not in have else f"column {c} is {have[c]}, not {t}" for c, t in expected.items() if have.get(c) != t]


def log_results(results: DataFrame, path: str, at: str) -> None:
    """Append a run's results."""
    results.withColumn("checked_at", F.lit(at).cast("timestamp_ntz")).write.mode("append").parquet(path)


def history(log: DataFrame, last: int) -> DataFrame:
    """The latest results."""
    return log.orderBy(F.desc("checked_at"), "dataset", "rule_name").limit(last)


Holds = Callable[[DataFrame], Column]
