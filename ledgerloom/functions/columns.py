"""Column functions: tiers, bins, keys, null-safe arithmetic, dates, URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tier(x: Column, edges: list[float], labels: list[str]) -> Column:
    """Left-closed tiers: the first label whose edge exceeds x, else the last; null: last."""
    out: Column | None = None
    for edge, label in zip(edges, labels, strict=False):
        out = F.when(x < edge, label) if out is None else out.when(x < edge, label)
    return F.lit(labels[-1]) if out is None else out.otherwise(labels[len(edges)])


def bucketize_right_closed(x: Column, edges: list[float | None], labels: list[str]) -> Column:
    """Bins (lo, hi]; None is an open end; at or below the lowest edge and for null: null."""
    out = None
    for lo, hi, label in zip(edges, edges[1:], labels, strict=False):
        inside = F.lit(True)
        if lo is not None:
            inside &= x > lo
        if hi is not None:
            inside &= x <= hi
        inside &= x.isNotNull()
        out = F.when(inside, label) if out is None else out.when(inside, label)
    return out


def md5_surrogate_int(key: Column) -> Column:
    """The first eight hex digits of the MD5 as an integer."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long")


#: Fixed value: what stands for null in a key.
NULL_KEY = "_dbt_utils_surrogate_key_null_"


def surrogate_key(*columns: Column, null: str = NULL_KEY) -> Column:
    """MD5 of the columns as text, joined by hyphens."""
    return F.md5(F.concat_ws("-", *[F.coalesce(c.cast("string"), F.lit(null)) for c in columns]))


def safe_divide(a: Column, b: Column) -> Column:
    """Null where the divisor is zero or null."""
    return F.try_divide(a, b)


def safe_add(*xs: Column) -> Column:
    """A sum in which nulls count as 0."""
    return sum((F.coalesce(x, F.lit(0)) for x in xs), F.lit(0))


def safe_subtract(x: Column, *others: Column) -> Column:
    """A difference in which nulls count as 0."""
    out = F.coalesce(x, F.lit(0))
    for o in others:
        out = out - F.coalesce(o, F.lit(0))
    return out


def width_bucket(x: Column, low: float, high: float, n: int) -> Column:
    """Equal bins from ``low`` to ``high`` by a rule of their own: the share of the range, rounded up, n + 1 at most, and one more where ``x`` is a multiple of the bin's width."""
    width = (high - low) / n
    return (x % F.lit(width) == 0).cast("int") + F.least(F.ceil((x - low) / width), F.lit(n + 1)).cast("int")


def date_key(d: Column) -> Column:
    return F.coalesce(F.date_format(d, "yyyyMMdd").cast("int"), F.lit(19000101))


#: Fixed value: kilometres in a mile.
KM = 1.60934


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, unit: str = "mi") -> Column:
    """Great-circle distance; 3961 miles is the radius."""
    half = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 3961 * F.asin(F.sqrt(half)) * (KM if unit == "km" else 1)


def _without(u: Column, *schemes: str) -> Column:
    for x in schemes:
        u = F.replace(u, F.lit(x), F.lit(""))
    return u


def url_host(u: Column) -> Column:
    """What stands between the scheme and the first slash or question mark."""
    return F.split_part(F.split_part(_without(u, "android-app://", "http://", "https://"), F.lit("/"), F.lit(1)), F.lit("?"), F.lit(1))


def url_parameter(u: Column, name: str) -> Column:
    return F.nullif(F.split_part(F.split_part(u, F.lit(f"{name}="), F.lit(2)), F.lit("&"), F.lit(1)), F.lit(""))


def url_path(u: Column) -> Column:
    """What stands between the first slash after the scheme, or else the question mark, and the next question mark."""
    bare = _without(u, "http://", "https://")
    at = F.coalesce(F.nullif(F.locate("/", bare), F.lit(0)), F.locate("?", bare) - 1)
    return F.split_part(F.substr(bare, at + 1), F.lit("?"), F.lit(1))
