"""Joins that a panel engine needs beyond equi joins: as-of, range, bucket, hierarchical fallback, leave-one-out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows up to which a side is broadcast; beyond, the plan uses a shuffle.
SMALL_ROWS = 100_000


def asof(left: DataFrame, right: DataFrame, key: str = "symbol", left_on: str = "date", right_on: str = "date", values: list[str] | None = None, tolerance_days: int | None = None) -> DataFrame:
    """Backward as-of: each left row gets the last right row of its key at or before it (the latest row wins ties).

    Both sides are laid into one ordered stream per key and the last right row is carried forward: one shuffle by key and
    no pairs, so dense histories don't multiply.
    """
    values = values or [c for c in right.columns if c not in (key, right_on)]
    payload = F.struct(F.col(right_on).alias("_at"), *values)
    marked = right.select(F.col(key), F.col(right_on).alias("_t"), F.lit(0).alias("_side"), payload.alias("_r"), *[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns if c != key])
    asked = left.select(F.col(key), F.col(left_on).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(marked.schema["_r"].dataType).alias("_r"), *[c for c in left.columns if c != key])
    w = Window.partitionBy(key).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = marked.unionByName(asked).withColumn("_r", F.last("_r", ignorenulls=True).over(w)).filter("_side = 1")
    if tolerance_days is not None:
        out = out.withColumn("_r", F.when(F.datediff("_t", "_r._at") <= tolerance_days, F.col("_r")))
    return out.select(*left.columns, *[F.col(f"_r.{v}").alias(v) for v in values])


def asof_lagged(left: DataFrame, right: DataFrame, lag_days: int, key: str = "symbol", date: str = "date", values: list[str] | None = None) -> DataFrame:
    """As-of with a publication lag: a right row counts ``lag_days`` after its date."""
    values = values or [c for c in right.columns if c not in (key, date)]
    return asof(left, right.withColumn(date, F.date_add(date, lag_days)), key, date, date, values)


def range_mean(left: DataFrame, right: DataFrame, value: str, days: int, key: str = "symbol", date: str = "date", out: str = "mean") -> DataFrame:
    """Mean of the right side's value within +-days of each left row, by key.

    Dates are dealt into bins of 2 x days + 1; a left row looks at its own and the two adjoining bins, so the join is an
    equi join on (key, bin) and no task pairs a key's whole history with itself.
    """
    width = 2 * days + 1
    bin_of = lambda d: F.floor(F.datediff(d, F.lit("1970-01-01").cast("date")) / width)
    r = right.select(key, F.col(date).alias("_d"), F.col(value).alias("_v"), bin_of(F.col(date)).alias("_bin"))
    rows = left.withColumn("_bin", F.explode(F.array(*[bin_of(F.col(date)) + i for i in (-1, 0, 1)])))
    near = rows.join(r, [key, "_bin"]).filter(F.abs(F.datediff("_d", date)) <= days)
    means = near.groupBy(key, date).agg(F.avg("_v").alias(out), F.count("_v").alias(f"n_{out}"))
    return left.join(means, [key, date], "left")


def bucket(df: DataFrame, x: str, bounds: DataFrame, label: str = "bucket", default: str | None = None) -> DataFrame:
    """First bucket with lo <= x < hi. bounds(label, lo, hi) is a parameter table; past SMALL_ROWS it is refused."""
    rows = bounds.orderBy("lo").select(label, "lo", "hi").limit(SMALL_ROWS + 1).collect()
    if len(rows) > SMALL_ROWS:
        raise ValueError("bucket bounds are not a parameter table")
    out = F.lit(default)
    for r in reversed(rows):
        low = F.lit(True) if r["lo"] is None else F.col(x) >= F.lit(r["lo"])
        high = F.lit(True) if r["hi"] is None else F.col(x) < F.lit(r["hi"])
        out = F.when(low & high, F.lit(r[label])).otherwise(out)
    return df.withColumn(label, out)


def fallback(df: DataFrame, lookups: list[tuple[DataFrame, list[str]]], value: str, out: str | None = None, default: Column | None = None) -> DataFrame:
    """Left joins on ever coarser keys; the first that knows the value gives it."""
    rows, names = df, []
    for i, (table, keys) in enumerate(lookups):
        names.append(f"_v{i}")
        rows = rows.join(table.select(*keys, F.col(value).alias(names[-1])), keys, "left")
    return rows.withColumn(out or value, F.coalesce(*[F.col(n) for n in names], *([default] if default is not None else []))).drop(*names)


def leave_one_out(df: DataFrame, x: str, by: list[str], out: str) -> DataFrame:
    """Mean of x over the other rows of the group: window sums less the row's own."""
    w = Window.partitionBy(*by)
    n, s = F.count(x).over(w), F.sum(x).over(w)
    own = F.col(x).isNotNull().cast("int")
    return df.withColumn(out, F.when(n - own > 0, (s - F.coalesce(x, F.lit(0.0))) / (n - own)))


def map_lookup(df: DataFrame, key: str, mapping: dict, out: str, default=None) -> DataFrame:
    """A literal dictionary as a column."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    found = F.element_at(F.create_map(*pairs), F.col(key)) if pairs else F.lit(None)
    return df.withColumn(out, F.coalesce(found, F.lit(default)) if default is not None else found)


def common_dates(frames: list[DataFrame], date: str = "date") -> DataFrame:
    out = frames[0].select(date).distinct()
    for f in frames[1:]:
        out = out.intersect(f.select(date).distinct())
    return out


def outer_panel(frames: dict[str, tuple[DataFrame, str]], date: str = "date") -> DataFrame:
    """Full outer join of named series on date, as one aggregation (no chain of joins)."""
    rows = None
    for name, (f, col) in frames.items():
        one = f.select(date, F.lit(name).alias("_n"), F.col(col).cast("double").alias("_v"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy(date).pivot("_n", list(frames)).agg(F.first("_v", ignorenulls=True))
