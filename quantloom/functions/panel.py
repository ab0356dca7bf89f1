"""Column builders over ordered panels (symbol, date). Missing values are NULL; frames count non-null rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def over(*keys: str, order: str | list[str] = "date") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*([order] if isinstance(order, str) else order))


def whole(*keys: str) -> WindowSpec:
    return Window.partitionBy(*keys)


def clean(x: Column | str) -> Column:
    """NaN and infinities become NULL."""
    x = F.col(x) if isinstance(x, str) else x
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0 or NULL."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def pct_change(x: str, w: WindowSpec, k: int = 1) -> Column:
    return ratio(F.col(x), F.lag(x, k).over(w)) - 1


def diff(x: str, w: WindowSpec, k: int = 1) -> Column:
    return F.col(x) - F.lag(x, k).over(w)


def log_return(x: str, w: WindowSpec) -> Column:
    return F.log(ratio(F.col(x), F.lag(x, 1).over(w)))


def rolling(fn: Callable[[Column], Column], x: Column | str, w: WindowSpec, n: int, least: int | None = None, shift: int = 0) -> Column:
    """fn over the last n rows (``shift`` rows back), NULL under ``least`` non-null values (default n)."""
    frame = w.rowsBetween(-(n - 1) - shift, -shift)
    x = F.col(x) if isinstance(x, str) else x
    return F.when(F.count(x).over(frame) >= (n if least is None else least), fn(x).over(frame))


def ffill(x: str, w: WindowSpec) -> Column:
    return F.last(x, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def bfill(x: str, w: WindowSpec) -> Column:
    return F.first(x, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))


def cumsum(x: Column, w: WindowSpec) -> Column:
    return F.sum(x).over(w.rowsBetween(Window.unboundedPreceding, 0))


def cummax(x: Column, w: WindowSpec) -> Column:
    return F.max(x).over(w.rowsBetween(Window.unboundedPreceding, 0))


def wealth(r: Column, w: WindowSpec, start: float = 1.0) -> Column:
    """start * product of (1 + r) so far."""
    return F.lit(start) * F.exp(cumsum(F.log1p(r), w))


def clip(x: Column, low: Column | float | None = None, high: Column | float | None = None) -> Column:
    """Bounds keep NULL a NULL (least and greatest alone would skip it)."""
    y = x
    if low is not None:
        y = F.greatest(y, low if isinstance(low, Column) else F.lit(low))
    if high is not None:
        y = F.least(y, high if isinstance(high, Column) else F.lit(high))
    return F.when(x.isNotNull(), y)


def interpolate(df: DataFrame, x: str, key: str = "symbol", order: str = "date") -> DataFrame:
    """Linear in row distance between known neighbours; ends: the last known value goes on, leading gaps stay."""
    w = over(key, order=order)
    rows = df.withColumn("_i", F.row_number().over(w))
    at = F.when(F.col(x).isNotNull(), F.col("_i"))
    back, on = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    rows = rows.select("*", F.last(x, True).over(back).alias("_a"), F.last(at, True).over(back).alias("_ai"), F.first(x, True).over(on).alias("_b"), F.first(at, True).over(on).alias("_bi"))
    line = F.col("_a") + (F.col("_b") - F.col("_a")) * ratio(F.col("_i") - F.col("_ai"), F.col("_bi") - F.col("_ai"))
    return rows.withColumn(x, F.coalesce(F.col(x), line, F.col("_a"))).drop("_i", "_a", "_ai", "_b", "_bi")


def signed_log1p(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def signed_expm1(y: Column) -> Column:
    return F.signum(y) * F.expm1(F.abs(y))


def crosses_over(x: str, y: str, w: WindowSpec) -> Column:
    return F.coalesce((F.col(x) > F.col(y)) & (F.lag(x).over(w) <= F.lag(y).over(w)), F.lit(False))


def crosses_under(x: str, y: str, w: WindowSpec) -> Column:
    return F.coalesce((F.col(x) < F.col(y)) & (F.lag(x).over(w) >= F.lag(y).over(w)), F.lit(False))


def keep_last(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the last in order. Ties are the caller's to break."""
    w = Window.partitionBy(*keys).orderBy(*[c.desc() for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn")


def week_end(d: Column | str, day: str = "SUN") -> Column:
    """Date of the week's last day (label of a W-<day> bucket)."""
    d = F.col(d) if isinstance(d, str) else d
    return F.next_day(F.date_sub(d, 1), day)


def month_end(d: Column | str) -> Column:
    return F.last_day(d)


def quarter_end(d: Column | str) -> Column:
    return F.last_day(F.add_months(F.trunc(d, "quarter"), 2))


def year_end(d: Column | str) -> Column:
    return F.last_day(F.add_months(F.trunc(d, "year"), 11))


BUCKETS = {"W-SUN": lambda d: week_end(d, "SUN"), "W-FRI": lambda d: week_end(d, "FRI"), "ME": month_end, "QE": quarter_end, "YE": year_end}


def resample(df: DataFrame, rule: str, how: dict[str, str], key: str = "symbol", date: str = "date") -> DataFrame:
    """Bucketed last / first / mean / sum / prod / max / min per symbol; the label is the bucket's last day."""
    d = F.col(date)
    # "prod" compounds returns: the product of (1 + x) less one.
    agg = {"last": lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), d)), "first": lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), d)), "mean": F.avg, "sum": F.sum, "max": F.max, "min": F.min, "prod": lambda c: F.exp(F.sum(F.log1p(c))) - 1, "count": F.count}
    return df.groupBy(key, BUCKETS[rule](date).alias(date)).agg(*[agg[h](c).alias(c) for c, h in how.items()])


def spine(df: DataFrame, rule: str = "B", key: str = "symbol", date: str = "date") -> DataFrame:
    """Every calendar bucket from each symbol's first to its last date: B (weekdays), D, W-SUN, W-FRI, ME, QE, YE."""
    ends = df.groupBy(key).agg(F.min(date).alias("_a"), F.max(date).alias("_z"))
    if rule in ("B", "D"):
        days = ends.select(key, F.explode(F.sequence("_a", "_z", F.expr("interval 1 day"))).alias(date))
        return days.filter(F.dayofweek(date).between(2, 6)) if rule == "B" else days
    end, step = BUCKETS[rule], {"W": "7 days", "M": "1 month", "Q": "3 months", "Y": "1 year"}[rule[0]]
    if rule[0] == "W":
        return ends.select(key, F.explode(F.sequence(end("_a"), end("_z"), F.expr(f"interval {step}"))).alias(date))
    first = {"M": "month", "Q": "quarter", "Y": "year"}[rule[0]]
    return ends.select(key, F.explode(F.sequence(F.trunc("_a", first), F.trunc("_z", first), F.expr(f"interval {step}"))).alias("_d")).select(key, end("_d").alias(date))


def reindex(df: DataFrame, spine_df: DataFrame, on: list[str], fill: str | None = None, values: list[str] = ()) -> DataFrame:
    """Left join onto a spine, then ffill, bfill or both within the first key."""
    out = spine_df.join(df, on, "left")
    w = over(*on[:-1], order=on[-1])
    for v in values:
        if fill in ("ffill", "both"):
            out = out.withColumn(v, ffill(v, w))
        if fill in ("bfill", "both"):
            out = out.withColumn(v, bfill(v, w))
    return out


def runs(df: DataFrame, state: Column, key: str = "symbol", date: str = "date") -> DataFrame:
    """Gaps and islands: (key, state, start, end, length) of runs of equal state."""
    w, ws = Window.partitionBy(key).orderBy(date), Window.partitionBy(key, "_s").orderBy(date)
    rows = df.withColumn("_s", state).withColumn("_g", F.row_number().over(w) - F.row_number().over(ws))
    return rows.groupBy(key, F.col("_s").alias("state"), "_g").agg(F.min(date).alias("start"), F.max(date).alias("end"), F.count(F.lit(1)).alias("length")).drop("_g")


def fourier(t: Column, period: float, k: int, prefix: str = "f") -> list[Column]:
    out = []
    for j in range(1, k + 1):
        a = t * F.lit(2 * 3.141592653589793 * j / period)
        out += [F.sin(a).alias(f"{prefix}_sin{j}"), F.cos(a).alias(f"{prefix}_cos{j}")]
    return out
