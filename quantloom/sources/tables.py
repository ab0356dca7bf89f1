"""Sources and sinks: explicit schemas, NA tokens, newest-file fallback, keyed upserts, and the panels of the test tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NA_TOKENS = ("—", "-", "", "NA", "N/A", "nan")


def parquet(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def csv(spark: SparkSession, path: str, schema: str, na: str = "", header: bool = True) -> DataFrame:
    return spark.read.csv(path, schema=schema, header=header, nullValue=na, enforceSchema=False)


def json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.json(path, schema=schema)


def number(x) -> F.Column:
    """Text to double: thousands separators dropped, NA tokens and other text NULL."""
    t = F.trim(x if not isinstance(x, str) else F.col(x))
    return F.when(t.isin(*NA_TOKENS), None).otherwise(F.regexp_replace(t, ",", "").try_cast("double"))


def abbreviated(x) -> F.Column:
    """'1.2B', '3M', '4T', '5K' to a number."""
    t = F.upper(F.regexp_replace(F.trim(x), ",", ""))
    pattern = r"^([-+]?[0-9]*\.?[0-9]+)\s*([KMBT]?)$"
    unit = F.regexp_extract(t, pattern, 2)
    scale = F.when(unit == "K", 1e3).when(unit == "M", 1e6).when(unit == "B", 1e9).when(unit == "T", 1e12).otherwise(1.0)
    return F.regexp_extract(t, pattern, 1).try_cast("double") * scale


def growth(x) -> F.Column:
    """'12%' to 0.12; bare numbers over 1 are percent too."""
    t = F.trim(x)
    v = F.regexp_replace(t, "[%,]", "").try_cast("double")
    return F.when(t.endswith("%") | (F.abs(v) > 1), v / 100).otherwise(v)


def quarter_label(x) -> F.Column:
    """'2024Q3' (also '2024 Q3', 'Q3/2024') to the quarter's last day; other text NULL."""
    t = F.upper(F.trim(x))
    y = F.regexp_extract(t, r"(\d{4})", 1).try_cast("int")
    q = F.regexp_extract(t, r"Q([1-4])", 1).try_cast("int")
    return F.when(y.isNotNull() & q.isNotNull(), F.last_day(F.make_date(y, q * 3, F.lit(1))))


def newest(spark: SparkSession, folder: str, pattern: str = r"(\d{4}-\d{2}-\d{2})", today: str | None = None) -> str | None:
    """Path of the folder's entry dated ``today``, else of the newest date in a name. Works on any Hadoop file system."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    dated = [(m[1], s.getPath().toString()) for s in (fs.listStatus(at) if fs.exists(at) else []) if (m := re.search(pattern, s.getPath().getName()))]
    exact = [p for d, p in dated if d == today]
    return exact[0] if exact else max(dated, default=(None, None))[1]


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, ``spark.checkpoint.dir``; one is made only where none is set and Spark runs locally."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to storage that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quantloom-"))
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


#: Spark's switch for deleting an execution's shuffle files at its end, not when the driver happens to collect garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(spark: SparkSession, df: DataFrame, label: str, clean: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """Write df as a working table in the shared folder and read it back: cuts lineage, survives lost executors. ``clean``: the
    shuffle files of the write go with it. ``by``: columns that files are kept apart by."""
    path = f"{shared_dir(spark)}/quantloom/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    if clean:
        spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.partitionBy(*by).parquet(path)
    finally:
        if clean:
            spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def without(current: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``current`` whose keys ``rows`` hasn't; NULL keys are equal to each other."""
    new = rows.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).distinct()
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    return current.join(new, same, "left_anti")


def upsert(current: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``current`` whose keys don't recur, and the new rows."""
    return without(current, rows, keys).unionByName(rows, allowMissingColumns=True)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Replace a table; Spark's commit protocol makes it whole or absent."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def headers(df: DataFrame) -> DataFrame:
    """Trimmed, distinct string headers: repeats get _2, _3 ..."""
    seen: dict[str, int] = {}
    out = []
    for c in df.columns:
        c = str(c).strip() or "column"
        seen[c] = seen.get(c, 0) + 1
        out.append(c if seen[c] == 1 else f"{c}_{seen[c]}")
    return df.toDF(*out)


#: Lines whose bars are made at once by ``bars_in_parts``.
PART_LINES = 6_000_000


def bars_in_parts(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """``bars`` of all suppliers, some suppliers a part: each part reads all lines and shuffles its own once, by supplier, so that a
    caller who stores one part after the other never has the shuffle files of more than about PART_LINES lines on disk."""
    line = parquet(spark, sf_dir, "lineitem")
    parts = max(1, -(-line.count() // PART_LINES))
    if parts == 1:
        return [bars(spark, sf_dir)]
    return [bars(spark, sf_dir, F.pmod(F.xxhash64("l_suppkey"), F.lit(parts)) == i) for i in range(parts)]


def bars(spark: SparkSession, sf_dir: str, only: F.Column | None = None) -> DataFrame:
    """Daily OHLCV of each supplier: prices are l_extendedprice / l_quantity in line order.

    The order is one decimal (order key, line number, part key), which a hash aggregate can hold; a struct would sort the rows.
    ``only``: a condition on suppliers, whose lines then meet by supplier, which all that is grouped by symbol shares.
    """
    line = parquet(spark, sf_dir, "lineitem")
    if only is not None:
        line = line.filter(only)
    key = F.col("l_orderkey").cast("decimal(20,0)") * F.lit(10**16).cast("decimal(17,0)")
    at = (key + F.col("l_linenumber").cast("decimal(17,0)") * F.lit(10**13).cast("decimal(14,0)") + F.col("l_partkey")).cast("decimal(38,0)")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    rows = line.select(F.col("l_suppkey").alias("symbol"), F.to_date("l_shipdate").alias("date"), price.alias("p"), at.alias("at"), F.col("l_quantity").alias("q"))
    if only is not None:
        rows = rows.repartition("symbol")
    return rows.groupBy("symbol", "date").agg(F.min_by("p", "at").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "at").alias("close"), F.sum("q").alias("volume"))


#: The same bars for DuckDB.
BARS_SQL = """bars AS (SELECT l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS date,
  first(l_extendedprice / l_quantity ORDER BY l_orderkey, l_linenumber, l_partkey) AS open,
  max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
  last(l_extendedprice / l_quantity ORDER BY l_orderkey, l_linenumber, l_partkey) AS close,
  sum(l_quantity) AS volume FROM lineitem GROUP BY 1, 2)"""


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols with country, region and size: supplier, nation and region."""
    s, n, r = (parquet(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    named = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select("n_nationkey", F.col("n_name").alias("country"), F.col("r_name").alias("region"))  # 25 rows by definition
    return s.join(F.broadcast(named), s.s_nationkey == named.n_nationkey).select(F.col("s_suppkey").alias("symbol"), "country", "region", F.col("s_acctbal").alias("mcap"))


UNIVERSE_SQL = """universe AS (SELECT s_suppkey AS symbol, n_name AS country, r_name AS region, s_acctbal AS mcap
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
