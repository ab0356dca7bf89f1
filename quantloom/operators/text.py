"""Text signals: ticker mentions, word counts, lexicon sentiment, comment trees."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.functions import panel as P
from quantloom.sources.tables import stored

#: Words of the trading lexicon and their valence.
LEXICON = {
    "buy": 4.0, "sell": -4.0, "bull": 4.0, "bullish": 4.0, "bear": -4.0, "bearish": -4.0, "moon": 4.0, "rocket": 4.0, "crash": -4.0, "yolo": 2.0, "tendies": 2.0,
    "stonks": 2.0, "omg": 1.0, "fomo": 1.0, "fml": -1.0, "up": 4.0, "down": -4.0, "long": 4.0, "short": -4.0, "overvalued": -3.0, "undervalued": 3.0, "pump": 4.0,
    "dump": -4.0, "bagholder": -2.0, "moonshot": 2.0, "highs": 2.0, "lows": -2.0, "underrated": 3.0, "overrated": -3.0, "pumping": 2.0, "dumping": -3.0,
    "recession": -2.0, "depression": -2.0, "crisis": -2.0, "soaring": 3.0, "soars": 2.0, "soared": 2.0, "plunges": -3.0, "plunged": -2.0, "plunge": -3.0,
    "surge": 4.0, "surges": 4.0, "surged": 2.0, "collapses": -4.0, "collapsed": -2.0, "collapse": -4.0, "rally": 2.0, "rallies": 2.0, "rallied": 2.0,
    "crashes": -4.0, "crashed": -2.0, "buy the dip": 4.0, "put": -4.0, "call": 4.0, "buying": 4.0, "selling": -4.0, "cheap": 4.0, "expensive": -4.0, "late": -4.0,
}
STOP = ("the", "of", "and", "to", "in", "is", "a", "for", "on", "with", "it", "this", "that", "be", "as", "by", "an", "at")
NOT_TICKERS = ("THE", "AND", "OF", "TO", "IN", "IS", "FOR", "IT", "ON", "CEO", "USA", "ETF", "IPO", "YOLO")


#: A word in any script, as Python's re takes it (Java's own classes differ between releases).
WORD = r"([\p{L}\p{N}_]+)"


def tickers(text: Column, stop: tuple[str, ...] = NOT_TICKERS) -> Column:
    """Words of 2 to 5 capitals A to Z, duplicates kept."""
    return F.filter(F.regexp_extract_all(text, F.lit(WORD), 1), lambda t: t.rlike(r"\A[A-Z]{2,5}\z") & ~t.isin(*stop))


def words(text: Column, stop: tuple[str, ...] = STOP) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(WORD), 1), lambda w: ~w.isin(*stop))


def sentiment(text: Column, lexicon: dict[str, float] = LEXICON, alpha: float = 15.0) -> Column:
    """Sum of valences, squashed to -1 .. 1 as x / sqrt(x^2 + alpha)."""
    scores = F.create_map(*[F.lit(v) for kv in lexicon.items() for v in kv])
    total = F.aggregate(F.regexp_extract_all(F.lower(text), F.lit(WORD), 1), F.lit(0.0), lambda s, w: s + F.coalesce(F.element_at(scores, w), F.lit(0.0)))
    return total / F.sqrt(total * total + alpha)


def mentions(posts: DataFrame, text: str = "text", top: int = 3) -> DataFrame:
    """Per ticker: mentions, mean and population deviation of sentiment, and the commonest words of its posts."""
    each = posts.select(tickers(F.col(text)).alias("t"), sentiment(F.col(text)).alias("s"), words(F.col(text)).alias("w"))  # once a post
    rows = each.select(F.explode("t").alias("ticker"), "s", "w")
    stats = rows.groupBy("ticker").agg(F.count(F.lit(1)).alias("mentions"), F.avg("s").alias("avg_sentiment"), F.stddev_pop("s").alias("sentiment_std"))
    counted = rows.select("ticker", F.explode("w").alias("word")).groupBy("ticker", "word").agg(F.count(F.lit(1)).alias("n"))
    best = P.top_k(counted, ["ticker"], [F.col("n").desc(), F.col("word")], top)
    listed = best.groupBy("ticker").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "word"))), lambda x: x["word"]), ", ").alias("top_words"))
    return stats.join(listed, "ticker", "left")


COMMENT = "id string, parent_id string, kind string, body string"


def comment_depths(comments: DataFrame, most: int | None = None) -> DataFrame:
    """Depth of each comment below its post (roots 0), one join a level, until a level is empty. Rows deeper than ``most`` are
    an error; without it, more levels than comments are, as ids that occur twice may form a loop.

    Each level is written under ``spark.checkpoint.dir``, so a lost executor only repeats its own tasks."""
    spark = comments.sparkSession
    level, d, levels = comments.filter("parent_id IS NULL").select("id", F.lit(0).alias("depth")), 0, []
    most = comments.count() if most is None else most
    while True:
        level = stored(spark, level, "comment-level")
        if d and level.isEmpty():
            break
        if d > most:
            raise ValueError(f"comments deeper than {most} levels")
        levels.append(level)
        d += 1
        level = comments.join(level.select(F.col("id").alias("parent_id")), "parent_id").select("id", F.lit(d).alias("depth"))
    return reduce(DataFrame.unionByName, levels)


def listing(raw: DataFrame, col: str = "json") -> DataFrame:
    """Posts of landed listing JSON: data.children[].data."""
    kind = "struct<data: struct<children: array<struct<kind: string, data: struct<id: string, title: string, selftext: string, score: bigint>>>>>"
    return raw.select(F.explode(F.from_json(col, kind)["data"]["children"]).alias("c")).filter("c.kind = 't3'").select("c.data.*")


def html_table(pages: DataFrame, html: str = "html") -> DataFrame:
    """Cells of the first html table of each page, as rows of arrays of text."""
    table = F.regexp_extract(html, r"(?is)<table\b[^>]*>(.*?)</table>", 1)
    row = F.explode(F.regexp_extract_all(table, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), 1))
    cells = F.transform(F.regexp_extract_all("r", F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), 1), lambda c: F.trim(F.regexp_replace(c, "<[^>]+>", "")))
    return pages.withColumn("r", row).withColumn("cells", cells).drop("r")
