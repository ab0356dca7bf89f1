"""Text queries over every text, whatever its script, against plain Python as the surveyed code does it."""

import math
import re
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quantloom import catalog
from quantloom.operators import text as X

Q = catalog.queries()


def tickers(t):
    return [x for x in re.findall(r"\b[A-Z]{2,5}\b", t) if x not in X.NOT_TICKERS]


def sentiment(t):
    s = sum(X.LEXICON.get(w, 0.0) for w in re.findall(r"\b\w+\b", t.lower()))
    return s / math.sqrt(s * s + 15)


@pytest.fixture(scope="module")
def documents(sf):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pylist() if r["text"] is not None]
    assert any(not t.isascii() and tickers(t) for _, t in rows)
    return rows


def test_ticker_counts_of_every_text(spark, sf, documents):
    n, ids = Counter(), defaultdict(set)
    for i, t in documents:
        for x in tickers(t):
            n[x] += 1
            ids[x].add(i)
    assert {r["ticker"]: (r["mentions"], r["docs"]) for r in Q["ticker_counts"](spark, sf).collect()} == {x: (n[x], len(ids[x])) for x in n}


def test_ticker_mentions_of_every_text(spark, sf, documents):
    scores, found = defaultdict(list), defaultdict(Counter)
    for _, t in documents:
        own = Counter(w for w in re.findall(r"\b\w+\b", t.lower()) if w not in X.STOP)
        for x in tickers(t):
            scores[x].append(sentiment(t))
            found[x].update(own)
    got = {r["ticker"]: r for r in Q["ticker_mentions"](spark, sf).collect()}
    assert set(got) == set(scores)
    for x, s in scores.items():
        mean = sum(s) / len(s)
        assert got[x]["mentions"] == len(s) and abs(got[x]["avg_sentiment"] - mean) < 2e-6, x
        assert abs(got[x]["sentiment_std"] - math.sqrt(sum((v - mean) ** 2 for v in s) / len(s))) < 2e-6, x
        assert (got[x]["top_words"] or "") == ", ".join(w for w, _ in sorted(found[x].items(), key=lambda p: (-p[1], p[0]))[:3]), x


def test_conversation_sentiment_of_every_turn(spark, sf):
    each = defaultdict(list)
    for r in pq.read_table(f"{sf}/conversations.parquet").to_pylist():
        each[r["conv_id"]].append(sentiment(r["text"] or ""))
    got = {r["conv_id"]: r for r in Q["conversation_sentiment"](spark, sf).collect()}
    assert {k: r["turns"] for k, r in got.items()} == {k: len(v) for k, v in each.items()}
    assert all(abs(got[k]["sentiment"] - sum(v) / len(v)) < 2e-6 for k, v in each.items())


def test_words_of_other_scripts(spark):
    row = spark.createDataFrame([("ÜBER die AG f\u00fcr ABC_D und \u0421\u0428\u0410 XY. BUY",)], "text string").select(X.tickers(F.col("text")), X.words(F.col("text"))).first()
    assert row[0] == ["AG", "XY", "BUY"] and row[1][:4] == ["\u00fcber", "die", "ag", "f\u00fcr"]


def test_comments_to_the_deepest_level(spark):
    rows = [("c0", None, "post", "")] + [(f"c{i}", f"c{i - 1}", "comment", "") for i in range(1, 15)]
    got = X.comment_depths(spark.createDataFrame(rows, X.COMMENT).coalesce(1).cache())
    assert {r["id"]: r["depth"] for r in got.collect()} == {f"c{i}": i for i in range(15)}
