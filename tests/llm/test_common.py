import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quantloom.llm import common as C


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "c", "dd"]), max_size=40), max_size=6), st.integers(2, 5), st.integers(5, 9))
def test_rolling_and_winnow(docs, k, t):
    docs = [[w.encode() for w in d] for d in docs]
    flat = C.Flat(docs)
    h, ok = flat.windows(k)
    seen = {}
    for i in np.flatnonzero(ok):
        d, p = flat.doc[i], flat.pos[i]
        key = tuple(docs[d][p : p + k])
        assert seen.setdefault(key, h[i]) == h[i]
    assert len(set(seen.values())) == len(seen)
    grams, chosen, least, full = C.winnow(flat, k, t)
    for i in np.flatnonzero(full):
        span = grams[i : i + t - k + 1]
        assert least[i] == span.min()
        assert chosen[i : i + t - k + 1][span == span.min()].all()
    covered = np.zeros(len(grams), bool)
    for i in np.flatnonzero(full):
        covered[i : i + t - k + 1] = True
    assert not (chosen & ~covered).any()


def test_ranked_counts_across_parts(spark):
    df = spark.range(500).selectExpr("id % 3 AS k", "id AS o", "id % 7 AS v")
    rows, runs, _ = C.ranked(spark, df, ["k"], ["o"], ["v"], "t")
    got = {(r["k"], r["o"]): r for r in rows.collect()}
    before = {}
    for r in sorted(runs.collect(), key=lambda r: (r["k"], r["part"])):
        before[(r["k"], r["part"])] = before.get(("n", r["k"]), 0), before.get(("s", r["k"]), 0)
        before[("n", r["k"])] = before.get(("n", r["k"]), 0) + r["n"]
        before[("s", r["k"])] = before.get(("s", r["k"]), 0) + r["sum_v"]
    for k in range(3):
        total = 0
        for rank, o in enumerate(o for o in range(500) if o % 3 == k):
            r = got[(k, o)]
            n, s = before[(k, r["part"])]
            assert n + r["idx"] == rank and s + r["cum_v"] == total
            total += o % 7


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 30), (30, 1000), (5, 5), (1000, 999)]
    got = {r["v"]: r["root"] for r in C.components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7, 30: 7, 1000: 7, 999: 7}
    assert C.components(spark, spark.createDataFrame([], "a long, b long")).count() == 0


def test_bitmap(spark):
    x = (np.arange(1, 4000, dtype=np.uint64) * C.ODD).view(np.int64)
    near = C.bitmap(spark, spark.createDataFrame([(int(v),) for v in x[:2000]], "h long"), "h").value
    assert near.has(x[:2000].view(np.uint64)).all()
    assert near.has(x[2000:].view(np.uint64)).mean() < 0.01


def test_components_of_few_edges_take_no_stars(spark, monkeypatch):
    rng = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in rng.integers(-90, 90, (110, 2))] + [(k, k + 1) for k in range(200, 300)] + [(5, 5)]
    edges = spark.createDataFrame(pairs, "a long, b long")
    run = lambda: {r["v"]: r["root"] for r in C.components(spark, edges).collect()}
    with monkeypatch.context() as m:
        m.setattr(C, "FEW_EDGES", -1)
        stars = run()
    monkeypatch.setattr(C, "_star", lambda *_: (_ for _ in ()).throw(AssertionError("a round of stars")))
    few = run()
    assert few == stars and few[300] == 200
