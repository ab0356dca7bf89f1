"""How many files the working tables have: each one that an executor writes starts a process there."""

import glob
import random

import pytest

from quantloom.llm import common as C
from quantloom.llm import near_dedup, phrases


@pytest.fixture
def written(monkeypatch):
    """Labels of the working tables as they are written, with their files."""
    out, stored = [], C.stored

    def seen(spark, df, label, *args, **kwargs):
        table, path = stored(spark, df, label, *args, **kwargs)
        out.append((label, len(glob.glob(f"{path.removeprefix('file:')}/part-*"))))
        return table, path

    monkeypatch.setattr(C, "stored", seen)
    return out


@pytest.fixture
def many_partitions(spark):
    conf = {"spark.sql.shuffle.partitions": str(8 * C.few_tasks(spark)), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    had = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in had.items():
        spark.conf.set(k, v)


def texts(n):
    r = random.Random(5)
    base = [" ".join(r.choice("abcdefghij") * 3 + str(r.randrange(99)) for _ in range(40)) for _ in range(n)]
    return [(i, t) for i, t in enumerate(base + [t + " more" for t in base])]


def test_few_files_of_near_dedup(spark, written, many_partitions):
    found = near_dedup.cluster(spark, spark.createDataFrame(texts(150), "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["component_id"]) for r in found} == {(i, i % 150) for i in range(300)}
    assert max(n for label, n in written if label != "near-described") <= C.few_tasks(spark)


def test_no_files_of_phrases(spark, written):
    got = phrases.dedup(spark, spark.createDataFrame(texts(20), "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["n_removed"]) for r in got} == {(i, 40 * (i >= 20)) for i in range(40)}
    assert not written
