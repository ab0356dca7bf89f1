import random

import pytest

WORDS = [f"w{i}{c}" for i in range(300) for c in "abc"]


def make_docs(seed=1):
    """Small rows with every hard case: nulls, empties, a very long text, copies, near copies, ties, a shared passage."""
    r = random.Random(seed)
    prose = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    passage, base = prose(60), prose(120)
    near = base.split()
    near[50] = "changed"
    near2 = list(near)
    near2[90] = "again"
    texts = [prose(80), prose(80) + " " + passage, passage + "\n" + prose(30), base, " ".join(near), " ".join(near2), base, base.upper(), None, "", " \n\t ", "one", "two words", "a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a", prose(30) + " " + passage + " " + prose(5) + " " + passage, "ünï cödé wörds — " + prose(20), prose(3000), "x\n" * 40, "### $$$ %%% " * 20]
    rows = [(i * 3, t, "en" if i % 2 else None, f"src{i % 3}", len(t) if t is not None else None, f"extra{i}") for i, t in enumerate(texts)]
    rows.append((None, base, "de", "src0", len(base), "null id"))
    rows.append(rows[3])
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string"


@pytest.fixture(scope="session")
def rows():
    return make_docs()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
