import json
import os
from collections import Counter

import corpus_pipeline

from quantloom.llm import common, quality_rules, secrets, token_files

from .test_operators import WORD_LIST, plain_components, plain_hits


def test_pipeline_against_plain_stages(spark, rows, tmp_path):
    base = rows[1][1].split()
    docs = [(*r[:5], 7, "x") for r in rows] + [(900, " ".join(base[:70]) + " password=0123456789abcdef99", "en", "s", 10, 7, "x"), (901, " ".join(f"z{i}" for i in range(60)) + " token: abcdefabcdef12345", "en", "s", 10, 7, "x")]
    items = [("7", " ".join(rows[16][1].split()[100:115]))]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, n_words long, kept string").write.parquet(os.path.join(tmp_path, "documents.parquet"))
    spark.createDataFrame(items, "item_id string, text string").write.parquet(os.path.join(tmp_path, "benchmark.parquet"))
    now = spark.read.parquet(os.path.join(tmp_path, "documents.parquet"))
    want = [d for d in docs if keep(d[1])]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        now = stage(spark, now, str(tmp_path))
        if k == 1:
            named = plain_components(want, 5, 80)
            kept = {}
            for d, (i, _, c) in zip(want, named, strict=True):
                if i == c:
                    kept.setdefault(d[:2], []).append(d)
            want = [min(same, key=lambda d: json.dumps(d[2:])) for same in kept.values()]
        if k == 2:
            want = [d for d in want if not plain_hits(d[1], items)[1]]
        if k == 3:
            want = [(d[0], secrets.hide(d[1], secrets.scan(d[1], WORD_LIST), "[secret]"), *d[2:]) for d in want]
            want = [(*d[:4], len(d[1]), *d[5:]) for d in want]
        if k < 4:
            assert Counter(tuple(r) for r in now.collect()) == Counter(want), name
            assert now.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_words", "kept"]
    enc = token_files.encoder(token_files.vocabulary_path())
    assert Counter(r["doc_id"] for r in now.collect()) == Counter(d[0] for d in want for _ in range(-(-(len(enc.encode([d[1]])[0]) + 1) // 4096)))
    before = set(common.working_tables())
    out = corpus_pipeline.run(spark, str(tmp_path))
    left = [p.rsplit("/", 1)[1] for p in common.working_tables() if p not in before]
    assert [p.rsplit("-", 1)[0] for p in left] == [f"pipeline-{name}" for name, _ in corpus_pipeline.STAGES]
    assert Counter(r["doc_id"] for r in out.collect()) == Counter(r["doc_id"] for r in now.collect())
    assert any("[secret]" in d[1] for d in want)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def keep(text):
    m = {k: int(v[0]) for k, v in quality_rules.measure([text]).items()}
    return not any(eval(c.replace("and", "and"), {}, m) for _, c in quality_rules.RULES)
