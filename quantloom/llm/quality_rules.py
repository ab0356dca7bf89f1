"""Quality rules as a bitmask ledger.

``ledger`` reads every whole text once and stores one failure bit per rule plus the measurements. ``Policy`` objects
are versioned sets of bits: ``apply_policy`` judges the ledger without touching texts again, ``ablate`` counts what
each rule decides from an aggregate over failure masks (at most 2^rules rows, however many documents there are).

Defined results: a null or empty text has no words, so all measurements are 0 and the word-count rule fails. Repeated
rows are judged alike, one row each. Null ids are kept. Only the id and text columns are read; others may be anything.
An empty table gives an empty ledger.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letters", "n_upper", "n_digits")

#: (name, SQL condition over the measures that makes the rule fail). The place in the list is the bit.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 50"),
    ("repeated_trigrams", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "100 * n_symbols > 30 * n_words"),
    ("duplicate_lines", "100 * n_dup_lines > 50 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
    ("upper_case", "n_letters > 0 and 100 * n_upper > 60 * n_letters"),
    ("few_letters", "100 * n_letters < 25 * word_chars"),
    ("digits", "100 * n_digits > 60 * word_chars"),
)
BIT = {name: i for i, (name, _) in enumerate(RULES)}


def mask(*names: str) -> int:
    return sum(1 << BIT[n] for n in names)


@dataclass(frozen=True)
class Policy:
    """Rejects a document if a ``hard`` bit is set, or ``soft_limit`` or more of the ``soft`` bits."""

    name: str
    version: int
    hard: int
    soft: int = 0
    soft_limit: int = 2


#: The base rules reject alone; so does each rule that plain prose of any of the languages keeps far away from.
DEFAULT = Policy("default", 1, mask("few_words", "repeated_trigrams", "symbols", "duplicate_lines", "upper_case", "few_letters"), mask("short_words", "long_words", "digits"), 1)

SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\x0b\x0c\r"
UPPER = bytes(range(65, 91))
DIGITS = b"0123456789"
#: All bytes but those of letters: ASCII letters, and lead bytes of longer characters (one for each).
NOT_LETTERS = bytes(b for b in range(256) if not (65 <= b <= 90 or 97 <= b <= 122 or b >= 0xC2))
CONTINUED = bytes(range(0x80, 0xC0))


def measure(texts: list[str | None]) -> dict[str, np.ndarray]:
    """All measurements of these texts, as arrays in MEASURES' names."""
    raw = [C.text_of(t) for t in texts]
    flat = C.Flat([b.split() for b in raw])
    n = len(raw)
    out = {"n_words": flat.sizes}
    count = lambda b, drop: len(b) - len(b.translate(None, drop))
    out["word_chars"] = np.array([len(b.translate(None, CONTINUED + SPACE)) for b in raw], np.int64)
    out["n_symbols"] = np.array([count(b, SYMBOLS) for b in raw], np.int64)
    lines = [[x for x in b.split(b"\n") if x.strip()] for b in raw]
    out["n_lines"] = np.array([len(x) for x in lines], np.int64)
    out["n_dup_lines"] = np.array([len(x) - len(set(x)) for x in lines], np.int64)
    out["n_letters"] = np.array([len(b.translate(None, NOT_LETTERS)) for b in raw], np.int64)
    out["n_upper"] = np.array([count(b, UPPER) for b in raw], np.int64)
    out["n_digits"] = np.array([count(b, DIGITS) for b in raw], np.int64)
    tri, full = flat.windows(3)
    at = np.flatnonzero(full)
    with np.errstate(over="ignore"):
        key = C.mix(tri[at] ^ (flat.doc[at].astype(np.uint64) * C.ODD))
    _, back, times = np.unique(key, return_inverse=True, return_counts=True)
    hit = at[times[back] > 1]
    marked = np.zeros(len(flat.h), bool)
    for j in range(3):
        marked[hit + j] = True
    out["n_repeat_words"] = np.bincount(flat.doc[marked], minlength=n)[:n] if n else np.zeros(0, np.int64)
    return out


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: id, measurements and ``fail_bits`` (bit i: RULES[i] failed). ``carry``: columns to keep."""
    kept = [id_col, text_col, *[c for c in carry if c not in (id_col, text_col)]]
    src = docs.select(*kept)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields if f.name != text_col or text_col in carry)
    schema = fields + "".join(f", {m} bigint" for m in MEASURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in C.chunks(batch):
                m = measure(b.column(1).to_pylist())
                cols = [(n, b.column(i)) for i, n in enumerate(kept) if i != 1 or text_col in carry]
                yield pa.RecordBatch.from_arrays([c for _, c in cols] + [pa.array(m[x], pa.int64()) for x in MEASURES], names=[n for n, _ in cols] + list(MEASURES))

    bits = " | ".join(f"IF({cond}, {1 << i}L, 0L)" for i, (_, cond) in enumerate(RULES))
    return src.mapInArrow(run, schema).withColumn("fail_bits", F.expr(bits))


def verdict(policy: Policy):
    """Column: does the policy keep the row of a ledger?"""
    bits = F.col("fail_bits")
    ok = bits.bitwiseAND(F.lit(policy.hard)) == 0
    return ok & (F.bit_count(bits.bitwiseAND(F.lit(policy.soft))) < policy.soft_limit) if policy.soft else ok


def apply_policy(entries: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    return entries.withColumn("policy", F.lit(f"{policy.name}@{policy.version}")).withColumn("kept", verdict(policy))


def ablate(entries: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """For each rule: documents that fail it, that fail it alone, and that the policy would keep without it."""
    masks = entries.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, (name, _) in enumerate(RULES)]))
    each = masks.withColumn("r", rules).select("fail_bits", "n", "r.rule", "r.bit", verdict(policy).alias("kept"))
    without = each.withColumn("full", F.col("fail_bits")).withColumn("fail_bits", F.col("full").bitwiseAND(F.bitwise_not(F.col("bit"))))
    without = without.withColumn("then_kept", verdict(policy))
    fails = F.col("full").bitwiseAND(F.col("bit")) != 0
    total = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    return without.groupBy("rule").agg(total(fails).alias("n_fail"), total(F.col("full") == F.col("bit")).alias("n_alone"), total(~F.col("kept") & F.col("then_kept")).alias("n_rescued"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = apply_policy(ledger(C.table(spark, sf_dir, "documents")))
    base = mask("few_words", "repeated_trigrams")
    return entries.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (F.col("fail_bits").bitwiseAND(F.lit(base)) != 0).alias("base_failed"), "fail_bits", "kept")


def ablation_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the default policy decides over all documents."""
    return ablate(ledger(C.table(spark, sf_dir, "documents"))).orderBy("rule")


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
tri AS (SELECT r, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] AS g
        FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM tri) WHERE c > 1),
words AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i+1, i+2]) AS p FROM rep) GROUP BY r),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words,
        length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
        coalesce(words.n, 0)::BIGINT AS n_repeat_words,
        length(regexp_replace(t, '[\x00-\x40\x5B-\x60\x7B-\x7F]', '', 'g'))::BIGINT AS n_letters,
        length(regexp_replace(t, '[^A-Z]', '', 'g'))::BIGINT AS n_upper,
        length(regexp_replace(t, '[^0-9]', '', 'g'))::BIGINT AS n_digits
      FROM w LEFT JOIN words USING (r)),
f AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
        + CASE WHEN 100 * n_symbols > 30 * n_words THEN 4 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END
        + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 20 * n_words THEN 32 ELSE 0 END
        + CASE WHEN n_letters > 0 AND 100 * n_upper > 60 * n_letters THEN 64 ELSE 0 END
        + CASE WHEN 100 * n_letters < 25 * word_chars THEN 128 ELSE 0 END
        + CASE WHEN 100 * n_digits > 60 * word_chars THEN 256 ELSE 0 END)::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, fail_bits, fail_bits = 0 AS kept FROM f
"""

ABLATION_SQL = f"""
WITH e AS ({ORACLE_SQL}), r AS (SELECT * FROM (VALUES {", ".join(f"('{name}', {1 << i})" for i, (name, _) in enumerate(RULES))}) AS v(rule, bit))
SELECT rule, (count(*) FILTER (fail_bits & bit <> 0))::BIGINT AS n_fail, (count(*) FILTER (fail_bits = bit))::BIGINT AS n_alone, (count(*) FILTER (fail_bits <> 0 AND fail_bits & ~bit = 0))::BIGINT AS n_rescued FROM e, r GROUP BY rule
"""
