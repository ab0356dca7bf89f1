"""Benchmark decontamination by winnowing.

Of every window of ``WINDOW`` words the k-gram with the least hash is kept as its fingerprint, in documents and in
benchmark items alike, so every shared span of a whole window shares a fingerprint. Training fingerprints are joined
with the test fingerprints, and each hit is extended: the windows around it are compared with the item's. Items shorter
than a window are one window each, looked up by their whole word sequence, one pass for each length.

Scale: a benchmark of at most ``INDEX_BYTES`` of text goes to the executors as an index (about 40 times its text in each
worker), so the join is map-only and windows are compared word by word. A larger one stays in tables: a bitmap of its
fingerprints (bounded size, false positives only) picks the documents' fingerprints that can meet, the windows around them and
the short windows go on as 128-bit hashes and meet the items' windows in a join that spreads hot windows, and each document's
hits are merged as they stream by in order of place. Documents are read twice, whatever the benchmark's size.

Defined results: null and empty texts have no words; very long texts are read whole; an item without words hits nothing;
repeated documents are judged each, repeated items and equal item ids count once; null item ids read as the empty string in the
digest. Columns beside the id, the text and ``carry`` are not read, so they may have any name. Empty tables give no rows, or no hits.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

WINDOW = 10
GRAM = 5
INDEX_BYTES = 2 << 20

#: Words are runs of 0-9, A-Z (lower-cased), a-z and any character past ASCII; all other bytes separate.
WORD_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return C.text_of(text).translate(WORD_TABLE).split()


class Index:
    """Fingerprints and windows of some benchmark items."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW, gram: int = GRAM):
        self.window, self.gram = window, gram
        self.items = [i for i, _ in items]
        self.exact: dict[int, dict[bytes, list[int]]] = defaultdict(lambda: defaultdict(list))  # by length, window -> items
        long_docs = []
        for k, (_, text) in enumerate(items):
            w = words_of(text)
            n = min(len(w), window)
            for i in range(len(w) - n + 1 if n else 0):
                self.exact[n][b" ".join(w[i : i + n])].append(k)
            if len(w) >= window:
                long_docs.append(w)
        flat = C.Flat(long_docs)
        grams, chosen, _, _ = C.winnow(flat, gram, window)
        self.fingerprints = np.unique(grams[chosen])
        self.short = {}
        for n, found in self.exact.items():
            self.exact[n] = dict(found)
            if n < window:
                self.short[n] = np.unique(np.array([C.rolling(C.hashes(x.split(b" ")), n)[0] for x in found], np.uint64))
        self.exact = dict(self.exact)

    def scan(self, docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, list[set[int]], np.ndarray, C.Flat]:
        """Words and hit words per document, the items found in each, the mask of hit words, and the flat words."""
        flat = C.Flat(docs)
        hit = np.zeros(len(flat.h), bool)
        found: list[set[int]] = [set() for _ in docs]

        def confirm(starts: np.ndarray, n: int) -> None:
            known = self.exact[n]
            for i in starts.tolist():
                d, p = int(flat.doc[i]), int(flat.pos[i])
                if (items := known.get(b" ".join(docs[d][p : p + n]))) is not None:
                    found[d].update(items)
                    hit[i : i + n] = True

        if len(self.fingerprints) and len(flat.h):
            grams, chosen, _, full = C.winnow(flat, self.gram, self.window)
            seeds = chosen.copy()
            seeds[chosen] = member(grams[chosen], self.fingerprints)
            if seeds.any():
                # Windows over a shared fingerprint are the extensions of the hit; each is compared word by word.
                around = np.zeros(len(flat.h), bool)
                at = np.flatnonzero(seeds)
                for j in range(self.window - self.gram + 1):
                    around[np.maximum(at - j, 0)] = True
                confirm(np.flatnonzero(around & full), self.window)
        for n, keys in self.short.items():
            grams, full = flat.windows(n)
            at = np.flatnonzero(full)
            if len(at):
                confirm(at[member(grams[at], keys)], n)
        return flat.sizes, np.bincount(flat.doc[hit], minlength=len(docs))[: len(docs)], found, hit, flat


def member(x: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of x are in the sorted keys."""
    if not len(keys):
        return np.zeros(len(x), bool)
    return keys[np.minimum(np.searchsorted(keys, x), len(keys) - 1)] == x


def two_hashes(words: list[bytes], starts: list[int], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of the n words from each start."""
    keys = [xxhash.xxh3_128_intdigest(b" ".join(words[i : i + n])) for i in starts]
    low = np.array([k & 0xFFFFFFFFFFFFFFFF for k in keys], np.uint64)
    return low.view(np.int64), np.array([k >> 64 for k in keys], np.uint64).view(np.int64)


def joined(spark: SparkSession, keyed: DataFrame, benchmark: DataFrame, item_col: str, item_text: str) -> DataFrame:
    """(_row, n_hit, items) of the rows (_row, text) with hits, for a benchmark of any size."""
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(item_text).alias("text"))

    def of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The windows of each item, and in ``seed`` a fingerprint: of a short item its only window's hash."""
        for batch in batches:
            for b in C.chunks(batch):
                for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    w = words_of(text)
                    n = min(len(w), WINDOW)
                    if not n:
                        continue
                    a, z = two_hashes(w, list(range(len(w) - n + 1)), n)
                    flat = C.Flat([w])
                    if n == WINDOW:
                        _, _, least, full = C.winnow(flat, GRAM, WINDOW)
                        seeds = C.to_signed(least[full])
                    else:
                        seeds = C.to_signed(C.rolling(flat.h, n)[:1])
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(a), pa.string()), pa.array([n] * len(a), pa.int64()), pa.array(a), pa.array(z), pa.array(seeds)], names=["item", "n", "a", "z", "seed"])

    wins, wins_path = C.stored(spark, items.mapInArrow(of_items, "item string, n bigint, a bigint, z bigint, seed bigint"), "decon-windows")
    near = C.bitmap(spark, wins.select("seed"), "seed")
    lengths = [r["n"] for r in wins.select("n").distinct().collect()]  # at most WINDOW

    def of_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in C.chunks(batch):
                docs = [words_of(t) for t in b.column(1).to_pylist()]
                flat = C.Flat(docs)
                for n in lengths if len(flat.h) else ():
                    if n == WINDOW:
                        _, _, least, full = C.winnow(flat, GRAM, WINDOW)
                        at = np.flatnonzero(full)
                        at = at[near.value.has(least[at])]
                    else:
                        grams, full = flat.windows(n)
                        at = np.flatnonzero(full)
                        at = at[near.value.has(grams[at])]
                    if len(at):
                        doc, pos = flat.doc[at], flat.pos[at]
                        edge = np.append(np.concatenate([[0], np.flatnonzero(doc[1:] != doc[:-1]) + 1]), len(at))
                        hashed = [two_hashes(docs[int(doc[s])], pos[s:e].tolist(), n) for s, e in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
                        cols = [np.concatenate([h[i] for h in hashed]) for i in range(2)]
                        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc)), pa.array(pos.astype(np.int64)), pa.array(np.full(len(at), n, np.int64)), *map(pa.array, cols)], names=["_row", "pos", "n", "a", "z"])

    # Copies of a text have the same candidates: one of each goes on.
    seen, seen_path = C.stored(spark, keyed.mapInArrow(of_docs, "_row string, pos bigint, n bigint, a bigint, z bigint").distinct(), "decon-candidates")
    by = ["n", "a", "z"]
    # Windows that both sides have; then hits by place, and items by document, each window's items once a document.
    known, known_path = C.stored(spark, seen.groupBy(*by).agg(F.count(F.lit(1)).alias("k")).join(wins.select(*by).distinct(), by).withColumn("w", F.monotonically_increasing_id()), "decon-known")
    of = F.xxhash64(*by).alias("key")
    hits = C.join_spread(spark, seen.select("_row", "pos", F.col("n").alias("n0"), F.col("a").alias("a0"), F.col("z").alias("z0"), of), known.select("*", of), "key", "k").filter("n0 = n AND a0 = a AND z0 = z").select("_row", "pos", "n", "w")
    hits, hits_path = C.stored(spark, hits, "decon-hits")
    found = wins.select("item", *by).distinct().join(known, by).select("w", "item")
    asked = hits.select("_row", "w").distinct()
    with_items, pairs_path = C.stored(spark, found.groupBy("w").agg(F.collect_set("item").alias("its")).join(asked.groupBy("w").agg(F.count(F.lit(1)).alias("k")), "w"), "decon-items")
    asked, asked_path = C.stored(spark, asked, "decon-asked")
    per_row = C.join_spread(spark, asked, with_items, "w", "k").select("_row", F.explode("its").alias("item")).distinct().groupBy("_row").agg(F.array_sort(F.collect_set("item")).alias("items"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Length of the union of each row's hit places, which come in order."""
        now, until, total = None, 0, 0
        for b in batches:
            rows, sums = [], []
            for row, pos, n in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if row != now:
                    if now is not None:
                        rows.append(now)
                        sums.append(total)
                    now, until, total = row, 0, 0
                total += max(0, pos + n - max(until, pos))
                until = max(until, pos + n)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string()), pa.array(sums, pa.int64())], names=["_row", "n_hit"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.string()), pa.array([total], pa.int64())], names=["_row", "n_hit"])

    places = hits.select("_row", "pos", "n").repartition(C.partitions(spark), "_row").sortWithinPartitions("_row", "pos")
    out, _ = C.stored(spark, places.mapInArrow(merge, "_row string, n_hit bigint").join(per_row, "_row"), "decon-found")
    C.drop_paths(spark, wins_path, seen_path, known_path, hits_path, pairs_path, asked_path)
    return out


def detect(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", index_bytes: int = INDEX_BYTES, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: id, n_words, n_hit, ``items`` (sorted strings with an occurring window), plus ``carry``."""
    kept = list(dict.fromkeys([id_col, text_col, *carry]))
    src = docs.select(*kept)
    out = [c for c in kept if c != text_col or text_col in carry]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields if f.name in out)
    size = benchmark.agg(F.sum(F.octet_length(item_text) + 64).alias("n")).first()["n"] or 0
    if size <= index_bytes:
        rows = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(item_text).alias("t")).collect()  # at most index_bytes
        index = spark.sparkContext.broadcast(Index([(r["i"] or "", r["t"]) for r in rows]))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            idx: Index = index.value
            for batch in batches:
                for b in C.chunks(batch):
                    n_words, n_hit, found, _, _ = idx.scan([words_of(t) for t in b.column(1).to_pylist()])
                    items = [sorted({idx.items[k] for k in f}) for f in found]
                    yield pa.RecordBatch.from_arrays([b.column(kept.index(c)) for c in out] + [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string()))], names=[*out, "n_words", "n_hit", "items"])

        return src.mapInArrow(scan, fields + ", n_words bigint, n_hit bigint, items array<string>")
    # Rows with one text are hit alike: hits go by the text's hash.
    row = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("_row")
    found = joined(spark, src.select(row, F.col(text_col).alias("text")), benchmark, item_col, item_text)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in C.chunks(batch):
                n = [len(words_of(t)) for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(kept.index(c)) for c in out] + [b.column(len(kept)), pa.array(n, pa.int64())], names=[*out, "_row", "n_words"])

    counted = src.select(*kept, row).mapInArrow(count, fields + ", _row string, n_words bigint")
    merged = counted.join(found, "_row", "left")
    return merged.select(*out, "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect(spark, C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLE_SQL = r"""
WITH dw AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
il AS (SELECT item_id, ws, least(len(ws), 10) AS n FROM iw WHERE len(ws) > 0),
iwin AS (SELECT DISTINCT item_id, n, array_to_string(ws[i : i + n - 1], ' ') AS k FROM (SELECT item_id, n, ws, unnest(range(1, len(ws) - n + 2)) AS i FROM il)),
lens AS (SELECT DISTINCT n FROM iwin),
dwin AS (SELECT r, n, i, array_to_string(ws[i : i + n - 1], ' ') AS k FROM (SELECT r, n, ws, unnest(range(1, len(ws) - n + 2)) AS i FROM dw, lens)),
hits AS (SELECT r, i, d.n, item_id FROM dwin d JOIN iwin USING (n, k)),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS l FROM (SELECT DISTINCT r, item_id::VARCHAR AS s FROM hits) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (r) LEFT JOIN its USING (r)
"""
