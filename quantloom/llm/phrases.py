"""Repeated passages removed by sharded phrase automata.

A window is ``WINDOW`` consecutive words; a word goes if a window over it also starts earlier. Steps:

1. Fingerprints (winnowed ``GRAM``-word hashes) are counted; every window holds one, so only windows over a recurring
   fingerprint can recur. The recurring ones fill a bitmap of fixed size; its false positives only cost work.
2. Such windows are confirmed: their hashes meet by hash, in compressed column blobs, and each recurring window learns its
   first place. Windows with very many occurrences are found before from combined counts and sent to all tasks: there are
   at most (all windows) / (number of blocks), which is a constant number of windows per block of text.
3. Documents are dealt into blocks of bounded text. The fingerprint phrases of the windows that recur in a block are
   compiled into Aho-Corasick automata over the block's own vocabulary, ``PATTERNS`` phrases to an automaton, and all
   documents of the block are streamed through them. The windows over each occurrence are compared whole with the recurring
   ones, and each that is not the first marks its words. Phrases are taken from the block's own text, so a block holds
   each once however many of its documents repeat it.

Rows that repeat whole (id and text) are folded to one with a count before each shuffle, batch by batch, and unfolded at the end,
so a row repeated very often doesn't fill its block.

Defined results: null and empty texts have no words; texts shorter than a window lose nothing; null ids come before all
others; rows that share an id count as one document (only the start decides), rows that repeat whole are judged alike; of windows
that tie in id and start (rows of one id) none is later than the other. A very long text is a block's only text and held whole by
one task. An empty table gives no rows. Ids are integers. Only the id and text columns are read, so others may have any name.
Windows and repeated rows meet by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

WINDOW = 20
GRAM = 10
BLOCK_BYTES = 4 << 20
#: Phrases in one automaton: about 80 MB.
PATTERNS = 50_000
#: A window is sent to all blocks from this many occurrences: HOT, and HOT_BLOCKS for each block up to HOT_MOST, yet never
#: less than one for each block.
HOT, HOT_BLOCKS, HOT_MOST = 64, 16, 200_000
FIRST = -(1 << 63)


def to_blob(*cols: np.ndarray) -> bytes:
    return zstandard.compress(np.uint32(len(cols[0])).tobytes() + b"".join(np.ascontiguousarray(c).tobytes() for c in cols), 1)


def from_blobs(blobs: list[bytes], kinds: tuple[str, ...]) -> list[np.ndarray]:
    parts: list[list[np.ndarray]] = [[] for _ in kinds]
    for blob in blobs:
        raw = zstandard.decompress(blob)
        n, at = int(np.frombuffer(raw, np.uint32, 1)[0]), 4
        for i, k in enumerate(kinds):
            col = np.frombuffer(raw, k, n, at)
            parts[i].append(col)
            at += col.nbytes
    return [np.concatenate(p) if p else np.zeros(0, k) for p, k in zip(parts, kinds, strict=True)]


def dealt(to: np.ndarray, *cols: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Blobs of the rows for each value of ``to``."""
    order = np.argsort(to, kind="stable")
    to = to[order]
    edge = np.concatenate([[0], np.flatnonzero(to[1:] != to[:-1]) + 1, [len(to)]]) if len(to) else np.zeros(1, np.int64)
    for s, e in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        yield int(to[s]), to_blob(*(c[order[s:e]] for c in cols))


def rows_of(blobs: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p for p, _ in blobs], pa.int64()), pa.array([b for _, b in blobs], pa.binary())], names=["to", "data"])


def ids_of(col: pa.Array) -> np.ndarray:
    return C.pc.fill_null(col, FIRST).to_numpy(zero_copy_only=False).astype(np.int64)


def grouped(key: np.ndarray) -> np.ndarray:
    """Starts of the groups of equal sorted keys."""
    return np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1]) if len(key) else np.zeros(0, np.int64)


def folded(b: pa.RecordBatch, hash_col: int) -> tuple[pa.RecordBatch, np.ndarray]:
    """The rows of a batch that differ in the hash of id and text, and how often each stands in it."""
    _, one, times = np.unique(b.column(hash_col).to_numpy(), return_index=True, return_counts=True)
    return (b, np.ones(b.num_rows, np.int64)) if len(one) == b.num_rows else (b.take(pa.array(one)), times)


def member(x: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return keys[np.minimum(np.searchsorted(keys, x), len(keys) - 1)] == x if len(keys) else np.zeros(len(x), bool)


def gather(df: DataFrame, n: int, kinds: tuple[str, ...], reduce, schema: str) -> DataFrame:
    """Blobs (to, data) brought together by ``to`` in n tasks, each of which reduces its columns at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = [x for b in batches for x in b.column(1).to_pylist()]
        if blobs:
            yield from reduce(*from_blobs(blobs, kinds))

    return df.repartitionById(n, F.col("to").cast("int")).mapInArrow(run, schema)


BLOBS = "to bigint, data binary"


class Automata:
    """Aho-Corasick automata over phrases of one block, in shards of PATTERNS phrases."""

    def __init__(self, texts: list[str], phrases: list[tuple[int, int]], words: int):
        self.texts, self.phrases, self.words = texts, phrases, words

    def occurrences(self) -> Iterator[tuple[int, np.ndarray]]:
        """(document, word positions of phrases), once for each document and shard with any."""
        import ahocorasick

        for at in range(0, len(self.phrases), PATTERNS):
            machine = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
            for d, s in self.phrases[at : at + PATTERNS]:
                machine.add_word(self.texts[d][2 * s : 2 * (s + self.words)])
            machine.make_automaton()
            for d, t in enumerate(self.texts):
                if len(t) >= 2 * self.words and (ends := [e for e, _ in machine.iter(t)]):
                    yield d, (np.array(ends, np.int64) + 1) // 2 - self.words


def symbols(flat: C.Flat) -> list[str]:
    """Each document as a string over the block's own vocabulary, two characters to a word.

    The first is one of 256 and the second tells its words apart, so no node of an automaton has many children (they are
    searched one by one); the ranges are disjoint, so matches stay aligned to words.
    """
    _, code = np.unique(flat.h, return_inverse=True)
    pair = np.stack([1 + (code & 255), 0x10000 + (code >> 8)], axis=1).astype("<u4")
    return [pair[s:e].tobytes().decode("utf-32-le") for s, e in zip(flat.starts[:-1].tolist(), flat.starts[1:].tolist(), strict=True)]


def locate(ids: np.ndarray, docs: list[list[bytes]], records: list[np.ndarray], hot: tuple[np.ndarray, ...], window: int, gram: int) -> list[np.ndarray]:
    """Which words of each document go. records: id, start, tag, first id, first start of recurring windows here.

    The phrases compiled are the fingerprint grams of the recurring windows: wherever such a window stands, its phrase
    stands at the same place in it. The windows over each occurrence are then compared whole with the recurring ones.
    """
    gone = [np.zeros(len(d), bool) for d in docs]
    rid, start, tag, fid, fstart = records
    if not len(rid) and not len(hot[0]):
        return gone
    rows: dict[int, list[int]] = {}
    for d, i in enumerate(ids.tolist()):
        rows.setdefault(i, []).append(d)
    flat = C.Flat(docs)
    wh, _ = flat.windows(window)
    grams, _, least, full = C.winnow(flat, gram, window)
    places: list[int] = []
    firsts: list[tuple[int, int]] = []
    for i, s, g, fi, fs in zip(*(x.tolist() for x in (rid, start, tag, fid, fstart)), strict=True):
        for d in rows.get(i, ()):
            # Of several rows with one id, the window stands in those whose window has its tag.
            if s + window <= len(docs[d]) and (len(rows[i]) == 1 or int(wh[flat.starts[d] + s]) & 0xFFFFFFFF == g):
                places.append(int(flat.starts[d]) + s)
                firsts.append((fi, fs))
                break
    if len(hot[0]):
        at = np.flatnonzero(full)
        at = at[member(wh[at], hot[0])]
        _, one = np.unique(wh[at], return_index=True)
        k = np.searchsorted(hot[0], wh[at[one]])
        places += at[one].tolist()
        firsts += list(zip(hot[1][k].tolist(), hot[2][k].tolist(), strict=True))
    if not places:
        return gone
    texts = symbols(flat)
    at = np.array(places, np.int64)
    doc, pos = flat.doc[at], flat.pos[at]
    whole = {texts[d][2 * s : 2 * (s + window)]: f for d, s, f in zip(doc.tolist(), pos.tolist(), firsts, strict=True)}
    recurring = np.unique(wh[at])
    place = at.copy()
    for j in range(window - gram, -1, -1):
        place = np.where(grams[at + j] == least[at], at + j, place)
    _, one = np.unique(least[at], return_index=True)
    phrases = list(zip(flat.doc[place[one]].tolist(), flat.pos[place[one]].tolist(), strict=True))
    candidates: dict[int, list[np.ndarray]] = {}
    for d, p in Automata(texts, phrases, gram).occurrences():
        candidates.setdefault(d, []).append(p)
    for d, found in candidates.items():
        n = len(docs[d])
        s = np.unique((np.concatenate(found)[:, None] - np.arange(window - gram + 1)[None, :]).reshape(-1))
        s = s[(s >= 0) & (s + window <= n)]
        s = s[member(wh[flat.starts[d] + s], recurring)]
        t, me = texts[d], int(ids[d])
        later = [i for i in s.tolist() if (f := whole.get(t[2 * i : 2 * (i + window)])) is not None and f != (me, i)]
        if later:
            edge = np.zeros(n + 1, np.int64)
            edge[later] += 1
            edge[np.array(later) + window] -= 1
            gone[d] = np.cumsum(edge)[:-1] > 0
    return gone


def dedup(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row per document: id, n_words, n_removed and the kept words joined by spaces (with ``digest``: their sha256)."""
    parts = C.partitions(spark)
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("rh", F.xxhash64("id", "text"))
    total = src.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n_blocks = max(1, -(-total // BLOCK_BYTES))
    hot_at = max(HOT, n_blocks, min(HOT_BLOCKS * n_blocks, HOT_MOST))

    def part_of(h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(40)).astype(np.int64) % parts

    # 1. Recurring fingerprints.
    def fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in C.chunks(folded(batch, 2)[0]):
                grams, chosen, _, _ = C.winnow(C.Flat(map(C.ascii_words, b.column(1).to_pylist())), gram, window)
                fp, n = np.unique(grams[chosen], return_counts=True)
                yield rows_of(list(dealt(part_of(fp), fp, n.astype(np.int32))))

    def count(fp: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        one, back = np.unique(fp, return_inverse=True)
        times = np.bincount(back, n).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(C.to_signed(one[times > 1])), pa.array(times[times > 1])], names=["fp", "n"])

    # Kept by Spark, not as a working table: it is read right away, and each file that an executor writes starts a process there.
    seeds = gather(src.mapInArrow(fingerprints, BLOBS), parts, ("u8", "i4"), count, "fp bigint, n bigint").persist(StorageLevel.DISK_ONLY)
    near = C.bitmap(spark, seeds, "fp")

    # 2a. Windows with so many occurrences that they are sent to all blocks: at most (all windows) / n_blocks.
    hot_seeds = np.sort(np.array([r["fp"] for r in seeds.filter(F.col("n") >= hot_at).select("fp").toLocalIterator()], np.int64).view(np.uint64))
    seeds.unpersist()
    hot = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    if len(hot_seeds):
        known = spark.sparkContext.broadcast(hot_seeds)

        def hot_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for b in C.chunks(folded(batch, 2)[0]):
                    flat = C.Flat(map(C.ascii_words, b.column(1).to_pylist()))
                    _, _, least, full = C.winnow(flat, gram, window)
                    at = np.flatnonzero(full)
                    at = at[member(least[at], known.value)]
                    wh = flat.windows(window)[0][at]
                    ids, pos = ids_of(b.column(0))[flat.doc[at]], flat.pos[at]
                    order = np.lexsort((pos, ids, wh))
                    g = grouped(wh[order])
                    n = np.diff(np.append(g, len(order)))
                    one = order[g]
                    yield rows_of(list(dealt(part_of(wh[one]), wh[one], n.astype(np.int64), ids[one], pos[one].astype(np.int64))))

        def first_of_hot(wh, n, ids, pos) -> Iterator[pa.RecordBatch]:
            order = np.lexsort((pos, ids, wh))
            g = grouped(wh[order])
            times = np.add.reduceat(n[order], g)
            one = order[g[times >= hot_at]]
            yield pa.RecordBatch.from_arrays([pa.array(C.to_signed(wh[one])), pa.array(ids[one]), pa.array(pos[one])], names=["wh", "id", "start"])

        rows = gather(src.mapInArrow(hot_windows, BLOBS), parts, ("u8", "i8", "i8", "i8"), first_of_hot, "wh bigint, id bigint, start bigint").collect()
        cols = np.array([(r["wh"], r["id"], r["start"]) for r in rows], np.int64).reshape(-1, 3)
        cols = cols[np.argsort(cols[:, 0].copy().view(np.uint64))]
        hot = (cols[:, 0].copy().view(np.uint64), cols[:, 1].copy(), cols[:, 2].copy())
    hot_known = spark.sparkContext.broadcast(hot)

    # 2b. All other windows over a recurring fingerprint meet by hash; later ones become patterns of their blocks.
    placed = src.withColumn("block", F.pmod("rh", F.lit(n_blocks)))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in C.chunks(folded(batch, 2)[0]):
                flat = C.Flat(map(C.ascii_words, b.column(1).to_pylist()))
                _, _, least, full = C.winnow(flat, gram, window)
                at = np.flatnonzero(full)
                at = at[near.value.has(least[at])]
                wh = flat.windows(window)[0][at]
                cold = ~member(wh, hot_known.value[0])
                at, wh = at[cold], wh[cold]
                doc = flat.doc[at]
                yield rows_of(list(dealt(part_of(wh), wh, ids_of(b.column(0))[doc], flat.pos[at].astype(np.int32), b.column(3).to_numpy()[doc].astype(np.int32))))

    def patterns(wh, ids, pos, block) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((pos, ids, wh))
        wh, ids, pos, block = (x[order] for x in (wh, ids, pos, block))
        g = grouped(wh)
        first = np.repeat(g, np.diff(np.append(g, len(wh))))
        later = np.flatnonzero((ids != ids[first]) | (pos != pos[first]))
        # One pattern for each window and block.
        by = later[np.lexsort((wh[later], block[later]))]
        new = np.ones(len(by), bool)
        new[1:] = (wh[by][1:] != wh[by][:-1]) | (block[by][1:] != block[by][:-1])
        by = by[new]
        by = by[np.lexsort((pos[by], ids[by], block[by]))]
        f = first[by]
        yield rows_of(list(dealt(block[by].astype(np.int64), ids[by], pos[by], wh[by].astype(np.uint32), ids[f], pos[f])))

    found = gather(placed.mapInArrow(candidates, BLOBS), parts, ("u8", "i8", "i4", "i4"), patterns, BLOBS)

    # 3. Each block's documents through its automata.
    long, text = T.LongType(), T.StringType()
    last = "kept_sha256" if digest else "kept_text"
    schema = T.StructType([T.StructField(id_col, long), T.StructField("n_words", long), T.StructField("n_removed", long), T.StructField(last, text)])
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b, times = folded(batch, 2)
            yield pa.RecordBatch.from_arrays([b.column(3), b.column(0), b.column(1), b.column(2), pa.array(times), pa.nulls(b.num_rows, pa.binary())], names=["block", "id", "text", "rh", "times", "data"])

    rows = placed.mapInArrow(fold, "block bigint, id bigint, text string, rh bigint, times bigint, data binary")
    none = lambda t, n: F.lit(None).cast(t).alias(n)
    both = rows.unionByName(found.select(F.col("to").alias("block"), none("long", "id"), none("string", "text"), none("long", "rh"), none("long", "times"), "data"))
    dealt_out = both.repartitionById(parts, F.col("block").cast("int")).sortWithinPartitions("block", "rh")

    def finish(ids: list, texts: list, times: list[int], blobs: list[bytes]) -> pa.RecordBatch:
        docs = [C.ascii_words(t) for t in texts]
        keys = np.array([FIRST if i is None else i for i in ids], np.int64)
        gone = locate(keys, docs, from_blobs(blobs, ("i8", "i4", "u4", "i8", "i4")), hot_known.value, window, gram)
        kept = [b" ".join(w for w, x in zip(d, g.tolist(), strict=True) if not x) if g.any() else b" ".join(d) for d, g in zip(docs, gone, strict=True)]
        out = [hashlib.sha256(k).hexdigest() for k in kept] if digest else [k.decode("utf-8", "surrogatepass") for k in kept]
        one = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(d) for d in docs], pa.int64()), pa.array([int(g.sum()) for g in gone], pa.int64()), pa.array(out, pa.string())], names=schema.names)
        yield one
        more = np.array(times, np.int64) - 1  # repeated rows, a batch's worth at a time
        while (left := np.flatnonzero(more > 0)).size:
            again = np.repeat(left, np.minimum(more[left], max(1, 10_000 // len(left))))
            yield one.take(pa.array(again))
            more -= np.bincount(again, minlength=len(more))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, texts, times, blobs, last = None, [], [], [], [], None
        for batch in batches:
            for block, i, t, rh, n, data in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                if block != now:
                    if ids:
                        yield from finish(ids, texts, times, blobs)
                    now, ids, texts, times, blobs, last = block, [], [], [], [], None
                if data is not None:
                    blobs.append(data)
                elif rh == last:  # the same row from another batch
                    times[-1] += n
                else:
                    ids.append(i)
                    texts.append(t)
                    times.append(n)
                    last = rh
        if ids:
            yield from finish(ids, texts, times, blobs)

    return dealt_out.mapInArrow(stream, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark, C.table(spark, sf_dir, "documents"), digest=True)


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, i, md5(array_to_string(ws[i : i + 19], ' ')) AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM d)),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM w),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM f WHERE r > 1),
n AS (SELECT doc_id, count(*) AS n, list(p) AS ps FROM g GROUP BY doc_id),
a AS (SELECT d.doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word FROM d),
k AS (SELECT a.doc_id, string_agg(word, ' ' ORDER BY a.p) AS t FROM a LEFT JOIN g ON g.doc_id = a.doc_id AND g.p = a.p WHERE g.p IS NULL GROUP BY a.doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)
"""
