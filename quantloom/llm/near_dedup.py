"""MinHash near-duplicates verified by odd sketches.

Each document's set of word shingles gets ``SAMPLES`` MinHash values. Bands of them find candidates. Two parity bitmaps
(odd sketches) then tell which candidates are worth confirming on the full sets, by the population count of their XOR: one
folds the MinHash samples and estimates the similarity of sets of any size; the other folds the set itself, and since each
differing shingle flips one bit, its count is a lower bound of the symmetric difference, nearly exact for usual sizes.

No bucket is expanded into all its pairs. Equal sets are one vertex. In each bucket members are first compared with one
centre (in large buckets the member nearest to the majority sketch), and each vertex confirms its best-estimated link.
Then buckets that still hold several components are compared in blocks: a vertex outside its bucket's largest component
confirms its nearest members of other components, a few, then eight times as many each round, until no colliding pair that
the sketches admit and that could join two components is untested.

Losses: a pair at similarity s misses all bands with probability (1 - s^rows)^bands (3e-7 at 0.85); the sketch of the samples
rejects a pair at the threshold with 1e-9, its own collisions counted (``most_differing``), and the sketch of the sets lies six
standard deviations off. Vertices are 64-bit hashes of sets.

Hot groups: a bucket's rows are salted by its size wherever they meet one row of their bucket, and hot centres, components and
groups of equal texts meet their one row by ``common.join_spread``. A split bucket of m members is dealt into blocks of at least
BLOCK members, CELLS at most until a block has MOST_BLOCK, so each member is sent to at most CELLS cells up to half a million
members and to m / MOST_BLOCK beyond. The comparisons of sketches within a split bucket grow with its square.

Defined results: null and empty texts and those without words have empty sets and link with nothing; texts shorter than a
shingle are one shingle; equal sets are linked; rows that share an id are each judged on their text; null ids never name
a component that has another id. An empty table gives no rows. Only the id and text columns are read.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

SAMPLES = 256
#: Bits of the sketch of the samples and of the sketch of the set.
SKETCH_BITS, SET_BITS = 512, 1024
SAMPLE_WORDS, SKETCH_WORDS = SKETCH_BITS // 64, (SKETCH_BITS + SET_BITS) // 64
#: Probability that the sketch of the samples rejects a pair at the threshold, and standard deviations allowed to that of the sets.
MISS, DEVIATIONS = 1e-9, 6
#: Members of a block of a split bucket: at least, and at most before there are more than CELLS blocks.
BLOCK, MOST_BLOCK, CELLS = 1024, 1 << 16, 8
#: Members of a bucket that share a salt.
SALTED = 512
#: Nearest members that a vertex confirms in the first round over split buckets; each further round takes eight times as many.
FIRST_BEST = 8
#: Members from which a bucket gets a medoid.
LARGE = 16
#: Pairs of one vertex that one group confirms.
FAN = 256

_rng = np.random.RandomState(8)
MULTIPLY = (_rng.randint(0, 1 << 31, SAMPLES, np.int64) * 2 + 1).astype(np.uint32)
ADD = _rng.randint(0, 1 << 32, SAMPLES, np.int64).astype(np.uint32)


def bands_for(percent: int) -> tuple[int, int]:
    """Bands and rows that miss a pair at the threshold with a probability of about 3e-7."""
    return (32, 6) if percent >= 85 else (40, 5) if percent >= 80 else (64, 4)


@functools.cache
def most_differing(percent: int, bits: int = SKETCH_BITS, samples: int = SAMPLES, miss: float = MISS) -> int:
    """Least number of differing bits that a pair at the threshold exceeds with a probability of at most ``miss``.

    Exact: the differing samples are binomial, each flips two random bits, and ``odd`` follows how many bits are then odd.
    """
    apart = 1 - percent / 100
    odd = np.zeros(bits + 1)
    odd[0] = 1.0
    total = np.zeros(bits + 1)
    k = np.arange(bits + 1)
    for d in range(samples + 1):
        total += math.exp(math.lgamma(samples + 1) - math.lgamma(d + 1) - math.lgamma(samples - d + 1) + d * math.log(apart) + (samples - d) * math.log1p(-apart)) * odd
        for _ in range(2):
            up, down = odd * (bits - k) / bits, odd * k / bits
            odd = np.concatenate([[0.0], up[:-1]]) + np.concatenate([down[1:], [0.0]])
    tail = np.cumsum(total[::-1])[::-1]  # tail[z]: probability of z or more
    return int(np.flatnonzero(np.append(tail[1:], 0.0) <= miss)[0])


def most_in_sets(total: np.ndarray, percent: int) -> np.ndarray:
    """Most differing bits of set sketches whose sizes sum to ``total`` and that may still be linked.

    100 |A n B| >= p |A u B| bounds the symmetric difference by total (100 - p) / (100 + p); the bits can't be more, and
    are expected to be fewer where many fall together.
    """
    d = total * (100 - percent) / (100 + percent)
    mean = SET_BITS / 2 * (1 - np.exp(-2 * d / SET_BITS))
    sd = np.sqrt(SET_BITS / 4 * (1 - np.exp(-4 * d / SET_BITS)))
    return np.minimum(np.floor(d + 1e-9), mean + DEVIATIONS * sd)


def most_in_sets_column(total, percent: int):
    """The same as a column."""
    d = total * (100 - percent) / (100 + percent)
    mean = SET_BITS / 2 * (1 - F.exp(-2 * d / SET_BITS))
    sd = F.sqrt(SET_BITS / 4 * (1 - F.exp(-4 * d / SET_BITS)))
    return F.least(F.floor(d + 1e-9).cast("double"), mean + DEVIATIONS * sd)


def shingle_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    flat = C.Flat([C.text_of(t).lower().split() for t in texts])
    grams, _ = flat.windows(words)
    out = []
    for n, at in zip(flat.sizes.tolist(), flat.starts.tolist(), strict=False):
        out.append(np.unique(grams[at : at + n - words + 1]) if n >= words else C.rolling(flat.h[at : at + n], n)[:1] if n else np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values, one row per (non-empty) set."""
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), SAMPLES), np.uint32)
    y = np.empty_like(x)
    with np.errstate(over="ignore"):
        for j in range(SAMPLES):
            np.multiply(x, MULTIPLY[j], out=y)
            np.add(y, ADD[j], out=y)
            out[:, j] = np.minimum.reduceat(y, starts)
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit bucket key per band, distinct between bands."""
    v = sig[:, : bands * rows].reshape(len(sig), bands, rows).astype(np.uint64)
    key = np.arange(bands, dtype=np.uint64)[None, :] * C.ODD
    with np.errstate(over="ignore"):
        for r in range(rows):
            key = C.mix(key ^ (v[:, :, r] + np.uint64(r + 1) * C.ODD))
    return key


def odd_sketches(sig: np.ndarray) -> np.ndarray:
    """Parity bitmaps: sample j with value m flips bit hash(j, m)."""
    with np.errstate(over="ignore"):
        bit = C.mix(sig.astype(np.uint64) | (np.arange(SAMPLES, dtype=np.uint64)[None, :] << np.uint64(32))) % np.uint64(SKETCH_BITS)
    flat = (np.arange(len(sig), dtype=np.int64)[:, None] * SKETCH_BITS + bit.astype(np.int64)).reshape(-1)
    odd = (np.bincount(flat, minlength=len(sig) * SKETCH_BITS) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(len(sig), SKETCH_BITS), axis=1)


def set_sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Parity bitmaps of the sets themselves."""
    bit = (C.mix(np.concatenate(sets)) & np.uint64(SET_BITS - 1)).astype(np.int64)
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    odd = (np.bincount(row * SET_BITS + bit, minlength=len(sets) * SET_BITS) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(len(sets), SET_BITS), axis=1)


def describe(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(id, idh, v, n, bands, sketch) of (id, text) rows; v is null for empty sets."""
    src = docs.select("id", "text", F.xxhash64(F.col("id").cast("string")).alias("idh"), F.xxhash64("text").alias("th"))
    long, shape = T.LongType(), bands_for(percent)
    schema = T.StructType([src.schema["id"], T.StructField("idh", long), T.StructField("v", long), T.StructField("n", long), T.StructField("bands", T.ArrayType(long)), T.StructField("sketch", T.ArrayType(long)), T.StructField("th", long)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in C.chunks(batch):
                sets = shingle_sets(b.column(1).to_pylist(), words)
                full = [s for s in sets if len(s)]
                keep = [len(s) > 0 for s in sets]
                v = [vertex(s) if len(s) else None for s in sets]
                bands: list = [None] * len(sets)
                sketch: list = [None] * len(sets)
                if full:
                    sig = signatures(full)
                    rows = np.flatnonzero(keep).tolist()
                    both = np.concatenate([odd_sketches(sig), set_sketches(full)], axis=1).view(np.int64)
                    for i, k, o in zip(rows, C.to_signed(band_keys(sig, *shape)), both, strict=True):
                        bands[i], sketch[i] = k, o
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(v, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.list_(pa.int64())), b.column(3)], names=schema.names)

    return src.mapInArrow(run, schema)


def vertex(s: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).view(np.int64))


def confirmed(spark: SparkSession, docs: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """Those pairs (a, b) of vertices whose full sets reach the threshold: 100 |A n B| >= percent |A u B|.

    pairs also carry ha and hb, the id hashes of one text of each vertex: only those texts are read (a fixed-size bitmap
    filters the scan). Each group holds one set and at most about FAN partners, so a vertex with any number of partners is
    spread over many groups.
    """
    ends = pairs.select(F.col("ha").alias("h")).unionByName(pairs.select(F.col("hb").alias("h")))
    near = C.bitmap(spark, ends.distinct(), "h", 2 * pairs.count())
    src = docs.select("text", F.xxhash64(F.col("id").cast("string")).alias("idh"))

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = near.value.has(batch.column(1).to_numpy().view(np.uint64))
            for b in C.chunks(batch.filter(pa.array(hit)), 0):
                sets = [s for s in shingle_sets(b.column(0).to_pylist(), words) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([vertex(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["v", "set"])

    sets, sets_path = C.stored(spark, src.mapInArrow(load, "v bigint, set binary"), "near-sets", few=True)
    fans, fans_path = C.stored(spark, pairs.groupBy("a").agg(F.count(F.lit(1)).alias("k")).withColumn("g", F.ceil(F.col("k") / FAN).cast("long")), "near-fans", few=True)
    salted = C.join_spread(spark, pairs.select("a", "b"), fans, "a", "k").select("a", "b", F.pmod(F.xxhash64("b"), F.col("g")).alias("salt"))
    one = sets.withColumnRenamed("v", "a").join(fans, "a").select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("g") - 1)).alias("salt"), F.lit(None).cast("long").alias("b"), "set")
    other = salted.join(sets.withColumnRenamed("v", "b"), "b").select("a", "salt", "b", "set")
    dealt = one.unionByName(other).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, mine = None, None
        for batch in batches:
            a_out, b_out = [], []
            for a, b, s in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                this = np.frombuffer(s.as_buffer(), np.uint64)
                if b is None:
                    held, mine = a, this
                    continue
                assert held == a
                common = int((mine[np.minimum(np.searchsorted(mine, this), len(mine) - 1)] == this).sum())
                if 100 * common >= percent * (len(mine) + len(this) - common):
                    a_out.append(a)
                    b_out.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["a", "b"])

    out, _ = C.stored(spark, dealt.mapInArrow(compare, "a bigint, b bigint"), "near-links", few=True)
    C.drop_paths(spark, sets_path, fans_path)
    return out


def runs_of(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table | None, bool]]:
    """Tables of the rows that share the first ``keys`` columns; (None, True) after each batch."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if b.num_rows:
            k = np.stack([b.column(i).to_numpy() for i in range(keys)])
            edge = np.concatenate([[0], np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1, [b.num_rows]])
            for s, e in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                if held and last != tuple(k[:, s]):
                    yield pa.Table.from_batches(held), False
                    held = []
                held.append(b.slice(s, e - s))
                last = tuple(k[:, s])
        yield None, True
    if held:
        yield pa.Table.from_batches(held), False
    yield None, True


def sketch_words(col: pa.ChunkedArray) -> np.ndarray:
    return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in col.chunks]).view(np.uint64).reshape(-1, SKETCH_WORDS)


def differing(x: str, y: str, first: int, last: int):
    """Column: differing bits of words first to last of two sketch columns."""
    word = lambda i: F.bit_count(F.element_at(x, i + 1).bitwiseXOR(F.element_at(y, i + 1)))
    return sum((word(i) for i in range(first + 1, last)), word(first))


def with_salt(rows: DataFrame) -> DataFrame:
    """Rows (key, v, m, ...) of buckets with m members: about SALTED members of a bucket share a salt."""
    return rows.withColumn("salt", F.pmod(F.xxhash64("v"), F.ceil(F.col("m") / SALTED).cast("long")))


def with_every_salt(buckets: DataFrame) -> DataFrame:
    """One row (key, m, ...) of a bucket for each of its salts: m / SALTED."""
    return buckets.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("m") / SALTED).cast("long") - 1)))


def medoids(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """(key, m, a): of each bucket the member nearest to the bitwise majority of its sketches.

    Where all copies come from one text, that text is the hub that most of them link with. Bits are counted in groups of
    about SALTED members and summed, so no task sees a whole bucket. rows: (key, v, m, sketch).
    """
    rows = with_salt(rows)
    salted = rows.select("key", "salt", "sketch")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, bytes]] = []
        for t, end in runs_of(batches, 2):
            if t is not None:
                bits = np.unpackbits(sketch_words(t.column(2)).view(np.uint8).reshape(t.num_rows, -1), axis=1)
                out.append((t.column(0)[0].as_py(), t.num_rows, bits.sum(axis=0, dtype=np.int64).tobytes()))
            if end and out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["key", "n", "bits"])
                out = []

    def majority(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[int, np.ndarray]] = {}
        for b in batches:
            for key, k, bits in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                had = sums.get(key, (0, 0))
                sums[key] = (had[0] + k, had[1] + np.frombuffer(bits, np.int64))
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(sums.keys(), pa.int64()), pa.array([k for k, _ in sums.values()], pa.int64()), pa.array([np.packbits(2 * x > k).view(np.int64) for k, x in sums.values()], pa.list_(pa.int64()))], names=["key", "m", "middle"])

    parts = salted.repartition("key", "salt").sortWithinPartitions("key", "salt").mapInArrow(count, "key bigint, n bigint, bits binary")
    middle = parts.repartition("key").mapInArrow(majority, "key bigint, m bigint, middle array<bigint>")
    far = F.struct(differing("sketch", "middle", 0, SKETCH_WORDS).alias("z"), "v")
    best = rows.drop("m").join(with_every_salt(middle), ["key", "salt"]).groupBy("key", "m", "salt").agg(F.min(far).alias("p"))
    return best.groupBy("key", "m").agg(F.min("p").alias("p")).select("key", "m", F.col("p.v").alias("a"))


def cells_of(rows: DataFrame) -> DataFrame:
    """Each member of a bucket once for each block that its own is compared with."""
    blocks = F.least(F.ceil(F.col("m") / BLOCK), F.greatest(F.lit(CELLS).cast("long"), F.ceil(F.col("m") / MOST_BLOCK)))
    cells = rows.withColumn("g", blocks.cast("long")).withColumn("c", F.pmod(F.xxhash64("v"), F.col("g")))
    cells = cells.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("g") - 1)))
    return cells.select("key", F.least("c", "o").alias("p"), F.greatest("c", "o").alias("q"), "c", "v", "n", "root", "sketch")


def nearest(spark: SparkSession, rows: DataFrame, percent: int, best: int) -> DataFrame:
    """For vertices outside their bucket's largest component: the ``best`` nearest members of other components.

    rows: (key, m, v, n, sketch, root), m the members of the bucket. Returns (x, y, z); x = y marks that x has more. Buckets
    are compared in blocks x blocks, and what such a cell returns is linear in its members.
    """
    cells = cells_of(rows)
    dealt = cells.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")
    most = most_differing(percent)

    def near(t: pa.Table) -> Iterator[tuple[int, int, int]]:
        p, q, c, v, n, root = (t.column(i).to_numpy() for i in range(1, 7))
        roots, back, times = np.unique(root, return_inverse=True, return_counts=True)
        if len(roots) < 2:
            return
        sk = sketch_words(t.column(7))
        of_samples, of_sets = np.ascontiguousarray(sk[:, :SAMPLE_WORDS]), np.ascontiguousarray(sk[:, SAMPLE_WORDS:])
        for i in np.flatnonzero(back != times.argmax()).tolist():
            ok = (root != root[i]) & (np.minimum(n, n[i]) * 100 >= percent * np.maximum(n, n[i]))
            r = np.flatnonzero(ok & (c != c[i]) if p[0] != q[0] else ok)
            if len(r):
                z = np.bitwise_count(of_sets[r] ^ of_sets[i]).sum(axis=1, dtype=np.int64)
                ok = z <= most_in_sets(n[r] + n[i], percent)
                r, z = r[ok], z[ok]
                ok = np.bitwise_count(of_samples[r] ^ of_samples[i]).sum(axis=1, dtype=np.int64) <= most
                r, z = r[ok], z[ok]
                order = np.lexsort((v[r], z))
                for k in order[:best].tolist():
                    yield int(v[i]), int(v[r[k]]), int(z[k])
                if len(order) > best:
                    yield int(v[i]), int(v[i]), -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, int]] = []
        for t, end in runs_of(batches, 3):
            if t is not None:
                out.extend(near(t))
            if end and out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["x", "y", "z"])
                out = []

    return dealt.mapInArrow(run, "x bigint, y bigint, z bigint")


def both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))


def cluster(spark: SparkSession, docs: DataFrame, words: int = 3, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id (smallest id reachable), kept (the id is its component's).

    ``text_hash`` (xxhash64 of the text) tells rows of one id apart.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    described, _ = C.stored(spark, describe(docs, words, percent), "near-described")
    first = [F.first(c).alias(c) for c in ("idh", "n", "bands", "sketch")]
    reps, reps_path = C.stored(spark, described.filter("v IS NOT NULL").groupBy("v").agg(*first, F.count(F.lit(1)).alias("copies"), F.min("id").alias("low")), "near-vertices", few=True)
    used = [reps_path]

    # Buckets of two and more vertices, each with a centre: large ones their medoid, others their first vertex.
    members = reps.select("v", F.explode("bands").alias("key"))
    firsts, path = C.stored(spark, members.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("v").alias("a")).filter("m > 1"), "near-firsts", few=True)
    used.append(path)
    members, path = C.stored(spark, C.join_spread(spark, members, firsts, "key", "m"), "near-buckets", few=True)
    used.append(path)
    sketches = reps.select("v", "n", "sketch")
    large = medoids(spark, members.filter(F.col("m") >= LARGE).select("key", "v", "m").join(sketches, "v").select("key", "v", "m", "sketch"))
    stars = with_salt(members.filter(F.col("m") >= LARGE).select("key", "v", "m")).drop("m").join(with_every_salt(large), ["key", "salt"]).select("a", F.col("v").alias("b"))
    stars = stars.unionByName(members.filter(F.col("m") < LARGE).select("a", F.col("v").alias("b"))).filter("a <> b").distinct()
    stars, path = C.stored(spark, stars, "near-stars", few=True)
    used.append(path)

    hashed = lambda c: reps.select(F.col("v").alias(c), F.col("idh").alias(f"h{c}"))

    # First round: each vertex confirms its best-estimated link with a centre.
    side = lambda c: reps.select(F.col("v").alias(c), F.col("idh").alias(f"h{c}"), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"))
    centres, path = C.stored(spark, side("a").join(stars.groupBy("a").agg(F.count(F.lit(1)).alias("k")), "a"), "near-centres", few=True)
    used.append(path)
    stars = C.join_spread(spark, stars, centres, "a", "k").join(side("b"), "b").filter(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
    stars = stars.withColumn("z", differing("s_a", "s_b", SAMPLE_WORDS, SKETCH_WORDS)).filter(F.col("z") <= most_in_sets_column(F.col("n_a") + F.col("n_b"), percent))
    stars = stars.filter(differing("s_a", "s_b", 0, SAMPLE_WORDS) <= most_differing(percent))
    tried, path = C.stored(spark, stars.groupBy("b").agg(F.min(F.struct("z", "a", "ha", "hb")).alias("p")).select(F.col("p.a").alias("a"), "b", "p.ha", "p.hb"), "near-tried", few=True)
    used.append(path)
    links = confirmed(spark, docs, tried, words, percent)
    roots = C.components(spark, links, "near-roots")

    # Further rounds: buckets that still hold several components, nearest members first, until no candidate is untried.
    best, rest = FIRST_BEST, True
    while rest:
        rooted = members.select("key", "v", "m").join(roots, "v", "left").withColumn("root", F.coalesce("root", "v"))
        split = rooted.groupBy("key", "m").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("key", "m")
        rows = with_salt(rooted).join(with_every_salt(split).drop("m"), ["key", "salt"]).join(sketches, "v").select("key", "m", "v", "n", "root", "sketch")
        order = Window.partitionBy("x").orderBy("z", "y")
        # Buckets that share members name the same pairs: each goes on once, and of a vertex no more ranks than are looked at.
        ranked = nearest(spark, rows, percent, best).distinct().withColumn("r", F.dense_rank().over(order)).filter(F.col("r") <= best + 2)
        near, near_path = C.stored(spark, ranked, "near-nearest", few=True)
        rest = not near.filter((F.col("x") == F.col("y")) | (F.col("r") > best + 1)).isEmpty()
        pairs = near.filter((F.col("x") != F.col("y")) & (F.col("r") <= best + 1)).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        pairs = pairs.join(both_ways(tried), ["a", "b"], "left_anti").join(hashed("a"), "a").join(hashed("b"), "b").select("a", "b", "ha", "hb")
        pairs, path = C.stored(spark, pairs, "near-pairs", few=True)
        used.append(path)
        C.drop_paths(spark, near_path)
        best *= 8
        if pairs.isEmpty():
            continue
        more = confirmed(spark, docs, pairs, words, percent)
        of = lambda c: roots.select(F.col("v").alias(c), F.col("root").alias(f"r_{c}"))  # noqa: B023, E731
        lifted = more.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("r_a", "a").alias("a"), F.coalesce("r_b", "b").alias("b"))
        joined = C.components(spark, lifted, "near-joined")
        known = roots.unionByName(joined.select("v", F.col("v").alias("root")).join(roots, "v", "left_anti"))
        roots, path = C.stored(spark, known.join(joined.select(F.col("v").alias("root"), F.col("root").alias("top")), "root", "left").select("v", F.coalesce("top", "root").alias("root")), "near-roots", few=True)
        used.append(path)
        tried = tried.unionByName(pairs)

    # Names: the least id of each component, back to its vertices, and on to their documents.
    final, path = C.stored(spark, reps.select("v", "copies", "low").join(roots, "v", "left").withColumn("root", F.coalesce("root", "v")), "near-final", few=True)
    used.append(path)
    names, path = C.stored(spark, final.groupBy("root").agg(F.min("low").alias("component_id"), F.count(F.lit(1)).alias("k")), "near-names", few=True)
    used.append(path)
    named, _ = C.stored(spark, C.join_spread(spark, final, names, "root", "k").select("v", "copies", "component_id"), "near-named", few=True)
    C.drop_paths(spark, *used)
    rows = described.select("id", "n", "v", "th")
    out = C.join_spread(spark, rows.filter("v IS NOT NULL"), named, "v", "copies").select("id", "n", "th", "component_id")
    out = out.unionByName(rows.filter("v IS NULL").select("id", "n", "th", F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"), F.col("th").alias("text_hash"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(spark, C.table(spark, sf_dir, "documents")).drop("text_hash")


ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + least(len(ws), 3) - 1], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - least(len(ws), 3) + 2)) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
walk AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT walk.x, u.b FROM walk JOIN u ON u.a = walk.y),
c AS (SELECT x, min(y) AS m FROM walk GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.m AS component_id, d.doc_id = c.m AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN c ON c.x = d.doc_id
"""
