"""Variable-capacity best-fit packing of token ids.

Texts are encoded (with an end id each) by the tokenizer of ``token_files`` and packed where they are read: there is no shuffle.
Several sequence lengths are permitted. Documents longer than the largest are cut into full pieces and a rest; nothing is
dropped. A task gathers the pieces of its rows up to ``HELD_IDS`` ids (a tail's waste against many thousand bins), and plans
over their histogram of lengths: open a bin for the longest piece left, try every permitted size, fill each by best fit (the
longest pieces that still fit), keep the size with the least cost per token, and repeat that bin for as long as its pieces last.
Every bin is then downsized to the smallest permitted length that holds it.

Sequences are written as Parquet, one folder for each capacity, one row for each sequence: its ids bit-packed as in
``token_files``, and for each piece the document, piece number, start in the document and length. A lost task packs its rows
again alike.

Defined results: a null or empty text has the end id only (length 1); ties of length go by the order of the rows; repeated rows
are packed each; very long texts are cut into as many pieces as they need; an empty table gives no rows. Only the id and text
columns are read, so others may have any name.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C
from . import token_files

CAPACITIES = (512, 1024, 2048, 4096)
#: What one more sequence costs besides its places.
PER_SEQUENCE = 16
#: Ids that a task holds to plan over (16 MB at 16 bits, some thousand sequences), and sequences of a batch that it hands on.
HELD_IDS, OUT_BINS = 1 << 23, 512


def price(capacity: int) -> float:
    return capacity + PER_SEQUENCE


@dataclass
class Bins:
    """``times`` equal bins: [(length, how many of it)], their final capacity and the first bin's number."""

    first: int
    times: int
    capacity: int
    parts: list[tuple[int, int]]


def plan(histogram: dict[int, int], capacities: tuple[int, ...] = CAPACITIES, cost: Callable[[int], float] = price) -> list[Bins]:
    sizes = sorted(capacities)
    left = {n: c for n, c in histogram.items() if c}
    lengths = sorted(left)
    out: list[Bins] = []
    number = 0

    def fill(capacity: int) -> list[tuple[int, int]]:
        n = lengths[-1]
        k = min(left[n], capacity // n)
        parts, room = [(n, k)], capacity - k * n
        at = bisect_right(lengths, min(room, n - 1)) - 1
        while at >= 0 and room:
            n = lengths[at]
            k = min(left[n], room // n)
            parts.append((n, k))
            room -= k * n
            at = min(at - 1, bisect_right(lengths, room) - 1)
        return parts

    while lengths:
        best = None
        for c in sizes:
            if c < lengths[-1]:
                continue
            parts = fill(c)
            used = sum(n * k for n, k in parts)
            final = next(s for s in sizes if s >= used)
            score = (cost(final) / used, final)
            if best is None or score < best[0]:
                best = (score, parts, final)
        _, parts, final = best
        times = min(left[n] // k for n, k in parts)
        out.append(Bins(number, times, final, parts))
        number += times
        for n, k in parts:
            left[n] -= k * times
            if not left[n]:
                del left[n]
                lengths.remove(n)
    return out


def ranks(bins: list[Bins]) -> dict[int, list[tuple[int, int, int, int, int]]]:
    """By length: (first rank, pieces a bin, first bin, offset of the first piece, capacity), in rank order."""
    out: dict[int, list[tuple[int, int, int, int, int]]] = {}
    seen: dict[int, int] = {}
    for b in bins:
        offset = 0
        for n, k in b.parts:
            insort(out.setdefault(n, []), (seen.get(n, 0), k, b.first, offset, b.capacity))
            seen[n] = seen.get(n, 0) + k * b.times
            offset += n * k
    return out


def encode_words(texts: list[str | None], end_id: int = token_files.END_ID) -> list[np.ndarray]:
    """A stand-in for a tokenizer: crc32 of each word, and an end id."""
    return [np.array([zlib.crc32(w) for w in C.ascii_words(t)] + [end_id], np.uint32) for t in texts]


def packed_schema(kind: T.DataType) -> T.StructType:
    """Columns of the packed sequences, for ids of this type. A sequence's number counts within its shard (the task)."""
    long, many = T.LongType(), T.ArrayType(T.LongType())
    return T.StructType([T.StructField("shard", long), T.StructField("bin", long), T.StructField("capacity", long), T.StructField("n_ids", long), T.StructField("doc_ids", T.ArrayType(kind)), T.StructField("pieces", many), T.StructField("lengths", many), T.StructField("ids", T.BinaryType())])


def placed(sizes: np.ndarray, capacities: tuple[int, ...], cost: Callable[[int], float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset in it, its capacity) of each piece; pieces of one length take their places in order."""
    lengths, counts = np.unique(sizes, return_counts=True)
    table = ranks(plan(dict(zip(lengths.tolist(), counts.tolist(), strict=True)), capacities, cost))
    base = np.concatenate([[0], np.cumsum(counts)])  # ranks are counted on through all lengths
    steps = np.array([(base[i] + first, k, start, offset, capacity) for i, n in enumerate(lengths.tolist()) for first, k, start, offset, capacity in table[n]], np.int64).reshape(-1, 5)
    rank = np.empty(len(sizes), np.int64)
    rank[np.argsort(sizes, kind="stable")] = np.arange(len(sizes))
    s = steps[np.searchsorted(steps[:, 0], rank, side="right") - 1]
    j, t = np.divmod(rank - s[:, 0], s[:, 1])
    return s[:, 2] + j, s[:, 3] + t * sizes, s[:, 4]


def write(spark: SparkSession, docs: DataFrame, path: str, vocab: str | None = None, capacities: tuple[int, ...] = CAPACITIES, cost: Callable[[int], float] = price, id_col: str = "doc_id", text_col: str = "text", held_ids: int = HELD_IDS) -> None:
    """Encode, plan and write the packed sequences. ``vocab``: a tokenizer file; without one, words stand for tokens."""
    top = max(capacities)
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = src.schema[0].dataType
    schema = packed_schema(kind)
    bits = token_files.bits_for(max(token_files.encoder(vocab).size, token_files.END_ID + 1)) if vocab else 32

    def sequences(ids: pa.Array, tokens: list[np.ndarray], shard: int, number: int) -> Iterator[pa.RecordBatch]:
        """All pieces of some rows, packed; about OUT_IDS ids to a batch."""
        total = np.array([len(x) for x in tokens], np.int64)
        n = -(-total // top)
        row = np.repeat(np.arange(len(tokens)), n)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        size = np.minimum(top, total[row] - piece * top)
        bins, offset, capacity = placed(size, capacities, cost)
        order = np.lexsort((offset, bins))
        bins, row, piece, size, capacity = (x[order] for x in (bins, row, piece, size, capacity))
        first = np.concatenate([[0], np.flatnonzero(bins[1:] != bins[:-1]) + 1])
        n_ids = np.add.reduceat(size, first)
        edge = np.append(first, len(bins))
        for at in range(0, len(first), OUT_BINS):
            lo, hi = edge[at], edge[min(at + OUT_BINS, len(first))]
            some = slice(at, min(at + OUT_BINS, len(first)))
            parts = [tokens[r][p * top : p * top + s] for r, p, s in zip(row[lo:hi].tolist(), piece[lo:hi].tolist(), size[lo:hi].tolist(), strict=True)]
            data = [token_files.pack(np.concatenate(parts[s - lo : e - lo]), bits) for s, e in zip(edge[some].tolist(), edge[some.start + 1 : some.stop + 1].tolist(), strict=True)]
            ends = pa.array((edge[some.start : some.stop + 1] - lo).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, x) for x in (ids.take(pa.array(row[lo:hi])), pa.array(piece[lo:hi]), pa.array(size[lo:hi]))]
            count = some.stop - some.start
            yield pa.RecordBatch.from_arrays([pa.array(np.full(count, shard)), pa.array(number + bins[first[some]]), pa.array(capacity[first[some]]), pa.array(n_ids[some]), *lists, pa.array(data, pa.binary())], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, number, ids, tokens, have = TaskContext.get().partitionId(), 0, [], [], 0

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal number, ids, tokens, have
            for b in sequences(pa.concat_arrays(ids), tokens, shard, number):
                last = b.column(1)[b.num_rows - 1].as_py() + 1
                yield b
            number, ids, tokens, have = last, [], [], 0

        for batch in batches:
            for b in C.chunks(batch):
                new = (token_files.encoder(vocab).encode if vocab else encode_words)(b.column(1).to_pylist(), token_files.END_ID)
                ids.append(b.column(0))
                tokens += new
                have += sum(map(len, new))
                if have >= held_ids:
                    yield from packed()
        if tokens:
            yield from packed()

    src.mapInArrow(run, schema).write.partitionBy("capacity").parquet(path)


def shard_offsets(spark: SparkSession, path: str, kind: T.DataType) -> dict[int, int]:
    """Sequences before each shard: one total per shard reaches the driver."""
    out, total = {}, 0
    rows = spark.read.schema(packed_schema(kind)).parquet(path).groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()
    for r in sorted(rows, key=lambda r: r["shard"]):
        out[r["shard"]], total = total, total + r["n"]
    return out


def read(spark: SparkSession, path: str, vocab: str | None = None, capacities: tuple[int, ...] = CAPACITIES, id_col: str = "doc_id", kind: T.DataType = T.LongType()) -> DataFrame:  # noqa: B008
    """The pieces of the packed sequences: id, piece, start, length, bin_id, capacity, offset, and the crc32 of their ids."""
    rows = spark.read.schema(packed_schema(kind)).parquet(path)
    offsets = spark.sparkContext.broadcast(shard_offsets(spark, path, kind))
    bits, top = token_files.bits_for(max(token_files.encoder(vocab).size, token_files.END_ID + 1)) if vocab else 32, max(capacities)
    long = T.LongType()
    schema = T.StructType([T.StructField(id_col, kind), *[T.StructField(c, long) for c in ("piece", "start", "length", "bin_id", "capacity", "offset", "ids_crc32")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            doc, piece, sizes = (b.column(i).flatten() for i in (4, 5, 6))
            sizes, per = sizes.to_numpy(), np.diff(b.column(6).offsets.to_numpy())
            offset = np.cumsum(sizes) - sizes
            offset -= np.repeat(offset[np.cumsum(per) - per], per)
            crc, at = np.empty(len(sizes), np.int64), 0
            for i, n in enumerate(per.tolist()):
                raw = memoryview(token_files.unpack(b.column(7)[i].as_buffer(), b.column(3)[i].as_py(), bits).astype("<u4").tobytes())
                for j in range(at, at + n):
                    crc[j] = zlib.crc32(raw[4 * offset[j] : 4 * (offset[j] + sizes[j])])
                at += n
            first = np.array([offsets.value[x] for x in b.column(0).to_pylist()], np.int64)
            bins, capacity = (np.repeat(x, per) for x in (first + b.column(1).to_numpy(), b.column(2).to_numpy()))
            yield pa.RecordBatch.from_arrays([doc, piece, pa.array(piece.to_numpy() * top), pa.array(sizes), pa.array(bins), pa.array(capacity), pa.array(offset), pa.array(crc)], names=schema.names)

    return rows.select(*packed_schema(kind).names).mapInArrow(run, schema)


def pack(spark: SparkSession, docs: DataFrame, vocab: str | None = None, capacities: tuple[int, ...] = CAPACITIES, cost: Callable[[int], float] = price, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs into a new folder of the shared storage and reads the pieces back."""
    path = C.new_path(spark, "packed")
    write(spark, docs, path, vocab, capacities, cost, id_col, text_col)
    return read(spark, path, vocab, capacities, id_col, docs.schema[id_col].dataType)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, C.table(spark, sf_dir, "documents"), token_files.vocabulary_path())
