"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Keys stand on a 64-bit ring; each shard owns the arcs before its virtual nodes. A shard takes keys up to its capacity,
``(1 + slack) / shards`` of all bytes; what overflows goes on clockwise to the next shards with room. The law kept is
``bytes``: no shard exceeds its capacity by more than single rows, so all sizes are near equal.

Scale: per-arc totals (arcs = shards x virtual nodes, a parameter) decide where arcs are cut; rows are dealt by ring
position, so an arc that holds a third of all rows is cut like any other. Nothing per row reaches the driver.

Defined results: columns of other names, clashing ones too, are not read; a very long text is one row and goes to one shard whole
(so shards differ by such rows); a null text has size 1 and crc 0; null ids share one ring position; repeated rows are placed each on
their own, in text-hash order; an empty table gives no rows. Only the id and text columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

VNODES = 4096
SLACK = 0.0005


def ring(shards: int, vnodes: int = VNODES) -> tuple[np.ndarray, np.ndarray]:
    """Sorted virtual-node positions (signed 64-bit) and the shard of each."""
    at = np.array([xxhash.xxh3_64_intdigest(f"{s}/{v}") for s in range(shards) for v in range(vnodes)], np.uint64).view(np.int64)
    own = np.repeat(np.arange(shards), vnodes)
    order = np.lexsort((own, at))
    return at[order], own[order]


def fill(arcs: list[tuple[int, int]], owner: np.ndarray, capacity: float) -> dict[int, list[tuple[int, int]]]:
    """Bounded loads over arcs in ring order. arcs: (arc, bytes). Returns for each arc [(bytes up to here, shard)].

    First each arc fills its own shard up to the capacity; then each overflow, in ring order, goes clockwise.
    """
    load = [0.0] * (int(owner.max()) + 1)
    cuts: dict[int, list[tuple[int, int]]] = {}
    over: list[tuple[int, int]] = []
    for arc, size in arcs:
        s = int(owner[arc])
        take = min(size, max(0, int(capacity - load[s])))
        load[s] += take
        cuts[arc] = [(take, s)] if take or not size else []
        if take < size:
            over.append((arc, size - take))
    n = len(owner)
    for arc, left in over:
        done, at = (cuts[arc][-1][0] if cuts[arc] else 0), arc
        for step in range(1, n + 1):
            s = int(owner[(arc + step) % n])
            take = min(left, max(0, int(capacity - load[s])))
            if take:
                done, left = done + take, left - take
                load[s] += take
                cuts[arc].append((done, s))
            if not left:
                break
        if left:  # capacities are whole bytes; the last few go to the least loaded
            s = int(np.argmin(load))
            load[s] += left
            cuts[arc].append((done + left, s))
    return cuts


def assign(spark: SparkSession, docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", vnodes: int = VNODES, slack: float = SLACK) -> DataFrame:
    """Every row with ``size, text_crc32, shard, slot`` (slots of a shard are gapless from 0, in ring order)."""
    at, owner = ring(shards, vnodes)
    edges = at.tolist()
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).cast("long").alias("crc"), F.xxhash64(text).alias("th"), F.xxhash64(F.col(id_col).cast("string"), F.lit(17)).alias("pos"))

    def arc_of(batches):
        for b in batches:
            pos = b.column(b.schema.get_field_index("pos")).to_numpy(zero_copy_only=False)
            arc = np.searchsorted(np.asarray(edges, np.int64), pos, side="left") % len(edges)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(arc, pa.int64())], names=[*b.schema.names, "arc"])

    # The arc past the last node wraps to node 0; it is its own key (arc, high) so that runs stay contiguous.
    last = edges[-1] if edges else 0
    base = base.mapInArrow(arc_of, T.StructType([*base.schema.fields, T.StructField("arc", T.LongType())])).withColumn("high", F.col("pos") > last)
    id_type = dict(docs.dtypes)[id_col]
    rows, runs, path = C.ranked(spark, base, ["high", "arc"], ["pos", "id", "th"], ["size"], "shard-rows")
    pieces = [(r["high"], r["arc"], r["part"], r["n"], r["sum_size"]) for r in runs.collect()]  # at most arcs + parts
    pieces.sort(key=lambda r: (r[0], r[1], r[2]))
    if not pieces:
        return rows.select(F.col("id").cast(id_type).alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    total = sum(r[4] for r in pieces)
    sizes: dict[int, int] = {}
    for _, arc, _, _, s in pieces:
        sizes[arc] = sizes.get(arc, 0) + s
    cuts = fill(sorted(sizes.items()), owner, total * (1 + slack) / shards)
    # Bytes are counted on through all arcs, so that one sorted array holds the ends of all their segments.
    before, at_byte, ends, to, last = {}, 0, [], [], {}
    for arc, size in sorted(sizes.items()):
        before[arc] = at_byte
        ends += [at_byte + end for end, _ in cuts[arc]]
        to += [s for _, s in cuts[arc]]
        last[arc] = len(ends) - 1
        at_byte += size
    n = C.partitions(spark) + 1
    runs_at: dict[int, tuple[int, int]] = {}  # (arc, high, part) -> first byte of the run, last segment of its arc
    for high, arc, part, _, s in sorted(pieces, key=lambda r: (r[1], r[0], r[2])):
        runs_at[(arc * 2 + high) * n + part] = (before[arc], last[arc])
        before[arc] += s
    codes = np.array(sorted(runs_at), np.int64)
    firsts = np.array([runs_at[c] for c in codes.tolist()], np.int64)
    plan = spark.sparkContext.broadcast((codes, firsts, np.array(ends, np.int64), np.array(to, np.int32)))  # bounded: arcs + parts + cuts

    def place(batches):
        codes, firsts, ends, to = plan.value
        for b in batches:
            col = {c: b.column(i) for i, c in enumerate(b.schema.names)}
            arc, part, cum, size = (col[c].to_numpy() for c in ("arc", "part", "cum_size", "size"))
            high = col["high"].to_numpy(zero_copy_only=False).astype(np.int64)
            run = firsts[np.searchsorted(codes, (arc * 2 + high) * n + part)]
            seg = np.minimum(np.searchsorted(ends, run[:, 0] + cum + size // 2, side="right"), run[:, 1])  # a row goes where its middle lies
            yield pa.RecordBatch.from_arrays([col["id"], col["size"], col["crc"], pa.array(to[seg]), col["high"], col["arc"], col["part"], pa.array(seg), col["idx"]], names=["id", "size", "crc", "shard", "high", "arc", "part", "seg", "idx"])

    schema = f"id {id_type}, size bigint, crc bigint, shard int, high boolean, arc bigint, part bigint, seg bigint, idx bigint"
    placed, placed_path = C.stored(spark, rows.mapInArrow(place, schema), "shard-placed")
    groups = placed.groupBy("shard", "high", "arc", "part", "seg").agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("first")).collect()  # at most arcs + parts + cuts
    offsets, seen = {}, {}
    for g in sorted(groups, key=lambda g: (g["shard"], g["high"], g["arc"], g["part"], g["seg"])):
        offsets[(g["seg"] * 2 + g["high"]) * n + g["part"]] = seen.get(g["shard"], 0) - g["first"]
        seen[g["shard"]] = seen.get(g["shard"], 0) + g["n"]
    keys = np.array(sorted(offsets), np.int64)
    known = spark.sparkContext.broadcast((keys, np.array([offsets[k] for k in keys.tolist()], np.int64)))

    def slots(batches):
        keys, add = known.value
        for b in batches:
            col = {c: b.column(i) for i, c in enumerate(b.schema.names)}
            high = col["high"].to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.searchsorted(keys, (col["seg"].to_numpy() * 2 + high) * n + col["part"].to_numpy())
            yield pa.RecordBatch.from_arrays([col["id"], col["size"], col["crc"], col["shard"], pa.array(col["idx"].to_numpy() + add[at])], names=[id_col, "size", "text_crc32", "shard", "slot"])

    C.drop_paths(spark, path)
    return placed.mapInArrow(slots, f"`{id_col}` {id_type}, size bigint, text_crc32 bigint, shard int, slot bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assign(spark, C.table(spark, sf_dir, "documents"), 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
