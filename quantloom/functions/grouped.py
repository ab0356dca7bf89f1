"""Per-symbol kernels: recurrences that window frames can't express, over one ordered numpy array per symbol.

A group is one symbol's history, so its size is bounded by the calendar, not by the universe.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def per_group(df: DataFrame, key: str, order: str, columns: dict[str, str], fn: Callable[[pd.DataFrame], dict[str, np.ndarray]]) -> DataFrame:
    """Adds columns (name -> type) that fn computes from a group's ordered rows."""
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, T._parse_datatype_string(t)) for n, t in columns.items()]])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable")
        return rows.assign(**fn(rows))[[f.name for f in schema.fields]]

    return df.groupBy(key).applyInPandas(run, schema)


def per_symbol(df: DataFrame, key: str, order: str, schema: str, fn: Callable[[object, pd.DataFrame], list[tuple]]) -> DataFrame:
    """Rows that fn(key, ordered rows) returns for each group. ``{key}`` in the schema stands for the key's type.

    The kernels' work isn't in proportion to their rows, so small groups stay dealt over all shuffle partitions.
    """
    schema = schema.replace("{key}", df.schema[key].dataType.simpleString())
    names = [f.split()[0] for f in schema.split(", ")]
    df = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)

    def run(k: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(fn(k[0], rows.sort_values(order, kind="stable")), columns=names)

    return df.groupBy(key).applyInPandas(run, schema)


def per_history(df: DataFrame, key: str, order: str, schema: str, fn: Callable[[object, dict[str, np.ndarray]], list[tuple]]) -> DataFrame:
    """As ``per_symbol``, for kernels of numbers alone: fn(key, columns in order as doubles, NULL as NaN). Spark orders the rows and
    they come in batches of many groups, so no table is made of each group."""
    schema = schema.replace("{key}", df.schema[key].dataType.simpleString())
    numbers = [c for c in df.columns if c not in (key, order)]
    df = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key).sortWithinPartitions(key, F.col(order).asc_nulls_last())
    arrow = to_arrow_schema(T._parse_datatype_string(schema))

    def one(k, parts: list[pa.RecordBatch]) -> list[tuple]:
        return fn(k, {c: np.concatenate([p[c].to_numpy(zero_copy_only=False) for p in parts]) for c in numbers})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        out = []
        for batch in batches:
            keys = pc.run_end_encode(batch[key])
            start = 0
            for end, k in zip(keys.run_ends.to_pylist(), keys.values.to_pylist(), strict=True):
                if held and k != now:
                    out += one(now, held)
                    held = []
                now = k
                held.append(batch.slice(start, end - start))
                start = end
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, row, strict=True)) for row in out], arrow)
                out = []
        if held:
            yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, row, strict=True)) for row in one(now, held)], arrow)

    return df.select(key, *[F.col(c).cast("double").alias(c) for c in numbers]).mapInArrow(run, schema)


def seeded(seed: int, *keys) -> np.random.Generator:
    """Random numbers of a seed and keys (integers, or anything as text), alike on every run."""
    return np.random.default_rng([seed, *(abs(int(k)) if isinstance(k, (int, np.integer)) else zlib.crc32(str(k).encode()) for k in keys)])


def alpha_of(span: float | None = None, halflife: float | None = None, alpha: float | None = None) -> float:
    if alpha is not None:
        return alpha
    return 2 / (span + 1) if span is not None else 1 - np.exp(-np.log(2) / halflife)


def smooth(x: np.ndarray, alpha: float) -> np.ndarray:
    """Exponential mean of values without gaps: y[t] = q^t (y[0] + sum of alpha x[i] / q^i), in stretches within the range of doubles."""
    q = 1 - alpha
    stretch = max(1, int(-200 / np.log10(q)))
    out = np.empty(len(x))
    out[0] = x[0]
    for s in range(1, len(x), stretch):
        part = x[s : s + stretch]
        decay = q ** np.arange(1, len(part) + 1)
        out[s : s + len(part)] = decay * (out[s - 1] + np.cumsum(alpha * part / decay))
    return out


def ewm_mean(x: np.ndarray, alpha: float) -> np.ndarray:
    """adjust=False; gaps keep the last mean while older weights go on decaying."""
    out = np.full(len(x), np.nan)
    known = np.flatnonzero(~np.isnan(x))
    if alpha <= 0.9 and len(known) and len(known) == len(x) - known[0]:
        out[known[0] :] = smooth(np.asarray(x, float)[known[0] :], alpha)
        return out
    mean, weight = np.nan, 1.0
    for i, v in enumerate(x):
        if np.isnan(mean):
            if not np.isnan(v):
                mean = v
        else:
            weight *= 1 - alpha
            if not np.isnan(v):
                mean = (weight * mean + alpha * v) / (weight + alpha)
                weight = 1.0
        out[i] = mean
    return out


def ewm_std(x: np.ndarray, alpha: float) -> np.ndarray:
    """adjust=False, bias-corrected; NULL for the first value. Gaps keep the last value."""
    out = np.full(len(x), np.nan)
    mean, var, w2 = np.nan, 0.0, 1.0
    for i, v in enumerate(x):
        if not np.isnan(v):
            if np.isnan(mean):
                mean = v
            else:
                d = v - mean
                mean += alpha * d
                var = (1 - alpha) * (var + alpha * d * d)
                w2 = (1 - alpha) ** 2 * w2 + alpha**2
        if 1 - w2 > 1e-12:
            out[i] = np.sqrt(var / (1 - w2))
    return out


def positions(buy: np.ndarray, sell: np.ndarray, lag: int = 0, cooldown: int = 0, mode: str = "sell_wins") -> np.ndarray:
    """-1 / 0 / +1 from pulses: the last pulse holds; after one, ``cooldown`` bars ignore pulses."""
    out = np.zeros(len(buy), np.int32)
    now = wait = 0
    for t in range(len(buy)):
        at = t - lag
        b = bool(buy[at]) if at >= 0 and not wait else False
        s = bool(sell[at]) if at >= 0 and not wait else False
        wait = max(0, wait - 1)
        if b and s:
            b, s = (False, True) if mode == "sell_wins" else (True, False) if mode == "buy_wins" else (False, False)
        if b or s:
            now, wait = (1 if b else -1), cooldown
        out[t] = now
    return out


def repair_unit_flips(x: np.ndarray, factor: float = 100.0, jump: float = 20.0) -> np.ndarray:
    """Quotes that switch between pounds and pence: each jump against the repaired last value takes the scaling (1/factor,
    1 or factor) with the smallest absolute log ratio."""
    out = x.copy()
    last = np.nan
    for i, v in enumerate(x):
        if np.isnan(v):
            continue
        if not np.isnan(last) and last > 0 and v > 0 and not 1 / jump < v / last < jump:
            out[i] = min((v, v / factor, v * factor), key=lambda c: abs(np.log(c / last)))
        last = out[i]
    return out
