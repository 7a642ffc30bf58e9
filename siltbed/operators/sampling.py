"""Deterministic sampling: fixed-depth resampling, shuffles and bootstraps that give the same result on every run."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltbed.functions.statistics import splitmix64
from siltbed.operators.grouped import spread


def _uniform(seed: int, stream: int, n: int) -> np.ndarray:
    """n numbers in [0, 1) of a stream."""
    with np.errstate(over="ignore"):
        base = np.uint64(seed) ^ splitmix64(np.array([stream], np.int64).view(np.uint64))[0]
        return (splitmix64(base + np.arange(1, n + 1, dtype=np.uint64)) >> np.uint64(11)) / float(1 << 53)


def resample(counts: DataFrame, depth: int, seed: int = 42) -> DataFrame:
    """(cell, feature, value): every cell's counts brought down to exactly depth by stochastic rounding.

    A value's expected count is rounded up with the chance of its fraction; what the sum is off is corrected where that
    changes the rounding error least (the largest fractions go up, the smallest go down; ties by feature). A cell's features
    are one group: bounded by the number of features. A cell below depth raises.
    """
    kinds = dict(counts.dtypes)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("feature", ignore_index=True)
        n = g["value"].to_numpy(np.int64)
        total = int(n.sum())
        if total < depth:
            raise ValueError(f"cell {g['cell'].iloc[0]} has {total} counts, below {depth}")
        expected = n * depth / total
        base = np.floor(expected).astype(np.int64)
        part = expected - base
        up = _uniform(seed, int(g["cell"].iloc[0]) if isinstance(g["cell"].iloc[0], (int, np.integer)) else hash_text(g["cell"].iloc[0]), len(n)) < part
        off = depth - int((base + up).sum())
        rows = np.arange(len(n))
        if off > 0:
            free = rows[~up]
            up[free[np.lexsort((free, -part[free]))][:off]] = True
        elif off < 0:
            taken = rows[up]
            up[taken[np.lexsort((taken, part[taken]))][:-off]] = False
        value = base + up
        keep = value > 0
        return pd.DataFrame({"cell": g["cell"][keep], "feature": g["feature"][keep], "value": value[keep]})

    return spread(counts.where("value > 0"), ["cell"]).groupBy("cell").applyInPandas(run, f"cell {kinds['cell']}, feature {kinds['feature']}, value long")


def hash_text(text: str) -> int:
    from siltbed.functions.statistics import fnv1a

    h = fnv1a(text.encode())
    return h - (1 << 64) if h >> 63 else h


def shuffle_key(df: DataFrame, column: str, seed: int, name: str = "shuffled") -> DataFrame:
    """df with a splitmix64 value of a number and the seed: ordering by it shuffles, alike on every run."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index(column)
        for b in batches:
            x = b.column(at).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(splitmix64(x ^ np.uint64(seed)).view(np.int64))], names=[*names, name])

    names = list(df.columns)
    fields = ", ".join(f"`{c}` {k}" for c, k in df.dtypes)
    return df.mapInArrow(run, f"{fields}, {name} long")


def shuffled_pairs(df: DataFrame, by: Sequence[str], key: str, value: str, seed: int) -> DataFrame:
    """df whose value column is dealt anew within each group: rank by key takes the value of the same rank by hash."""
    from pyspark.sql import Window

    own = df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(key)))
    dealt = shuffle_key(df, key, seed, "_s")
    dealt = dealt.select(*by, F.col(value).alias("_v"), F.row_number().over(Window.partitionBy(*by).orderBy("_s", key)).alias("_r"))
    return own.drop(value).join(dealt, [*by, "_r"]).withColumnRenamed("_v", value).drop("_r")
