"""Mixed tables: factor encoding, missing values, splits and imputation. All columns arrive as strings; null is missing."""

from __future__ import annotations

import json
from collections.abc import Sequence
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltbed.operators.ranking import positions

#: Strings that mean a missing value in a factor or number column.
MISSING = ("", "NA")


def as_number(c: str) -> Column:
    """The value with a decimal comma or point; null where it is no number."""
    return F.replace(F.trim(c), F.lit(","), F.lit(".")).try_cast("double")


def missing(c: str) -> Column:
    return F.col(c).isNull() | F.trim(c).isin(*MISSING)


def factor_columns(df: DataFrame) -> list[str]:
    """Columns with at least one value that is neither missing nor a number; one pass over all columns."""
    found = df.agg(*[F.bool_or(~missing(c) & as_number(c).isNull()).alias(c) for c in df.columns]).first()
    return [c for c in df.columns if found[c]]


def factor_levels(df: DataFrame, column: str, ordinal: str) -> DataFrame:
    """(column, level, numeric): levels in the order of their first appearance, from 0."""
    first = df.where(~missing(column)).groupBy(F.trim(column).alias("level")).agg(F.min(ordinal).alias("_at"))
    return first.select(F.lit(column).alias("column"), "level", (F.row_number().over(Window.orderBy("_at", "level")) - 1).cast("double").alias("numeric"))


def encode(df: DataFrame, levels: DataFrame, column: str, out: str | None = None) -> DataFrame:
    """df with column replaced by its level's number; unknown and missing levels give null. The level table is small by
    nature; Spark broadcasts it if it is under its own limit."""
    one = levels.where(F.col("column") == column).select(F.col("level").alias("_l"), F.col("numeric").alias("_v"))
    return df.join(one, F.trim(column) == F.col("_l"), "left").withColumn(out or column, F.col("_v")).drop("_l", "_v")


def one_hot(df: DataFrame, column: str, levels: Sequence[str]) -> DataFrame:
    """df with a 0/1 column <column>_<level> for each level, null where column is missing; a single level isn't expanded."""
    if len(levels) < 2:
        return df
    made = {f"{column}_{x}": F.when(missing(column), F.lit(None)).otherwise((F.trim(column) == x).cast("int")) for x in levels}
    return df.withColumns(made).drop(column)


def modify_levels(levels: DataFrame, renamed: dict[str, str]) -> DataFrame:
    """Levels under new names; those that meet keep the lowest number."""
    mapping = F.create_map(*[F.lit(x) for x in chain(*renamed.items())]) if renamed else F.create_map().cast("map<string,string>")
    return levels.withColumn("level", F.coalesce(mapping[F.col("level")], "level")).groupBy("column", "level").agg(F.min("numeric").alias("numeric"))


def levels_to_json(levels: DataFrame) -> str:
    """Factor definitions as JSON; the level table is a dimension."""
    rows = levels.groupBy("column").agg(F.array_sort(F.collect_list(F.struct("numeric", "level"))).alias("l")).orderBy("column").collect()
    return json.dumps([{"column": r["column"], "levels": [x["level"] for x in r["l"]], "numeric": [x["numeric"] for x in r["l"]]} for r in rows])


def na_fraction(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, fraction): the share of missing values."""
    one = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("fraction")) for c in columns])).alias("r")).select("r.*")


def drop_sparse_columns(df: DataFrame, columns: Sequence[str], most: float) -> DataFrame:
    """df without the columns whose share of missing values is over most."""
    keep = {r["feature"] for r in na_fraction(df, columns).where(F.col("fraction") <= most).collect()}
    return df.drop(*[c for c in columns if c not in keep])


def drop_na(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows without a missing value in columns; the same rule whether or not all rows are usable."""
    return df.dropna(subset=list(columns))


def drop_low_variance(df: DataFrame, columns: Sequence[str], least: float) -> DataFrame:
    found = df.agg(*[F.var_pop(c).alias(c) for c in columns]).first()
    return df.drop(*[c for c in columns if found[c] is None or found[c] < least])


def train_test_split(df: DataFrame, key: str, share: float, seed: int) -> DataFrame:
    """df with train: exactly round(n * share) rows, by a seeded hash of key.

    The cut is the hash of the row at that position: hashes are counted by their top bits first, and only the bucket at the
    cut is ranked, so no task sorts all rows.
    """
    h = F.xxhash64(F.lit(seed), key)
    rows = df.withColumn("_h", h).withColumn("_b", F.shiftright(F.col("_h"), 48))
    buckets = rows.groupBy("_b").agg(F.count("*").alias("_n"))
    w = Window.orderBy("_b")
    before = F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = buckets.agg(F.round(F.sum("_n") * share).cast("long").alias("_want"))
    cut = buckets.withColumn("_before", before).crossJoin(F.broadcast(total)).select("_b", F.least(F.col("_n"), F.greatest(F.lit(0), F.col("_want") - F.col("_before"))).alias("_k"))
    rank = F.row_number().over(Window.partitionBy("_b").orderBy("_h", key))
    return rows.join(cut, "_b").withColumn("train", rank <= F.col("_k")).drop("_h", "_b", "_k")


def alternate_split(df: DataFrame, key: str) -> DataFrame:
    """df with part 0 or 1 by the parity of a numeric key's position in sorted order."""
    return positions(df, key, key).withColumn("part", (F.col("position") % 2).cast("int")).drop("position")


def impute_knn(df: DataFrame, key: str, columns: Sequence[str], k: int, min_common: int) -> DataFrame:
    """df with missing values filled in from the k nearest rows, in key order; filled values count for later rows.

    Distance is the root mean square over shared columns (at least min_common), weights are 1 / (distance + 1e-8). The
    rule is sequential, so the whole table is one group: this operator is for tables that fit a worker.
    """
    names = list(columns)

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(key, ignore_index=True)
        x = group[names].to_numpy(float)
        for i in range(len(x)):
            for j in np.flatnonzero(np.isnan(x[i])):
                common = ~np.isnan(x) & ~np.isnan(x[i])
                n = common.sum(axis=1)
                d = np.sqrt(np.where(common, (x - x[i]) ** 2, 0).sum(axis=1) / np.maximum(n, 1))
                ok = (n >= min_common) & ~np.isnan(x[:, j])
                ok[i] = False
                near = np.flatnonzero(ok)
                near = near[np.argsort(d[near], kind="stable")[:k]]
                if len(near):
                    w = 1 / (d[near] + 1e-8)
                    x[i, j] = (w @ x[near, j]) / w.sum()
        group[names] = x
        return group

    typed = df.withColumns({c: F.col(c).cast("double") for c in names})
    return typed.withColumn("_all", F.lit(True)).groupBy("_all").applyInPandas(lambda g: fill(g.drop(columns="_all")), typed.schema)
