"""Groups that Python works on, and groups in order that no single task could sort."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltbed.scratch import stored

#: Rows that a task sorts at most, but for equal rows.
RANGE_ROWS = 500_000


def spread(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """df dealt out by the group's key to as many tasks as there are cores at least.

    Adaptive execution joins partitions by their bytes, and groups that are small in bytes can be long in work; a stated
    number of partitions is left alone, and the grouping that follows needs no further shuffle.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(n, *by)


def dealt(df: DataFrame, order: Sequence[str | Column], label: str, rows: int | None = None) -> DataFrame:
    """df as a table with _part and _row: parts are ranges of the order, as many as its rows need, and _row counts up in order
    within a part. A window over a large group sorts it in one task; here a task has RANGE_ROWS rows or so at any size."""
    df = stored(df, label)  # it is counted, sampled and dealt
    n, most = df.count(), rows or RANGE_ROWS
    parts = max(1, -(-n // most), min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // 10_000))
    made = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    made = stored(made, label)
    return made.withColumns({"_part": F.shiftright("_id", 33), "_row": F.col("_id").bitwiseAND((1 << 33) - 1)}).drop("_id")


def across(sizes: DataFrame, by: Sequence[str], **values: Column) -> DataFrame:
    """(by, _part, values) of groups that have rows in several parts: two rows a part at most, so they can be broadcast.

    sizes: a row for each group and part; values are window expressions over the parts of a group, in order: see earlier() and later().
    """
    several = F.count("*").over(Window.partitionBy(*by)) > 1
    return sizes.withColumn("_several", several).where("_several").select(*by, "_part", *[c.alias(n) for n, c in values.items()])


def earlier(by: Sequence[str]):
    return Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)


def later(by: Sequence[str]):
    return Window.partitionBy(*by).orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)


def with_edges(df: DataFrame, edges: DataFrame, by: Sequence[str], how: str = "left") -> DataFrame:
    """df with the values of across(); missing values of by are a group of their own."""
    key = [*by, "_part"]
    e = edges.select(*[F.col(c).alias(f"_{c}_e") for c in key], *[c for c in edges.columns if c not in key])
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}_e")) for c in key])
    return df.join(F.broadcast(e), on, how).drop(*[f"_{c}_e" for c in key])
