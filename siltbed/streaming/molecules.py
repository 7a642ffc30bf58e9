"""Molecule dedup, windows and sessions that run on tables and on streams alike.

Finite files have no event time; a stream that never ends needs a watermark, or its dedup state grows for ever.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from siltbed.scratch import shared_dir


def dedup(molecules: DataFrame, key: Sequence[str], event_time: str | None = None, late: str | None = None) -> DataFrame:
    """One row per key. With event_time and late, state older than the watermark is dropped, and so are late repeats."""
    if event_time and late:
        return molecules.withWatermark(event_time, late).dropDuplicatesWithinWatermark(list(key))
    return molecules.dropDuplicates(list(key))


def first_wins(table: DataFrame, key: Sequence[str], ordinal: str) -> DataFrame:
    """The row of the smallest ordinal of each key (batch)."""
    return table.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(ordinal))).where("_r = 1").drop("_r")


def windowed(events: DataFrame, time: str, size: str, slide: str | None, by: Sequence[str], value: str, late: str | None = None) -> DataFrame:
    """Tumbling (slide None) or sliding windows: n and total per window and key."""
    e = events.withWatermark(time, late) if late else events
    w = F.window(time, size, slide) if slide else F.window(time, size)
    out = e.groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("start"), *by, "n", "total")


def sessions(events: DataFrame, time: str, gap: str, by: Sequence[str], late: str | None = None) -> DataFrame:
    """Sessions that end after a gap without events."""
    e = events.withWatermark(time, late) if late else events
    out = e.groupBy(F.session_window(time, gap).alias("w"), *by).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def new_territory(reads: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Streaming: (key, start, end, added) of reads that cover positions no earlier read of the key did.

    A key's state is its disjoint covered intervals; rows of a batch come in order of start and end.
    """
    kind = dict(reads.dtypes)[key]

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        covered = [tuple(x) for x in zip(*state.get)] if state.exists else []
        rows = pd.concat(list(batches)).sort_values([start, end])
        out = []
        for a, b in zip(rows[start].tolist(), rows[end].tolist()):
            known = sum(max(0, min(b, y) - max(a, x)) for x, y in covered)
            if b - a > known:
                out.append((name[0], a, b, b - a - known))
                merged: list[tuple[int, int]] = []
                for x, y in sorted([*covered, (a, b)]):
                    if merged and x <= merged[-1][1]:
                        merged[-1] = (merged[-1][0], max(merged[-1][1], y))
                    else:
                        merged.append((x, y))
                covered = merged
        state.update(([x for x, _ in covered], [y for _, y in covered]))
        yield pd.DataFrame(out, columns=[key, start, end, "added"])

    return reads.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {start} long, {end} long, added long", "a array<long>, b array<long>", "append", GroupStateTimeout.NoTimeout)


def cluster_buffer(rows: DataFrame, key: str, tick: str, max_gap: int) -> DataFrame:
    """(key, first, last, n): stretches of a key's rows whose ticks lie at most max_gap apart (batch form of the buffer)."""
    w = Window.partitionBy(key).orderBy(tick)
    new = F.when(F.col(tick) - F.lag(tick).over(w) <= max_gap, 0).otherwise(1)
    run = F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_new", new).withColumn("_run", run).groupBy(key, "_run").agg(F.min(tick).alias("first"), F.max(tick).alias("last"), F.count("*").alias("n")).drop("_run")


def write_each(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Start a stream that hands batches to sink(batch, id); a sink that keys its writes by id survives restarts."""
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_counts(spark: SparkSession, path: str) -> DataFrame:
    """Distinct (user, type, floor of value) of an events table read as a file stream, counted by user and type."""
    schema: StructType = spark.read.parquet(path).schema
    base = f"{shared_dir(spark)}/siltbed/stream-{uuid.uuid4().hex}"
    folder, _, name = path.rpartition("/")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).option("pathGlobFilter", "*.parquet").parquet(path if _is_dir(spark, path) else f"{folder}/{name[:-1]}[{name[-1]}]")
    mol = source.select(F.col("user_id").alias("cell"), F.col("event_type").alias("feature"), F.floor("value").alias("umi"))
    out = f"{base}/molecules"

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    write_each(dedup(mol, ["cell", "feature", "umi"]), sink, f"{base}/state").awaitTermination()
    return spark.read.parquet(out).groupBy("cell", "feature").agg(F.count("*").alias("value"))


def _is_dir(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory())
