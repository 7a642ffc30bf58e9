"""Runs that can be stopped and taken up again, pipes to outside programs, and progress."""

from __future__ import annotations

import hashlib
import json
import subprocess
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener


def signature(parameters: dict) -> str:
    """A digest of a stage's parameters; the order of keys doesn't count."""
    return hashlib.sha256(json.dumps(parameters, sort_keys=True, default=str).encode()).hexdigest()


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def resumed(spark: SparkSession, folder: str, parameters: dict, make: Callable[[], DataFrame]) -> DataFrame:
    """The table that an earlier run with equal parameters finished, else make's, written with a marker of the parameters.

    The marker is written after the table, so a run that died leaves none; one of other parameters is computed anew.
    """
    sign = signature(parameters)
    marker, fs = _fs(spark, f"{folder}/_done-{sign}")
    data = f"{folder}/data-{sign[:16]}"
    if not fs.exists(marker):
        make().write.mode("overwrite").parquet(data)
        fs.create(marker, True).close()
    return spark.read.parquet(data)


def piped(reads: DataFrame, command: Sequence[str], schema: str, encode: Callable[[pd.DataFrame], str], decode: Callable[[str], pd.DataFrame]) -> DataFrame:
    """Batches of rows through an outside program's standard input and output; a program that fails ends the task."""
    fixed = list(command)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                done = subprocess.run(fixed, input=encode(b), capture_output=True, text=True, check=False)
                if done.returncode:
                    raise RuntimeError(f"{fixed[0]} ended with {done.returncode}: {done.stderr[-500:]}")
                yield decode(done.stdout)

    return reads.mapInPandas(run, schema)


class Progress(StreamingQueryListener):
    """Keeps the rows and batches of running streams, for a report while they run."""

    def __init__(self) -> None:
        super().__init__()
        self.rows: dict[str, int] = {}
        self.batches: dict[str, int] = {}
        self.ended: set[str] = set()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.rows.setdefault(str(event.id), 0)

    def onQueryProgress(self, event) -> None:  # noqa: N802
        key = str(event.progress.id)
        self.rows[key] = self.rows.get(key, 0) + event.progress.numInputRows
        self.batches[key] = self.batches.get(key, 0) + 1

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.ended.add(str(event.id))
