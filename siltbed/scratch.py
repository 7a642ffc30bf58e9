"""Tables in the folder that all executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: The paths of the tables made in each open cleared().
_open: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a temporary folder in local mode where that is unset."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="siltbed-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def stored(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Write df as a table in the shared folder and read it back; keep: it outlives the cleared() around."""
    path = f"{shared_dir(df.sparkSession)}/siltbed/{label}-{uuid.uuid4().hex}"
    schema = df.schema
    if _open and not keep:
        _open[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def delete_stored(df: DataFrame) -> None:
    """Remove the files below a table made by stored()."""
    _delete(df.sparkSession, {f.rsplit("/", 1)[0] for f in df.inputFiles()})


@contextmanager
def cleared(spark: SparkSession) -> Iterator[None]:
    """Removes at its end the tables that stored() made within, but those to keep. Nothing that reads them may be used later."""
    _open.append([])
    try:
        yield
    finally:
        _delete(spark, _open.pop())


def _delete(spark: SparkSession, paths) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
