"""Text and parquet sinks. A single ordered file is one task's work by nature; Spark sorts before it, so memory is bounded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltbed.operators.molecules import unsigned_order


def _one_file(rows: DataFrame, order: list, folder: str, gz: bool = True) -> None:
    """rows.value as one text file below folder, in order. The global sort runs in parallel; only the last merge is one task."""
    rows.orderBy(*order).select("value").coalesce(1).write.mode("overwrite").option("compression", "gzip" if gz else "none").text(folder)


def _publish(spark: SparkSession, folder: str, target: str) -> None:
    """Move the single part file of folder to target."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    src = jvm.org.apache.hadoop.fs.Path(folder)
    fs = src.getFileSystem(conf)
    part = next(s.getPath() for s in fs.listStatus(src) if s.getPath().getName().startswith("part-"))
    fs.delete(jvm.org.apache.hadoop.fs.Path(target), False)
    fs.rename(part, jvm.org.apache.hadoop.fs.Path(target))
    fs.delete(src, True)


def write_mex(counts: DataFrame, features: DataFrame, cells: DataFrame, folder: str, kind: str = "integer") -> dict[str, int]:
    """matrix.mtx.gz, features.tsv.gz and barcodes.tsv.gz of (cell, feature, value) above zero.

    features: feature (id), name, feature_type, ord; those with a count are written, in ord's order. cells: cell, label;
    all are written, by unsigned id. The header's number of entries is that of the lines.
    """
    spark = counts.sparkSession
    rows = counts.where("value > 0").join(cells.select("cell"), "cell", "left_semi")
    used = features.join(rows.select("feature").distinct(), "feature", "left_semi")
    f = used.withColumn("row", F.row_number().over(Window.orderBy("ord")))
    c = cells.withColumn("col", F.row_number().over(Window.orderBy(unsigned_order("cell"))))
    entries = rows.join(f.select("feature", "row"), "feature").join(c.select("cell", "col"), "cell")
    n = {"features": f.count(), "cells": c.count(), "entries": entries.count()}
    shown = F.col("value").cast("long").cast("string") if kind == "integer" else F.col("value").cast("string")
    body = entries.select(F.lit(2).alias("k"), "col", "row", F.concat_ws(" ", F.col("row").cast("string"), F.col("col").cast("string"), shown).alias("value"))
    head = spark.createDataFrame([(0, 0, 0, f"%%MatrixMarket matrix coordinate {kind} general"), (1, 0, 0, f"{n['features']} {n['cells']} {n['entries']}")], "k int, col int, row int, value string")
    parts = {
        "matrix.mtx.gz": (head.unionByName(body), ["k", "col", "row"]),
        "features.tsv.gz": (f.select("row", F.concat_ws("\t", "feature", "name", "feature_type").alias("value")), ["row"]),
        "barcodes.tsv.gz": (c.select("col", F.col("label").alias("value")), ["col"]),
    }
    for name, (df, order) in parts.items():
        _one_file(df, order, f"{folder}/_{name}")
        _publish(spark, f"{folder}/_{name}", f"{folder}/{name}")
    return n


def write_raw_and_filtered(counts: DataFrame, features: DataFrame, cells: DataFrame, kept: DataFrame, folder: str) -> None:
    """Two matrices of one table: raw with all cells, filtered with the kept ones."""
    write_mex(counts, features, cells, f"{folder}/raw")
    write_mex(counts, features, cells.join(kept, "cell", "left_semi"), f"{folder}/filtered")


def dense_table(counts: DataFrame, cells: DataFrame, features: list[str]) -> DataFrame:
    """cell and one column per feature; missing entries are 0."""
    wide = counts.groupBy("cell").pivot("feature", features).agg(F.sum("value"))
    return cells.select("cell").join(wide, "cell", "left").fillna(0, subset=features)


def write_delimited(df: DataFrame, folder: str, sep: str = ",", missing: str = "NA") -> None:
    """CSV or TSV with a header; missing values and NaN are written as NA."""
    nan = {c: F.when(F.isnan(c), None).otherwise(F.col(c)) for c, k in df.dtypes if k in ("double", "float")}
    df.withColumns(nan).write.mode("overwrite").csv(folder, sep=sep, header=True, nullValue=missing, emptyValue="")


def bedgraph(track: DataFrame, width: int, chromosomes: DataFrame | None = None) -> DataFrame:
    """Lines chr, start, end, value of a binned track; a chromosome's last bin ends with it."""
    end = (F.col("bin") + 1) * width
    if chromosomes is not None:
        track = track.join(F.broadcast(chromosomes), "chr")
        end = F.least(end, F.col("length"))
    return track.select("chr", "bin", F.concat_ws("\t", "chr", (F.col("bin") * width).cast("string"), end.cast("string"), F.col("value").cast("string")).alias("value"))


def write_bedgraph(track: DataFrame, width: int, folder: str, chromosomes: DataFrame | None = None) -> None:
    _one_file(bedgraph(track, width, chromosomes), ["chr", "bin"], folder, gz=False)


def fastq_lines(reads: DataFrame) -> DataFrame:
    """One value per record: its four lines."""
    return reads.select(F.concat(F.lit("@"), "id", F.lit("\n"), "seq", F.lit("\n+\n"), "qual").alias("value"))


def write_fastq(reads: DataFrame, folder: str) -> None:
    """A gz file for each partition; the order of records is that of partitions."""
    fastq_lines(reads).write.mode("overwrite").option("compression", "gzip").text(folder)


def fasta_text(name: Column, seq: Column, width: int = 60) -> Column:
    """A record with its sequence wrapped."""
    return F.concat(F.lit(">"), name, F.lit("\n"), F.rtrim(F.regexp_replace(seq, f"(.{{{width}}})", "$1\n"), F.lit("\n")))


def write_fasta(records: DataFrame, folder: str, width: int = 60) -> None:
    records.select(fasta_text(F.col("id"), F.col("seq"), width).alias("value")).write.mode("overwrite").text(folder)


def write_bundle(tables: dict[str, DataFrame], folder: str) -> None:
    """An annotated matrix as parquet tables x, obs, var, obsm, layers."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def split_by(df: DataFrame, column: str, folder: str) -> None:
    """A folder for each value of column."""
    df.write.mode("overwrite").partitionBy(column).parquet(folder)
