"""Sparse cell x feature x molecule tables: exact dedup, merge, accounting and filters (long format, no dense axes)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltbed.operators.ranking import positions

KEY = ("cell", "feature", "umi")
#: The depth thresholds of the accounting table.
THRESHOLDS = (1, 10, 50, 100, 200, 400, 1000)


def distinct_molecules(mol: DataFrame) -> DataFrame:
    """One row per (cell, feature, umi)."""
    return mol.select(*KEY).distinct()


def umi_counts(mol: DataFrame) -> DataFrame:
    """(cell, feature, value): distinct molecules; a repeated key never counts twice."""
    return distinct_molecules(mol).groupBy("cell", "feature").agg(F.count("*").alias("value"))


def first_value_sums(obs: DataFrame, ordinal: str, value: str) -> DataFrame:
    """Numeric accumulation where the first value of a key, by source ordinal, wins; then summed per (cell, feature)."""
    first = obs.groupBy(*KEY).agg(F.min_by(value, ordinal).alias("value"))
    return first.groupBy("cell", "feature").agg(F.sum("value").alias("value"))


def merge_evidence(mol: DataFrame, mask: str, start: str, end: str, reads: str) -> DataFrame:
    """Mergeable evidence per key: masks by OR, ranges by min and max, SNP reads by saturating sum (at most 255)."""
    return mol.groupBy(*KEY).agg(
        F.bit_or(mask).alias("mask"), F.min(start).alias("first_start"), F.max(end).alias("last_end"),
        F.least(F.lit(255), F.sum(reads)).cast("long").alias("reads"),
    )


def merge_accounting(left: DataFrame, right: DataFrame) -> DataFrame:
    """Per cell of right: molecules new to left (accepted) and known already (duplicate)."""
    a, b = distinct_molecules(left).withColumn("known", F.lit(1)), distinct_molecules(right)
    joined = b.join(a, list(KEY), "left")
    return joined.groupBy("cell").agg(F.count_if(F.col("known").isNull()).alias("accepted"), F.count_if(F.col("known").isNotNull()).alias("duplicate"))


def merge(*mols: DataFrame) -> DataFrame:
    """Union of molecule sets; equal keys meet."""
    out = mols[0].select(*KEY)
    for m in mols[1:]:
        out = out.unionByName(m.select(*KEY))
    return out.distinct()


def merge_values(*layers: DataFrame) -> DataFrame:
    """Additive merge of (cell, feature, value) layers."""
    out = layers[0]
    for x in layers[1:]:
        out = out.unionByName(x)
    return out.groupBy("cell", "feature").agg(F.sum("value").alias("value"))


def cell_totals(counts: DataFrame) -> DataFrame:
    return counts.groupBy("cell").agg(F.sum("value").alias("total"), F.count("*").alias("detected"))


def threshold_table(totals: DataFrame, thresholds: Sequence[int] = THRESHOLDS) -> DataFrame:
    """(threshold, cells): cells at or above each depth; one pass."""
    one = totals.agg(*[F.count_if(F.col("total") >= t).alias(str(t)) for t in thresholds])
    return one.select(F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(str(t)).alias("cells")) for t in thresholds])).alias("r")).select("r.*")


def cells_with_min(counts: DataFrame, least: int) -> DataFrame:
    """Cells whose total is at least least (the bound counts)."""
    return cell_totals(counts).where(F.col("total") >= least).select("cell")


def restrict_cells(counts: DataFrame, cells: DataFrame) -> DataFrame:
    return counts.join(cells, "cell", "left_semi")


def split_cells(counts: DataFrame, cells: DataFrame) -> DataFrame:
    """counts with kept: whether the row's cell is among cells."""
    marked = cells.select("cell").distinct().withColumn("kept", F.lit(True))
    return counts.join(marked, "cell", "left").withColumn("kept", F.coalesce("kept", F.lit(False)))


def retain_features(counts: DataFrame, features: DataFrame) -> DataFrame:
    """Rows of the given features; cells left with none drop out by themselves."""
    return counts.join(features, "feature", "left_semi")


def ambient_pairs(mol: DataFrame, least: int) -> DataFrame:
    """(feature, umi, seen, ambient): pairs seen in at least least cells are ambient."""
    return distinct_molecules(mol).groupBy("feature", "umi").agg(F.count("*").alias("seen")).withColumn("ambient", F.col("seen") >= least)


def remap_features(mol: DataFrame, mapping: DataFrame) -> DataFrame:
    """Molecules under new feature ids (mapping: feature, new_feature); colliding keys meet; a missing id raises."""
    joined = mol.join(mapping, "feature", "left")
    new = F.coalesce("new_feature", F.raise_error(F.concat(F.lit("no mapping for feature "), F.col("feature").cast("string"))))
    return joined.select("cell", new.alias("feature"), "umi").distinct()


def qc(counts: DataFrame, classes: dict[str, Column]) -> DataFrame:
    """Per cell: total, detected, the sum of each class of features, and surviving = total without the classes, at least 0."""
    sums = [F.sum(F.when(c, F.col("value")).otherwise(0)).alias(k) for k, c in classes.items()]
    out = counts.groupBy("cell").agg(F.sum("value").alias("total"), F.count("*").alias("detected"), *sums)
    left = F.col("total")
    for k in classes:
        left = left - F.col(k)
    return out.withColumn("surviving", F.greatest(F.lit(0), left))


def unsigned_order(c: str) -> Column:
    """A sort key that orders BIGINT bit patterns as unsigned numbers."""
    return F.col(c).bitwiseXOR(F.lit(-(1 << 63)))


def ranked(totals: DataFrame, by: str, name: str = "depth_rank") -> DataFrame:
    """Position by depth from 1, deepest first, ties by cell."""
    return positions(totals, by, "cell", descending=True).withColumn(name, F.col("position") + 1).drop("position")
