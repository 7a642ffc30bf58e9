"""Group summaries over sparse counts. Zeros are implicit: denominators come from the cell table, never from the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def five_numbers(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """n, min, q1, median, q3 and max per group; quantiles interpolate linearly at q * (n - 1)."""
    q = F.percentile(value, F.array(*[F.lit(x) for x in (0.0, 0.25, 0.5, 0.75, 1.0)]))
    out = df.groupBy(*by).agg(F.count("*").alias("n"), q.alias("q"))
    return out.select(*by, "n", *[F.col("q")[k].alias(c) for k, c in enumerate(("min", "q1", "median", "q3", "max"))])


def group_means(counts: DataFrame, cells: DataFrame, group: str) -> DataFrame:
    """Mean, detection share and population sd per (group, feature), zeros included.

    counts: cell, feature, value; cells: cell and group, with every cell, also those without counts.
    """
    size = cells.groupBy(group).agg(F.count("*").alias("n_cells"))
    sums = counts.join(cells, "cell").groupBy(group, "feature").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("s2"), F.count_if(F.col("value") > 0).alias("k"))
    out = sums.join(F.broadcast(size), group)
    mean = F.col("s") / F.col("n_cells")
    var = F.greatest(F.lit(0.0), F.col("s2") / F.col("n_cells") - mean * mean)
    return out.select(group, "feature", "n_cells", mean.alias("mean"), (F.col("k") / F.col("n_cells")).alias("detection"), F.sqrt(var).alias("sd"))


def positive_quantiles(counts: DataFrame, cells: DataFrame, group: str, qs: Sequence[float]) -> DataFrame:
    """Quantiles and mean of the values above zero, per (group, feature)."""
    q = F.percentile("value", F.array(*[F.lit(float(x)) for x in qs]))
    out = counts.where(F.col("value") > 0).join(cells, "cell").groupBy(group, "feature").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), q.alias("q"))
    return out.select(group, "feature", "n", "mean", *[F.col("q")[k].alias(f"q{round(100 * x)}") for k, x in enumerate(qs)])


def pair_stats(pairs: DataFrame, min_pair: int, min_umis: int) -> DataFrame:
    """Per cell over (cell, umi) pairs read at least min_pair times, for cells with at least min_umis of them."""
    seen = pairs.groupBy("cell", "umi").agg(F.count("*").alias("reads")).where(F.col("reads") >= min_pair)
    r = F.col("reads")
    out = seen.groupBy("cell").agg(F.count("*").alias("n"), F.avg(r).alias("mean"), F.percentile(r, 0.5).alias("median"), F.min(r).alias("min"), F.max(r).alias("max"))
    return out.where(F.col("n") >= min_umis)


def dirichlet_profile(counts: DataFrame, features: DataFrame, alpha: float) -> DataFrame:
    """(feature, n, p): p = (n + alpha) / (N + alpha * G) over all features, those without counts included."""
    n = features.select("feature").distinct().join(counts.groupBy("feature").agg(F.sum("value").alias("n")), "feature", "left")
    n = n.select("feature", F.coalesce("n", F.lit(0)).alias("n"))
    total = n.agg(F.sum("n").alias("total"), F.count("*").alias("g"))
    return n.crossJoin(F.broadcast(total)).select("feature", "n", ((F.col("n") + alpha) / (F.col("total") + alpha * F.col("g"))).alias("p"))


def gap_stats(gaps: DataFrame, by: str, value: str) -> DataFrame:
    """Summary of a value by multiplicity, and over all (by is null), in one pass."""
    v = F.col(value)
    q = F.percentile(v, F.array(*[F.lit(x) for x in (0.25, 0.5, 0.75, 0.9, 0.95)]))
    sets = gaps.groupingSets([[by], []], by).agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"), q.alias("q"))
    return sets.select(by, "n", "mean", "min", "max", *[F.col("q")[k].alias(c) for k, c in enumerate(("q1", "median", "q3", "p90", "p95"))])


def genotype(mut: Column, wt: Column, least_wt: int) -> Column:
    """Any mutated SNP: MUT; at least least_wt wild-type SNPs: WT; else NO_INFO, which is no wild type."""
    return F.when(mut > 0, "MUT").when(wt >= least_wt, "WT").otherwise("NO_INFO")


def dense_cross(rows: DataFrame, columns: DataFrame, *layers: tuple[DataFrame, str], key: Sequence[str]) -> DataFrame:
    """Every pair of rows and columns (columns is a small dimension) with each layer's value, zero where it has none."""
    out = rows.crossJoin(F.broadcast(columns))
    for layer, name in layers:
        out = out.join(layer.select(*key, F.col("value").alias(name)), list(key), "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def dense_row(counts: DataFrame, features: DataFrame | None = None) -> DataFrame:
    """Per cell: total, the feature with the highest count (ties: first name), its share, and the gap to the nearest lower
    count as a share of the highest.

    features are those of the row; where a cell lacks one of them its count 0 is a lower one. Ties of the highest don't
    count as lower; where there is no lower count the gap is 0. Without features, those of counts.
    """
    n = (counts if features is None else features).agg(F.count_distinct("feature").alias("_n"))
    top = F.max("value").over(Window.partitionBy("cell"))
    marked = counts.where("value > 0").withColumn("_top", top)
    out = marked.groupBy("cell").agg(
        F.sum("value").alias("total"), F.max("_top").alias("_top"), F.count_distinct("feature").alias("_k"),
        F.min(F.when(F.col("value") == F.col("_top"), F.col("feature"))).alias("top_feature"), F.max(F.when(F.col("value") < F.col("_top"), F.col("value"))).alias("_next"),
    )
    lower = F.coalesce("_next", F.when(F.col("_k") < F.col("_n"), 0))
    gap = F.coalesce((F.col("_top") - lower) / F.col("_top"), F.lit(0.0))
    return out.crossJoin(F.broadcast(n)).select("cell", "total", "top_feature", (F.col("_top") / F.col("total")).alias("share"), gap.alias("gap_share"))


def column_overview(df: DataFrame, columns: Sequence[str], cap: int) -> DataFrame:
    """(column, level, n): the cap most frequent levels of each column; ties by level."""
    long = df.select(F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in columns]), F.array(*[F.col(c).cast("string") for c in columns]))).alias("column", "level"))
    n = long.groupBy("column", "level").agg(F.count("*").alias("n"))
    w = Window.partitionBy("column").orderBy(F.desc("n"), "level")
    return n.withColumn("r", F.row_number().over(w)).where(F.col("r") <= cap).drop("r")


def log_histogram(df: DataFrame, value: str, bins: int = 100) -> DataFrame:
    """(bin, n): equal bins of log10 of the value over [0, max(1, largest)]; the last bin is closed."""
    logs = df.where(F.col(value) > 0).select(F.log10(value).alias("x"))
    top = logs.agg(F.greatest(F.lit(1.0), F.max("x")).alias("top"))
    b = F.least(F.lit(bins - 1), F.floor(F.col("x") / (F.col("top") / bins))).cast("int")
    return logs.crossJoin(F.broadcast(top)).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


def compatibility_classes(pairs: DataFrame, row: str, item: str) -> DataFrame:
    """(items, n): how many rows have exactly this sorted set of items."""
    sets = pairs.groupBy(row).agg(F.array_sort(F.collect_set(item)).alias("items"))
    return sets.groupBy("items").agg(F.count("*").alias("n"))


def shared_positions(muts: DataFrame, members: DataFrame) -> DataFrame:
    """Positions that all members of a group have: (grp, position); members: grp, member; muts: grp, member, position."""
    size = members.select("grp", "member").distinct().groupBy("grp").agg(F.count("*").alias("size"))
    seen = muts.select("grp", "member", "position").distinct().groupBy("grp", "position").agg(F.count("*").alias("n"))
    return seen.join(size, "grp").where("n = size").select("grp", "position")
