"""Matrix analytics on long tables: normalisation, moments, tests, markers, module scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltbed.operators.ranking import bh_fdr, ranked_values

#: The Chebyshev coefficients of the complementary error function in its classical textbook form.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def erfc(x: Column) -> Column:
    """Complementary error function for x >= 0, relative error about 1e-7."""
    t = 1 / (1 + 0.5 * x)
    poly = F.lit(ERFC[-1])
    for c in ERFC[-2::-1]:
        poly = F.lit(c) + t * poly
    return t * F.exp(-x * x + poly)


def mann_whitney(df: DataFrame, by: Sequence[str], inside: str, value: str) -> DataFrame:
    """Per group: sizes, U, z and the two-sided p by the normal approximation, without tie or continuity correction."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("_n"), F.count_if(F.col(inside)).alias("_i"), F.count_if(~F.col(inside)).alias("_o"))
    ranked = ranked_values(counts, value, by, "_k")
    k1 = F.sum(F.when(F.col("_i") > 0, F.col("_k") * F.col("_i")))
    u = ranked.groupBy(*by).agg(F.sum("_i").alias("n1"), F.sum("_o").alias("n2"), k1.alias("_s"))
    u = u.withColumn("u", F.col("_s") - F.col("n1") * (F.col("n1") + 1) / 2)
    n1, n2 = F.col("n1"), F.col("n2")
    z = F.try_divide(F.col("u") - n1 * n2 / 2, F.sqrt(n1 * n2 * (n1 + n2 + 1) / 12))
    out = u.withColumn("z", F.coalesce(z, F.lit(0.0)))
    return out.withColumn("p", F.least(F.lit(1.0), erfc(F.abs("z") / F.sqrt(F.lit(2.0))))).drop("_s")


def log_normalise(counts: DataFrame, totals: DataFrame | None = None, scale: float = 10_000.0) -> DataFrame:
    """ln(1 + scale * value / surviving); totals: cell, s (default: the sum of the cell's values); cells with none drop out."""
    if totals is None:
        totals = counts.groupBy("cell").agg(F.sum("value").alias("s"))
    out = counts.join(totals, "cell").where("s > 0")
    return out.select("cell", "feature", F.log1p(scale * F.col("value") / F.col("s")).alias("value"))


def feature_moments(values: DataFrame, cells: DataFrame) -> DataFrame:
    """(feature, mean, variance) over all cells, zeros included; population variance."""
    n = cells.agg(F.count("*").alias("n"))
    s = values.groupBy("feature").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("s2")).crossJoin(F.broadcast(n))
    mean = F.col("s") / F.col("n")
    return s.select("feature", mean.alias("mean"), F.greatest(F.lit(0.0), F.col("s2") / F.col("n") - mean * mean).alias("variance"))


def zscores(values: DataFrame, cells: DataFrame) -> DataFrame:
    """(cell, feature, z) for every cell and varying feature; dense by nature, so give it chosen features only."""
    stats = feature_moments(values, cells).where("variance > 0")
    dense = cells.select("cell").crossJoin(F.broadcast(stats)).join(values, ["cell", "feature"], "left")
    return dense.select("cell", "feature", ((F.coalesce("value", F.lit(0.0)) - F.col("mean")) / F.sqrt("variance")).alias("z"))


def log2_fold(a: Column, b: Column, pseudo: float = 1e-6) -> Column:
    return F.log2((a + pseudo) / (b + pseudo))


def markers(means: DataFrame, group: str, n: int) -> DataFrame:
    """The n strongest features up and down of each group against the mean of all other groups that have the feature."""
    w = Window.partitionBy("feature")
    weighted = F.col("mean") * F.col("n_cells")
    other = F.try_divide(F.sum(weighted).over(w) - weighted, F.sum("n_cells").over(w) - F.col("n_cells"))
    fold = means.withColumn("other", other).where("other is not null").withColumn("log2fc", F.round(log2_fold(F.col("mean"), F.col("other")), 6))
    fold = fold.withColumn("direction", F.when(F.col("log2fc") >= 0, "up").otherwise("down"))
    rank = F.row_number().over(Window.partitionBy(group, "direction").orderBy(F.desc(F.abs("log2fc")), "feature"))
    return fold.withColumn("rank", rank).where(F.col("rank") <= n).select(group, "feature", "direction", "log2fc", "rank")


def marker_scores(detection: Column, other_detection: Column, mean: Column, other_mean: Column) -> dict[str, Column]:
    """Rankings of a marker from detection shares and means of the values above zero, inside and outside of a group.

    general rewards specific and strong signals, sparse strong ones in a minority of cells, low_signal a change either way
    of weak ones.
    """
    zero, strength = F.lit(0.0), F.log1p(mean)
    gain, lift = F.greatest(detection - other_detection, zero), strength - F.log1p(other_mean)
    general = gain * (1 + F.greatest(lift, zero)) * strength
    sparse = F.when(detection > 0, strength * mean / (1 + mean) * F.sqrt(detection) * F.greatest(1 - detection, zero) * gain).otherwise(zero)
    weak = F.pow(1 + F.greatest(mean, other_mean), F.lit(-3.0))
    change = F.abs(detection - other_detection) + 0.1 * F.abs(lift) * F.sqrt(F.least(detection, other_detection))
    return {"general": general, "sparse": sparse, "low_signal": weak * change}


def marker_tests(values: DataFrame, cells: DataFrame, group: str, samples: int) -> DataFrame:
    """Each feature in each group against all cells outside of it, a row for every (group, feature) of values' features.

    mean and other are means over pseudobulk samples: the cells of either side, in the order of cell, are dealt round-robin
    into max(2, samples) samples, at most one a cell, and u and p compare the samples' means (mann_whitney); q is
    Benjamini-Hochberg over the group's features. Then detection shares and means of values above zero, inside and outside,
    log2fc of the means, and the marker_scores. cells: cell and group, every cell. A cell goes to every group's comparison,
    so values are read once for each group; groups are few.
    """
    groups = cells.groupBy(group).agg(F.count("*").alias("_in"))
    sides = cells.select("cell", F.col(group).alias("_own")).crossJoin(F.broadcast(groups)).withColumn("_side", F.col("_own") == F.col(group))
    place = F.row_number().over(Window.partitionBy(group, "_side").orderBy("cell")) - 1
    size = F.count("*").over(Window.partitionBy(group, "_side"))
    dealt = sides.select("cell", group, "_side", size.alias("_size"), place.alias("_place")).withColumn("_sample", F.col("_place") % F.least(F.lit(max(2, samples)), F.col("_size")))
    sizes = dealt.groupBy(group, "_side", "_sample").agg(F.count("*").alias("_n"))
    sums = values.join(dealt, "cell").groupBy(group, "_side", "_sample", "feature").agg(F.sum("value").alias("_s"), F.count_if(F.col("value") > 0).alias("_k"), F.sum(F.when(F.col("value") > 0, F.col("value")).otherwise(0)).alias("_p"))
    dense = sizes.crossJoin(F.broadcast(values.select("feature").distinct())).join(sums, [group, "_side", "_sample", "feature"], "left").na.fill(0, ["_s", "_k", "_p"])
    dense = dense.withColumn("_mean", F.col("_s") / F.col("_n"))
    test = mann_whitney(dense, [group, "feature"], "_side", "_mean").where("n1 > 0 and n2 > 0").select(group, "feature", "u", "p")
    of = lambda f, c, inside: f(F.when(F.col("_side") == inside, F.col(c)))
    both = [(n, inside) for n, inside in (("", True), ("other_", False))]
    stats = dense.groupBy(group, "feature").agg(
        *[of(F.avg, "_mean", i).alias(n + "mean") for n, i in both], *[(of(F.sum, "_k", i) / of(F.sum, "_n", i)).alias(n + "detection") for n, i in both],
        *[F.coalesce(F.try_divide(of(F.sum, "_p", i), of(F.sum, "_k", i)), F.lit(0.0)).alias(n + "positive") for n, i in both],
    )
    scores = marker_scores(*(F.col(c) for c in ("detection", "other_detection", "positive", "other_positive")))
    out = bh_fdr(test.join(stats, [group, "feature"]), "p", [group], "feature").withColumn("log2fc", log2_fold(F.col("mean"), F.col("other_mean")))
    return out.withColumns(scores)


def marker_rankings(tests: DataFrame, group: str, n: int = 50, digits: int = 9) -> DataFrame:
    """(ranking, group, direction, rank, feature, score): the n first features up and down of each group by four rankings.

    significance sorts marker_tests by q, p and |log2fc| (score is q); general by its score, then q; sparse and low_signal
    by theirs; ties by name. A feature is up where log2fc is above 0, down where below. Scores of 0 aren't ranked. What is
    sorted is rounded to digits, so that sums in another order give no other ranks.
    """
    t = tests.withColumns({c: F.round(c, digits) for c in ("q", "p", "log2fc", "general", "sparse", "low_signal")})
    direction = F.when(F.col("log2fc") > 0, "up").when(F.col("log2fc") < 0, "down")
    orders = {"significance": ("q", ["q", "p", F.desc(F.abs("log2fc"))]), "general": ("general", [F.desc("general"), "q"]), "sparse": ("sparse", [F.desc("sparse")]), "low_signal": ("low_signal", [F.desc("low_signal")])}
    every = None
    for name, (score, order) in orders.items():
        one = t.withColumn("direction", direction).where("direction is not null")
        one = one if name == "significance" else one.where(F.col(score) > 0)
        rank = F.row_number().over(Window.partitionBy(group, "direction").orderBy(*order, "feature"))
        one = one.withColumn("rank", rank).where(F.col("rank") <= n).select(F.lit(name).alias("ranking"), group, "direction", "rank", "feature", F.col(score).alias("score"))
        every = one if every is None else every.unionByName(one)
    return every


def pseudobulk(values: DataFrame, cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean per (by, feature) over all of the group's cells."""
    n = cells.groupBy(*by).agg(F.count("*").alias("_n"))
    s = values.join(cells, "cell").groupBy(*by, "feature").agg(F.sum("value").alias("_s"))
    return s.join(F.broadcast(n), list(by)).select(*by, "feature", (F.col("_s") / F.col("_n")).alias("mean"))


def module_scores(values: DataFrame, cells: DataFrame, genes: DataFrame, controls: DataFrame) -> DataFrame:
    """(cell, score): mean of the module's genes less the mean of its control genes, zeros included."""
    sizes = genes.agg(F.count("*").alias("g")).crossJoin(controls.agg(F.count("*").alias("k")))
    marked = F.broadcast(genes.select("feature").distinct().withColumn("_in", F.lit(1))), F.broadcast(controls.select("feature").distinct().withColumn("_out", F.lit(1)))
    sums = values.join(marked[0], "feature", "left").join(marked[1], "feature", "left").groupBy("cell")
    sums = sums.agg(F.sum(F.col("value") * F.coalesce("_in", F.lit(0))).alias("a"), F.sum(F.col("value") * F.coalesce("_out", F.lit(0))).alias("b"))
    out = cells.select("cell").join(sums, "cell", "left").crossJoin(F.broadcast(sizes))
    part = [F.coalesce(F.try_divide(F.coalesce(s, F.lit(0.0)), F.col(n).cast("double")), F.lit(0.0)) for s, n in (("a", "g"), ("b", "k"))]
    return out.select("cell", (part[0] - part[1]).alias("score"))


def control_genes(means: DataFrame, module: DataFrame, bins: int = 24, per_gene: int = 100, seed: int = 0) -> DataFrame:
    """Genes outside the module from the expression bins of its genes: per gene of the module up to per_gene of its bin,
    by a seeded hash; the union over the module's genes. Genes are a dimension, so their order is one window."""
    n = F.count("*").over(Window.partitionBy(F.lit(1)))
    place = F.row_number().over(Window.orderBy("mean", "feature")) - 1
    binned = means.select("feature", F.floor(place * bins / n).alias("bin"))
    wanted = binned.join(module, "feature", "left_semi").select(F.col("bin"), F.col("feature").alias("gene"))
    pool = binned.join(module, "feature", "left_anti")
    rank = F.row_number().over(Window.partitionBy("gene").orderBy(F.xxhash64(F.lit(seed), "gene", "feature"), "feature"))
    return wanted.join(pool, "bin").withColumn("r", rank).where(F.col("r") <= per_gene).select("feature").distinct()


def phase(s: Column, g2m: Column) -> Column:
    """Cell-cycle phase of two module scores: G1 where both are below 0; a tie is G2M."""
    return F.when((s < 0) & (g2m < 0), "G1").when(s > g2m, "S").otherwise("G2M")


def pearson(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column, degenerate: float | None = 0.0) -> Column:
    """From sums; a side that doesn't vary gives degenerate (0 or null)."""
    vx, vy = n * sxx - sx * sx, n * syy - sy * sy
    return F.when((vx <= 0) | (vy <= 0), F.lit(degenerate).cast("double")).otherwise(F.try_divide(n * sxy - sx * sy, F.sqrt(vx * vy)))


def stability_weighted(effects: DataFrame, by: Sequence[str], effect: str, dispersion: str) -> DataFrame:
    """Weighted mean effect with weights 1 / (1 + dispersion), and the effective n (sum w)^2 / sum w^2."""
    w = 1 / (1 + F.col(dispersion))
    out = effects.groupBy(*by).agg(F.sum(w * F.col(effect)).alias("_e"), F.sum(w).alias("_w"), F.sum(w * w).alias("_w2"))
    return out.select(*by, (F.col("_e") / F.col("_w")).alias("effect"), (F.col("_w") * F.col("_w") / F.col("_w2")).alias("effective_n"))


def module_by_condition(scores: DataFrame, cells: DataFrame, condition: str) -> DataFrame:
    """(condition, module, n_cells, mean, sd) of scores (cell, module, score); population sd."""
    out = scores.join(cells.select("cell", condition), "cell").groupBy(condition, "module")
    return out.agg(F.count("*").alias("n_cells"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("sd"))


def welch_statistics(df: DataFrame, by: Sequence[str], inside: str, value: str) -> DataFrame:
    """Per group: sizes, means, t and degrees of freedom of a value inside and outside; t and df are 0 where a side has under two
    rows or nothing varies. Its p is statistics.t_two_sided."""
    def side(f, flag: bool) -> Column:
        return f(F.when(F.col(inside) == flag, F.col(value)))

    out = df.groupBy(*by).agg(*[side(f, flag).alias(n + k) for k, flag in (("1", True), ("2", False)) for n, f in (("n", F.count), ("mean", F.avg), ("_v", F.var_samp))])
    a, b = F.col("_v1") / F.col("n1"), F.col("_v2") / F.col("n2")
    able = (F.col("n1") >= 2) & (F.col("n2") >= 2) & (a + b > 0)
    t = F.when(able, (F.col("mean1") - F.col("mean2")) / F.sqrt(a + b)).otherwise(0.0)
    dof = F.when(able, (a + b) * (a + b) / (a * a / (F.col("n1") - 1) + b * b / (F.col("n2") - 1))).otherwise(0.0)
    return out.select(*by, "n1", "n2", "mean1", "mean2", t.alias("t"), dof.alias("dof"))
