"""Ranks, cut-offs and ordered analytics."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltbed.operators.grouped import across, dealt, earlier, later, with_edges
from siltbed.scratch import stored


def positions(df: DataFrame, value: str, tie: str, descending: bool = False, parts: int = 256) -> DataFrame:
    """df with position: its place from 0 in the order of a numeric value, then of a unique numeric tie column.

    A window without a partition sorts all rows in one task. Here rows are dealt out by ranges of the value, whose borders
    are approximate quantiles; a value that fills whole ranges is dealt on by ranges of tie. Places within a range and the
    sizes of the ranges before it add up to the exact place, wherever the borders lie.
    """
    df = stored(df, "positions")  # three passes over it follow
    v, t = F.col(value).cast("double"), F.col(tie).cast("double")
    if descending:
        v = -v
    shares = [k / parts for k in range(1, parts)]
    cut = df.agg(F.percentile_approx(v, shares, 10_000).alias("v"), F.percentile_approx(t, shares, 10_000).alias("t")).first()
    borders, ties = cut["v"] or [], cut["t"] or []
    hot = sorted({a for a, b in zip(borders, borders[1:]) if a == b})

    def slot(x: Column, at: list[float]) -> Column:
        if not at:
            return F.lit(0)
        return F.size(F.filter(F.array(*[F.lit(b) for b in sorted(set(at))]), lambda b: b < x))

    # equal values always share the first slot, and a hot value's rows are alone in it
    first = 2 * slot(v, [*borders, *hot]) + F.when(v.isin(hot), 1).otherwise(0) if hot else 2 * slot(v, borders)
    second = F.when(v.isin(hot), slot(t, ties)).otherwise(0) if hot else F.lit(0)
    dealt = df.withColumns({"_a": first, "_b": second})
    sizes = dealt.groupBy("_a", "_b").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_a", "_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_a", "_b", before.alias("_before"))
    order = [F.desc(value) if descending else F.asc(value), F.asc(tie)]
    place = F.row_number().over(Window.partitionBy("_a", "_b").orderBy(*order)) - 1 + F.col("_before")
    return dealt.join(offsets, ["_a", "_b"]).withColumn("position", place.cast("long")).drop("_a", "_b", "_before")


def knee(counts: DataFrame, value: str = "total") -> DataFrame:
    """The knee of a barcode-rank curve, one row: knee_rank (cells at or over the cut-off), cutoff, score; none if fewer than
    three cells have more than one molecule.

    The knee is the cell farthest from the chord of the log10-log10 curve over cells of more than one molecule. If at least
    10 cells lie before it and 20 after, the rest of the curve is looked at again, and a second knee with 10 cells on either
    side and a score of 0.05 takes its place. Along cells of equal depth the distance is linear in log rank, so only the
    first and the last of them can be farthest: the passes run over distinct depths, not over cells.
    """
    depths = counts.where(F.col(value) > 1).groupBy(F.col(value).cast("long").alias("depth")).agg(F.count("*").alias("n"))
    last = F.sum("n").over(Window.orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0))
    ends = stored(depths.select("depth", "n", last.alias("last")).withColumn("first", F.col("last") - F.col("n") + 1), "depths")
    points = ends.select("depth", "last", F.explode(F.array_distinct(F.array("first", "last"))).alias("rank"))
    size = ends.agg(F.max("last").alias("cells"), F.min("depth").alias("low"), F.max("depth").alias("high")).where("cells >= 3")

    def farthest(start: DataFrame) -> DataFrame:
        """start: one row with r0, d0 (the chord's first cell), cells, low. The first of equal distances counts."""
        x0, y0 = F.log10(F.col("r0").cast("double")), F.log10(F.col("d0").cast("double"))
        dx, dy = F.log10(F.col("cells").cast("double")) - x0, F.log10(F.col("low").cast("double")) - y0
        off = F.abs(dy * (F.log10(F.col("rank").cast("double")) - x0) - dx * (F.log10(F.col("depth").cast("double")) - y0))
        score = F.round(F.try_divide(off, F.sqrt(dx * dx + dy * dy)), 9)
        inside = points.crossJoin(F.broadcast(start)).where("rank > r0 and rank < cells").withColumn("score", score).where("score is not null")
        best = F.max(F.struct(F.col("score"), F.negative("rank").alias("r"), F.col("depth"), F.col("last")))
        return inside.agg(best.alias("b"), F.max("cells").alias("cells"), F.max("low").alias("low")).where("b is not null").select(F.negative("b.r").alias("rank"), "b.depth", "b.last", "b.score", "cells", "low")

    one = farthest(size.select(F.lit(1).cast("long").alias("r0"), F.col("high").alias("d0"), "cells", "low"))
    again = one.where("rank - 1 >= 10 and cells - (rank - 1) >= 20").select(F.col("rank").alias("r0"), F.col("depth").alias("d0"), "cells", "low")
    first = again.select(F.col("r0").alias("p"))
    two = farthest(again).crossJoin(F.broadcast(first)).where("rank - p >= 10 and cells - (rank - 1) >= 10 and score >= 0.05")
    both = one.select(F.lit(1).alias("k"), "last", "depth", "score").unionByName(two.select(F.lit(2).alias("k"), "last", "depth", "score"))
    return both.agg(F.max(F.struct("k", "last", "depth", "score")).alias("b")).where("b is not null").select(F.col("b.last").alias("knee_rank"), F.col("b.depth").alias("cutoff"), F.col("b.score").alias("score"))


def bh_over_all(tests: DataFrame, p: str, tie: str, blocks: int = 256) -> DataFrame:
    """tests with q: Benjamini-Hochberg over all rows, without a window over all rows; tie is any numeric column.

    Rows are cut in blocks by their exact place. The smallest p m / rank of the later rows is that of the later rows of the
    block or of the later blocks, of which there are few.
    """
    n = tests.agg(F.count("*").alias("_m"))
    placed = positions(tests, p, tie).crossJoin(F.broadcast(n)).withColumn("_block", F.floor(F.col("position") * blocks / F.col("_m")))
    placed = stored(placed.withColumn("_raw", F.col(p) * F.col("_m") / (F.col("position") + 1)), "tests")
    later = Window.orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    after = placed.groupBy("_block").agg(F.min("_raw").alias("_least")).select("_block", F.min("_least").over(later).alias("_after"))
    own = F.min("_raw").over(Window.partitionBy("_block").orderBy(F.desc("position")).rowsBetween(Window.unboundedPreceding, 0))
    out = placed.withColumn("_own", own).join(F.broadcast(after), "_block")
    return out.withColumn("q", F.least(F.lit(1.0), "_own", F.coalesce("_after", F.lit(1.0)))).drop("_m", "position", "_block", "_raw", "_own", "_after")


def bh_fdr(tests: DataFrame, p: str, by: Sequence[str], tie: str | None = None) -> DataFrame:
    """tests with q: Benjamini-Hochberg within each group; the number of tests is the group's own.

    Rows are dealt out by ranges of (group, p, tie), so a large group is no single task's; places and the smallest p m / rank of
    later rows are carried over the few groups that have several ranges.
    """
    by = list(by)
    rows = dealt(tests, [*by, p, *([tie] if tie else [])], "tests")
    within = Window.partitionBy(*by, "_part")
    sizes = rows.groupBy(*by, "_part").agg(F.count("*").alias("_n"))
    places = across(sizes, by, _before=F.coalesce(F.sum("_n").over(earlier(by)), F.lit(0)), _m=F.sum("_n").over(Window.partitionBy(*by)))
    rank = F.col("_row") - F.min("_row").over(within) + 1
    raw = F.col(p) * F.coalesce("_m", F.count("*").over(within)) / (rank + F.coalesce("_before", F.lit(0)))
    ranked = stored(with_edges(rows, places, by).withColumn("_raw", raw).drop("_before", "_m"), "ranked")
    least = ranked.groupBy(*by, "_part").agg(F.min("_raw").alias("_least"))
    after = across(least, by, _after=F.min("_least").over(later(by)))
    own = F.min("_raw").over(within.orderBy(F.desc("_row")).rowsBetween(Window.unboundedPreceding, 0))
    out = with_edges(ranked.withColumn("_own", own), after, by)
    return out.withColumn("q", F.least(F.lit(1.0), "_own", "_after")).select(*tests.columns, "q")


def average_rank(value: str, by: Sequence[str]) -> Column:
    """The mean rank of equal values, from 1, for groups that a task can sort; see with_average_rank."""
    ordered = Window.partitionBy(*by).orderBy(value)
    return F.rank().over(ordered) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2


def ranked_values(counts: DataFrame, value: str, by: Sequence[str], name: str) -> DataFrame:
    """counts (by, value, _n and more: a row for each value of a group) with the mean rank of the value's rows, from 1."""
    by = list(by)
    rows = dealt(counts, [*by, value], "values")
    sizes = rows.groupBy(*by, "_part").agg(F.sum("_n").alias("_s"))
    places = across(sizes, by, _before=F.sum("_s").over(earlier(by)))
    w = Window.partitionBy(*by, "_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    rows = with_edges(rows.withColumn("_own", F.sum("_n").over(w)), places, by)
    rank = F.coalesce("_before", F.lit(0)) + F.coalesce("_own", F.lit(0)) + 1 + (F.col("_n") - 1) / 2
    return rows.withColumn(name, rank).drop("_part", "_row", "_own", "_before")


def with_average_rank(df: DataFrame, value: str, by: Sequence[str], name: str) -> DataFrame:
    """df with the mean rank of equal values, from 1, within each group. Only distinct values are ordered, and those in ranges, so a
    group of any size passes; rows then look their value up."""
    key = [*by, value]
    ranks = ranked_values(df.groupBy(*key).agg(F.count("*").alias("_n")), value, by, "_rank")
    ranks = ranks.select(*[F.col(c).alias(f"_{c}_v") for c in key], F.col("_rank").alias(name))
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}_v")) for c in key])
    return df.join(ranks, on).drop(*[f"_{c}_v" for c in key])


def equal_frequency_bins(df: DataFrame, value: str, tie: str, bins: int, name: str = "bin") -> DataFrame:
    """df with (position from 0) * bins / n, rounded down: unlike ntile where n is no multiple of bins."""
    n = df.agg(F.count("*").alias("_n"))
    placed = positions(df, value, tie).crossJoin(F.broadcast(n))
    return placed.withColumn(name, F.floor(F.col("position") * bins / F.col("_n")).cast("int")).drop("position", "_n")


def holdout(cells: DataFrame, group: str, depth: str, tie: str, share: float = 0.1) -> DataFrame:
    """cells with held: the deepest ceil(share) of each group, at least one and not all."""
    w = Window.partitionBy(group).orderBy(F.desc(depth), tie)
    n = F.count("*").over(Window.partitionBy(group))
    k = F.least(n - 1, F.greatest(F.lit(1), F.ceil(n * share)))
    return cells.withColumn("held", F.row_number().over(w) <= k)


def variable_features(stats: DataFrame, n: int) -> DataFrame:
    """The n features of the highest variance; ties by feature."""
    return stats.orderBy(F.desc("variance"), "feature").limit(n)


def top_per_group(df: DataFrame, by: Sequence[str], score: Column, tie: str, n: int, name: str = "rank") -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc_nulls_last(score), tie)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= n)


def best_and_second(df: DataFrame, key: str, item: str, score: str) -> DataFrame:
    """Per key: the best and second item by score (ties by item) and the gap; no second gives null."""
    w = Window.partitionBy(key).orderBy(F.desc(score), item)
    ranked = df.withColumns({"_r": F.row_number().over(w), "second": F.lead(item).over(w), "_s": F.lead(score).over(w)})
    return ranked.where("_r = 1").select(key, F.col(item).alias("best"), "second", F.col(score).alias("best_score"), (F.col(score) - F.col("_s")).alias("gap"))


def two_calls_per_locus(calls: DataFrame, by: Sequence[str], unique: Sequence[str], n: int = 2) -> DataFrame:
    """The best call of each distinct (unique) combination, then the n best of each locus: by umis, reads, id."""
    order = [F.desc("umis"), F.desc("reads"), F.col("id")]
    first = calls.withColumn("_u", F.row_number().over(Window.partitionBy(*by, *unique).orderBy(*order))).where("_u = 1").drop("_u")
    return first.withColumn("call", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("call") <= n)


def run_ids(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """df with run: a number per stretch of equal neighbours, not one per value."""
    w = Window.partitionBy(*by).orderBy(*order)
    new = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return df.withColumn("_new", new).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def transitions(df: DataFrame, by: str, order: Sequence[str], value: str) -> DataFrame:
    """How often the value changes along each sequence."""
    w = Window.partitionBy(by).orderBy(*order)
    return df.withColumn("_p", F.lag(value).over(w)).groupBy(by).agg(F.count_if(F.col("_p").isNotNull() & (F.col("_p") != F.col(value))).alias("transitions"))


def upper_median_gap(df: DataFrame, by: str, position: str) -> DataFrame:
    """Per group the upper median (sorted[n div 2]) of the positive gaps between neighbours."""
    w = Window.partitionBy(by).orderBy(position)
    gaps = df.withColumn("gap", F.col(position) - F.lag(position).over(w)).where("gap > 0")
    at = gaps.withColumns({"_r": F.row_number().over(Window.partitionBy(by).orderBy("gap")) - 1, "_n": F.count("*").over(Window.partitionBy(by))})
    return at.where(F.col("_r") == F.floor(F.col("_n") / 2)).select(by, F.col("gap").alias("median_gap"))


def cumulative_keep(parts: DataFrame, order: str, value: str, share: float, least: int) -> DataFrame:
    """parts with cumulative share and kept: the first ones up to share of the total, least of them at least."""
    w = Window.orderBy(order)
    total = parts.agg(F.sum(value).alias("_t"))
    out = parts.crossJoin(F.broadcast(total)).withColumns({"cumulative": F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)) / F.col("_t"), "_r": F.row_number().over(w)})
    before = F.col("cumulative") - F.col(value) / F.col("_t")
    return out.withColumn("kept", (F.col("_r") <= least) | (F.round(before, 9) < share)).drop("_r", "_t")
