"""Half-open genomic intervals: binned joins, coverage, islands.

A range predicate alone plans as a nested loop. Both sides get the bins of fixed width that they touch, join by equality on
(chr, bin), and a pair is kept in just one bin: that where the later of the two starts lies. That needs no distinct.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltbed.operators.grouped import across, dealt, earlier, with_edges
from siltbed.scratch import stored

#: Fixed value: width of a SNP bin.
SNP_BIN = 10_000


def bins(start: Column, end: Column, width: int) -> Column:
    """The bins that [start, end) touches; none for an empty interval."""
    w = F.lit(width)
    first, last = F.floor(start / w), F.floor((end - 1) / w)
    return F.when(end > start, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Touching intervals don't overlap."""
    return (a_start < b_end) & (b_start < a_end)


def contains(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start <= b_start) & (b_end <= a_end)


def reciprocal_overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Overlap as a share of the longer interval; 0 without overlap."""
    common = F.greatest(F.lit(0), F.least(a_end, b_end) - F.greatest(a_start, b_start))
    return F.coalesce(F.try_divide(common, F.greatest(a_end - a_start, b_end - b_start)), F.lit(0.0))


def overlap_join(left: DataFrame, right: DataFrame, width: int, names: tuple[str, str, str] = ("chr", "start", "end"), suffix: str = "_r") -> DataFrame:
    """All pairs that overlap; right's columns get the suffix. A hot bin is dealt out by AQE's skew join."""
    c, s, e = names
    a = left.withColumn("_bin", F.explode(bins(F.col(s), F.col(e), width)))
    b = right.select(*[F.col(x).alias(x + suffix) for x in right.columns])
    b = b.withColumn("_bin_r", F.explode(bins(F.col(s + suffix), F.col(e + suffix), width)))
    later = F.floor(F.greatest(F.col(s), F.col(s + suffix)) / F.lit(width))
    on = (F.col(c) == F.col(c + suffix)) & (F.col("_bin") == F.col("_bin_r")) & overlaps(F.col(s), F.col(e), F.col(s + suffix), F.col(e + suffix)) & (F.col("_bin") == later)
    return a.join(b, on).drop("_bin", "_bin_r")


def points_in(points: DataFrame, spans: DataFrame, width: int = SNP_BIN) -> DataFrame:
    """(points: chr, pos) within (spans: chr, start, end); a point has one bin, so nothing repeats."""
    p = points.withColumn("_bin", F.floor(F.col("pos") / width))
    s = spans.withColumn("_bin_s", F.explode(bins(F.col("start"), F.col("end"), width))).withColumnRenamed("chr", "_chr")
    on = (F.col("chr") == F.col("_chr")) & (F.col("_bin") == F.col("_bin_s")) & (F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("end"))
    return p.join(s, on).drop("_bin", "_bin_s", "_chr")


def _stretches(spans: DataFrame, by: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with _part and _no, a table of by, _part, _no, start, end, n, _key): islands of each range of rows, and with _key those
    of the group: a stretch that an earlier one reaches has that one's key."""
    rows = dealt(spans, [*by, "start", "end"], "spans")
    w = Window.partitionBy(*by, "_part").orderBy("_row")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_new", F.when(F.col("start") <= reach, 0).otherwise(1))
    rows = rows.withColumn("_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new", "_row")
    own = stored(rows.groupBy(*by, "_part", "_no").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n")), "stretches")
    reached = across(own.groupBy(*by, "_part").agg(F.max("end").alias("_e")), by, _reach=F.max("_e").over(earlier(by)))
    own = with_edges(own, reached, by).withColumn("_on", F.coalesce(F.col("start") <= F.col("_reach"), F.lit(False))).drop("_reach")
    begun = own.groupBy(*by, "_part").agg(F.max(F.when(~F.col("_on"), F.struct("_part", "_no"))).alias("_last"))
    carried = across(begun, by, _carry=F.last("_last", ignorenulls=True).over(earlier(by)))
    own = with_edges(own, carried, by)
    return rows, own.withColumn("_key", F.when(F.col("_on"), F.col("_carry")).otherwise(F.struct("_part", "_no"))).drop("_on", "_carry")


def islands(spans: DataFrame, by: Sequence[str] = ("chr",)) -> DataFrame:
    """Unions of intervals with the number of sources; touching intervals merge. Ranges of starts are merged first, in tasks of bounded
    size, then what reaches from one into the next."""
    _, own = _stretches(spans.select(*by, "start", "end"), by)
    return own.groupBy(*by, "_key").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n")).drop("_key")


def with_islands(spans: DataFrame, by: Sequence[str] = ("chr",)) -> DataFrame:
    """spans with island: a struct that intervals of one union share, unlike others of their group."""
    rows, own = _stretches(spans, by)
    key = [*by, "_part", "_no"]
    keys = own.select(*[F.col(c).alias(f"_{c}_k") for c in key], F.col("_key").alias("island"))
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}_k")) for c in key])
    return rows.join(keys, on).select(*spans.columns, "island")


def coverage(spans: DataFrame, width: int) -> DataFrame:
    """(chr, bin, value): reads that touch each bin. spans has a row for each read: chr, start, end.

    Reads of several blocks: block_coverage, which counts a read once in a bin without a shuffle of (read, bin)."""
    return spans.select("chr", F.explode(bins(F.col("start"), F.col("end"), width)).alias("bin")).groupBy("chr", "bin").agg(F.count("*").alias("value"))


def block_coverage(reads: DataFrame, width: int, blocks: str = "blocks") -> DataFrame:
    """(chr, bin, value) of reads with an array of blocks (start, end): a read adds 1 to each bin that any block touches."""
    touched = F.array_distinct(F.flatten(F.transform(blocks, lambda b: bins(b["start"], b["end"], width))))
    return reads.select("chr", F.explode(touched).alias("bin")).groupBy("chr", "bin").agg(F.count("*").alias("value"))


def full_track(track: DataFrame, chromosomes: DataFrame, width: int) -> DataFrame:
    """The track with zero bins: chromosomes has chr and length."""
    last = F.floor((F.col("length") - 1) / width)
    all_bins = chromosomes.select("chr", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("bin"))
    return all_bins.join(track, ["chr", "bin"], "left").withColumn("value", F.coalesce("value", F.lit(0)))


def normalised(track: DataFrame, how: str, width: int, reads: DataFrame) -> DataFrame:
    """value of coverage()'s track as CPM (per million reads), RPKM (that per kilobase of bin) or BPM (per million of the
    sum of all bins).

    reads is the table that was counted, a row for each mapped read, whether or not it fell into a bin; a read that
    touches several bins is one read. Without reads (BPM: without values) every value is 0.
    """
    total = track.agg(F.sum("value").alias("_t")) if how == "BPM" else reads.agg(F.count("*").alias("_t"))
    per_million = F.col("value") * 1e6 / F.col("_t")
    factor = {"CPM": per_million, "RPKM": per_million * (1000.0 / width), "BPM": per_million}[how]
    return track.crossJoin(F.broadcast(total)).withColumn("value", F.when(F.col("_t") > 0, factor).otherwise(0.0)).drop("_t")


def compare_tracks(left: DataFrame, right: DataFrame, eps: float) -> DataFrame:
    """One row: bins, bins that differ by more than eps, mean and variance of |difference|, rmse, the worst bin, Pearson's r.

    A bin that only one track has counts as 0 in the other; r is 0 where a track doesn't vary.
    """
    a, b = left.select("chr", "bin", F.col("value").cast("double").alias("a")), right.select("chr", "bin", F.col("value").cast("double").alias("b"))
    both = a.join(b, ["chr", "bin"], "full").withColumns({"a": F.coalesce("a", F.lit(0.0)), "b": F.coalesce("b", F.lit(0.0))}).withColumn("d", F.abs(F.col("a") - F.col("b")))
    s = both.agg(
        F.count("*").alias("n"), F.count_if(F.col("d") > eps).alias("n_over_eps"), F.avg("d").alias("mean_abs"), F.avg(F.col("d") * F.col("d")).alias("msd"),
        F.sum("a").alias("sa"), F.sum("b").alias("sb"), F.sum(F.col("a") * F.col("a")).alias("saa"), F.sum(F.col("b") * F.col("b")).alias("sbb"), F.sum(F.col("a") * F.col("b")).alias("sab"),
        F.max(F.struct(F.col("d"), F.col("chr"), F.negative("bin").alias("nb"))).alias("worst"),
    )
    n = F.col("n")
    va, vb, cab = n * F.col("saa") - F.col("sa") ** 2, n * F.col("sbb") - F.col("sb") ** 2, n * F.col("sab") - F.col("sa") * F.col("sb")
    r = F.coalesce(F.try_divide(cab, F.sqrt(F.greatest(va, F.lit(0.0)) * F.greatest(vb, F.lit(0.0)))), F.lit(0.0))
    return s.select(
        "n", "n_over_eps", "mean_abs", (F.col("msd") - F.col("mean_abs") ** 2).alias("var_abs"), F.sqrt("msd").alias("rmse"),
        F.col("worst.chr").alias("worst_chr"), F.negative("worst.nb").alias("worst_bin"), F.col("worst.d").alias("worst_diff"), r.alias("pearson"),
    )


def adjacent_domains(anchors: DataFrame) -> DataFrame:
    """Neighbouring anchors of a chromosome span a domain between their midpoints."""
    w = Window.partitionBy("chr").orderBy("start", "end", "id")
    mid = F.floor((F.col("start") + F.col("end")) / 2)
    out = anchors.select("chr", "id", mid.alias("domain_start"), F.lead(mid).over(w).alias("domain_end"), F.lead("id").over(w).alias("next_id"))
    return out.where("domain_end is not null")


def loop_recurrence(loops: DataFrame, width: int = 25_000) -> DataFrame:
    """(a, b, experiments): in how many experiments an unordered pair of binned endpoints occurs."""
    x, y = F.floor(F.col("left") / width), F.floor(F.col("right") / width)
    keyed = loops.select("experiment", F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()
    return keyed.groupBy("a", "b").agg(F.count("*").alias("experiments"))


def neighbours(genes: DataFrame, k: int, by: str = "chr") -> DataFrame:
    """(id, neighbour, distance, rank): the k nearest other genes of the chromosome by midpoint, ties by id.

    Only the k + 1 smallest ids of a midpoint can be wanted, and only those of the k midpoints before and after; so each
    midpoint gets a bounded list of candidates by lags, in place of a self-join of the chromosome.
    """
    first = genes.withColumn("_r", F.row_number().over(Window.partitionBy(by, "mid").orderBy("id"))).where(F.col("_r") <= k + 1)
    mids = first.groupBy(by, "mid").agg(F.array_sort(F.collect_list("id")).alias("_ids"))
    w = Window.partitionBy(by).orderBy("mid")
    own = F.struct(F.col("mid").alias("m"), F.col("_ids").alias("ids"))
    others = [f(own, d).over(w) for d in range(1, k + 1) for f in (F.lag, F.lead)]
    wide = mids.select(by, "mid", F.array(own, *others).alias("_o"))
    near = genes.join(wide, [by, "mid"]).select(by, "id", "mid", F.explode("_o").alias("_c")).where("_c is not null")
    near = near.select(by, "id", F.explode("_c.ids").alias("neighbour"), F.abs(F.col("mid") - F.col("_c.m")).alias("distance")).where("id <> neighbour")
    rank = F.row_number().over(Window.partitionBy(by, "id").orderBy("distance", "neighbour"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k)


def junctions(blocks: Column, gap: int = 0) -> Column:
    """Gaps over gap between neighbouring blocks (array of start, end structs in order)."""
    pairs = F.transform(F.sequence(F.lit(1), F.size(blocks) - 1), lambda i: F.struct(blocks[i - 1]["end"].alias("start"), blocks[i]["start"].alias("end")))
    found = F.filter(pairs, lambda j: j["end"] - j["start"] > gap)
    return F.when(F.size(blocks) > 1, found).otherwise(F.slice(F.transform(blocks, lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"))), 1, 0))


def merged_blocks(blocks: Column) -> Column:
    """Blocks in order, touching and overlapping ones merged."""

    def fold(done: Column, b: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], b["end"]).alias("end"))))
        return F.when(F.size(done) == 0, F.array(b)).when(b["start"] <= last["end"], joined).otherwise(F.concat(done, F.array(b)))

    return F.aggregate(F.array_sort(blocks), F.slice(blocks, 1, 0), fold)
