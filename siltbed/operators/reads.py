"""Aligned reads: CIGAR strings, blocks, lifts between read and reference, matches to annotation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltbed.operators.intervals import overlap_join

#: Fixed values of the SAM format: operations that consume the reference, the read, and aligned bases.
CONSUMES_REF, CONSUMES_READ, ALIGNED = "MDN=X", "MIS=X", "M=X"
#: Fixed values of the SAM format: flag bits.
UNMAPPED, SECONDARY, SUPPLEMENTARY, READ1 = 0x4, 0x100, 0x800, 0x40


def passes(flag: Column, mapq: Column, min_mapq: int, read1_only: bool = False) -> Column:
    """Mapped, primary and at least min_mapq; on request read 1 only."""
    ok = (flag.bitwiseAND(UNMAPPED | SECONDARY | SUPPLEMENTARY) == 0) & (mapq >= min_mapq)
    return ok & (flag.bitwiseAND(READ1) != 0) if read1_only else ok


def flag_filter(flag: Column, include: int, exclude: int) -> Column:
    """All bits of include, none of exclude."""
    return (flag.bitwiseAND(include) == include) & (flag.bitwiseAND(exclude) == 0)


def ops(cigar: Column, pos: Column) -> Column:
    """Array of (op, len, ref_start, read_start)."""
    lengths = F.transform(F.regexp_extract_all(cigar, F.lit(r"(\d+)[MIDNSHP=X]"), F.lit(1)), lambda x: x.cast("long"))
    kinds = F.regexp_extract_all(cigar, F.lit(r"\d+([MIDNSHP=X])"), F.lit(1))
    pairs = F.zip_with(kinds, lengths, lambda k, n: F.struct(k.alias("op"), n.alias("len")))

    def step(acc: Column, x: Column) -> Column:
        ref, read = acc["ref"], acc["read"]
        one = F.struct(x["op"].alias("op"), x["len"].alias("len"), ref.alias("ref_start"), read.alias("read_start"))
        return F.struct(
            F.concat(acc["out"], F.array(one)).alias("out"),
            (ref + F.when(F.instr(F.lit(CONSUMES_REF), x["op"]) > 0, x["len"]).otherwise(F.lit(0))).alias("ref"),
            (read + F.when(F.instr(F.lit(CONSUMES_READ), x["op"]) > 0, x["len"]).otherwise(F.lit(0))).alias("read"),
        )

    empty = F.array().cast("array<struct<op:string,len:bigint,ref_start:bigint,read_start:bigint>>")
    start = F.struct(empty.alias("out"), pos.cast("long").alias("ref"), F.lit(0).cast("long").alias("read"))
    # most alignments are one stretch; that needs no step for each operation
    number = F.substring_index(cigar, "M", 1).cast("long")
    one = F.array(F.struct(F.lit("M").alias("op"), number.alias("len"), pos.cast("long").alias("ref_start"), F.lit(0).cast("long").alias("read_start")))
    return F.when(cigar.rlike("^[0-9]{1,18}M$"), one).otherwise(F.aggregate(pairs, start, step, lambda acc: acc["out"]))


def with_blocks(df: DataFrame, pos: str, cigar: str) -> DataFrame:
    """df with blocks (aligned stretches; touching ones merge, so an insertion doesn't split) and introns (N only)."""
    found = df.withColumn("_ops", ops(F.col(cigar), F.col(pos)))

    def fold(acc: Column, x: Column) -> Column:
        last, end = F.try_element_at(acc, F.lit(-1)), x["ref_start"] + x["len"]
        new = F.struct(x["ref_start"].alias("start"), end.alias("end"))
        grown = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(last["start"].alias("start"), end.alias("end"))))
        return F.when((F.size(acc) > 0) & (last["end"] == x["ref_start"]), grown).otherwise(F.concat(acc, F.array(new)))

    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")
    aligned = F.filter("_ops", lambda x: F.instr(F.lit(ALIGNED), x["op"]) > 0)
    introns = F.transform(F.filter("_ops", lambda x: x["op"] == "N"), lambda x: F.struct(x["ref_start"].alias("start"), (x["ref_start"] + x["len"]).alias("end")))
    return found.withColumns({"blocks": F.aggregate(aligned, empty, fold), "introns": introns}).drop("_ops")


def read_position(pos: Column, cigar: Column, at: Column) -> Column:
    """The 0-based read position aligned to reference position at; null where none is."""
    hit = F.filter(ops(cigar, pos), lambda x: (F.instr(F.lit(ALIGNED), x["op"]) > 0) & (x["ref_start"] <= at) & (at < x["ref_start"] + x["len"]))
    one = F.try_element_at(hit, F.lit(1))
    return one["read_start"] + (at - one["ref_start"])


def exon_units(exons: DataFrame) -> DataFrame:
    """(gene, unit, start, end, exonic): the stretches between all exon borders of a gene, in order; even the gaps."""
    borders = exons.select("gene", F.explode(F.array("start", "end")).alias("x")).distinct()
    w = Window.partitionBy("gene").orderBy("x")
    units = borders.select("gene", (F.row_number().over(w) - 1).cast("long").alias("unit"), F.col("x").alias("start"), F.lead("x").over(w).alias("end")).where("end is not null")
    inside = exons.select(F.col("gene").alias("_g"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    on = (F.col("gene") == F.col("_g")) & (F.col("_s") <= F.col("start")) & (F.col("end") <= F.col("_e"))
    exonic = units.join(inside, on, "left_semi").select("gene", "unit", F.lit(True).alias("exonic"))
    return units.join(exonic, ["gene", "unit"], "left").withColumn("exonic", F.coalesce("exonic", F.lit(False)))


def unit_mask(units: DataFrame, blocks: DataFrame) -> DataFrame:
    """(id, gene, mask): the units (up to 63 of a gene) that a molecule's blocks touch, as bits."""
    on = (units.gene == blocks.gene) & (blocks.start < units.end) & (units.start < blocks.end)
    hit = blocks.join(units, on).select("id", units.gene, "unit").distinct()
    return hit.groupBy("id", "gene").agg(F.bit_or(F.expr("shiftleft(1L, cast(unit as int))")).alias("mask"))


def best_matches(reads: DataFrame, genes: DataFrame, width: int) -> DataFrame:
    """(id, gene, rank, overhang): per read the genes of its best class, ties kept: within 3, partly 2, around 1."""
    pairs = overlap_join(reads, genes, width)
    s, e, gs, ge = F.col("start"), F.col("end"), F.col("start_r"), F.col("end_r")
    rank = F.when((gs <= s) & (e <= ge), 3).when((s < gs) & (e > ge), 1).otherwise(2)
    overhang = F.greatest(F.lit(0), gs - s) + F.greatest(F.lit(0), e - ge)
    out = pairs.select("id", F.col("gene_r").alias("gene"), rank.alias("rank"), overhang.alias("overhang"))
    return out.withColumn("_best", F.max("rank").over(Window.partitionBy("id"))).where("rank = _best").drop("_best")


def resolve_ambiguity(hits: DataFrame, key: str = "id") -> DataFrame:
    """(id, class) of multimappers: several chromosomes, then one gene in several bins, then several genes in one bin."""
    n = hits.groupBy(key).agg(F.count_distinct("chr").alias("c"), F.count_distinct("gene").alias("g"), F.count_distinct("bin").alias("b"))
    kind = F.when(F.col("c") > 1, "multi_chromosome").when((F.col("g") == 1) & (F.col("b") > 1), "same_gene").when((F.col("g") > 1) & (F.col("b") == 1), "same_bin").otherwise("other")
    return n.select(key, kind.alias("class"))


def distinct_pairs(pairs: DataFrame, bases: int = 16) -> DataFrame:
    """pairs (ordinal, r1_seq, r2_seq, ...) without barcodes: the first by ordinal of those whose reads begin with the same bases
    in any case. A pair with a read that is shorter, or has another letter than ACGT there, has no key and stays."""
    heads = [F.upper(F.substring(c, 1, bases)) for c in ("r1_seq", "r2_seq")]
    keyed = pairs.withColumn("_key", F.when(F.forall(F.array(*heads), lambda h: h.rlike(f"^[ACGT]{{{bases}}}$")), F.concat(*heads)))
    first = keyed.where("_key is not null").groupBy("_key").agg(F.min("ordinal").alias("ordinal")).select("ordinal")
    return keyed.join(first.withColumn("_first", F.lit(True)), "ordinal", "left").where("_key is null or _first").drop("_key", "_first")
