"""From alignments to molecule matrices: filters, identities, gene evidence, one merge per molecule, datasets, cells.

Reads meet the masks of their shapes (position and CIGAR), made once each; one shuffle on (cell, gene, umi) merges all
evidence; counts need one more on (cell, gene).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltbed.operators.grammar import parse_read_name
from siltbed.operators.intervals import overlap_join
from siltbed.operators.molecules import umi_counts
from siltbed.operators.ranking import knee
from siltbed.operators.reads import passes, with_blocks
from siltbed.operators.transcripts import mask_bits, resolve_umis


def identified(alignments: DataFrame, tags: DataFrame | None = None, cell_tag: str = "CB", umi_tag: str = "UB") -> DataFrame:
    """alignments with cell and umi: from the read's name, else from a tag table by read id, else from its aux tags; reads
    without both are left out."""
    named = F.when(F.contains("qname", F.lit("|")), parse_read_name(F.col("qname")))  # most names are plain; taking one apart is slow
    out = alignments.withColumns({"_n": named, "_id": F.substring_index("qname", "|", 1)})
    cell, umi = F.col("_n.cell"), F.col("_n.umi")
    if tags is not None:
        t = tags.select(F.col("read_id").alias("_id"), F.col("cell").alias("_c"), F.col("umi").alias("_u"))
        out = out.join(t, "_id", "left")
        cell, umi = F.coalesce(cell, "_c"), F.coalesce(umi, "_u")
    found = out.withColumns({"cell": F.coalesce(cell, F.col("tags")[cell_tag]), "umi": F.coalesce(umi, F.col("tags")[umi_tag])})
    return found.where("cell is not null and umi is not null").drop("_n", "_id", "_c", "_u")


def bulk_identity(alignments: DataFrame, source: str) -> DataFrame:
    """Without barcodes: a file is a cell, and a read's name stands for its molecule."""
    return alignments.withColumns({"cell": F.col(source), "umi": F.xxhash64("qname").cast("string")})


def exon_catalogue(transcripts: DataFrame) -> DataFrame:
    """(gene, chr, strands, units, start, end): each gene's exon units between all exon borders, without what no exon covers.

    transcripts: gene, tx_id, chr, strand, exons. A gene is one row; its units are an array in genomic order.
    """
    e = transcripts.select("gene", "chr", F.explode("exons").alias("e")).select("gene", "chr", "e.start", "e.end").distinct()
    g = e.groupBy("gene", "chr").agg(F.collect_list(F.struct("start", "end")).alias("_e"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("start", "end"))))).alias("_b"))
    pairs = F.transform(F.sequence(F.lit(1), F.size("_b") - 1), lambda i: F.struct(F.get("_b", i - 1).alias("start"), F.get("_b", i).alias("end")))
    units = F.filter(pairs, lambda u: F.exists("_e", lambda x: (x["start"] <= u["start"]) & (u["end"] <= x["end"])))
    strands = transcripts.groupBy("gene").agg(F.collect_set("strand").alias("strands"))
    return g.join(strands, "gene").select("gene", "chr", "strands", units.alias("units"), F.col("_b")[0].alias("start"), F.element_at("_b", -1).alias("end"))


def shape_masks(shapes: DataFrame, catalogue: DataFrame, key: Sequence[str], width: int = 10_000) -> DataFrame:
    """(key, gene, strands, b): the bits that each shape sets on each gene; shapes: key, chr and blocks, a row for each.

    Blocks meet units and the gaps between them as rows of a binned join, so a block is held only against what is near it, not
    against all units of its gene. Bits are those of transcripts.mask_bits.
    """
    u = catalogue.select("gene", "chr", "strands", "units", F.posexplode("units").alias("i", "u")).withColumn("after", F.get("units", F.col("i") + 1)["start"])
    unit = F.struct(F.col("u.start").alias("start"), F.col("u.end").alias("end"), (2 * F.col("i")).alias("bit"))
    gap = F.struct(F.col("u.end").alias("start"), F.col("after").alias("end"), (2 * F.col("i") + 1).alias("bit"))
    u = u.select("gene", "chr", "strands", F.explode(F.array(unit, gap)).alias("x")).select("gene", "chr", "strands", "x.*").where(F.col("start") < F.col("end"))
    own = [F.col(c).alias(f"_k{n}") for n, c in enumerate(key)]
    b = shapes.select(*own, "chr", F.explode("blocks").alias("x")).select(*(f"_k{n}" for n in range(len(key))), "chr", "x.start", "x.end")
    hits = overlap_join(b, u, width).groupBy(*(f"_k{n}" for n in range(len(key))), "gene_r", "strands_r").agg(F.array_sort(F.collect_set("bit_r")).alias("b"))
    return hits.select(*(F.col(f"_k{n}").alias(c) for n, c in enumerate(key)), F.col("gene_r").alias("gene"), F.col("strands_r").alias("strands"), "b")


def _merged(reads: DataFrame, masks: DataFrame, key: Sequence[str], require_strand: bool) -> DataFrame:
    """(cell, gene, umi, bits) of reads (cell, umi, strand, key) and the masks of their shapes."""
    pairs = reads.select("cell", "umi", "strand", *key).join(masks, list(key))
    if require_strand:
        pairs = pairs.where(F.col("strand").isin(".", "?") | F.array_contains("strands", F.col("strand")))
    merged = pairs.groupBy("cell", "gene", "umi").agg(F.flatten(F.collect_set("b")).alias("b"))
    return merged.select("cell", "gene", "umi", F.array_sort(F.array_distinct("b")).alias("bits"))


def gene_evidence(reads: DataFrame, catalogue: DataFrame, width: int = 10_000, require_strand: bool = False) -> DataFrame:
    """(cell, gene, umi, bits): evidence of all reads of a molecule on a gene, merged by union.

    reads: cell, umi, chr, strand, blocks. Reads of equal blocks have equal masks, which are made once for them all.
    """
    key = ("chr", "blocks")
    return _merged(reads, shape_masks(reads.select(*key).distinct(), catalogue, key, width), key, require_strand)


def datasets(evidence: DataFrame) -> DataFrame:
    """(dataset, cell, feature, value): every molecule counts in exprs, and in intronic_exprs if any gap bit is set, else in
    exonic_exprs."""
    odd = F.exists("bits", lambda b: b % 2 == 1)
    names = F.explode(F.array(F.lit("exprs"), F.when(odd, "intronic_exprs").otherwise("exonic_exprs")))
    return evidence.select(names.alias("dataset"), "cell", F.col("gene").alias("feature")).groupBy("dataset", "cell", "feature").agg(F.count("*").alias("value"))


def transcript_counts(evidence: DataFrame, transcripts: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(cell, feature, value): molecules by the transcript that explains them, <gene>_novel for other mature ones."""
    masks = transcripts.join(catalogue.select("gene", "units"), "gene").select("gene", "tx_id", mask_bits(F.col("exons"), F.col("units")).alias("bits"))
    found = resolve_umis(evidence, masks).where("kind <> 'Intronic'")
    feature = F.coalesce(F.col("tx_id").cast("string"), F.concat(F.col("gene").cast("string"), F.lit("_novel")))
    return umi_counts(found.select("cell", feature.alias("feature"), F.struct("gene", "umi").alias("umi")))


def called_cells(counts: DataFrame, min_umis: int | None = None) -> DataFrame:
    """(cell): at least min_umis exonic molecules, or, without that, the cells up to the knee of all molecules."""
    if min_umis is not None:
        t = counts.where("dataset = 'exonic_exprs'").groupBy("cell").agg(F.sum("value").alias("total"))
        return t.where(F.col("total") >= min_umis).select("cell")
    t = counts.where("dataset = 'exprs'").groupBy("cell").agg(F.sum("value").alias("total"))
    return t.crossJoin(F.broadcast(knee(t).select("cutoff"))).where("total >= cutoff").select("cell")


def quantify(alignments: DataFrame, transcripts: DataFrame, min_mapq: int = 0, tags: DataFrame | None = None, min_umis: int | None = None, require_strand: bool = False) -> dict[str, DataFrame]:
    """evidence, counts (by dataset) and cells of alignments (qname, flag, rname, pos, mapq, cigar, tags)."""
    flag = F.col("flag")
    strand: Column = F.when(flag.bitwiseAND(16) != 0, "-").otherwise("+")
    passed = alignments.where(passes(flag, F.col("mapq"), min_mapq)).withColumnRenamed("rname", "chr")
    reads = identified(passed, tags).select("cell", "umi", "chr", strand.alias("strand"), "pos", "cigar")
    # a position and a CIGAR make the blocks, so that is all that reads are compared by
    key = ("chr", "pos", "cigar")
    shapes = with_blocks(passed.select(*key).distinct(), "pos", "cigar")
    evidence = _merged(reads, shape_masks(shapes, exon_catalogue(transcripts), key), key, require_strand)
    counts = datasets(evidence)
    return {"evidence": evidence, "counts": counts, "cells": called_cells(counts, min_umis)}
