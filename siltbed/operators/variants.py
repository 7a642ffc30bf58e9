"""Variants seen by reads: quality and flank filters, reference and alternative counts, genotypes; CIGAR clean-up at introns."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltbed.operators.intervals import points_in
from siltbed.operators.reads import CONSUMES_READ, CONSUMES_REF, ops
from siltbed.operators.summaries import genotype

#: Quality that every flank base needs at least, and how far a SNP's may lie below the flanks' median.
FLANK_QUALITY, BELOW_MEDIAN = 10, 10
#: Fixed value: width of the bins in which aligned stretches of reads meet SNPs.
READ_BIN = 128


def _place(found: Column, at: Column) -> Column:
    """The read position of a reference position among parsed operations."""
    hit = F.get(F.filter(found, lambda x: x["op"].isin("M", "=", "X") & (x["ref_start"] <= at) & (at < x["ref_start"] + x["len"])), F.lit(0))
    return hit["read_start"] + (at - hit["ref_start"])


def observe_snps(reads: DataFrame, snps: DataFrame, min_quality: int = 20, flank: int = 5) -> DataFrame:
    """(read, name, base, quality, allele): reads' bases at SNPs that pass; allele is ref, alt or other.

    reads: read, chr, pos, cigar, seq, qual; snps: chr, pos (0-based), ref, alts, name. With a flank, all bases of it are
    aligned without a break and have a quality of max(min_quality, 10), and the SNP's is at most 10 below their median.
    """
    r = reads.withColumn("_ops", ops(F.col("cigar"), F.col("pos"))).withColumnRenamed("pos", "_start")
    # a SNP that a read shows lies in one of its aligned stretches; in bins of about their length, not of SNP_BIN, a read is held
    # against the SNPs around it only
    aligned = F.filter("_ops", lambda x: x["op"].isin("M", "=", "X") & (x["len"] > 0))
    r = r.withColumn("_block", F.explode(aligned)).withColumns({"start": F.col("_block.ref_start"), "end": F.col("_block.ref_start") + F.col("_block.len")})
    r = r.withColumn("_read_start", F.col("_block.read_start")).drop("cigar", "_start", "_block", *([] if flank else ["_ops"]))
    j = points_in(snps, r, READ_BIN)
    own = F.col("_read_start") + F.col("pos") - F.col("start")
    j = j.withColumn("_own", own)
    quality = lambda p: F.ascii(F.substring("qual", p.cast("int") + 1, F.lit(1))) - 33
    j = j.withColumns({"base": F.upper(F.substring("seq", F.col("_own").cast("int") + 1, F.lit(1))), "quality": quality(F.col("_own"))}).where((F.col("quality") >= min_quality) & (F.length("qual") == F.length("seq")))
    if flank:
        at = F.transform(F.sequence(F.col("pos") - flank, F.col("pos") + flank), lambda p: _place(F.col("_ops"), p))
        j = j.withColumn("_at", at)
        whole = F.forall("_at", lambda p: p.isNotNull())
        straight = F.get("_at", F.lit(2 * flank)) - F.get("_at", F.lit(0)) == 2 * flank
        j = j.where(whole & straight).withColumn("_q", F.transform("_at", quality))
        others = F.array_sort(F.concat(F.slice("_q", 1, flank), F.slice("_q", flank + 2, flank)))
        median = F.floor((F.get(others, F.lit(flank - 1)) + F.get(others, F.lit(flank))) / 2)
        j = j.where(F.forall("_q", lambda q: q >= max(min_quality, FLANK_QUALITY)) & (F.col("quality") + BELOW_MEDIAN >= median))
    allele = F.when(F.col("base") == F.upper("ref"), "ref").when(F.array_contains(F.transform("alts", F.upper), F.col("base")), "alt").otherwise("other")
    return j.select("read", "name", "base", "quality", allele.alias("allele"))


def allele_counts(observed: DataFrame, molecules: DataFrame) -> DataFrame:
    """(cell, name, ref, alt): molecules (not reads) that show each allele; molecules: read, cell, umi. One that shows both
    counts on both sides."""
    one = observed.join(molecules, "read").where("allele <> 'other'").select("cell", "umi", "name", "allele").distinct()
    return one.groupBy("cell", "name").agg(F.count_if(F.col("allele") == "ref").alias("ref"), F.count_if(F.col("allele") == "alt").alias("alt"))


def cell_genotypes(counts: DataFrame, cells: DataFrame, least_wt: int = 2) -> DataFrame:
    """(cell, call) of every cell: any SNP with an alternative molecule is MUT, least_wt SNPs with reference ones only WT."""
    g = counts.groupBy("cell").agg(F.count_if(F.col("alt") > 0).alias("mut"), F.count_if((F.col("alt") == 0) & (F.col("ref") > 0)).alias("wt"))
    j = cells.select("cell").join(g, "cell", "left")
    return j.select("cell", genotype(F.coalesce("mut", F.lit(0)), F.coalesce("wt", F.lit(0)), least_wt).alias("call"))


def refine_at_introns(cigar: str, pos: int, seq: str, genome: Callable[[int, int], str], longest: int = 1) -> str:
    """Mismatch runs of up to longest bases beside an intron become matches across it, where the genome says so.

    M X N M: the X bases equal the genome's first bases after the intron, and are counted to the right match; M N X M: they
    equal the bases that follow the left match, and are counted to it. Equal neighbours merge.
    """
    run = [[int(n), o] for n, o in re.findall(r"(\d+)([MIDNSHP=X])", cigar)]

    def starts() -> Iterator[tuple[int, int, int]]:
        ref, read = pos, 0
        for k, (n, o) in enumerate(run):
            yield k, ref, read
            ref += n * (o in CONSUMES_REF)
            read += n * (o in CONSUMES_READ)

    for before in (True, False):
        k = 0
        while k < len(run):
            kinds = [o for _, o in run[k : k + 4]]
            if len(kinds) == 4 and kinds[0] in "M=" and kinds[3] in "M=" and kinds[1:3] == (["X", "N"] if before else ["N", "X"]):
                at = {i: (ref, read) for i, ref, read in starts()}
                x = k + 1 if before else k + 2
                n = run[x][0]
                bases = seq[at[x][1] : at[x][1] + n].upper()
                side = at[k + 3][0] if before else at[k + 1][0]
                target = genome(side, side + n)
                if n <= longest and bases == target.upper():
                    if before:
                        run[k + 3][0] += n
                    else:
                        run[k][0] += n
                    del run[x]
            k += 1
    out: list[list] = []
    for n, o in run:
        if out and out[-1][1] == o:
            out[-1][0] += n
        else:
            out.append([n, o])
    return "".join(f"{n}{o}" for n, o in out)


def refine_reads(reads: DataFrame, contigs: DataFrame, longest: int = 1) -> DataFrame:
    """reads (read, chr, pos, cigar, seq) with refined CIGARs. Only reads with a mismatch beside an intron meet their contig
    (chr, seq), cut to the read's span."""
    odd = F.col("cigar").rlike("[M=][0-9]+X[0-9]+N|N[0-9]+X")
    span = F.aggregate(ops(F.col("cigar"), F.col("pos")), F.lit(0).cast("long"), lambda s, x: s + F.when(F.instr(F.lit(CONSUMES_REF), x["op"]) > 0, x["len"]).otherwise(0))
    todo = reads.where(odd).withColumn("_n", span).join(contigs.select("chr", F.col("seq").alias("_g")), "chr")
    todo = todo.withColumn("_g", F.substring("_g", F.col("pos").cast("int") + 1, F.col("_n").cast("int"))).select(*reads.columns, "_g")
    names = list(reads.columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fixed = [refine_at_introns(c, p, s, lambda x, y, p=p, g=g: g[x - p : y - p], longest) for c, p, s, g in zip(b["cigar"], b["pos"], b["seq"], b["_g"])]
            yield b.assign(cigar=fixed)[names]

    return reads.where(~odd).unionByName(todo.mapInPandas(run, reads.schema))
