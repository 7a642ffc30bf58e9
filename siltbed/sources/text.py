"""Text sources as DataFrames. Lines keep their order by (file, block, seq), as Spark itself gives rows none."""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltbed.functions.sequences import pack_low_first
from siltbed.functions.statistics import fnv1a
from siltbed.operators.relations import passing, snv_only
from siltbed.scratch import stored

ORDER = ("file", "block", "seq")


def lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(value, file, block, seq): sorted by the last three, the lines of each file are in order. Compressed files work too."""
    text = spark.read.text(paths)
    return text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"))


def numbered(rows: DataFrame, name: str = "ord") -> DataFrame:
    """rows with their position in the file, from 0; for dimension files and files that are one record stream."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy("file").orderBy("block", "seq")) - 1)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))


def first_path(spark: SparkSession, folder: str, names: Sequence[str]) -> str:
    """The first of names that is in folder."""
    for n in names:
        if _exists(spark, f"{folder}/{n}"):
            return f"{folder}/{n}"
    raise FileNotFoundError(f"none of {', '.join(names)} in {folder}")


def resolve_mex(spark: SparkSession, folder: str, below: Sequence[str] = ("", "filtered_feature_bc_matrix", "raw_feature_bc_matrix", "outs/filtered_feature_bc_matrix", "exprs", "filtered", "raw")) -> str:
    """The folder at or below folder that holds a matrix."""
    for b in below:
        at = f"{folder}/{b}".rstrip("/")
        if any(_exists(spark, f"{at}/{n}") for n in ("matrix.mtx.gz", "matrix.mtx")):
            return at
    raise FileNotFoundError(f"no matrix.mtx at or below {folder}")


# --- matrices -------------------------------------------------------------------------------------------------------


def mex_features(spark: SparkSession, folder: str) -> DataFrame:
    """(ord, id, name, feature_type); ord is the row in the file, from 0."""
    path = first_path(spark, folder, ("features.tsv.gz", "features.tsv", "genes.tsv.gz", "genes.tsv"))
    parts = F.split("value", "\t")
    rows = numbered(lines(spark, path).where("trim(value) <> ''"))
    return rows.select("ord", parts[0].alias("id"), F.coalesce(F.try_element_at(parts, F.lit(2)), parts[0]).alias("name"), F.coalesce(F.try_element_at(parts, F.lit(3)), F.lit("Gene Expression")).alias("feature_type"))


def feature_names(features: DataFrame) -> DataFrame:
    """(key, ord): ids win over names, and of equal names the first."""
    both = features.select(F.col("id").alias("key"), F.lit(0).alias("p"), "ord").union(features.select(F.col("name").alias("key"), F.lit(1).alias("p"), "ord"))
    return both.groupBy("key").agg(F.min(F.struct("p", "ord")).alias("b")).select("key", F.col("b.ord").alias("ord"))


def cell_id(label: Column) -> Column:
    """A stable 64-bit id: DNA before a dash is packed, whole numbers stay, anything else is hashed by FNV-1a."""
    sequence = F.substring_index(label, "-", 1)

    @F.udf("long")
    def hashed(text: str | None) -> int | None:
        if text is None:
            return None
        h = fnv1a(text.encode())
        return h - (1 << 64) if h >> 63 else h

    return F.when(sequence.rlike("^[ACGTacgt]+$"), pack_low_first(sequence)).otherwise(F.coalesce(label.try_cast("long"), hashed(label)))


def mex_barcodes(spark: SparkSession, folder: str) -> DataFrame:
    """(ord, label, cell); two labels with one id raise."""
    rows = numbered(lines(spark, first_path(spark, folder, ("barcodes.tsv.gz", "barcodes.tsv"))).where("trim(value) <> ''")).select("ord", F.trim("value").alias("label"))
    found = rows.withColumn("cell", cell_id(F.col("label")))
    w = Window.partitionBy("cell")
    clash = F.min("label").over(w) != F.max("label").over(w)
    checked = F.when(clash, F.raise_error(F.concat(F.lit("labels share a cell id: "), F.col("label"))).cast("long")).otherwise(F.col("cell"))
    return found.withColumn("cell", checked)


def mex_entries(spark: SparkSession, folder: str) -> tuple[DataFrame, tuple[int, int, int]]:
    """(row, col, value) from 0, and the header's rows, columns and entries."""
    rows = lines(spark, first_path(spark, folder, ("matrix.mtx.gz", "matrix.mtx"))).where("trim(value) <> ''")
    banner = rows.orderBy(*ORDER).first()["value"].split()
    if banner[:3] != ["%%MatrixMarket", "matrix", "coordinate"] or banner[3] not in ("integer", "real"):
        raise ValueError(f"unsupported matrix: {' '.join(banner)}")
    body = rows.where("not startswith(value, '%')")
    size = body.orderBy(*ORDER).first()
    dims = tuple(int(x) for x in size["value"].split())
    entries = body.where((F.col("block") != size["block"]) | (F.col("seq") != size["seq"]))
    part = F.split(F.trim("value"), r"\s+")
    return entries.select((part[0].cast("long") - 1).alias("row"), (part[1].cast("long") - 1).alias("col"), part[2].cast("double").alias("value")), dims


def read_mex(spark: SparkSession, folder: str, feature_type: str | None = None, whole: bool = True) -> DataFrame:
    """(cell, label, feature, name, value) of one feature type; rows of other types are passed over.

    Raises where the header disagrees with barcodes, features or the number of entries, or (whole) a count is negative or
    no whole number.
    """
    features, barcodes = mex_features(spark, folder), mex_barcodes(spark, folder)
    entries, (n_rows, n_cols, n_entries) = mex_entries(spark, folder)
    found = (features.count(), barcodes.count(), entries.count())
    if found != (n_rows, n_cols, n_entries):
        raise ValueError(f"matrix header says {(n_rows, n_cols, n_entries)}, files have {found}")
    if feature_type is not None:
        features = features.where(F.col("feature_type") == feature_type)
    v = F.col("value")
    if whole:
        v = F.when((v < 0) | (v != F.floor(v)), F.raise_error(F.concat(F.lit("not a count: "), v.cast("string"))).cast("double")).otherwise(v)
    out = entries.join(F.broadcast(features) if n_rows < 200_000 else features, F.col("row") == features.ord).drop("ord")
    return out.join(barcodes, F.col("col") == barcodes.ord).select("cell", "label", F.col("id").alias("feature"), "name", v.alias("value"))


# --- annotation -----------------------------------------------------------------------------------------------------


def attributes(text: Column) -> Column:
    """GTF or GFF3 attributes as a map; any = makes it GFF3; unbalanced quotes raise; of repeated keys the first counts."""
    odd = (F.length(text) - F.length(F.replace(text, F.lit('"'), F.lit("")))) % 2 == 1
    gff = F.regexp_extract_all(text, F.lit(r"([^;=\s][^;=]*)=([^;]*)"), F.lit(1)), F.regexp_extract_all(text, F.lit(r"([^;=\s][^;=]*)=([^;]*)"), F.lit(2))
    gtf = F.regexp_extract_all(text, F.lit(r'([^;\s"]+)\s+("[^"]*"|[^;\s]+)'), F.lit(1)), F.regexp_extract_all(text, F.lit(r'([^;\s"]+)\s+("[^"]*"|[^;\s]+)'), F.lit(2))

    def as_map(keys: Column, values: Column) -> Column:
        pairs = F.zip_with(keys, values, lambda k, v: F.struct(F.trim(k).alias("key"), F.trim(F.trim(v), F.lit('"')).alias("value")))
        kept = F.filter(pairs, lambda p: p["value"] != "")
        first = F.filter(kept, lambda p, i: F.array_position(F.transform(kept, lambda q: q["key"]), p["key"]) == i + 1)
        return F.map_from_entries(first)

    made = F.when(F.instr(text, "=") > 0, as_map(*gff)).otherwise(as_map(*gtf))
    return F.when((F.instr(text, "=") == 0) & odd, F.raise_error(F.concat(F.lit("unbalanced quotes: "), text)).cast("map<string,string>")).otherwise(made)


def read_gtf(spark: SparkSession, path: str) -> DataFrame:
    """GTF or GFF3 records, 0-based half-open; a line without nine columns raises."""
    rows = lines(spark, path).where("trim(value) <> '' and not startswith(value, '#')")
    p = F.split("value", "\t")
    at = lambda k: F.get(p, F.lit(k))
    bad = F.when(F.size(p) != 9, F.raise_error(F.concat(F.lit("not nine columns: "), F.col("value"))).cast("string")).otherwise(at(0))
    return rows.select(
        bad.alias("chr"), at(1).alias("source"), at(2).alias("feature"), (at(3).cast("long") - 1).alias("start"), at(4).cast("long").alias("end"),
        F.nullif(at(5), F.lit(".")).alias("score"), at(6).alias("strand"), F.nullif(at(7), F.lit(".")).alias("phase"), attributes(at(8)).alias("attrs"),
    )


def splice_tables(gtf: DataFrame) -> dict[str, DataFrame]:
    """genes, transcripts and exons of exon records (the parquet form of a splice index)."""
    e = gtf.where(F.lower("feature") == "exon").select("chr", "start", "end", "strand", F.col("attrs")["gene_id"].alias("gene_id"), F.coalesce(F.col("attrs")["gene_name"], F.col("attrs")["gene_id"]).alias("gene_name"), F.coalesce(F.col("attrs")["transcript_id"], F.col("attrs")["Parent"]).alias("tx_id"))
    tx = e.groupBy("chr", "strand", "gene_id", "gene_name", "tx_id").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum(F.col("end") - F.col("start")).alias("bases"), F.array_sort(F.collect_list(F.struct("start", "end"))).alias("exons"))
    genes = tx.groupBy("chr", "strand", "gene_id", "gene_name").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_tx"))
    return {"exons": e, "transcripts": tx, "genes": genes}


def read_vcf(spark: SparkSession, path: str, pass_only: bool = True, snv: bool = True) -> DataFrame:
    """(chr, pos0, id, ref, alts, filter, info, name); by default passing single-base variants only."""
    p = F.split("value", "\t")
    v = lines(spark, path).where("trim(value) <> '' and not startswith(value, '#')").select(
        p[0].alias("chr"), (p[1].cast("long") - 1).alias("pos0"), F.nullif(p[2], F.lit(".")).alias("id"), p[3].alias("ref"), F.filter(F.split(p[4], ","), lambda a: ~a.isin(".", "")).alias("alts"),
        F.try_element_at(p, F.lit(7)).alias("filter"), F.try_element_at(p, F.lit(8)).alias("info"),
    )
    if pass_only:
        v = v.where(passing(F.col("filter")))
    if snv:
        v = v.where(snv_only(F.col("ref"), F.col("alts")))
    made = F.concat("chr", F.lit(":"), (F.col("pos0") + 1).cast("string"), F.lit(":"), "ref", F.lit(">"), F.array_join("alts", ","))
    return v.withColumn("name", F.coalesce("id", made))


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignment lines: qname, flag, rname, pos (0-based), mapq, cigar, seq, qual, tags (map), ord."""
    p = F.split("value", "\t")
    tags = F.transform(F.slice(p, 12, 1 << 20), lambda t: F.struct(F.substring(t, 1, 2).alias("key"), F.substring(t, 6, 1 << 30).alias("value")))
    rows = lines(spark, path).where("trim(value) <> '' and not value rlike '^@[A-Z][A-Z]\\t'")
    return rows.select(p[0].alias("qname"), p[1].cast("int").alias("flag"), p[2].alias("rname"), (p[3].cast("long") - 1).alias("pos"), p[4].cast("int").alias("mapq"), p[5].alias("cigar"), p[9].alias("seq"), p[10].alias("qual"), F.map_from_entries(tags).alias("tags"), *ORDER)


def rmsk_to_gtf(table: DataFrame) -> DataFrame:
    """UCSC RepeatMasker rows (genoName, genoStart, genoEnd, strand, repName, repClass, repFamily) as GTF lines."""
    locus = F.concat_ws(":", "repName", "repFamily", "repClass")
    attrs = F.concat(F.lit('gene_id "'), F.col("repName"), F.lit('"; transcript_id "'), F.concat("genoName", F.lit(":"), F.col("genoStart").cast("string"), F.lit("-"), F.col("genoEnd").cast("string"), F.lit(":"), locus), F.lit('"; family_id "'), F.col("repFamily"), F.lit('"; class_id "'), F.col("repClass"), F.lit('";'))
    return table.select(F.concat_ws("\t", "genoName", F.lit("rmsk"), F.lit("exon"), (F.col("genoStart") + 1).cast("string"), F.col("genoEnd").cast("string"), F.lit("."), "strand", F.lit("."), attrs).alias("value"))


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """chr, start, end, name, score, strand and blocks (of BED12; else one block)."""
    p = F.split("value", "\t")
    at = lambda k: F.try_element_at(p, F.lit(k))
    numbers = lambda k: F.transform(F.filter(F.split(at(k), ","), lambda x: x != ""), lambda x: x.cast("long"))
    start, end = p[1].cast("long"), p[2].cast("long")
    twelve = F.zip_with(numbers(12), numbers(11), lambda s, n: F.struct((start + s).alias("start"), (start + s + n).alias("end")))
    rows = lines(spark, path).where("trim(value) <> '' and not value rlike '^(#|track|browser)'")
    return rows.select(p[0].alias("chr"), start.alias("start"), end.alias("end"), at(4).alias("name"), at(5).try_cast("double").alias("score"), at(6).alias("strand"), F.when(F.size(p) >= 12, twelve).otherwise(F.array(F.struct(start.alias("start"), end.alias("end")))).alias("blocks"))


def read_bedpe(spark: SparkSession, path: str, experiment: str) -> DataFrame:
    """Loop calls: experiment and both anchors; lines that don't start with two spans are passed over."""
    p = F.split(F.trim("value"), r"\s+")
    num = lambda k: F.try_element_at(p, F.lit(k)).try_cast("long")
    out = lines(spark, path).select(F.lit(experiment).alias("experiment"), p[0].alias("chr_a"), num(2).alias("start_a"), num(3).alias("end_a"), F.try_element_at(p, F.lit(4)).alias("chr_b"), num(5).alias("start_b"), num(6).alias("end_b"))
    return out.dropna(subset=["start_a", "end_a", "start_b", "end_b"])


# --- sequences ------------------------------------------------------------------------------------------------------


def _fours(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Records of runs of lines (file, line, value), four lines each; what a run doesn't hold whole comes as rows with gaps."""
    names = ["id", "seq", "plus", "qual"]
    rest = None
    for b in itertools.chain(batches, [None]):
        b = rest if b is None else b if rest is None else pd.concat([rest, b], ignore_index=True)
        if b is None or not len(b):
            return
        last = b is rest
        n, f = b["line"].to_numpy(), b["file"].to_numpy()
        run = np.ones(len(b), bool)
        run[1:] = (n[1:] != n[:-1] + 1) | (f[1:] != f[:-1]) | (n[1:] % 4 == 0)
        begins = np.flatnonzero(run)
        sizes = np.diff(np.append(begins, len(b)))
        # the last record may go on in the next batch
        keep = len(begins) if last or sizes[-1] == 4 else len(begins) - 1
        rest = None if keep == len(begins) else b.iloc[begins[-1] :].reset_index(drop=True)
        begins, sizes, v = begins[:keep], sizes[:keep], b["value"].to_numpy()
        whole, odd = begins[sizes == 4], [(i, s) for i, s in zip(begins, sizes) if s < 4]
        if len(whole):
            yield pd.DataFrame({"file": f[whole], "ordinal": n[whole] // 4, **{c: v[whole + k] for k, c in enumerate(names)}, "whole": True})
        if odd:
            cells = [{names[n[j] % 4]: v[j] for j in range(i, i + s)} for i, s in odd]
            yield pd.DataFrame({"file": [f[i] for i, _ in odd], "ordinal": [n[i] // 4 for i, _ in odd], **{c: [x.get(c) for x in cells] for c in names}, "whole": False})
        if last:
            return


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, id, seq, qual) in file order, gz or plain; a record without @ and + raises.

    Lines are put together as they are read, so that a file that can't be split is no sort in one task; only records over the
    borders of blocks meet in a shuffle.
    """
    rows = stored(lines(spark, path), "lines")  # numbers of lines hold for one reading only
    first = rows.groupBy("file", "block").agg(F.min("seq").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = first.select("file", "block", (before - F.col("_first")).alias("_shift"))
    rows = rows.join(F.broadcast(first), ["file", "block"]).select("file", (F.col("seq") + F.col("_shift")).alias("line"), "value")
    found = rows.mapInPandas(_fours, "file string, ordinal long, id string, seq string, plus string, qual string, whole boolean")
    cut = found.where("not whole").groupBy("file", "ordinal").agg(*[F.max(c).alias(c) for c in ("id", "seq", "plus", "qual")])
    four = found.where("whole").drop("whole").unionByName(cut)
    ok = F.startswith("id", F.lit("@")) & F.startswith("plus", F.lit("+")) & (F.length("seq") == F.length("qual"))
    checked = F.when(F.coalesce(ok, F.lit(False)), F.substring("id", 2, 1 << 30)).otherwise(F.raise_error(F.concat(F.lit("broken record "), F.col("ordinal").cast("string"))).cast("string"))
    return four.where("id is not null and id <> ''").select("ordinal", checked.alias("id"), "seq", "qual")


def read_fastq_pairs(spark: SparkSession, first: str, second: str) -> DataFrame:
    """Pairs in lock step; files of different length raise."""
    a, b = read_fastq(spark, first), read_fastq(spark, second)
    j = a.select("ordinal", "id", F.col("seq").alias("r1_seq"), F.col("qual").alias("r1_qual")).join(b.select("ordinal", F.col("seq").alias("r2_seq"), F.col("qual").alias("r2_qual")), "ordinal", "full")
    lone = F.col("r1_seq").isNull() | F.col("r2_seq").isNull()
    return j.withColumn("id", F.when(lone, F.raise_error(F.lit("one file has more reads")).cast("string")).otherwise(F.col("id")))


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(file, block, rec, head, seq) of lines in order: rec counts heads within the block of a file, and 0 is what comes before the
    first one. A record's lines are joined."""
    now, rec, head, parts = None, 0, None, []
    for b in batches:
        out: list[tuple] = []
        for file, block, v in zip(b["file"], b["block"], b["value"]):
            begins = v.startswith(">")
            if begins or (file, block) != now:
                if parts or head is not None:
                    out.append((*now, rec, head, "".join(parts)))
                rec, now, head, parts = (rec if (file, block) == now else 0) + begins, (file, block), None, []
            if begins:
                head = v[1:]
            else:
                parts.append(v.strip(" "))
        if out:
            yield pd.DataFrame(out, columns=["file", "block", "rec", "head", "seq"])
    if parts or head is not None:
        yield pd.DataFrame([(*now, rec, head, "".join(parts))], columns=["file", "block", "rec", "head", "seq"])


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(ord, id, description, seq) of each record; the lines of a record are joined in order, as they are read. Only records over the
    borders of blocks meet in a shuffle."""
    rows = lines(spark, path).where("trim(value) <> ''").select("file", "block", "value")
    rows = stored(rows.mapInPandas(_pieces, "file string, block long, rec long, head string, seq string"), "pieces")
    blocks = rows.groupBy("file", "block").agg(F.max("rec").alias("_last"))
    w = Window.partitionBy("file").orderBy("block")
    before = F.coalesce(F.sum("_last").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    several = F.count("*").over(Window.partitionBy("file")) > 1
    blocks = blocks.select("file", "block", "_last", before.alias("_before"), several.alias("_several"))
    rows = rows.join(F.broadcast(blocks), ["file", "block"]).withColumn("ord", F.col("_before") + F.col("rec") - 1)
    edge = F.col("_several") & ((F.col("rec") == 0) | (F.col("rec") == F.col("_last")))
    cut = rows.where(edge).groupBy("file", "ord").agg(F.max("head").alias("head"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "seq"))), lambda x: x["seq"]), "").alias("seq"))
    out = rows.where(~edge).select("file", "ord", "head", "seq").unionByName(cut)
    return out.where("ord >= 0").select("ord", F.substring_index("head", " ", 1).alias("id"), F.when(F.instr("head", " ") > 0, F.expr("substring(head, instr(head, ' ') + 1)")).alias("description"), "seq")


# --- tables ---------------------------------------------------------------------------------------------------------


def read_table(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """All columns as strings, in a column ordinal their order; empty fields are null."""
    df = spark.read.csv(path, sep=sep, header=True, inferSchema=False)
    return df.withColumn("ordinal", F.monotonically_increasing_id())


def read_factor_definitions(spark: SparkSession, path: str) -> DataFrame:
    """(column, level, numeric) of a JSON list of factors; without numbers, levels count from 0."""
    d = spark.read.json(path, multiLine=True, schema="column string, levels array<string>, numeric array<double>, matching array<string>, one_hot boolean")
    return d.select("column", F.posexplode("levels").alias("at", "level"), "numeric").select("column", "level", F.coalesce(F.get(F.coalesce("numeric", F.array().cast("array<double>")), F.col("at")), F.col("at").cast("double")).alias("numeric"))


def read_gmt(spark: SparkSession, path: str) -> DataFrame:
    """(name, description, genes sorted); fewer than three fields, or names that repeat but for case, raise."""
    p = F.split("value", "\t")
    rows = lines(spark, path).where("trim(value) <> ''")
    short = F.when(F.size(p) < 3, F.raise_error(F.concat(F.lit("fewer than three fields: "), F.col("value"))).cast("string")).otherwise(p[0])
    out = rows.select(short.alias("name"), p[1].alias("description"), F.array_sort(F.array_distinct(F.filter(F.slice(p, 3, 1 << 20), lambda g: g != ""))).alias("genes"))
    again = F.count("*").over(Window.partitionBy(F.lower("name"))) > 1
    return out.withColumn("name", F.when(again, F.raise_error(F.concat(F.lit("repeated set: "), F.col("name"))).cast("string")).otherwise(F.col("name")))


def read_gene_list(spark: SparkSession, path: str) -> DataFrame:
    """(gene): one a line; text after # and blank lines don't count."""
    return lines(spark, path).select(F.trim(F.substring_index("value", "#", 1)).alias("gene")).where("gene <> ''").distinct()


def read_links(spark: SparkSession, path: str, a: str = "protein1", b: str = "protein2", score: str = "combined_score", sep: str = " ") -> DataFrame:
    """(a, b, score) of a links file by its header; other columns may be there."""
    df = spark.read.csv(path, sep=sep, header=True, inferSchema=False)
    return df.select(F.col(a).alias("a"), F.col(b).alias("b"), F.col(score).cast("long").alias("score"))


def ensembl_protein(external: Column) -> Column:
    """9606.ENSP0001 becomes ENSP0001."""
    return F.regexp_replace(external, r"^\d+\.", "")


def read_tags(spark: SparkSession, path: str, read_id: str = "read_id", cell: str = "raw_cb", umi: str = "raw_umi") -> DataFrame:
    """(read_id, cell, umi): rows without any of them are passed over; of equal read ids the last line counts."""
    t = read_table(spark, path).select(F.trim(read_id).alias("read_id"), F.trim(cell).alias("cell"), F.trim(umi).alias("umi"), "ordinal")
    return t.where("read_id <> '' and cell <> '' and umi <> ''").groupBy("read_id").agg(F.max_by(F.struct("cell", "umi"), "ordinal").alias("x")).select("read_id", "x.cell", "x.umi")


def read_bundle(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The parquet form of an annotated matrix: x, obs, var and, where they are there, obsm and layers."""
    names = ("x", "obs", "var", "obsm", "layers")
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names if n in ("x", "obs", "var") or _exists(spark, f"{folder}/{n}")}


def read_domain_matches(spark: SparkSession, path: str, accessions: DataFrame | None = None) -> DataFrame:
    """(accession, entry, description, signature, aa_start, aa_end) of a protein-to-domain table (1-based, inclusive in the
    file; 0-based, half-open here), kept for the given accessions only: the far larger file is filtered as it is read."""
    df = spark.read.csv(path, sep="\t", schema="accession string, entry string, description string, signature string, first long, last long")
    if accessions is not None:
        df = df.join(accessions.select("accession").distinct(), "accession", "left_semi")
    return df.select("accession", "entry", "description", "signature", (F.col("first") - 1).alias("aa_start"), F.col("last").alias("aa_end")).where("aa_end > aa_start")
