"""Queries through files: each writes a table in a text format to the shared folder and reads it back with its source."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltbed.plans.catalog import query
from siltbed.plans.molecule_queries import read
from siltbed.plans.table_queries import DNA, dna
from siltbed.scratch import shared_dir
from siltbed.sinks import text as K
from siltbed.sources import text as S


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/siltbed/{name}-{uuid.uuid4().hex}"


def written(spark: SparkSession, name: str, lines: DataFrame) -> str:
    path = folder(spark, name)
    lines.select("value").write.text(path)
    return path


@query("SELECT l_suppkey AS cell, l_suppkey::VARCHAR AS label, 'p' || (l_partkey % 40) AS feature, 'Part ' || (l_partkey % 40) AS name, count(*)::DOUBLE AS value FROM lineitem WHERE l_partkey % 40 < 30 GROUP BY ALL")
def mex_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_partkey") % 40
    feature = F.concat(F.lit("p"), k.cast("string"))
    counts = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("cell"), feature.alias("feature")).agg(F.count("*").alias("value"))
    kinds = F.when(F.col("id") < 30, "Gene Expression").otherwise("Antibody Capture")
    features = spark.range(40).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("feature"), F.concat(F.lit("Part "), F.col("id").cast("string")).alias("name"), kinds.alias("feature_type"), F.col("id").alias("ord"))
    cells = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("cell"), F.col("s_suppkey").cast("string").alias("label"))
    path = folder(spark, "mex")
    K.write_mex(counts, features, cells, path)
    return S.read_mex(spark, path, "Gene Expression")


@query(f"SELECT 'r' || p_partkey AS id, {DNA} AS seq, repeat('I', length({DNA})) AS qual FROM part")
def fastq_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = dna(spark, sf_dir).select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("id"), "seq", F.repeat(F.lit("I"), F.length("seq")).alias("qual"))
    path = folder(spark, "fastq")
    K.write_fastq(reads, path)
    return S.read_fastq(spark, path).select("id", "seq", "qual")


@query(f"SELECT 'c' || p_partkey AS id, {DNA} AS seq FROM part")
def fasta_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "fasta")
    K.write_fasta(dna(spark, sf_dir).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("id"), "seq"), path, width=7)
    return S.read_fasta(spark, path).select("id", "seq")


@query("""SELECT 'chr' || (p_partkey % 3) AS chr, p_partkey * 10 AS start, p_partkey * 10 + p_size AS "end", CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand, 'g' || (p_partkey % 50) AS gene_id, 't' || p_partkey AS tx_id, p_name AS note FROM part""")
def gtf_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    text = lambda c: c.cast("string")
    gene, tx = F.concat(F.lit("g"), text(k % 50)), F.concat(F.lit("t"), text(k))
    gtf = F.concat(F.lit('gene_id "'), gene, F.lit('"; transcript_id "'), tx, F.lit('"; note "'), F.col("p_name"), F.lit('";'))
    gff = F.concat(F.lit("gene_id="), gene, F.lit(";transcript_id="), tx, F.lit(";note="), F.col("p_name"))
    line = F.concat_ws("\t", F.concat(F.lit("chr"), text(k % 3)), F.lit("x"), F.lit("exon"), text(k * 10 + 1), text(k * 10 + F.col("p_size")), F.lit("."), F.when(k % 2 == 0, "+").otherwise("-"), F.lit("."), F.when(k % 5 == 0, gff).otherwise(gtf))
    g = S.read_gtf(spark, written(spark, "gtf", read(spark, sf_dir, "part").select(line.alias("value"))))
    a = F.col("attrs")
    return g.select("chr", "start", "end", "strand", a["gene_id"].alias("gene_id"), a["transcript_id"].alias("tx_id"), a["note"].alias("note"))


@query("""SELECT 'chr' || (o_custkey % 5) AS chr, o_orderkey - 1 AS pos0, substr('ACGT', (o_orderkey % 4 + 1)::INT, 1) AS ref, CASE WHEN o_orderkey % 6 = 0 THEN ['A', 'C'] ELSE ['G'] END AS alts FROM orders WHERE o_orderkey > 0 AND o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0""")
def vcf_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    alt = F.when(k % 11 == 0, "G,AT").when(k % 6 == 0, "A,C").otherwise("G")
    line = F.concat_ws("\t", F.concat(F.lit("chr"), (F.col("o_custkey") % 5).cast("string")), k.cast("string"), F.lit("."), F.substring(F.lit("ACGT"), (k % 4 + 1).cast("int"), F.lit(1)), alt, F.lit("."), F.when(k % 7 == 0, "q10").when(k % 2 == 0, "PASS").otherwise("."), F.lit("."))
    return S.read_vcf(spark, written(spark, "vcf", read(spark, sf_dir, "orders").where("o_orderkey > 0").select(line.alias("value")))).select("chr", "pos0", "ref", "alts")


@query("SELECT 'q' || l_orderkey AS qname, (l_partkey * 37 % 4096)::INT AS flag, l_partkey * 10 AS pos, (l_suppkey % 61)::INT AS mapq, l_quantity::INT || 'M' AS cigar, 'S' || l_suppkey AS cb FROM lineitem")
def sam_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda c: c.cast("string")
    line = F.concat_ws("\t", F.concat(F.lit("q"), text(F.col("l_orderkey"))), text(F.col("l_partkey") * 37 % 4096), F.lit("chr1"), text(F.col("l_partkey") * 10 + 1), text(F.col("l_suppkey") % 61), F.concat(text(F.col("l_quantity").cast("int")), F.lit("M")), F.lit("*"), F.lit("0"), F.lit("0"), F.lit("*"), F.lit("*"), F.concat(F.lit("CB:Z:S"), text(F.col("l_suppkey"))))
    s = S.read_sam(spark, written(spark, "sam", read(spark, sf_dir, "lineitem").select(line.alias("value"))))
    return s.select("qname", "flag", "pos", "mapq", "cigar", F.col("tags")["CB"].alias("cb"))


@query("SELECT p_brand AS name, list_sort(list(DISTINCT p_type)) AS genes FROM part GROUP BY p_brand")
def gmt_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat_ws("\t", "p_brand", F.lit("d"), F.concat_ws("\t", F.collect_list("p_type")))
    return S.read_gmt(spark, written(spark, "gmt", read(spark, sf_dir, "part").groupBy("p_brand").agg(line.alias("value")))).select("name", "genes")


@query("""SELECT 'chr' || (p_partkey % 3) AS chr, p_partkey * 10 AS start, p_partkey * 10 + 100 AS "end", CASE WHEN p_partkey % 2 = 0 THEN p_size::BIGINT + 10 ELSE 100 END AS bases FROM part""")
def bed_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    text = lambda c: c.cast("string")
    three = [F.concat(F.lit("chr"), text(k % 3)), text(k * 10), text(k * 10 + 100)]
    twelve = F.concat_ws("\t", *three, F.lit("n"), F.lit("0"), F.lit("+"), *[F.lit("0")] * 3, F.lit("2"), F.concat(text(F.col("p_size")), F.lit(",10,")), F.lit("0,90,"))
    b = S.read_bed(spark, written(spark, "bed", read(spark, sf_dir, "part").select(F.when(k % 2 == 0, twelve).otherwise(F.concat_ws("\t", *three)).alias("value"))))
    return b.select("chr", "start", "end", F.aggregate("blocks", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"]).alias("bases"))


@query("SELECT event_id::VARCHAR AS read_id, 'C' || arg_max(user_id, value) AS cell FROM events WHERE user_id % 4 <> 0 GROUP BY event_id")
def read_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    cell = F.when(F.col("user_id") % 4 == 0, F.lit(None)).otherwise(F.concat(F.lit("C"), F.col("user_id").cast("string")))
    path = folder(spark, "tags")
    e.select(F.col("event_id").cast("string").alias("read_id"), cell.alias("raw_cb"), F.lit("U").alias("raw_umi")).write.csv(path, sep="\t", header=True)
    return S.read_tags(spark, path).select("read_id", "cell")


@query("""WITH c AS (SELECT l_returnflag AS chr, l_partkey // 10 AS bin, count(*)::DOUBLE AS value FROM lineitem GROUP BY ALL) SELECT chr, bin * 100 AS start, bin * 100 + 100 AS "end", value FROM c""")
def bedgraph_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    track = read(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("chr"), F.floor(F.col("l_partkey") / 10).alias("bin")).agg(F.count("*").cast("double").alias("value"))
    path = folder(spark, "bedgraph")
    K.write_bedgraph(track, 100, path)
    p = F.split("value", "\t")
    return S.lines(spark, path).select(p[0].alias("chr"), p[1].cast("long").alias("start"), p[2].cast("long").alias("end"), p[3].cast("double").alias("value"))
