"""Queries of whole flows: alignments to matrices, variants to genotypes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltbed.operators import quantification as U
from siltbed.operators import variants as V
from siltbed.plans.catalog import query
from siltbed.plans.molecule_queries import read

#: lineitem as alignments of 30 bases, part as transcripts of one exon; genes lie 1000 bases apart.
MOLECULES = """ex AS (SELECT p_partkey % 200 AS gene, p_partkey % 200 * 1000 + p_size * 7 AS s, p_partkey % 200 * 1000 + p_size * 8 + 20 AS e FROM part),
b AS (SELECT gene, s AS x FROM ex UNION SELECT gene, e FROM ex), u AS (SELECT gene, x AS s, lead(x) OVER (PARTITION BY gene ORDER BY x) AS e FROM b),
x AS (SELECT * FROM u WHERE e IS NOT NULL AND EXISTS (SELECT 1 FROM ex WHERE ex.gene = u.gene AND ex.s <= u.s AND u.e <= ex.e)),
g AS (SELECT * FROM (SELECT gene, e AS s, lead(s) OVER (PARTITION BY gene ORDER BY s) AS e FROM x) WHERE s < e),
r AS (SELECT l_suppkey AS cell, (l_orderkey % 300)::VARCHAR AS umi, l_partkey % 200 * 1000 + l_quantity::BIGINT * 8 AS s FROM lineitem WHERE l_linenumber % 5 <> 0),
h AS (SELECT cell, x.gene, umi, false AS odd FROM r JOIN x ON r.s < x.e AND x.s < r.s + 30 UNION ALL SELECT cell, g.gene, umi, true FROM r JOIN g ON r.s < g.e AND g.s < r.s + 30),
m AS (SELECT cell, gene, umi, bool_or(odd) AS odd FROM h GROUP BY ALL)"""


def flow(spark: SparkSession, sf_dir: str, **options) -> dict[str, DataFrame]:
    k, size = F.col("p_partkey"), F.col("p_size")
    start = k % 200 * 1000 + size * 7
    exons = F.array(F.struct(start.alias("start"), (start + size + 20).alias("end")))
    tx = read(spark, sf_dir, "part").select((k % 200).alias("gene"), k.alias("tx_id"), F.lit("c").alias("chr"), F.lit("+").alias("strand"), exons.alias("exons"))
    tags = F.create_map(F.lit("CB"), F.col("l_suppkey").cast("string"), F.lit("UB"), (F.col("l_orderkey") % 300).cast("string"))
    flag = F.when(F.col("l_linenumber") % 5 == 0, 256).otherwise(0)
    pos = F.col("l_partkey") % 200 * 1000 + F.col("l_quantity").cast("long") * 8
    al = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("qname"), flag.alias("flag"), F.lit("c").alias("rname"), pos.alias("pos"), F.lit(60).alias("mapq"), F.lit("30M").alias("cigar"), tags.alias("tags"))
    return U.quantify(al, tx, **options)


@query(f"""WITH {MOLECULES} SELECT dataset, cell, gene AS feature, count(*) AS value FROM (SELECT unnest(['exprs', CASE WHEN odd THEN 'intronic_exprs' ELSE 'exonic_exprs' END]) AS dataset, cell, gene FROM m) GROUP BY ALL""")
def quantify_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow(spark, sf_dir, min_umis=1)["counts"].withColumn("cell", F.col("cell").cast("long"))


@query(f"WITH {MOLECULES} SELECT cell FROM m WHERE NOT odd GROUP BY cell HAVING count(*) >= 256")
def called_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow(spark, sf_dir, min_umis=256)["cells"].select(F.col("cell").cast("long").alias("cell"))


@query("""WITH c AS (SELECT l_suppkey AS cell, l_partkey % 40 AS name, sum((l_discount < 0.03)::INT) AS ref, sum((l_discount > 0.095)::INT) AS alt FROM lineitem GROUP BY ALL),
g AS (SELECT cell, count(*) FILTER (alt > 0) AS mut, count(*) FILTER (alt = 0 AND ref > 0) AS wt FROM c GROUP BY cell)
SELECT s_suppkey AS cell, CASE WHEN coalesce(mut, 0) > 0 THEN 'MUT' WHEN coalesce(wt, 0) >= 2 THEN 'WT' ELSE 'NO_INFO' END AS call FROM supplier LEFT JOIN g ON s_suppkey = cell""")
def cell_genotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("cell"), (F.col("l_partkey") % 40).alias("name"))
    c = c.agg(F.count_if(F.col("l_discount") < 0.03).alias("ref"), F.count_if(F.col("l_discount") > 0.095).alias("alt"))
    return V.cell_genotypes(c, read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("cell")))


@query("""WITH r AS (SELECT l_orderkey * 10 + l_linenumber AS read, l_partkey * 10 AS pos, l_quantity::INT AS q, row_number() OVER () AS i FROM lineitem),
s AS (SELECT DISTINCT o_custkey * 25 + 3 AS pos, CASE WHEN o_custkey % 2 = 0 THEN 'A' ELSE 'C' END AS ref, ['G', 'T'] AS alts, 's' || o_custkey AS name FROM orders),
o AS (SELECT i, read, name, s.pos - r.pos AS k, ref, alts, 35 - (s.pos - r.pos + q) % 12 AS quality FROM r JOIN s ON s.pos >= r.pos AND s.pos < r.pos + 40)
SELECT read, name, substr('ACGT', (k % 4 + 1)::INT, 1) AS base, quality::INT AS quality, CASE WHEN substr('ACGT', (k % 4 + 1)::INT, 1) = ref THEN 'ref' WHEN list_contains(alts, substr('ACGT', (k % 4 + 1)::INT, 1)) THEN 'alt' ELSE 'other' END AS allele FROM o WHERE quality >= 28""")
def observed_snps(spark: SparkSession, sf_dir: str) -> DataFrame:
    # base k has the quality 35 - (k + quantity) % 12: a cut of one text that repeats
    qual = F.substring(F.lit("".join(chr(33 + 35 - k % 12) for k in range(52))), F.col("l_quantity").cast("int") % 12 + 1, F.lit(40))
    reads = read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("read"), F.lit("c").alias("chr"), (F.col("l_partkey") * 10).alias("pos"), F.lit("40M").alias("cigar"), F.repeat(F.lit("ACGT"), F.lit(10)).alias("seq"), qual.alias("qual"))
    k = F.col("o_custkey")
    snps = read(spark, sf_dir, "orders").select(F.lit("c").alias("chr"), (k * 25 + 3).alias("pos"), F.when(k % 2 == 0, "A").otherwise("C").alias("ref"), F.array(F.lit("G"), F.lit("T")).alias("alts"), F.concat(F.lit("s"), k.cast("string")).alias("name")).distinct()
    return V.observe_snps(reads, snps, 28, 0)
