"""Queries of operators that stand beside the larger ones: names, groups, blocks, barcodes, lookups, pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltbed.functions import alignment as N
from siltbed.functions import sequences as Q
from siltbed.operators import intervals as I
from siltbed.operators import matrix as X
from siltbed.operators import reads as A
from siltbed.operators import relations as J
from siltbed.plans.catalog import query
from siltbed.plans.interval_queries import READS, reads
from siltbed.plans.molecule_queries import read
from siltbed.plans.sequence_queries import TX, transcripts
from siltbed.plans.summary_queries import NORMAL, cells, rounded, sparse
from siltbed.plans.table_queries import DNA, dna
from siltbed.query.lookup import execute

NAMED = "n AS (SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'chr' || (o_custkey % 30) WHEN 1 THEN 'chrX' WHEN 2 THEN 'MT' WHEN 3 THEN 'chrM' ELSE '' || (o_custkey % 30) END AS chr FROM orders)"


def named(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey") % 5, (F.col("o_custkey") % 30).cast("string")
    name = F.when(k == 0, F.concat(F.lit("chr"), c)).when(k == 1, "chrX").when(k == 2, "MT").when(k == 3, "chrM").otherwise(c)
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), name.alias("chr"))


@query(f"WITH {NAMED} SELECT id, CASE WHEN upper(chr) IN ('MT', 'CHRM', 'M', 'CHRMT') THEN 'MT' ELSE regexp_replace(upper(chr), '^CHR', '') END AS key FROM n")
def chromosome_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named(spark, sf_dir).select("id", J.chromosome_key(F.col("chr")).alias("key"))


@query(f"""WITH {NAMED}, v AS (SELECT unnest(range(1, 25)) AS k, unnest([11, 12, 12, 12, 10, 12, 14, 11, 12, 11, 10, 12, 11, 9, 10, 10, 11, 10, 10, 11, 9, 11, 11, 10]) AS version)
SELECT id, coalesce('NC_' || lpad(k::VARCHAR, 6, '0') || '.' || version, chr) AS accession FROM n LEFT JOIN v ON chr = 'chr' || CASE k WHEN 23 THEN 'X' WHEN 24 THEN 'Y' ELSE k::VARCHAR END""")
def reference_accessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named(spark, sf_dir).select("id", J.reference_accession(F.col("chr")).alias("accession"))


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey::VARCHAR = '7'")
def column_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.matching(read(spark, sf_dir, "customer"), ["c_mktsegment=BUILDING", "c_nationkey=7"]).select("c_custkey", "c_mktsegment")


@query("SELECT p_partkey AS protein_id FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')")
def feature_kind_proteins(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("protein_id"), F.col("l_returnflag").alias("kind"))
    return J.proteins_with_feature(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("protein_id")), f, "R")


@query("SELECT c_mktsegment, list_sort(list(DISTINCT c_nationkey)) AS members, count(DISTINCT c_nationkey) AS n FROM customer GROUP BY c_mktsegment")
def grouped_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.grouped_members(read(spark, sf_dir, "customer"), "c_mktsegment", "c_nationkey")


@query("SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN 'new' || o_custkey ELSE o_custkey::VARCHAR END AS o_custkey FROM orders")
def rewritten_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapping = read(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").cast("string").alias("old"), F.concat(F.lit("new"), F.col("c_custkey").cast("string")).alias("new"))
    return J.rewrite_ids(read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("o_custkey")), "o_custkey", mapping)


@query("""WITH l AS (SELECT l_suppkey AS seed, l_partkey % 100 AS partner FROM lineitem) SELECT p_partkey AS tx_id, coalesce(list_sort(list(DISTINCT partner) FILTER (partner IS NOT NULL)), []) AS partners FROM part LEFT JOIN l ON seed = p_partkey % 150 GROUP BY p_partkey""")
def partner_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("seed"), (F.col("l_partkey") % 100).alias("partner")).distinct()
    return J.partner_sets(n, read(spark, sf_dir, "part").select(F.col("p_partkey").alias("tx_id"), (F.col("p_partkey") % 150).alias("protein")))


@query(f"""WITH {READS}, r AS (SELECT row_number() OVER () AS r, id, start AS s, "end" AS e FROM reads), b AS (SELECT r, id, unnest([s, e, s + 60]) AS s, unnest([e, e + id % 40, s + 60 + id % 30 + 1]) AS e FROM r),
l AS (SELECT *, max(e) OVER (PARTITION BY r ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM b), i AS (SELECT *, sum(CASE WHEN s <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM l),
m AS (SELECT r, id, k, min(s) AS s, max(e) AS e FROM i GROUP BY ALL) SELECT id, count(*) AS n, sum(e - s)::BIGINT AS bases, min(s) AS first, max(e) AS last FROM m GROUP BY r, id""")
def merged_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, e, k = F.col("start"), F.col("end"), F.col("id")
    block = lambda a, b: F.struct(a.alias("start"), b.alias("end"))
    made = I.merged_blocks(F.array(block(s, e), block(e, e + k % 40), block(s + 60, s + 61 + k % 30)))
    r = reads(spark, sf_dir).select("id", made.alias("b"))
    return r.select("id", F.size("b").cast("long").alias("n"), F.aggregate("b", F.lit(0).cast("long"), lambda t, x: t + x["end"] - x["start"]).alias("bases"), F.col("b")[0]["start"].alias("first"), F.element_at("b", -1)["end"].alias("last"))


@query(f"WITH s AS (SELECT p_partkey AS id, {DNA} AS seq FROM part), c AS (SELECT id, i, seq[i] AS c FROM s, unnest(range(1, length(seq) + 1)) t(i)), r AS (SELECT id, c, i - row_number() OVER (PARTITION BY id, c ORDER BY i) AS g FROM c) SELECT id, max(n) AS longest FROM (SELECT id, count(*) AS n FROM r GROUP BY id, c, g) GROUP BY id")
def longest_homopolymer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dna(spark, sf_dir).select("id", N.longest_run_of(F.col("seq")).alias("longest"))


@query(f"WITH b AS (SELECT DISTINCT substr({DNA}, 1, 12) AS x FROM part), d AS (SELECT min(hamming(a.x, c.x))::INT AS least FROM b a JOIN b c ON a.x < c.x) SELECT least, ((least - 1) // 2)::INT AS radius FROM d")
def correction_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.least_mismatches(dna(spark, sf_dir).select(F.substring("seq", 1, 12).alias("barcode")))


@query(f"""WITH s AS (SELECT p_partkey AS id, substr(CASE WHEN p_partkey % 3 = 0 THEN 'Nn' ELSE '' END || lower({DNA}) || {DNA}, 1, 31) AS seq FROM part), b AS (SELECT id, seq, unnest(range(1, length(seq) + 1)) AS i FROM s)
SELECT id, sum(greatest(0, strpos('ACGT', upper(seq[i])) - 1)::BIGINT << (2 * (length(seq) - i))::BIGINT)::BIGINT AS name FROM b GROUP BY id""")
def sequence_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = F.concat(F.when(F.col("id") % 3 == 0, "Nn").otherwise(""), F.lower("seq"), F.col("seq"))
    return dna(spark, sf_dir).select("id", Q.sequence_id(F.substring(seq, 1, 31)).alias("name"))


@query(f"""WITH s AS (SELECT p_partkey AS ordinal, CASE WHEN p_partkey % 11 = 0 THEN 'ACGNACGTACGTACGTAC' ELSE {DNA} END AS r1_seq, lower(substr({DNA}, 3, 14 + p_partkey % 5)) AS r2_seq FROM part),
k AS (SELECT *, CASE WHEN regexp_full_match(upper(substr(r1_seq, 1, 16)), '[ACGT]{{16}}') AND regexp_full_match(upper(substr(r2_seq, 1, 16)), '[ACGT]{{16}}') THEN upper(substr(r1_seq, 1, 16)) || upper(substr(r2_seq, 1, 16)) END AS key FROM s)
SELECT ordinal FROM (SELECT ordinal, key, row_number() OVER (PARTITION BY key ORDER BY ordinal) AS r FROM k) WHERE key IS NULL OR r = 1""")
def unbarcoded_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = dna(spark, sf_dir).select(F.col("id").alias("ordinal"), F.when(F.col("id") % 11 == 0, "ACGNACGTACGTACGTAC").otherwise(F.col("seq")).alias("r1_seq"), F.lower(F.substring(F.col("seq"), F.lit(3), (14 + F.col("id") % 5).cast("int"))).alias("r2_seq"))
    return A.distinct_pairs(p).select("ordinal")


@query(f"""WITH {NORMAL}, s AS (SELECT cell, substr(feature, 7, 1)::INT AS module, sum(value) AS score FROM norm GROUP BY ALL)
SELECT cluster, module, count(*) AS n_cells, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS sd FROM s JOIN cells USING (cell) GROUP BY ALL""")
def module_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = X.log_normalise(sparse(spark, sf_dir)).groupBy("cell", F.substring("feature", 7, 1).cast("int").alias("module")).agg(F.sum("value").alias("score"))
    return rounded(X.module_by_condition(scores, cells(spark, sf_dir), "cluster"), "mean", "sd")


@query("""WITH g AS (SELECT p_brand AS feature, count(*) FILTER (f) AS n1, count(*) FILTER (NOT f) AS n2, avg(v) FILTER (f) AS m1, avg(v) FILTER (NOT f) AS m2, var_samp(v) FILTER (f) / count(*) FILTER (f) AS a, var_samp(v) FILTER (NOT f) / count(*) FILTER (NOT f) AS b
FROM (SELECT p_brand, l_returnflag = 'R' AS f, l_quantity AS v FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY p_brand)
SELECT feature, n1, n2, round(m1, 6) AS mean1, round(m2, 6) AS mean2, round((m1 - m2) / sqrt(a + b), 6) AS t, round((a + b) ** 2 / (a * a / (n1 - 1) + b * b / (n2 - 1)), 4) AS dof FROM g""")
def welch_by_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("feature"))
    x = read(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select("feature", (F.col("l_returnflag") == "R").alias("inside"), "l_quantity")
    return rounded(rounded(X.welch_statistics(x, ["feature"], "inside", "l_quantity"), "mean1", "mean2", "t"), "dof", digits=4)


def looked_up(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    t = transcripts(spark, sf_dir)
    text = lambda c: c.cast("string")
    tx = t.select(F.col("tx_id"), F.col("gene").alias("gene_id"), F.array(F.concat(F.lit("T"), text(F.col("tx_id")), F.lit(".1"))).alias("names"), "chr", "strand", (3 * F.col("n")).alias("bases"), F.col("n").alias("cds_bases"))
    proteins = t.where("tx_id % 2 = 0").select(F.col("tx_id").alias("protein_id"), F.col("gene").alias("gene_id"), F.array(F.concat(F.lit("P"), text(F.col("tx_id")))).alias("names"), F.concat(F.lit("P"), text(F.col("tx_id"))).alias("accession"), F.lit("E").alias("entry"), F.lit("N").alias("name"), F.lit("S").alias("symbol"), F.lit("ENSP").alias("ensp"), F.array("tx_id", F.col("tx_id") + 1).alias("tx_ids"))
    features = t.select(F.col("tx_id").alias("feature_id"), F.concat(F.lit("L"), text(F.col("tx_id") % 9)).alias("label"), F.lit("domain").alias("kind"), F.lit("d").alias("description"), F.lit("s").alias("signature"), "chr", "strand", F.col("exons").alias("blocks"), F.lit("src").alias("source"), F.lit(1).alias("aa_start"), F.lit(9).alias("aa_end"), "tx_id")
    return {"transcripts": tx, "proteins": proteins, "features": features}


@query(f"WITH {TX} SELECT tx_id AS id, gene AS gene_id, 'T' || tx_id || '.1' AS names, 'c' AS chr, strand, 3 * n AS bases, n AS cds_bases FROM tx WHERE tx_id IN (5, 77, 90, 91)")
def query_lang_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = execute('SELECT transcript WHERE id IN "T5", "t77.1", "P90"', looked_up(spark, sf_dir))
    return out.select("id", "gene_id", "names", "chr", "strand", F.col("bases").cast("long"), F.col("cds_bases").cast("long"))


@query(f"WITH {TX} SELECT tx_id AS id, 'P' || tx_id AS accession, 'E' AS entry, 'N' AS name, 'S' AS symbol, 'ENSP' AS ensp, tx_id || ',' || (tx_id + 1) AS tx_ids, 2::BIGINT AS feature_count FROM tx WHERE tx_id IN (6, 40)")
def query_lang_protein(spark: SparkSession, sf_dir: str) -> DataFrame:
    return execute('SELECT protein WHERE id IN "P6", "T41"', looked_up(spark, sf_dir))


@query(f"WITH {TX} SELECT tx_id AS id, 'L' || (tx_id % 9) AS label, strand, (s0 + 1) || '-' || (s0 + n) || ',' || (s0 + 3 * n + 1) || '-' || (s0 + 4 * n) || ',' || (s0 + 6 * n + 1) || '-' || (s0 + 7 * n) AS blocks FROM tx WHERE tx_id % 9 = 4 OR tx_id IN (6, 7)")
def query_lang_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return execute('SELECT feature WHERE name = "l4" AND protein = "P6"', looked_up(spark, sf_dir)).select("id", "label", "strand", "blocks")
