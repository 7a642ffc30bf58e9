"""Queries of the tabular library, sequence functions and fuzzy joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltbed.functions import sequences as Q
from siltbed.operators import fuzzy as Z
from siltbed.operators import tabular as T
from siltbed.plans.catalog import query
from siltbed.plans.molecule_queries import read
from siltbed.plans.summary_queries import rounded


@query("""WITH l AS (SELECT c_mktsegment AS level, row_number() OVER (ORDER BY min(c_custkey), c_mktsegment) - 1 AS numeric FROM customer GROUP BY c_mktsegment)
SELECT c_custkey, numeric::DOUBLE AS c_mktsegment FROM customer JOIN l ON c_mktsegment = level""")
def factor_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return T.encode(c, T.factor_levels(c, "c_mktsegment", "c_custkey"), "c_mktsegment").select("c_custkey", "c_mktsegment")


@query("SELECT o_orderkey, (o_orderstatus = 'F')::INT AS o_orderstatus_F, (o_orderstatus = 'O')::INT AS o_orderstatus_O, (o_orderstatus = 'P')::INT AS o_orderstatus_P FROM orders")
def one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.one_hot(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", ["F", "O", "P"])


HOLES = "h AS (SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS seg, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS bal, c_nationkey::DOUBLE AS nat FROM customer)"


def holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select("c_custkey", F.expr("nullif(c_mktsegment, 'BUILDING')").alias("seg"), F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("bal"), F.col("c_nationkey").cast("double").alias("nat"))


@query(f"WITH {HOLES} SELECT unnest(['seg', 'bal', 'nat']) AS feature, round(unnest([avg((seg IS NULL)::INT), avg((bal IS NULL)::INT), avg((nat IS NULL)::INT)]), 9) AS fraction FROM h")
def na_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(T.na_fraction(holes(spark, sf_dir), ["seg", "bal", "nat"]), "fraction", digits=9)


@query(f"WITH {HOLES} SELECT * FROM h WHERE seg IS NOT NULL AND bal IS NOT NULL")
def drop_na(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.drop_na(holes(spark, sf_dir), ["seg", "bal"])


@query("SELECT count(*) AS n, round(count(*) * 0.7)::BIGINT AS n_train, round(count(*) * 0.7)::BIGINT AS n_train_distinct FROM orders")
def train_test_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = T.train_test_split(read(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 0.7, seed=4)
    return s.agg(F.count("*").alias("n"), F.count_if("train").alias("n_train"), F.count_distinct(F.when(F.col("train"), F.col("o_orderkey"))).alias("n_train_distinct"))


@query("SELECT p_partkey, ((row_number() OVER (ORDER BY p_partkey) - 1) % 2)::INT AS part FROM part")
def alternate_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.alternate_split(read(spark, sf_dir, "part").select("p_partkey"), "p_partkey")


@query()
def knn_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("double").alias("nat"), F.when(F.col("s_suppkey") % 5 > 0, F.col("s_acctbal")).alias("bal"), (F.col("s_suppkey") % 13).cast("double").alias("x"))
    return rounded(T.impute_knn(s, "s_suppkey", ["nat", "bal", "x"], 5, 1), "bal")


#: A stand-in for reads: each letter class of a name as a base.
DNA = "translate(upper(p_name || p_type || p_brand), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ #0123456789', 'ACGTACGTACGTACGTACGTACGTACGTACGTACGTA')"


def dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.expr(DNA).alias("seq"))


@query(f"SELECT p_partkey AS id, reverse(translate({DNA}, 'ACGT', 'TGCA')) AS rc FROM part")
def revcomp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dna(spark, sf_dir).select("id", Q.reverse_complement(F.col("seq")).alias("rc"))


@query(f"""WITH s AS (SELECT p_partkey AS id, {DNA} AS seq FROM part)
SELECT id, array_to_string([substr('FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG', (strpos('TCAG', seq[i * 3 + 1]) - 1) * 16 + (strpos('TCAG', seq[i * 3 + 2]) - 1) * 4 + strpos('TCAG', seq[i * 3 + 3]), 1) FOR i IN range(0, length(seq) // 3)], '') AS protein FROM s""")
def translate_dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dna(spark, sf_dir).select("id", Q.translate_dna(F.col("seq")).alias("protein"))


@query(f"""WITH s AS (SELECT p_partkey AS id, substr({DNA}, 1, 16) AS seq FROM part), b AS (SELECT id, seq, unnest(range(1, length(seq) + 1)) AS i FROM s)
SELECT id, sum((strpos('ACGT', seq[i]) - 1)::BIGINT << (2 * (i - 1))::BIGINT)::BIGINT AS low_first, sum((strpos('ACGT', seq[i]) - 1)::BIGINT << (2 * (length(seq) - i))::BIGINT)::BIGINT AS high_first, any_value(seq) AS again FROM b GROUP BY id""")
def pack_dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = dna(spark, sf_dir).withColumn("seq", F.substring("seq", 1, 16))
    packed = Q.pack_low_first(F.col("seq"))
    return s.select("id", packed.alias("low_first"), Q.pack_high_first(F.col("seq")).alias("high_first"), Q.unpack_low_first(packed, F.length("seq")).alias("again"))


@query(f"""WITH s AS (SELECT p_partkey AS id, {DNA} AS seq FROM part), c AS (SELECT id, seq, [length(seq) - length(replace(seq, b, '')) FOR b IN ['A', 'C', 'G', 'T']] AS n FROM s)
SELECT id, length(seq) >= 20 AND list_sum(n) >= 20 AND list_max(n) <= 0.45 * length(seq) AS usable FROM c""")
def usable_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dna(spark, sf_dir).select("id", Q.usable_insert(F.col("seq"), 20, 20, 0.45).alias("usable"))


@query("""WITH a AS (SELECT DISTINCT p_name AS a FROM part), b AS (SELECT DISTINCT upper(p_name) AS b FROM part) SELECT a, b, levenshtein(lower(a), lower(b))::INT AS distance FROM a, b WHERE levenshtein(lower(a), lower(b)) <= 2""")
def levenshtein_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    return Z.edit_join(p.select(F.col("p_name").alias("a")), p.select(F.upper("p_name").alias("b")), "a", "b", 2)


BARCODES = f"""wl AS (SELECT DISTINCT substr({DNA}, 1, 8) AS barcode FROM part WHERE p_partkey % 7 = 0),
rd AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN substr({DNA}, 1, 8) ELSE substr({DNA}, 1, 3) || 'A' || substr({DNA}, 5, 4) END AS seq FROM part)"""


@query(f"""WITH {BARCODES}, d AS (SELECT id, seq, barcode, hamming(seq, barcode) AS distance FROM rd, wl WHERE length(seq) = length(barcode)), n AS (SELECT *, min(distance) OVER (PARTITION BY id) AS best, count(*) OVER (PARTITION BY id, distance) AS ties FROM d)
SELECT id, seq, barcode, distance::INT AS distance FROM n WHERE distance = best AND ties = 1 AND distance <= 1""")
def barcode_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = dna(spark, sf_dir)
    mutated = F.concat(F.substring("seq", 1, 3), F.lit("A"), F.substring("seq", 5, 4))
    reads = s.select("id", F.when(F.col("id") % 2 == 0, F.substring("seq", 1, 8)).otherwise(mutated).alias("seq"))
    return Z.barcode_join(reads, s.where("id % 7 = 0").select(F.substring("seq", 1, 8).alias("barcode")).distinct(), 1, 2)


@query(f"""WITH r AS (SELECT p_partkey AS id, {DNA} AS seq FROM part WHERE p_partkey % 20 = 0), f AS (SELECT DISTINCT substr({DNA}, 3, 10) AS fseq FROM part),
rk AS (SELECT id, i AS rp, substr(seq, (i + 1)::INT, 6) AS kmer FROM r, unnest(range(0, length(seq) - 5)) t(i)), fk AS (SELECT fseq, i AS fp, substr(fseq, (i + 1)::INT, 6) AS kmer FROM f, unnest(range(0, length(fseq) - 5)) t(i))
SELECT id, fseq AS feature, (rp - fp)::INT AS "offset", count(*) AS hits FROM rk JOIN fk USING (kmer) GROUP BY ALL HAVING count(*) >= 5""")
def kmer_seed_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = dna(spark, sf_dir)
    features = s.select(F.substring("seq", 3, 10).alias("fseq")).distinct().withColumn("feature", F.col("fseq"))
    return Z.seed_join(s.where("id % 20 = 0"), features, 6, 5, top=1000).select("id", "feature", "offset", "hits")
