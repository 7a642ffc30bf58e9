"""Queries of catalog joins and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltbed.operators import relations as J
from siltbed.plans.catalog import query
from siltbed.plans.molecule_queries import read


@query("""WITH n AS (SELECT DISTINCT CASE WHEN c_custkey % 3 = 0 THEN upper(n_name) WHEN c_custkey % 3 = 1 THEN lower(n_name) || '.' || (c_custkey % 4) ELSE 'unknown_' || (c_custkey % 5) END AS name FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT name, coalesce((SELECT n_nationkey FROM nation WHERE lower(n_name) = lower(name)), (SELECT n_nationkey FROM nation WHERE lower(n_name) = regexp_replace(lower(name), '\\.\\d+$', ''))) AS id FROM n""")
def alias_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read(spark, sf_dir, "nation")
    k = F.col("c_custkey")
    name = F.when(k % 3 == 0, F.upper("n_name")).when(k % 3 == 1, F.concat(F.lower("n_name"), F.lit("."), (k % 4).cast("string"))).otherwise(F.concat(F.lit("unknown_"), (k % 5).cast("string")))
    names = read(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(name.alias("name")).distinct()
    return J.resolve_aliases(names, nation.select(F.col("n_name").alias("alias"), F.col("n_nationkey").alias("id"), F.lit(0).alias("priority")))


VARIANTS = """v AS (SELECT o_orderkey AS id, 'chr' || (o_custkey % 5) AS chr, o_orderkey % 900 AS pos, substr('ACGT', (o_orderkey % 4 + 1)::INT, 1) AS ref, [substr('ACGT', (o_custkey % 4 + 1)::INT, 1), substr('ACGT', ((o_custkey + 1) % 4 + 1)::INT, 1)] AS alts FROM orders),
c AS (SELECT DISTINCT 'chr' || (l_suppkey % 5) AS chr, l_partkey % 900 AS pos, substr('ACGT', (l_orderkey % 4 + 1)::INT, 1) AS ref, substr('ACGT', (l_linenumber % 4 + 1)::INT, 1) AS alt FROM lineitem),
h AS (SELECT DISTINCT id FROM (SELECT id, chr, pos, ref, unnest(alts) AS alt FROM v) JOIN c USING (chr, pos, ref, alt))"""


def variants(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    base = lambda c: F.substring(F.lit("ACGT"), (F.expr(c) % 4 + 1).cast("int"), F.lit(1))
    v = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("chr"), (F.col("o_custkey") % 5).cast("string")).alias("chr"), (F.col("o_orderkey") % 900).alias("pos"), base("o_orderkey").alias("ref"), F.array(base("o_custkey"), base("o_custkey + 1")).alias("alts"))
    c = read(spark, sf_dir, "lineitem").select(F.concat(F.lit("chr"), (F.col("l_suppkey") % 5).cast("string")).alias("chr"), (F.col("l_partkey") % 900).alias("pos"), base("l_orderkey").alias("ref"), base("l_linenumber").alias("alt"))
    return v, c


@query(f"WITH {VARIANTS} SELECT id, chr, pos FROM v WHERE id IN (SELECT id FROM h)")
def variant_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.with_clinical(*variants(spark, sf_dir), present=True).select("id", "chr", "pos")


@query(f"WITH {VARIANTS} SELECT id, chr, pos FROM v WHERE id NOT IN (SELECT id FROM h)")
def variant_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.with_clinical(*variants(spark, sf_dir), present=False).select("id", "chr", "pos")


@query("SELECT l_returnflag || '_' || l_suppkey AS cell, l_partkey % 100 AS feature, count(*) AS value FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY ALL")
def sample_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = read(spark, sf_dir, "lineitem")
    counts = lambda f: line.where(F.col("l_returnflag") == f).groupBy(F.col("l_suppkey").alias("cell"), (F.col("l_partkey") % 100).alias("feature")).agg(F.count("*").alias("value"))
    return J.merge_samples({f: counts(f) for f in ("A", "R")})


@query("SELECT c_custkey, c_mktsegment, n.n_orders FROM customer JOIN (SELECT c_custkey, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey) n USING (c_custkey)")
def annotation_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    orders = read(spark, sf_dir, "orders")
    annotation = cells.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n_orders"))
    return J.import_annotation(cells, annotation, "c_custkey")


@query("""WITH a AS (SELECT p_size * 1000 + p_partkey % 97 AS name, p_partkey AS x FROM part), b AS (SELECT (o_custkey % 50 + 1) * 1000 + o_orderkey % 97 AS name, o_orderkey AS y FROM orders)
SELECT a.name, x, y FROM a JOIN b ON a.name = b.name WHERE a.name IN (SELECT name FROM a GROUP BY name HAVING count(*) = 1) AND b.name IN (SELECT name FROM b GROUP BY name HAVING count(*) = 1)""")
def unique_name_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = read(spark, sf_dir, "part").select((F.col("p_size") * 1000 + F.col("p_partkey") % 97).alias("name"), F.col("p_partkey").alias("x"))
    b = read(spark, sf_dir, "orders").select(((F.col("o_custkey") % 50 + 1) * 1000 + F.col("o_orderkey") % 97).alias("name"), F.col("o_orderkey").alias("y"))
    return J.unique_name_join(a, b, "name")


@query("""WITH l AS (SELECT l_suppkey AS a, l_partkey % 100 AS b, l_quantity::BIGINT * 20 AS score FROM lineitem WHERE l_quantity * 20 >= 700), e AS (SELECT a AS seed, b AS partner, score FROM l UNION ALL SELECT b, a, score FROM l)
SELECT seed, partner, max(score) AS score FROM e WHERE seed IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000) GROUP BY ALL""")
def seed_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") % 100).alias("b"), (F.col("l_quantity").cast("long") * 20).alias("score"))
    return J.seed_neighbours(links, read(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.col("s_suppkey").alias("id")), 700)


@query("""WITH s AS (SELECT DISTINCT replace(p_name, ' ', '_') || '_' || p_type AS name FROM part), t AS (SELECT DISTINCT name, unnest(string_split(upper(name), '_')) AS symbol FROM s)
SELECT name, symbol FROM t WHERE symbol IN ('RED', 'BOLT', 'PROMO')""")
def set_token_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = read(spark, sf_dir, "part").select(F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), F.col("p_type")).alias("name")).distinct()
    return J.set_token_match(sets, spark.createDataFrame([("red",), ("Bolt",), ("PROMO",)], "symbol string"))


@query("""WITH s AS (SELECT p_brand AS name, list(DISTINCT p_type) AS genes FROM part GROUP BY p_brand), l AS (SELECT DISTINCT name, upper(unnest(genes)) AS gene FROM s)
SELECT gene, count(*) AS n, list_sort(list(name)) AS names FROM l WHERE gene IN ('PROMO', 'SMALL') GROUP BY gene""")
def gmt_reverse_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = read(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("name")).agg(F.collect_set("p_type").alias("genes"))
    return J.reverse_lookup(sets, spark.createDataFrame([("promo",), ("Small",)], "gene string"))


@query("""WITH a AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'R')
SELECT count(*) FILTER (a.l_partkey IS NOT NULL AND b.l_partkey IS NOT NULL) AS both, count(*) FILTER (b.l_partkey IS NULL) AS left_only, count(*) FILTER (a.l_partkey IS NULL) AS right_only FROM a FULL JOIN b ON a.l_partkey = b.l_partkey""")
def set_intersection_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = read(spark, sf_dir, "lineitem")
    return J.intersect_counts(line.where("l_returnflag = 'A'"), line.where("l_returnflag = 'R'"), "l_partkey")


@query("""SELECT side, k AS l_partkey FROM (SELECT 'left' AS side, l_partkey AS k FROM lineitem WHERE l_returnflag = 'A' EXCEPT SELECT 'left', l_partkey FROM lineitem WHERE l_returnflag = 'R')
UNION ALL SELECT side, k FROM (SELECT 'right' AS side, l_partkey AS k FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT 'right', l_partkey FROM lineitem WHERE l_returnflag = 'A')""")
def symmetric_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = read(spark, sf_dir, "lineitem")
    return J.only_in(line.where("l_returnflag = 'A'"), line.where("l_returnflag = 'R'"), "l_partkey")


@query("""SELECT s_suppkey AS cell, coalesce(n, 0) AS n, coalesce(flag, 'unassigned') AS flag FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS n, max(l_returnflag) AS flag FROM lineitem WHERE l_extendedprice > 90000 GROUP BY 1) ON s_suppkey = l_suppkey""")
def left_join_with_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = read(spark, sf_dir, "lineitem").where("l_extendedprice > 90000").groupBy(F.col("l_suppkey").alias("cell")).agg(F.count("*").alias("n"), F.max("l_returnflag").alias("flag"))
    return J.fill_left(read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("cell")), extra, "cell", {"n": 0, "flag": "unassigned"})
