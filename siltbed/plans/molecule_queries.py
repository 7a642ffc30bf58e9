"""Queries on molecule tables, with lineitem and part standing in for molecules (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltbed.operators import molecules as M
from siltbed.plans.catalog import query


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def molecules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell = supplier, feature = brand, umi = quantity."""
    part = read(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("feature"))
    line = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("cell"), "l_partkey", F.col("l_quantity").cast("int").alias("umi"))
    return line.join(part, line.l_partkey == part.p_partkey).select("cell", "feature", "umi")


MOL = "mol AS (SELECT l_suppkey AS cell, p_brand AS feature, CAST(l_quantity AS INT) AS umi FROM lineitem JOIN part ON l_partkey = p_partkey)"
COUNTS = f"{MOL}, counts AS (SELECT cell, feature, count(DISTINCT umi) AS value FROM mol GROUP BY ALL)"


@query(f"""WITH {COUNTS}
SELECT cell, sum(value)::BIGINT AS total, count(*) AS detected,
  sum(CASE WHEN starts_with(feature, 'Brand#1') THEN value ELSE 0 END)::BIGINT AS mito, sum(CASE WHEN starts_with(feature, 'Brand#2') THEN value ELSE 0 END)::BIGINT AS ribo,
  greatest(0, sum(CASE WHEN starts_with(feature, 'Brand#1') OR starts_with(feature, 'Brand#2') THEN 0 ELSE value END))::BIGINT AS surviving,
  row_number() OVER (ORDER BY sum(value) DESC, cell) AS depth_rank
FROM counts GROUP BY cell""")
def qc_per_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = M.umi_counts(molecules(spark, sf_dir))
    found = M.qc(counts, {"mito": F.col("feature").startswith("Brand#1"), "ribo": F.col("feature").startswith("Brand#2")})
    return M.ranked(found, "total").select("cell", "total", "detected", "mito", "ribo", "surviving", F.col("depth_rank").cast("long"))


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.umi_counts(molecules(spark, sf_dir))


def event_molecules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell = user, feature = event type, umi = whole value."""
    e = read(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("cell"), F.col("event_type").alias("feature"), F.floor("value").alias("umi"), "event_id", "value")


EVENTS = "ev AS (SELECT user_id AS cell, event_type AS feature, CAST(floor(value) AS BIGINT) AS umi, event_id, value FROM events)"


@query(f"WITH {COUNTS} SELECT * FROM counts")
def umi_dedup_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts(spark, sf_dir)


@query(f"WITH {EVENTS} SELECT cell, feature, round(sum(v), 4) AS value FROM (SELECT cell, feature, umi, arg_min(value, event_id) AS v FROM ev GROUP BY ALL) GROUP BY ALL")
def first_value_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.first_value_sums(event_molecules(spark, sf_dir), "event_id", "value").withColumn("value", F.round("value", 4))


@query(f"""WITH e AS (SELECT l_suppkey AS cell, p_brand AS feature, CAST(l_quantity AS INT) AS umi, (1::BIGINT << CAST(l_linenumber AS INT)) AS m, l_partkey * 10 AS s, l_partkey * 10 + CAST(l_quantity AS INT) AS e, CAST(l_tax * 1000 AS BIGINT) AS r
FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT cell, feature, umi, bit_or(m) AS mask, min(s) AS first_start, max(e) AS last_end, least(255, sum(r))::BIGINT AS reads FROM e GROUP BY ALL""")
def evidence_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("feature"))
    line = read(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    umi, start = F.col("l_quantity").cast("int"), F.col("l_partkey") * 10
    rows = line.select(F.col("l_suppkey").alias("cell"), "feature", umi.alias("umi"), F.expr("shiftleft(1L, cast(l_linenumber as int))").alias("m"), start.alias("s"), (start + umi).alias("e"), F.round(F.col("l_tax") * 1000).cast("long").alias("r"))
    return M.merge_evidence(rows, "m", "s", "e", "r")


@query(f"WITH {COUNTS} SELECT cell, sum(value)::BIGINT AS total, count(*) AS detected FROM counts GROUP BY cell")
def cell_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.cell_totals(counts(spark, sf_dir))


@query(f"WITH {COUNTS}, t AS (SELECT cell, sum(value) AS total FROM counts GROUP BY cell) SELECT threshold, count(*) FILTER (total >= threshold) AS cells FROM t, (VALUES (1), (10), (50), (100), (200), (400), (1000)) v(threshold) GROUP BY threshold")
def cell_threshold_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.threshold_table(M.cell_totals(counts(spark, sf_dir)))


MANY = f"{COUNTS}, cells AS (SELECT cell FROM counts GROUP BY cell HAVING sum(value) >= 470)"


@query(f"WITH {MANY} SELECT * FROM cells")
def min_umi_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.cells_with_min(counts(spark, sf_dir), 470)


@query(f"WITH {MANY} SELECT counts.*, cell IN (SELECT cell FROM cells) AS kept FROM counts")
def raw_filtered_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = counts(spark, sf_dir)
    return M.split_cells(c, M.cells_with_min(c, 470))


@query(f"WITH {MANY} SELECT counts.* FROM counts WHERE cell IN (SELECT cell FROM cells)")
def restrict_to_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = counts(spark, sf_dir)
    return M.restrict_cells(c, M.cells_with_min(c, 470))


@query(f"WITH {COUNTS} SELECT * FROM counts WHERE feature IN (SELECT p_brand FROM part WHERE p_size >= 45 AND p_type = 'PROMO')")
def retain_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = read(spark, sf_dir, "part").where("p_size >= 45 and p_type = 'PROMO'").select(F.col("p_brand").alias("feature")).distinct()
    return M.retain_features(counts(spark, sf_dir), wanted)


@query(f"WITH {MOL}, d AS (SELECT DISTINCT * FROM mol) SELECT feature, umi, count(*) AS seen, count(*) >= 40 AS ambient FROM d GROUP BY ALL")
def ambient_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.ambient_pairs(molecules(spark, sf_dir), 40)


HALVES = f"{MOL.replace('SELECT l_suppkey', 'SELECT l_orderkey % 2 AS half, l_suppkey')}, a AS (SELECT DISTINCT cell, feature, umi FROM mol WHERE half = 0), b AS (SELECT DISTINCT cell, feature, umi FROM mol WHERE half = 1)"


def halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part = read(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("feature"))
    line = read(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    cols = [F.col("l_suppkey").alias("cell"), "feature", F.col("l_quantity").cast("int").alias("umi")]
    return tuple(line.where(F.col("l_orderkey") % 2 == h).select(*cols) for h in (0, 1))


@query(f"WITH {HALVES} SELECT b.cell, count(*) FILTER (a.cell IS NULL) AS accepted, count(*) FILTER (a.cell IS NOT NULL) AS duplicate FROM b LEFT JOIN a ON a.cell = b.cell AND a.feature = b.feature AND a.umi = b.umi GROUP BY b.cell")
def merge_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.merge_accounting(*halves(spark, sf_dir))


@query(f"WITH {HALVES} SELECT cell, feature, count(*) AS value FROM (SELECT * FROM a UNION SELECT * FROM b) GROUP BY ALL")
def named_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.umi_counts(M.merge(*halves(spark, sf_dir)))


@query(f"WITH {HALVES} SELECT cell, feature, sum(value)::BIGINT AS value FROM (SELECT cell, feature, count(*) AS value FROM a GROUP BY ALL UNION ALL SELECT cell, feature, count(*) FROM b GROUP BY ALL) GROUP BY ALL")
def additive_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.merge_values(*map(M.umi_counts, halves(spark, sf_dir)))


@query(f"WITH {MOL} SELECT cell, feature, count(DISTINCT umi) AS value FROM (SELECT cell, substr(feature, 1, 7) AS feature, umi FROM mol) GROUP BY ALL")
def feature_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapping = read(spark, sf_dir, "part").select(F.col("p_brand").alias("feature")).distinct().withColumn("new_feature", F.substring("feature", 1, 7))
    return M.umi_counts(M.remap_features(molecules(spark, sf_dir), mapping))


@query("SELECT o_orderkey AS id, row_number() OVER (ORDER BY (o_orderkey * 4611686018427387905::HUGEINT % 18446744073709551616), o_orderkey) AS position FROM orders")
def unsigned_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    # id * (2 ** 62 + 1) modulo 2 ** 64, by shifts: bit patterns over the whole unsigned range
    bits = ids.withColumn("bits", F.expr("shiftleft(id & 3, 62) ^ id"))
    return bits.select("id", F.row_number().over(Window.orderBy(M.unsigned_order("bits"), "id")).cast("long").alias("position"))
