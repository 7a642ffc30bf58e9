"""Queries of group summaries, ranks and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltbed.operators import matrix as X
from siltbed.operators import molecules as M
from siltbed.operators import ranking as R
from siltbed.operators import summaries as S
from siltbed.plans.catalog import query
from siltbed.plans.molecule_queries import COUNTS, counts, read

#: Cells with a cluster (the supplier's nation), and counts of parts per supplier.
CELLS = "cells AS (SELECT s_suppkey AS cell, s_nationkey % 5 AS cluster FROM supplier)"
SPARSE = f"{CELLS}, counts AS (SELECT l_suppkey AS cell, p_brand AS feature, count(*) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("cell"), (F.col("s_nationkey") % 5).alias("cluster"))


def sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("feature"))
    line = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("cell"), "l_partkey")
    return line.join(part, line.l_partkey == part.p_partkey).groupBy("cell", "feature").agg(F.count("*").alias("value"))


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query(f"""WITH {SPARSE}, t AS (SELECT cell, sum(value) AS total FROM counts GROUP BY cell)
SELECT cluster, count(*) AS n, min(total)::DOUBLE AS min, quantile_cont(total, 0.25)::DOUBLE AS q1, quantile_cont(total, 0.5)::DOUBLE AS median, quantile_cont(total, 0.75)::DOUBLE AS q3, max(total)::DOUBLE AS max FROM t JOIN cells USING (cell) GROUP BY cluster""")
def cluster_five_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.five_numbers(M.cell_totals(sparse(spark, sf_dir)).join(cells(spark, sf_dir), "cell"), ["cluster"], "total")


MEANS = f"""{SPARSE}, size AS (SELECT cluster, count(*) AS n_cells FROM cells GROUP BY cluster),
means AS (SELECT cluster, feature, n_cells, sum(value) / n_cells AS mean, count(*) FILTER (value > 0) / n_cells AS detection, sqrt(greatest(0, sum(value * value) / n_cells - (sum(value) / n_cells) ** 2)) AS sd
FROM counts JOIN cells USING (cell) JOIN size USING (cluster) GROUP BY cluster, feature, n_cells)"""


@query(f"WITH {MEANS} SELECT cluster, feature, n_cells, round(mean, 6) AS mean, round(detection, 6) AS detection, round(sd, 6) AS sd FROM means")
def group_mean_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.group_means(sparse(spark, sf_dir), cells(spark, sf_dir), "cluster"), "mean", "detection", "sd")


@query(f"WITH {SPARSE} SELECT cluster, feature, count(*) AS n, round(avg(value), 6) AS mean, quantile_cont(value, 0.1)::DOUBLE AS q10, quantile_cont(value, 0.5)::DOUBLE AS q50, quantile_cont(value, 0.9)::DOUBLE AS q90 FROM counts JOIN cells USING (cell) WHERE value > 0 GROUP BY ALL")
def positive_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.positive_quantiles(sparse(spark, sf_dir), cells(spark, sf_dir), "cluster", (0.1, 0.5, 0.9)), "mean")


@query("""WITH p AS (SELECT l_suppkey AS cell, l_partkey % 200 AS umi, count(*) AS reads FROM lineitem GROUP BY ALL HAVING count(*) >= 4)
SELECT cell, count(*) AS n, round(avg(reads), 6) AS mean, quantile_cont(reads, 0.5)::DOUBLE AS median, min(reads) AS min, max(reads) AS max FROM p GROUP BY cell HAVING count(*) >= 10""")
def pair_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("cell"), (F.col("l_partkey") % 200).alias("umi"))
    return rounded(S.pair_stats(pairs, 4, 10), "mean")


@query(f"""WITH {SPARSE}, n AS (SELECT f.feature, coalesce(sum(value), 0)::BIGINT AS n FROM (SELECT DISTINCT p_brand AS feature FROM part UNION SELECT 'none') f LEFT JOIN counts USING (feature) GROUP BY f.feature)
SELECT feature, n, round((n + 0.5) / ((SELECT sum(n) FROM n) + 0.5 * (SELECT count(*) FROM n)), 9) AS p FROM n""")
def ambient_profile_dirichlet(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = read(spark, sf_dir, "part").select(F.col("p_brand").alias("feature")).union(spark.createDataFrame([("none",)], "feature string"))
    return rounded(S.dirichlet_profile(sparse(spark, sf_dir), features, 0.5), "p", digits=9)


@query(f"""WITH {COUNTS}, r AS (SELECT cell, value, row_number() OVER (PARTITION BY cell ORDER BY value DESC, feature) AS k, lead(value) OVER (PARTITION BY cell ORDER BY value DESC, feature) AS v2 FROM counts),
g AS (SELECT cell % 4 AS multiplicity, value - v2 AS gap FROM r WHERE k = 1)
SELECT multiplicity, count(*) AS n, round(avg(gap), 6) AS mean, min(gap) AS min, max(gap) AS max, quantile_cont(gap, 0.25)::DOUBLE AS q1, quantile_cont(gap, 0.5)::DOUBLE AS median, quantile_cont(gap, 0.75)::DOUBLE AS q3, round(quantile_cont(gap, 0.9), 6)::DOUBLE AS p90, round(quantile_cont(gap, 0.95), 6)::DOUBLE AS p95
FROM g GROUP BY GROUPING SETS ((multiplicity), ())""")
def multi_gap_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = R.best_and_second(counts(spark, sf_dir), "cell", "feature", "value")
    return rounded(S.gap_stats(best.select((F.col("cell") % 4).alias("multiplicity"), "gap"), "multiplicity", "gap"), "mean", "p90", "p95")


@query(f"""WITH {COUNTS}, r AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY value DESC, feature) AS k, lead(feature) OVER (PARTITION BY cell ORDER BY value DESC, feature) AS second, lead(value) OVER (PARTITION BY cell ORDER BY value DESC, feature) AS v2 FROM counts)
SELECT cell, feature AS best, second, value AS best_score, value - v2 AS gap FROM r WHERE k = 1""")
def best_second_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.best_and_second(counts(spark, sf_dir), "cell", "feature", "value")


@query(f"""WITH {COUNTS}, g AS (SELECT DISTINCT cell, f.feature FROM counts CROSS JOIN (SELECT DISTINCT p_brand AS feature FROM part) f), d AS (SELECT g.cell, g.feature, coalesce(value, 0) AS value FROM g LEFT JOIN counts c ON c.cell = g.cell AND c.feature = g.feature),
m AS (SELECT cell, max(value) AS top, sum(value) AS total FROM d GROUP BY cell)
SELECT m.cell, any_value(total)::BIGINT AS total, min(feature) FILTER (value = top) AS top_feature, round(any_value(top / total), 9) AS share, round(coalesce(min(top - value) FILTER (top - value > 0), 0) / any_value(top), 9)::DOUBLE AS gap_share FROM m JOIN d USING (cell) GROUP BY m.cell""")
def dense_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = read(spark, sf_dir, "part").select(F.col("p_brand").alias("feature"))
    return rounded(S.dense_row(counts(spark, sf_dir), features), "share", "gap_share", digits=9)


@query("""WITH o AS (SELECT l_suppkey AS cell, sum((l_discount > 0.09)::INT) AS mut, sum((l_discount < 0.02)::INT) AS wt FROM lineitem GROUP BY l_suppkey)
SELECT cell, mut::BIGINT AS mut, wt::BIGINT AS wt, CASE WHEN mut > 0 THEN 'MUT' WHEN wt >= 2 THEN 'WT' ELSE 'NO_INFO' END AS call FROM o""")
def genotype_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("cell"))
    o = o.agg(F.count_if(F.col("l_discount") > 0.09).alias("mut"), F.count_if(F.col("l_discount") < 0.02).alias("wt"))
    return o.withColumn("call", S.genotype(F.col("mut"), F.col("wt"), 2))


@query("""WITH c AS (SELECT s_suppkey AS cell FROM supplier), n AS (SELECT DISTINCT p_size AS snp FROM part),
v AS (SELECT l_suppkey AS cell, p_size AS snp, count(*) FILTER (l_returnflag = 'R') AS ref, count(*) FILTER (l_returnflag = 'A') AS alt FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)
SELECT cell, snp, coalesce(ref, 0) AS ref, coalesce(alt, 0) AS alt FROM c CROSS JOIN n LEFT JOIN v USING (cell, snp)""")
def ref_alt_dense_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("snp"))
    line = read(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    seen = [(line.where(F.col("l_returnflag") == f).groupBy(F.col("l_suppkey").alias("cell"), "snp").agg(F.count("*").alias("value")), n) for f, n in (("R", "ref"), ("A", "alt"))]
    return S.dense_cross(read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("cell")), part.select("snp").distinct(), *seen, key=("cell", "snp"))


@query("""WITH l AS (SELECT 'c_mktsegment' AS "column", c_mktsegment AS level FROM customer UNION ALL SELECT 'c_nationkey', c_nationkey::VARCHAR FROM customer),
n AS (SELECT "column", level, count(*) AS n FROM l GROUP BY ALL) SELECT "column", level, n FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, level) AS r FROM n) WHERE r <= 10""")
def obs_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.column_overview(read(spark, sf_dir, "customer"), ["c_mktsegment", "c_nationkey"], 10)


@query("""WITH x AS (SELECT log10(o_totalprice) AS x FROM orders WHERE o_totalprice > 0), t AS (SELECT greatest(1.0, max(x)) AS top FROM x)
SELECT least(99, floor(x / (top / 100)))::INT AS bin, count(*) AS n FROM x, t GROUP BY ALL""")
def log_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.log_histogram(read(spark, sf_dir, "orders"), "o_totalprice")


@query("SELECT items, count(*) AS n FROM (SELECT l_orderkey, list_sort(list(DISTINCT l_returnflag || l_linestatus)) AS items FROM lineitem GROUP BY l_orderkey) GROUP BY items")
def compat_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.compatibility_classes(read(spark, sf_dir, "lineitem").select("l_orderkey", F.concat("l_returnflag", "l_linestatus").alias("item")), "l_orderkey", "item")


@query("""WITH m AS (SELECT DISTINCT l_returnflag AS grp, l_linenumber AS member, l_partkey % 50 AS position FROM lineitem),
s AS (SELECT grp, count(DISTINCT member) AS size FROM m GROUP BY grp)
SELECT m.grp, position FROM m JOIN s ON m.grp = s.grp GROUP BY m.grp, position, size HAVING count(*) = size""")
def shared_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("grp"), F.col("l_linenumber").alias("member"), (F.col("l_partkey") % 50).alias("position"))
    return S.shared_positions(m, m.select("grp", "member"))


#: Every cell's distance to the chord, first over all cells, then over those after the first knee.
KNEE = """WITH r AS (SELECT total AS depth, row_number() OVER (ORDER BY total DESC) AS rank, count(*) OVER () AS n, min(total) OVER () AS low, max(total) OVER () AS high FROM t WHERE total > 1),
one AS (SELECT rank, depth, n, low, round(abs((log10(low) - log10(high)) * log10(rank) - log10(n) * (log10(depth) - log10(high))) / sqrt(log10(n) ** 2 + (log10(low) - log10(high)) ** 2), 9) AS score FROM r WHERE rank > 1 AND rank < n AND n >= 3 ORDER BY score DESC, rank LIMIT 1),
two AS (SELECT r.rank, r.depth, round(abs((log10(r.low) - log10(o.depth)) * (log10(r.rank) - log10(o.rank)) - (log10(r.n) - log10(o.rank)) * (log10(r.depth) - log10(o.depth))) / sqrt((log10(r.n) - log10(o.rank)) ** 2 + (log10(r.low) - log10(o.depth)) ** 2), 9) AS score, o.rank AS p, r.n
  FROM r, one o WHERE r.rank > o.rank AND r.rank < r.n AND o.rank - 1 >= 10 AND r.n - (o.rank - 1) >= 20 ORDER BY score DESC, r.rank LIMIT 1),
b AS (SELECT 1 AS k, depth, score FROM one UNION ALL SELECT 2, depth, score FROM two WHERE rank - p >= 10 AND n - (rank - 1) >= 10 AND score >= 0.05)
SELECT (SELECT count(*) FROM t WHERE total >= b.depth) AS knee_rank, depth AS cutoff, score FROM b ORDER BY k DESC LIMIT 1"""


@query(KNEE.replace("WITH r", "WITH t AS (SELECT count(*) AS total FROM orders GROUP BY o_custkey), r"))
def knee_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.knee(read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("total")))


@query(KNEE.replace("WITH r", "WITH t AS (SELECT greatest(1, 4000 // (p_partkey + 1)) + CASE WHEN p_partkey BETWEEN 100 AND 700 THEN 60 - p_partkey // 30 ELSE 0 END AS total FROM part), r"))
def second_knee(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    total = F.greatest(F.lit(1), F.floor(4000 / (k + 1))) + F.when(k.between(100, 700), 60 - F.floor(k / 30)).otherwise(0)
    return R.knee(read(spark, sf_dir, "part").select(total.alias("total")))


@query("""WITH t AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_returnflag AS grp, (l_extendedprice % 1000 + 1) / 1002 AS p FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY p, id) AS k, count(*) OVER (PARTITION BY grp) AS m FROM t)
SELECT id, grp, round(p, 9) AS p, round(least(1.0, min(p * m / k) OVER (PARTITION BY grp ORDER BY k DESC ROWS UNBOUNDED PRECEDING)), 9) AS q FROM r""")
def bh_fdr(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_returnflag").alias("grp"), ((F.col("l_extendedprice") % 1000 + 1) / 1002).alias("p"))
    return rounded(R.bh_fdr(t, "p", ["grp"], "id"), "p", "q", digits=9)


@query("""WITH t AS (SELECT l_orderkey * 10 + l_linenumber AS id, (l_extendedprice % 1000 + 1) / 1002 AS p FROM lineitem), r AS (SELECT *, row_number() OVER (ORDER BY p, id) AS k, count(*) OVER () AS m FROM t)
SELECT id, round(p, 9) AS p, round(least(1.0, min(p * m / k) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING)), 9) AS q FROM r""")
def bh_over_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), ((F.col("l_extendedprice") % 1000 + 1) / 1002).alias("p"))
    return rounded(R.bh_over_all(t, "p", "id"), "p", "q", digits=9)


@query("SELECT l_orderkey, l_linenumber, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2 AS avg_rank FROM lineitem")
def average_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    return R.with_average_rank(line, "l_quantity", ["l_returnflag"], "avg_rank").select("l_orderkey", "l_linenumber", "avg_rank")


@query("""WITH x AS (SELECT p_brand AS feature, l_returnflag = 'R' AS inside, l_extendedprice AS v FROM lineitem JOIN part ON l_partkey = p_partkey),
r AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY v) + (count(*) OVER (PARTITION BY feature, v) - 1) / 2 AS k FROM x),
u AS (SELECT feature, count(*) FILTER (inside) AS n1, count(*) FILTER (NOT inside) AS n2, sum(k) FILTER (inside) - count(*) FILTER (inside) * (count(*) FILTER (inside) + 1) / 2 AS u FROM r GROUP BY feature),
z AS (SELECT *, (u - n1 * n2 / 2) / sqrt(n1 * n2 * (n1 + n2 + 1) / 12) AS z FROM u), t AS (SELECT *, 1 / (1 + 0.5 * abs(z) / sqrt(2)) AS t FROM z)
SELECT feature, n1, n2, u, round(z, 6) AS z, round(least(1, t * exp(-z * z / 2 - 1.26551223 + t * (1.00002368 + t * (0.37409196 + t * (0.09678418 + t * (-0.18628806 + t * (0.27886807 + t * (-1.13520398 + t * (1.48851587 + t * (-0.82215223 + t * 0.17087277)))))))))), 6) AS p FROM t""")
def mann_whitney(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("feature"))
    x = read(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select("feature", (F.col("l_returnflag") == "R").alias("inside"), F.col("l_extendedprice").alias("v"))
    return rounded(X.mann_whitney(x, ["feature"], "inside", "v"), "z", "p")


NORMAL = f"{SPARSE}, t AS (SELECT cell, sum(value) AS s FROM counts GROUP BY cell), norm AS (SELECT cell, feature, ln(1 + 10000 * value / s) AS value FROM counts JOIN t USING (cell))"


@query(f"WITH {NORMAL} SELECT cell, feature, round(value, 6) AS value FROM norm")
def log_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(X.log_normalise(sparse(spark, sf_dir)), "value")


VARIANCE = f"{NORMAL}, n AS (SELECT count(*) AS n FROM cells), st AS (SELECT feature, sum(value) / n AS mean, greatest(0, sum(value * value) / n - (sum(value) / n) ** 2) AS variance FROM norm, n GROUP BY feature, n)"


@query(f"WITH {VARIANCE} SELECT feature, round(mean, 6) AS mean, round(variance, 6) AS variance FROM st ORDER BY round(variance, 9) DESC, feature LIMIT 10")
def hvg_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = X.feature_moments(X.log_normalise(sparse(spark, sf_dir)), cells(spark, sf_dir)).withColumn("variance", F.round("variance", 9))
    return rounded(R.variable_features(stats, 10), "mean", "variance")


@query(f"WITH {VARIANCE} SELECT c.cell, st.feature, round((coalesce(value, 0) - mean) / sqrt(variance), 5) AS z FROM cells c CROSS JOIN st LEFT JOIN norm ON norm.cell = c.cell AND norm.feature = st.feature WHERE variance > 0")
def zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(X.zscores(X.log_normalise(sparse(spark, sf_dir)), cells(spark, sf_dir)), "z", digits=5)


@query(f"""WITH {MEANS}, rest AS (SELECT m.cluster, m.feature, m.mean, m.detection, (sum(o.mean * o.n_cells) / sum(o.n_cells)) AS other FROM means m JOIN means o ON o.feature = m.feature AND o.cluster <> m.cluster GROUP BY ALL),
f AS (SELECT *, round(log2((mean + 1e-6) / (other + 1e-6)), 6) AS log2fc FROM rest)
SELECT cluster, feature, direction, log2fc, rank FROM (SELECT *, row_number() OVER (PARTITION BY cluster, direction ORDER BY abs(log2fc) DESC, feature) AS rank FROM (SELECT *, CASE WHEN log2fc >= 0 THEN 'up' ELSE 'down' END AS direction FROM f)) WHERE rank <= 5""")
def marker_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = S.group_means(sparse(spark, sf_dir), cells(spark, sf_dir), "cluster")
    return X.markers(means, "cluster", 5).withColumn("rank", F.col("rank").cast("long"))


@query("SELECT p_partkey AS feature, ((row_number() OVER (ORDER BY p_retailprice, p_partkey) - 1) * 24 // (SELECT count(*) FROM part))::INT AS bin FROM part")
def equal_freq_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("feature"), "p_retailprice")
    return R.equal_frequency_bins(part, "p_retailprice", "feature", 24).select("feature", "bin")


@query("""SELECT c_custkey AS cell, c_mktsegment AS grp, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) <= least(count(*) OVER (PARTITION BY c_mktsegment) - 1, greatest(1, ceil(count(*) OVER (PARTITION BY c_mktsegment) * 0.1))) AS held FROM customer""")
def holdout_deepest(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cell"), F.col("c_mktsegment").alias("grp"), "c_acctbal")
    return R.holdout(c, "grp", "c_acctbal", "cell").drop("c_acctbal")


@query("""WITH c AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey AS locus, l_partkey % 7 AS v, l_returnflag AS j, l_quantity::BIGINT AS umis, l_linenumber::BIGINT AS reads FROM lineitem),
u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY locus, v, j ORDER BY umis DESC, reads DESC, id) AS k FROM c) WHERE k = 1)
SELECT id, locus, v, j, umis, reads, call FROM (SELECT *, row_number() OVER (PARTITION BY locus ORDER BY umis DESC, reads DESC, id) AS call FROM u) WHERE call <= 2""")
def two_calls_per_locus(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = read(spark, sf_dir, "lineitem")
    c = line.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_suppkey").alias("locus"), (F.col("l_partkey") % 7).alias("v"), F.col("l_returnflag").alias("j"), F.col("l_quantity").cast("long").alias("umis"), F.col("l_linenumber").cast("long").alias("reads"))
    return R.two_calls_per_locus(c, ["locus"], ["v", "j"]).withColumn("call", F.col("call").cast("long"))


@query("""WITH l AS (SELECT conv_id, turn, role, CASE WHEN lag(role) OVER w IS NOT DISTINCT FROM role AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, count(*) AS turns, sum(new)::BIGINT AS runs FROM l GROUP BY conv_id""")
def run_length_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = R.run_ids(read(spark, sf_dir, "conversations"), ["conv_id"], ["turn", "role", "text"], "role")
    return runs.groupBy("conv_id").agg(F.count("*").alias("turns"), F.max("run").alias("runs"))


@query("""WITH l AS (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) SELECT user_id, count(*) FILTER (p IS NOT NULL AND p <> event_type) AS transitions FROM l GROUP BY user_id""")
def state_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.transitions(read(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type")


@query("""WITH g AS (SELECT o_custkey AS chr, o_orderkey - lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS gap FROM orders), s AS (SELECT chr, list_sort(list(gap)) AS l FROM g WHERE gap > 0 GROUP BY chr)
SELECT chr, l[len(l) // 2 + 1] AS median_gap FROM s""")
def upper_median_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.upper_median_gap(read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("chr"), "o_orderkey"), "chr", "o_orderkey")


@query("""WITH v AS (SELECT s_nationkey AS pc, sum(s_acctbal * s_acctbal) AS variance FROM supplier GROUP BY 1), c AS (SELECT pc, variance, sum(variance) OVER (ORDER BY pc ROWS UNBOUNDED PRECEDING) / (SELECT sum(variance) FROM v) AS cumulative, row_number() OVER (ORDER BY pc) AS r, (SELECT sum(variance) FROM v) AS t FROM v)
SELECT pc, round(cumulative, 6) AS cumulative, r <= 2 OR round(cumulative - variance / t, 9) < 0.9 AS kept FROM c""")
def informative_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = read(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("pc")).agg(F.sum(F.col("s_acctbal") * F.col("s_acctbal")).alias("variance"))
    return rounded(R.cumulative_keep(v, "pc", "variance", 0.9, 2).drop("variance"), "cumulative")


@query(f"""WITH {NORMAL}, p AS (SELECT cell, cluster, row_number() OVER (PARTITION BY cluster ORDER BY cell) % 3 AS patch FROM cells), n AS (SELECT cluster, patch, count(*) AS n FROM p GROUP BY ALL)
SELECT p.cluster, p.patch, feature, round(sum(value) / n, 6) AS mean FROM norm JOIN p USING (cell) JOIN n ON n.cluster = p.cluster AND n.patch = p.patch GROUP BY p.cluster, p.patch, feature, n""")
def pseudobulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    patch = F.row_number().over(Window.partitionBy("cluster").orderBy("cell")) % 3
    p = cells(spark, sf_dir).withColumn("patch", patch.cast("long"))
    return rounded(X.pseudobulk(X.log_normalise(sparse(spark, sf_dir)), p, ["cluster", "patch"]), "mean")
