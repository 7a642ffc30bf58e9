"""Further queries: tags, windows, sampling, gene models, labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltbed.operators import intervals as I
from siltbed.operators import loci as L
from siltbed.operators import matrix as X
from siltbed.operators import ranking as R
from siltbed.operators import receptors as V
from siltbed.operators import sampling as P
from siltbed.operators import tabular as T
from siltbed.operators import tags as G
from siltbed.operators.summaries import group_means
from siltbed.plans.catalog import query
from siltbed.plans.interval_queries import GENES, genes
from siltbed.plans.molecule_queries import read
from siltbed.plans.summary_queries import MEANS, NORMAL, cells, rounded, sparse
from siltbed.plans.table_queries import DNA
from siltbed.sources.binary import binned
from siltbed.streaming import molecules as W


@query("""WITH l AS (SELECT * FROM (VALUES ('A', 'one', 0), ('A', 'two', 1), ('R', 'one', 0)) x(value, subset, ord)) SELECT l_orderkey, l_linenumber, arg_max(subset, ord) AS subset FROM lineitem JOIN l ON l_returnflag = value GROUP BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice""")
def subset_by_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    al = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.create_map(F.lit("RF"), F.col("l_returnflag")).alias("tags"))
    lists = spark.createDataFrame([("A", "one", 0), ("A", "two", 1), ("R", "one", 0)], "value string, subset string, ord int")
    return G.subset_by_tags(al, lists, "RF").select("l_orderkey", "l_linenumber", "subset")


@query("SELECT p_type AS feature_type, l_suppkey AS cell, p_partkey AS feature, count(DISTINCT l_quantity::INT) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL")
def feature_type_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("cell"), F.col("l_partkey").alias("feature"), F.col("l_quantity").cast("int").alias("umi"))
    return G.split_features(obs, read(spark, sf_dir, "part").select(F.col("p_partkey").alias("feature"), F.col("p_type").alias("feature_type")))


@query("""WITH w AS (SELECT (i - 1)::BIGINT AS idx, substr('AAAACCCCGGGGTTTT', ((i - 1) * 4 + 1)::INT, 4) AS barcode FROM unnest([1, 2, 3, 4]) t(i)),
r AS (SELECT p_partkey AS id, substr('AAAACCCCGGGGTTTTACGT', (p_partkey % 5 * 4 + 1)::INT, 4) AS a, substr('AAAACCCCGGGGTTTTACGT', (p_size % 5 * 4 + 1)::INT, 4) AS b FROM part)
SELECT id, x.idx * 4 + y.idx AS cell, 0 AS distance FROM r JOIN w x ON x.barcode = a JOIN w y ON y.barcode = b""")
def combinatorial_barcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = spark.createDataFrame([("AAAA", 0), ("CCCC", 1), ("GGGG", 2), ("TTTT", 3)], "barcode string, idx int")
    cut = lambda c: F.substring(F.lit("AAAACCCCGGGGTTTTACGT"), (F.col(c) % 5 * 4 + 1).cast("int"), F.lit(4))
    r = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(cut("p_partkey"), F.lit("xx"), cut("p_size")).alias("seq"))
    return G.combinatorial_barcodes(r, [(0, w), (6, w)])


@query("""WITH w AS (SELECT time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') - k * INTERVAL 2 HOURS + CASE WHEN ts >= time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') + INTERVAL 4 HOURS THEN INTERVAL 4 HOURS WHEN ts >= time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') + INTERVAL 2 HOURS THEN INTERVAL 2 HOURS ELSE INTERVAL 0 HOURS END AS start, value FROM events, unnest([0, 1, 2]) t(k))
SELECT start, count(*) AS n, round(sum(value), 3) AS total FROM w GROUP BY start""")
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = W.windowed(read(spark, sf_dir, "events"), "ts", "6 hours", "2 hours", [], "value")
    return out.select("start", "n", F.round("total", 3).alias("total"))


@query("""WITH l AS (SELECT user_id, event_id, CASE WHEN event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) <= 100 THEN 0 ELSE 1 END AS new FROM events), r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM l)
SELECT user_id, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM r GROUP BY user_id, run""")
def cluster_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.cluster_buffer(read(spark, sf_dir, "events"), "user_id", "event_id", 100)


@query("SELECT l_suppkey AS cell, 300::BIGINT AS depth, count(*) >= 300 AS enough FROM lineitem GROUP BY l_suppkey HAVING count(*) >= 300")
def resampled_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = read(spark, sf_dir, "lineitem")
    counts = line.groupBy(F.col("l_suppkey").alias("cell"), (F.col("l_partkey") % 60).alias("feature")).agg(F.count("*").alias("value"))
    deep = counts.groupBy("cell").agg(F.sum("value").alias("s")).where("s >= 300").select("cell")
    out = P.resample(counts.join(deep, "cell", "left_semi"), 300).groupBy("cell").agg(F.sum("value").alias("depth"))
    return out.withColumn("enough", F.lit(True))


@query(f"""WITH {MEANS}, z AS (SELECT g.cluster, f.feature, coalesce(mean, 0) AS mean FROM (SELECT DISTINCT cluster FROM means) g CROSS JOIN (SELECT DISTINCT feature FROM means) f LEFT JOIN means ON means.cluster = g.cluster AND means.feature = f.feature), m AS (SELECT cluster, feature, mean - avg(mean) OVER (PARTITION BY feature) AS centroid FROM z), t AS (SELECT cell, sum(value) AS s FROM counts GROUP BY cell), norm AS (SELECT cell, feature, ln(1 + 10000 * value / s) AS value FROM counts JOIN t USING (cell)),
d AS (SELECT c.cell, m.cluster, m.centroid AS y, coalesce(n.value, 0) AS x FROM (SELECT DISTINCT cell FROM norm) c CROSS JOIN m LEFT JOIN norm n ON n.cell = c.cell AND n.feature = m.feature)
SELECT cell, cluster, round(corr(x, y), 5) AS score FROM d GROUP BY cell, cluster""")
def gene_model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, c = sparse(spark, sf_dir), cells(spark, sf_dir)
    model = L.gene_model(group_means(v, c, "cluster"), "cluster")
    out = L.apply_gene_model(model, X.log_normalise(v), "cluster")
    return out.select("cell", "cluster", F.round("score", 5).alias("score"))


@query("""WITH n AS (SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN 'WT' WHEN 1 THEN 'ctrl_' || o_custkey WHEN 2 THEN 'mock-1' WHEN 3 THEN 'control' || (o_custkey % 9) WHEN 4 THEN CASE o_custkey % 4 WHEN 0 THEN 'wtx' WHEN 1 THEN 'WT3b' WHEN 2 THEN 'Wild-Type' ELSE 'dmso' END ELSE o_orderpriority END AS name FROM orders)
SELECT id, lower(name) IN ('wt', 'wildtype', 'wild-type', 'control', 'ctrl', 'untreated', 'vehicle', 'mock') OR regexp_matches(lower(name), '^(wt|wildtype|wild-type|control|ctrl|untreated|vehicle|mock)(_|-|[0-9])') AS control FROM n""")
def control_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 6
    name = F.when(k == 0, "WT").when(k == 1, F.concat(F.lit("ctrl_"), F.col("o_custkey").cast("string"))).when(k == 2, "mock-1").when(k == 3, F.concat(F.lit("control"), (F.col("o_custkey") % 9).cast("string"))).when(k == 4, F.element_at(F.array(*map(F.lit, ("wtx", "WT3b", "Wild-Type", "dmso"))), (F.col("o_custkey") % 4 + 1).cast("int"))).otherwise(F.col("o_orderpriority"))
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), L.is_control(name).alias("control"))


@query(f"""WITH {GENES}, p AS (SELECT a.gene AS a, b.gene AS b, a.start AS s, a."end" AS e, b.start AS t, b."end" AS f FROM genes a JOIN genes b ON a.chr = b.chr AND b.gene = a.gene + 3)
SELECT a, b, s < f AND t < e AS overlaps, s <= t AND f <= e AS contains, round(greatest(0, least(e, f) - greatest(s, t)) / greatest(e - s, f - t), 9) AS reciprocal FROM p""")
def interval_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = genes(spark, sf_dir).select("chr", F.col("gene").alias("a"), F.col("start").alias("s"), F.col("end").alias("e"))
    b = genes(spark, sf_dir).select(F.col("chr").alias("c"), F.col("gene").alias("b"), F.col("start").alias("t"), F.col("end").alias("f"))
    args = [F.col(x) for x in "setf"]
    j = a.join(b, (F.col("chr") == F.col("c")) & (F.col("b") == F.col("a") + 3))
    return j.select("a", "b", I.overlaps(*args).alias("overlaps"), I.contains(*args).alias("contains"), F.round(I.reciprocal_overlap(*args), 9).alias("reciprocal"))


@query(f"""WITH {GENES}, i AS (SELECT chr, start, "end", gene::DOUBLE AS value FROM genes), c AS (SELECT chr, b AS bin, value, least("end", (b + 1) * 64) - greatest(start, b * 64) AS w FROM i, unnest(range(start // 64, ("end" - 1) // 64 + 1)) t(b))
SELECT chr, bin, round(sum(value * w) / sum(w), 6) AS value FROM c GROUP BY chr, bin""")
def interval_bin_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = genes(spark, sf_dir).select("chr", "start", "end", F.col("gene").cast("double").alias("value"))
    return rounded(binned(g, 64), "value")


#: Every feature of every cluster against the cells outside: pseudobulk samples, the rank test, and the descriptive scores.
TESTS = f"""{NORMAL}, gr AS (SELECT DISTINCT cluster AS g FROM cells), sd AS (SELECT cell, g, cluster = g AS side, row_number() OVER (PARTITION BY g, cluster = g ORDER BY cell) - 1 AS i, count(*) OVER (PARTITION BY g, cluster = g) AS n FROM cells, gr),
de AS (SELECT cell, g, side, i % least(4, n) AS sample FROM sd), sz AS (SELECT g, side, sample, count(*) AS n FROM de GROUP BY ALL), fe AS (SELECT DISTINCT feature FROM norm),
su AS (SELECT g, side, sample, feature, sum(value) AS s, count(*) FILTER (value > 0) AS k, sum(value) FILTER (value > 0) AS p FROM norm JOIN de USING (cell) GROUP BY ALL),
x AS (SELECT sz.g, sz.side, sz.sample, fe.feature, n, coalesce(s, 0) / n AS v, coalesce(k, 0) AS k, coalesce(p, 0) AS p FROM sz CROSS JOIN fe LEFT JOIN su ON su.g = sz.g AND su.side = sz.side AND su.sample = sz.sample AND su.feature = fe.feature),
rk AS (SELECT *, rank() OVER (PARTITION BY g, feature ORDER BY v) + (count(*) OVER (PARTITION BY g, feature, v) - 1) / 2 AS r FROM x),
ag AS (SELECT g, feature, count(*) FILTER (side) AS n1, count(*) FILTER (NOT side) AS n2, sum(r) FILTER (side) AS rs, avg(v) FILTER (side) AS ma, avg(v) FILTER (NOT side) AS mb, sum(k) FILTER (side) / sum(n) FILTER (side) AS d, sum(k) FILTER (NOT side) / sum(n) FILTER (NOT side) AS b,
  coalesce(sum(p) FILTER (side) / nullif(sum(k) FILTER (side), 0), 0) AS pa, coalesce(sum(p) FILTER (NOT side) / nullif(sum(k) FILTER (NOT side), 0), 0) AS pb FROM rk GROUP BY g, feature),
zt AS (SELECT *, abs(rs - n1 * (n1 + 1) / 2 - n1 * n2 / 2) / sqrt(n1 * n2 * (n1 + n2 + 1) / 12) AS z FROM ag), tt AS (SELECT *, 1 / (1 + 0.5 * z / sqrt(2)) AS t FROM zt),
pv AS (SELECT *, least(1, t * exp(-z * z / 2 - 1.26551223 + t * (1.00002368 + t * (0.37409196 + t * (0.09678418 + t * (-0.18628806 + t * (0.27886807 + t * (-1.13520398 + t * (1.48851587 + t * (-0.82215223 + t * 0.17087277)))))))))) AS pval FROM tt),
pr AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY pval, feature) AS k, count(*) OVER (PARTITION BY g) AS m FROM pv),
qv AS (SELECT *, least(1.0, min(pval * m / k) OVER (PARTITION BY g ORDER BY k DESC ROWS UNBOUNDED PRECEDING)) AS q FROM pr),
ts AS (SELECT g AS cluster, feature, round(q, 9) AS q, round(pval, 9) AS p, round(log2((ma + 1e-6) / (mb + 1e-6)), 9) AS log2fc, round(greatest(d - b, 0) * (1 + greatest(ln((1 + pa) / (1 + pb)), 0)) * ln(1 + pa), 9) AS general,
  round(CASE WHEN d > 0 THEN ln(1 + pa) * (pa / (1 + pa)) * sqrt(d) * greatest(1 - d, 0) * greatest(d - b, 0) ELSE 0 END, 9) AS sparse,
  round(CASE WHEN d = 0 AND b = 0 THEN 0 ELSE (abs(d - b) + 0.1 * abs(ln((1 + pa) / (1 + pb))) * sqrt(least(d, b))) / (1 + greatest(pa, pb)) ** 3 END, 9) AS low_signal FROM qv)"""


def tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.marker_tests(X.log_normalise(sparse(spark, sf_dir)), cells(spark, sf_dir), "cluster", 4)


@query(f"WITH {TESTS} SELECT cluster, feature, round(q, 6) AS q, round(general, 6) AS general, round(sparse, 6) AS sparse, round(low_signal, 6) AS low_signal FROM ts")
def marker_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tests(spark, sf_dir).select("cluster", "feature", *(s := ("q", "general", "sparse", "low_signal"))), *s)


@query(f"""WITH {TESTS}, ud AS (SELECT *, CASE WHEN log2fc > 0 THEN 'up' ELSE 'down' END AS direction FROM ts WHERE log2fc <> 0),
al AS (SELECT 'significance' AS ranking, cluster, direction, feature, q AS score, row_number() OVER (PARTITION BY cluster, direction ORDER BY q, p, abs(log2fc) DESC, feature) AS rank FROM ud
  UNION ALL SELECT 'general', cluster, direction, feature, general, row_number() OVER (PARTITION BY cluster, direction ORDER BY general DESC, q, feature) FROM ud WHERE general > 0
  UNION ALL SELECT 'sparse', cluster, direction, feature, sparse, row_number() OVER (PARTITION BY cluster, direction ORDER BY sparse DESC, feature) FROM ud WHERE sparse > 0
  UNION ALL SELECT 'low_signal', cluster, direction, feature, low_signal, row_number() OVER (PARTITION BY cluster, direction ORDER BY low_signal DESC, feature) FROM ud WHERE low_signal > 0)
SELECT ranking, cluster, direction, rank, feature, round(score, 6) AS score FROM al WHERE rank <= 50""")
def marker_rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(X.marker_rankings(tests(spark, sf_dir), "cluster").withColumn("rank", F.col("rank").cast("long")), "score")


#: Names as reads at a locus; features are stretches of names, each at the locus of a part that has it.
@query(f"""WITH r AS (SELECT p_partkey AS id, p_size % 10 AS locus, {DNA} AS seq FROM part), f AS (SELECT DISTINCT p_size % 10 AS locus, substr({DNA}, 3, 12 + p_size % 4) AS f FROM part),
rw AS (SELECT id, locus, seq, i AS rp, substr(seq, (i + 1)::INT, 8) AS w FROM r, unnest(range(0, length(seq) - 7)) t(i)), fw AS (SELECT locus, f, i AS fp, substr(f, (i + 1)::INT, 8) AS w FROM f, unnest(range(0, length(f) - 7)) t(i)),
v AS (SELECT id, locus, f, rp - fp AS o, count(*) AS n, bool_or(rp % 8 = 0 AND rp >= fp AND substr(seq, (rp - fp + 1)::INT, length(f)) = f) AS whole FROM rw JOIN fw USING (locus, w) GROUP BY ALL),
b AS (SELECT id, locus, max(n) AS hits, list_sort(list(DISTINCT f) FILTER (whole)) AS wh FROM v GROUP BY ALL),
j AS (SELECT v.id, v.locus, any_value(hits) AS hits, any_value(wh) AS wh, list_sort(list(f)) AS best FROM v JOIN b USING (id, locus) WHERE n = hits GROUP BY ALL)
SELECT r.id, r.locus, CASE WHEN len(wh) = 1 THEN 'Hit' WHEN hits >= 4 THEN CASE WHEN len(best) = 1 THEN 'Hit' ELSE 'Tie' END ELSE 'NoHit' END AS status, CASE WHEN len(wh) = 1 THEN wh WHEN hits >= 4 THEN best END AS features, CASE WHEN len(wh) = 1 THEN 1 WHEN hits >= 4 THEN hits END AS hits
FROM r LEFT JOIN j USING (id, locus)""")
def locus_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 10).alias("locus"), F.expr(DNA).alias("seq"), "p_size")
    cut = F.substring(F.col("seq"), F.lit(3), 12 + F.col("p_size") % 4)
    return G.map_tags_at_locus(s.select("id", "locus", "seq"), s.select("locus", cut.alias("fseq"), cut.alias("feature")).distinct())


@query("""WITH l AS (SELECT c_mktsegment AS level, row_number() OVER (ORDER BY min(c_custkey), c_mktsegment) - 1 AS numeric FROM customer GROUP BY c_mktsegment)
SELECT CASE WHEN level IN ('BUILDING', 'MACHINERY') THEN 'HEAVY' ELSE level END AS level, min(numeric)::DOUBLE AS numeric FROM l GROUP BY 1""")
def modified_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = T.factor_levels(read(spark, sf_dir, "customer"), "c_mktsegment", "c_custkey")
    return T.modify_levels(levels, {"BUILDING": "HEAVY", "MACHINERY": "HEAVY"}).select("level", "numeric")


@query("SELECT o_custkey AS id, count(*) > 0 AND (count(*) FILTER (o_orderkey % 3 = 0) > 0 OR count(*) >= 2) AS qualifies FROM orders GROUP BY o_custkey")
def reconstruction_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("v"), F.count_if(F.col("o_orderkey") % 3 == 0).alias("j"))
    return c.select("id", V.qualifies(F.col("v"), F.col("j")).alias("qualifies"))


@query("SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_shippriority_like DESC, o_orderkey) - 1 AS position FROM (SELECT o_orderkey, o_custkey % 4 AS o_shippriority_like FROM orders)")
def global_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 4).alias("v"))
    return R.positions(o, "v", "id", descending=True, parts=32).select("id", "position")
