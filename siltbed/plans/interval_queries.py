"""Queries on intervals: lineitem gives read blocks, part gives genes, orders give points and loops (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltbed.operators import intervals as I
from siltbed.operators import reads as A
from siltbed.plans.catalog import query
from siltbed.plans.molecule_queries import read
from siltbed.plans.summary_queries import rounded

READS = "reads AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_returnflag AS chr, l_partkey * 10 AS start, l_partkey * 10 + l_quantity::BIGINT AS \"end\" FROM lineitem)"
GENES = "genes AS (SELECT p_partkey AS gene, c.chr, p_partkey * 10 AS start, p_partkey * 10 + p_size * 4 AS \"end\" FROM part, (VALUES ('A'), ('N'), ('R')) c(chr) WHERE p_partkey % 3 = ascii(c.chr) % 3)"


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("l_partkey") * 10
    return read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_returnflag").alias("chr"), start.alias("start"), (start + F.col("l_quantity").cast("long")).alias("end"))


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    chrom = F.explode(F.array(*[F.lit(c) for c in "ANR"]))
    start = F.col("p_partkey") * 10
    out = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("gene"), chrom.alias("chr"), start.alias("start"), (start + F.col("p_size") * 4).alias("end"))
    return out.where(F.col("gene") % 3 == F.ascii("chr") % 3)


@query(f"WITH {READS}, {GENES} SELECT id, gene FROM reads r JOIN genes g ON r.chr = g.chr AND r.start < g.\"end\" AND g.start < r.\"end\"")
def interval_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.overlap_join(reads(spark, sf_dir), genes(spark, sf_dir), 256).select("id", F.col("gene_r").alias("gene"))


@query(f"WITH {GENES}, p AS (SELECT o_orderkey AS id, chr(CASE o_orderkey % 3 WHEN 0 THEN 65 WHEN 1 THEN 78 ELSE 82 END) AS chr, o_orderkey % 20000 AS pos FROM orders) SELECT id, gene FROM p JOIN genes g ON p.chr = g.chr AND pos >= g.start AND pos < g.\"end\"")
def point_in_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    p = read(spark, sf_dir, "orders").select(k.alias("id"), F.when(k % 3 == 0, "A").when(k % 3 == 1, "N").otherwise("R").alias("chr"), (k % 20000).alias("pos"))
    return I.points_in(p, genes(spark, sf_dir), 512).select("id", "gene")


@query(f"WITH {READS}, l AS (SELECT *, max(\"end\") OVER (PARTITION BY chr ORDER BY start, \"end\" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM reads), i AS (SELECT *, sum(CASE WHEN start <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY chr ORDER BY start, \"end\" ROWS UNBOUNDED PRECEDING) AS k FROM l) SELECT chr, min(start) AS start, max(\"end\") AS \"end\", count(*) AS n FROM i GROUP BY chr, k")
def interval_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.islands(reads(spark, sf_dir))


COVER = f"{READS}, cov AS (SELECT chr, bin, count(*) AS value FROM (SELECT chr, id, unnest(range(start // 50, (\"end\" - 1) // 50 + 1)) AS bin FROM reads) GROUP BY ALL)"


@query(f"""WITH {READS}, r AS (SELECT row_number() OVER () AS r, chr, start, "end", "end" + id % 200 AS start2, "end" + id % 200 + 30 AS end2 FROM reads), b AS (SELECT r, chr, unnest(range(start // 50, ("end" - 1) // 50 + 1)) AS bin FROM r UNION SELECT r, chr, unnest(range(start2 // 50, (end2 - 1) // 50 + 1)) FROM r)
SELECT chr, bin, count(*) AS value FROM b GROUP BY chr, bin""")
def block_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    gap = F.col("end") + F.col("id") % 200
    blocks = F.array(F.struct("start", "end"), F.struct(gap.alias("start"), (gap + 30).alias("end")))
    return I.block_coverage(reads(spark, sf_dir).select("chr", blocks.alias("blocks")), 50)


@query(f"WITH {COVER} SELECT * FROM cov")
def binned_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.coverage(reads(spark, sf_dir), 50)


@query(f"WITH {COVER} SELECT chr, bin, round(value * 1e6 / (SELECT count(*) FROM reads), 6) AS value FROM cov")
def coverage_cpm(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reads(spark, sf_dir)
    return rounded(I.normalised(I.coverage(r, 50), "CPM", 50, r), "value")


@query(f"""WITH {READS}, ch AS (SELECT chr, max("end") AS length FROM reads GROUP BY chr), cov AS (SELECT chr, bin, count(*) AS value FROM (SELECT chr, id, unnest(range(start // 50, ("end" - 1) // 50 + 1)) AS bin FROM reads) GROUP BY ALL),
b AS (SELECT chr, unnest(range(0, (length - 1) // 50 + 1)) AS bin FROM ch) SELECT chr, bin, coalesce(value, 0) AS value FROM b LEFT JOIN cov USING (chr, bin)""")
def coverage_with_zero_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reads(spark, sf_dir)
    chromosomes = r.groupBy("chr").agg(F.max("end").alias("length"))
    return I.full_track(I.coverage(r, 50), chromosomes, 50)


@query(f"""WITH {READS}, t AS (SELECT id % 2 AS half, chr, bin, count(*)::DOUBLE AS v FROM (SELECT chr, id, unnest(range(start // 50, ("end" - 1) // 50 + 1)) AS bin FROM reads) GROUP BY ALL),
b AS (SELECT coalesce(x.chr, y.chr) AS chr, coalesce(x.bin, y.bin) AS bin, coalesce(x.v, 0) AS a, coalesce(y.v, 0) AS b FROM (SELECT * FROM t WHERE half = 0) x FULL JOIN (SELECT * FROM t WHERE half = 1) y ON x.chr = y.chr AND x.bin = y.bin), d AS (SELECT *, abs(a - b) AS d FROM b)
SELECT count(*) AS n, count(*) FILTER (d > 2) AS n_over_eps, round(avg(d), 6) AS mean_abs, round(avg(d * d) - avg(d) ** 2, 6) AS var_abs, round(sqrt(avg(d * d)), 6) AS rmse, (SELECT chr FROM d ORDER BY d DESC, chr DESC, bin LIMIT 1) AS worst_chr, (SELECT bin FROM d ORDER BY d DESC, chr DESC, bin LIMIT 1) AS worst_bin, max(d) AS worst_diff, round(corr(a, b), 6) AS pearson FROM d""")
def track_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reads(spark, sf_dir)
    found = I.compare_tracks(*(I.coverage(r.where(F.col("id") % 2 == h), 50) for h in (0, 1)), eps=2.0)
    return rounded(found, "mean_abs", "var_abs", "rmse", "pearson")


@query(f"WITH {GENES}, m AS (SELECT chr, gene AS id, start, \"end\", floor((start + \"end\") / 2)::BIGINT AS mid FROM genes), d AS (SELECT chr, id, mid AS domain_start, lead(mid) OVER w AS domain_end, lead(id) OVER w AS next_id FROM m WINDOW w AS (PARTITION BY chr ORDER BY start, \"end\", id)) SELECT * FROM d WHERE domain_end IS NOT NULL")
def adjacent_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.adjacent_domains(genes(spark, sf_dir).withColumnRenamed("gene", "id"))


@query("WITH k AS (SELECT DISTINCT o_orderpriority AS e, least(o_custkey // 25, o_orderkey % 1500 // 25) AS a, greatest(o_custkey // 25, o_orderkey % 1500 // 25) AS b FROM orders) SELECT a, b, count(*) AS experiments FROM k GROUP BY a, b")
def loop_recurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("experiment"), F.col("o_custkey").alias("left"), (F.col("o_orderkey") % 1500).alias("right"))
    return I.loop_recurrence(o, 25)


@query(f"""WITH {GENES}, m AS (SELECT chr, gene AS id, floor((start + "end") / 2)::BIGINT AS mid FROM genes), p AS (SELECT a.chr, a.id, b.id AS neighbour, abs(a.mid - b.mid) AS distance FROM m a JOIN m b ON a.chr = b.chr AND a.id <> b.id)
SELECT chr, id, neighbour, distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY chr, id ORDER BY distance, neighbour) AS rank FROM p) WHERE rank <= 3""")
def neighbour_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = genes(spark, sf_dir).select("chr", F.col("gene").alias("id"), F.floor((F.col("start") + F.col("end")) / 2).alias("mid"))
    return I.neighbours(g, 3).withColumn("rank", F.col("rank").cast("long"))


CIGARS = "cig AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey * 10 AS pos, l_quantity::INT || 'M' || (l_partkey % 90 + 1) || (CASE l_linenumber % 3 WHEN 0 THEN 'N' WHEN 1 THEN 'D' ELSE 'I' END) || (l_suppkey % 40 + 5) || 'M' || (l_suppkey % 5 + 1) || 'S' AS cigar FROM lineitem)"


def cigars(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = F.when(F.col("l_linenumber") % 3 == 0, "N").when(F.col("l_linenumber") % 3 == 1, "D").otherwise("I")
    parts = [F.col("l_quantity").cast("int"), F.lit("M"), F.col("l_partkey") % 90 + 1, op, F.col("l_suppkey") % 40 + 5, F.lit("M"), F.col("l_suppkey") % 5 + 1, F.lit("S")]
    return read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_partkey") * 10).alias("pos"), F.concat(*[p.cast("string") for p in parts]).alias("cigar"))


@query(f"""WITH {CIGARS}, p AS (SELECT id, pos, regexp_extract(cigar, '^(\\d+)M', 1)::BIGINT AS m1, regexp_extract(cigar, '^\\d+M(\\d+)', 1)::BIGINT AS x, regexp_extract(cigar, '^\\d+M\\d+([NDI])', 1) AS op, regexp_extract(cigar, '(\\d+)M\\d+S$', 1)::BIGINT AS m2 FROM cig)
SELECT id, CASE WHEN op = 'I' THEN 1 ELSE 2 END::BIGINT AS n_blocks, CASE WHEN op = 'I' THEN m1 + m2 ELSE m1 END AS first_length, pos + m1 + m2 + CASE WHEN op = 'I' THEN 0 ELSE x END AS ref_end, CASE WHEN op = 'N' THEN x END AS intron FROM p""")
def cigar_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = A.with_blocks(cigars(spark, sf_dir), "pos", "cigar")
    first = F.col("blocks")[0]
    intron = F.try_element_at(F.col("introns"), F.lit(1))
    return b.select("id", F.size("blocks").cast("long").alias("n_blocks"), (first["end"] - first["start"]).alias("first_length"), F.element_at("blocks", -1)["end"].alias("ref_end"), (intron["end"] - intron["start"]).alias("intron"))


@query(f"""WITH {CIGARS}, p AS (SELECT id, pos, regexp_extract(cigar, '^(\\d+)M', 1)::BIGINT AS m1, regexp_extract(cigar, '^\\d+M(\\d+)', 1)::BIGINT AS x, regexp_extract(cigar, '^\\d+M\\d+([NDI])', 1) AS op, regexp_extract(cigar, '(\\d+)M\\d+S$', 1)::BIGINT AS m2, pos + 30 AS q FROM cig)
SELECT id, CASE WHEN q < pos + m1 THEN 30 WHEN op = 'I' AND q < pos + m1 + m2 THEN 30 + x WHEN op <> 'I' AND q >= pos + m1 + x AND q < pos + m1 + x + m2 THEN 30 - x END AS read_pos FROM p""")
def base_at_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cigars(spark, sf_dir)
    return c.select("id", A.read_position(F.col("pos"), F.col("cigar"), F.col("pos") + 30).alias("read_pos"))


@query("""WITH e AS (SELECT p_partkey % 200 AS gene, p_partkey AS tx, p_partkey % 200 * 1000 + p_size * 7 AS start, p_partkey % 200 * 1000 + p_size * 7 + p_size + 20 AS "end" FROM part),
b AS (SELECT DISTINCT gene, start AS x FROM e UNION SELECT DISTINCT gene, "end" FROM e), u AS (SELECT gene, x AS start, lead(x) OVER (PARTITION BY gene ORDER BY x) AS "end", row_number() OVER (PARTITION BY gene ORDER BY x) - 1 AS unit FROM b)
SELECT gene, unit, start, "end", EXISTS (SELECT 1 FROM e WHERE e.gene = u.gene AND e.start <= u.start AND u."end" <= e."end") AS exonic FROM u WHERE "end" IS NOT NULL""")
def exon_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    start = k % 200 * 1000 + size * 7
    e = read(spark, sf_dir, "part").select((k % 200).alias("gene"), k.alias("tx"), start.alias("start"), (start + size + 20).alias("end"))
    return A.exon_units(e)


@query(f"""WITH {READS}, {GENES}, o AS (SELECT id, gene, CASE WHEN g.start <= r.start AND r."end" <= g."end" THEN 3 WHEN r.start < g.start AND r."end" > g."end" THEN 1 ELSE 2 END AS rank, greatest(0, g.start - r.start) + greatest(0, r."end" - g."end") AS overhang
FROM reads r JOIN genes g ON r.chr = g.chr AND r.start < g."end" AND g.start < r."end")
SELECT id, gene, rank, overhang FROM (SELECT *, max(rank) OVER (PARTITION BY id) AS best FROM o) WHERE rank = best""")
def best_match_ties_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.best_matches(reads(spark, sf_dir), genes(spark, sf_dir), 256)
