"""Queries of the lookup language and of streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltbed.plans.catalog import query
from siltbed.plans.molecule_queries import EVENTS, event_molecules, read
from siltbed.query.lookup import Catalog, execute
from siltbed.streaming import molecules as W

GENES = """g AS (SELECT p_partkey AS gene_id, [p_name || ' ' || p_partkey, 'G' || p_partkey || '.' || (p_size % 3)] AS names, 'chr' || (p_partkey % 3 + 1) AS chr, p_partkey * 10 AS start, p_partkey * 10 + p_size * 4 AS "end", CASE WHEN p_size % 2 = 0 THEN '+' ELSE '-' END AS strand FROM part)"""
SHOW = """chr AS chromosome, start + 1 AS start, "end", gene_id, array_to_string(names, ',') AS names, strand"""


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    k, size = F.col("p_partkey"), F.col("p_size")
    text = lambda c: c.cast("string")
    names = F.array(F.concat("p_name", F.lit(" "), text(k)), F.concat(F.lit("G"), text(k), F.lit("."), text(size % 3)))
    genes = read(spark, sf_dir, "part").select(k.alias("gene_id"), names.alias("names"), F.concat(F.lit("chr"), text(k % 3 + 1)).alias("chr"), (k * 10).alias("start"), (k * 10 + size * 4).alias("end"), F.when(size % 2 == 0, "+").otherwise("-").alias("strand"))
    o = F.col("o_orderkey")
    base = lambda c: F.substring(F.lit("ACGT"), (c % 4 + 1).cast("int"), F.lit(1))
    variants = read(spark, sf_dir, "orders").select(F.concat(F.lit("chr"), text(o % 3 + 1)).alias("chr"), (o % 4000 + 1).alias("pos"), text(o).alias("id"), base(o).alias("ref"), F.array(base(o + 1)).alias("alts"))
    clinical = variants.where(F.col("id").cast("long") % 7 == 0).select("chr", "pos", "ref", F.col("alts")[0].alias("alt"))
    return {"genes": genes, "variants": variants, "clinical": clinical}


@query(f"WITH {GENES} SELECT {SHOW.replace('chr AS chromosome', chr(39) + '2' + chr(39) + ' AS chromosome')} FROM g WHERE chr = 'chr2' AND start < 6000 AND \"end\" > 4999")
def query_lang_gene(spark: SparkSession, sf_dir: str) -> DataFrame:
    return execute('select genes where chr = "2" and position = 5000:6000', lambda: catalog(spark, sf_dir))


@query(f"WITH {GENES} SELECT {SHOW} FROM g WHERE gene_id IN (12, 40, 77)")
def query_lang_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return execute('SELECT gene WHERE id IN "g12", "G40.9" AND name = "G77" AND position = 1:2', lambda: catalog(spark, sf_dir))


VARIANTS = "v AS (SELECT 'chr' || (o_orderkey % 3 + 1) AS chr, o_orderkey % 4000 + 1 AS pos, o_orderkey::VARCHAR AS id, substr('ACGT', (o_orderkey % 4 + 1)::INT, 1) AS ref, substr('ACGT', ((o_orderkey + 1) % 4 + 1)::INT, 1) AS alts FROM orders), c AS (SELECT DISTINCT chr, pos, ref, alts FROM v WHERE id::BIGINT % 7 = 0)"


@query(f"WITH {VARIANTS} SELECT v.* FROM v JOIN c USING (chr, pos, ref, alts) WHERE chr = 'chr1' AND pos BETWEEN 100 AND 2000")
def query_lang_variant_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return execute('SELECT variants WHERE chromosome = "chr1" AND pos = 100:2000 AND clinical_effect IS NOT NULL', catalog(spark, sf_dir))


@query(f"WITH {VARIANTS} SELECT v.* FROM v ANTI JOIN c USING (chr, pos, ref, alts) WHERE chr = 'chr1' AND pos BETWEEN 100 AND 2000")
def query_lang_variant_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return execute('SELECT variants WHERE chrom = "1" AND pos = 100:2000 AND clinical_effect IS NULL', catalog(spark, sf_dir))


@query(f"WITH {EVENTS} SELECT cell, feature, count(DISTINCT umi) AS value FROM ev GROUP BY ALL")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a file stream: keyed dedup, then counts, until all input is read."""
    return W.run_counts(spark, f"{sf_dir}/events.parquet")


@query("SELECT time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    out = W.windowed(e, "ts", "6 hours", None, ["event_type"], "value")
    return out.select("start", "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH l AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 4 HOURS THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM l)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.sessions(read(spark, sf_dir, "events"), "ts", "4 hours", ["user_id"]).select("user_id", "start", "n")


@query(f"WITH {EVENTS}, f AS (SELECT cell, feature, umi, arg_min(event_id, event_id) AS event_id FROM ev GROUP BY ALL) SELECT * FROM f")
def first_wins_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.first_wins(event_molecules(spark, sf_dir), ["cell", "feature", "umi"], "event_id").select("cell", "feature", "umi", "event_id")
