"""Queries of sequence, receptor, transcript and grammar expressions, on names and keys that stand in for reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltbed.functions import sequences as Q
from siltbed.operators import grammar as G
from siltbed.operators import intervals as I
from siltbed.operators import loci as L
from siltbed.operators import reads as A
from siltbed.operators import receptors as V
from siltbed.operators import transcripts as T
from siltbed.plans.catalog import query
from siltbed.plans.interval_queries import GENES, READS, genes, reads
from siltbed.plans.molecule_queries import read
from siltbed.plans.summary_queries import SPARSE, cells, rounded, sparse
from siltbed.plans.table_queries import DNA, dna

SEQ = f"s AS (SELECT p_partkey AS id, {DNA} AS seq FROM part)"


@query(f"WITH {SEQ} SELECT a.id, hamming(substr(a.seq, 1, 10), substr(b.seq, 1, 10))::INT AS distance FROM s a JOIN s b ON b.id = a.id + 1")
def hamming_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = dna(spark, sf_dir)
    b = s.select((F.col("id") - 1).alias("id"), F.col("seq").alias("b"))
    return s.join(b, "id").select("id", Q.hamming(F.substring("seq", 1, 10), F.substring("b", 1, 10)).alias("distance"))


@query(f"""WITH {SEQ}, m AS (SELECT * FROM (VALUES ('A', 1), ('C', 2), ('G', 4), ('T', 8), ('R', 5), ('N', 15)) t(l, v)), x AS (SELECT id, i, seq[i] AS a, substr('RNA', (i - 1) % 3 + 1, 1) AS b FROM s, unnest([1, 2, 3, 4, 5, 6]) t(i))
SELECT id, sum((p.v & q.v = 0)::INT)::INT AS mismatches FROM x JOIN m p ON p.l = a JOIN m q ON q.l = b GROUP BY id""")
def iupac_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dna(spark, sf_dir).select("id", Q.iupac_mismatches(F.substring("seq", 1, 6), F.lit("RNARNA")).alias("mismatches"))


@query(f"WITH {SEQ} SELECT id, i::INT AS pos, substr(seq, (i + 1)::INT, 5) AS kmer FROM s, unnest(range(0, length(seq) - 4)) t(i)")
def kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = dna(spark, sf_dir)
    return s.select("id", F.explode(Q.kmers(F.col("seq"), 5)).alias("k")).select("id", "k.pos", "k.kmer")


@query("SELECT p_partkey AS id, bit_count(xor(p_partkey, p_size::BIGINT))::DOUBLE / nullif(bit_count(p_partkey | p_size::BIGINT), 0) AS distance FROM part")
def bitset_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), Q.set_distance(F.col("p_partkey"), F.col("p_size").cast("long")).alias("distance"))


@query(f"WITH b AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'x_' || substr({DNA}, 1, 8) || '-' || (p_size % 10) ELSE p_name || '#' || p_brand END AS label FROM part) SELECT id, CASE WHEN regexp_extract(label, '([ACGT]+)-[0-9]', 1) <> '' THEN regexp_extract(label, '([ACGT]+)-[0-9]', 1) ELSE substr(label, 1, 16) END AS barcode FROM b")
def barcode_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    label = F.when(k % 2 == 0, F.concat(F.lit("x_"), F.substring(F.expr(DNA), 1, 8), F.lit("-"), (F.col("p_size") % 10).cast("string"))).otherwise(F.concat("p_name", F.lit("#"), "p_brand"))
    return read(spark, sf_dir, "part").select(k.alias("id"), Q.normalised_barcode(label).alias("barcode"))


@query("SELECT o_orderkey AS id, 'chr' || (o_custkey % 5) || ':' || (o_orderkey % 900) || ':' || substr('ACGT', (o_orderkey % 4 + 1)::INT, 1) || '>' || substr('ACGT', (o_custkey % 4 + 1)::INT, 1) AS name FROM orders")
def snp_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = lambda c: F.substring(F.lit("ACGT"), (F.col(c) % 4 + 1).cast("int"), F.lit(1))
    o = read(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), Q.snp_name(F.concat(F.lit("chr"), (F.col("o_custkey") % 5).cast("string")), F.col("o_orderkey") % 900, base("o_orderkey"), base("o_custkey")).alias("name"))


#: Brands as receptor and other gene names.
SYMBOL = "CASE p_partkey % 9 WHEN 0 THEN 'IGHV' || p_size WHEN 1 THEN 'IGHD' WHEN 2 THEN 'IGHD' || p_size WHEN 3 THEN 'trbj' || p_size WHEN 4 THEN 'IGHG' || (p_size % 4) WHEN 5 THEN 'MT-CO' || p_size WHEN 6 THEN 'RPL' || p_size WHEN 7 THEN 'TRAC' ELSE p_brand END"


@query(f"""WITH g AS (SELECT p_partkey AS id, {SYMBOL} AS name FROM part), u AS (SELECT id, upper(name) AS u FROM g)
SELECT id, CASE WHEN regexp_matches(u, '^(IGH|IGK|IGL|TRA|TRB|TRG|TRD)') THEN u[:3] END AS chain,
CASE WHEN u = 'IGHD' THEN 'C' WHEN regexp_matches(u, '^(IGH|IGK|IGL|TRA|TRB|TRG|TRD)V') THEN 'V' WHEN regexp_matches(u, '^(IGH|TRB|TRD)D') THEN 'D' WHEN regexp_matches(u, '^(IGH|IGK|IGL|TRA|TRB|TRG|TRD)J') THEN 'J' WHEN regexp_matches(u, '^(TRAC|TRBC|TRGC|TRDC|IGKC|IGLC|IGHM|IGHG|IGHA|IGHE)([0-9][A-Z0-9-]*)?$') THEN 'C' END AS kind,
CASE WHEN starts_with(u, 'MT-') THEN 'mito' WHEN starts_with(u, 'RPS') OR starts_with(u, 'RPL') THEN 'ribo' WHEN regexp_matches(u, '^(IGH|IGK|IGL|TRA|TRB|TRG|TRD)[VJ]') OR regexp_matches(u, '^(IGH|TRB|TRD)D') THEN 'vdj' ELSE 'other' END AS class FROM u""")
def gene_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.expr(SYMBOL)
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), V.gene_chain(name).alias("chain"), V.gene_kind(name).alias("kind"), V.gene_class(name).alias("class"))


@query(f"""WITH c AS (SELECT l_suppkey AS cell, {SYMBOL} AS name, count(*) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
r AS (SELECT cell, sum(CASE WHEN upper(name) = 'IGHD' OR regexp_matches(upper(name), '^(IGHV|IGHD|TRBJ|IGHG[0-9]|TRAC$)') THEN value ELSE 0 END)::BIGINT AS receptor, sum(value)::BIGINT AS total FROM c GROUP BY cell)
SELECT * FROM r ORDER BY receptor DESC, total DESC, cell LIMIT 10""")
def receptor_rich_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part").select("p_partkey", F.expr(SYMBOL).alias("feature"))
    c = read(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_suppkey").alias("cell"), "feature").agg(F.count("*").alias("value"))
    return V.rich_cells(c, 10)


@query("SELECT p_name AS seq, count(*) AS n, min(p_partkey) AS representative FROM part GROUP BY p_name")
def unique_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.unique_sequences(read(spark, sf_dir, "part").withColumnRenamed("p_name", "seq"), "seq", "p_partkey")


@query(f"""WITH l AS (SELECT p_brand AS grp, (i - 1)::INT AS pos, upper(substr({DNA}, i::INT, 1)) AS base FROM part, unnest(range(1, 13)) t(i)), n AS (SELECT grp, pos, base, count(*) AS n FROM l WHERE base <> '' GROUP BY ALL)
SELECT grp, pos, base, n FROM (SELECT *, row_number() OVER (PARTITION BY grp, pos ORDER BY n DESC, base DESC) AS r FROM n) WHERE r = 1""")
def column_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "part").select(F.col("p_brand").alias("grp"), F.substring(F.expr(DNA), 1, 12).alias("seq"))
    return V.consensus(s, "grp", "seq")


@query("SELECT c_custkey, c_acctbal > avg(c_acctbal) OVER () + 2 * stddev_pop(c_acctbal) OVER () AS outlier FROM customer")
def reference_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.reference_outliers(read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "c_acctbal").select("c_custkey", "outlier")


@query("""WITH h AS (SELECT l_orderkey AS id, l_returnflag AS chr, l_partkey % 3 AS gene, l_suppkey % 2 AS bin FROM lineitem), n AS (SELECT id, count(DISTINCT chr) AS c, count(DISTINCT gene) AS g, count(DISTINCT bin) AS b FROM h GROUP BY id)
SELECT id, CASE WHEN c > 1 THEN 'multi_chromosome' WHEN g = 1 AND b > 1 THEN 'same_gene' WHEN g > 1 AND b = 1 THEN 'same_bin' ELSE 'other' END AS class FROM n""")
def ambiguity_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.resolve_ambiguity(read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("chr"), (F.col("l_partkey") % 3).alias("gene"), (F.col("l_suppkey") % 2).alias("bin")))


@query("""WITH f AS (SELECT l_orderkey * 10 + l_linenumber AS id, (l_partkey * 37 % 4096)::INT AS flag, (l_suppkey % 61)::INT AS mapq FROM lineitem)
SELECT id, (flag & 2308) = 0 AND mapq >= 30 AS passes, (flag & 2308) = 0 AND mapq >= 30 AND (flag & 64) <> 0 AS read1, (flag & 3) = 3 AND (flag & 1024) = 0 AS masked FROM f""")
def alignment_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag, mapq = (F.col("l_partkey") * 37 % 4096).cast("int"), (F.col("l_suppkey") % 61).cast("int")
    return read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), A.passes(flag, mapq, 30).alias("passes"), A.passes(flag, mapq, 30, True).alias("read1"), A.flag_filter(flag, 3, 1024).alias("masked"))


#: Transcripts of three exons whose lengths and gaps follow the part's size.
TX = """tx AS (SELECT p_partkey AS tx_id, p_partkey % 100 AS gene, CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand, p_partkey % 100 * 1000 AS s0, p_size + 10 AS n FROM part),
ex AS (SELECT tx_id, gene, strand, k, s0 + k * 3 * n AS start, s0 + k * 3 * n + n AS "end", n FROM tx, unnest([0, 1, 2]) t(k))"""


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    n, s0 = (F.col("p_size") + 10).cast("long"), k % 100 * 1000
    exons = F.array(*[F.struct((s0 + 3 * i * n).alias("start"), (s0 + 3 * i * n + n).alias("end")) for i in range(3)])
    return read(spark, sf_dir, "part").select(k.alias("tx_id"), (k % 100).alias("gene"), F.lit("c").alias("chr"), F.when(k % 2 == 0, "+").otherwise("-").alias("strand"), exons.alias("exons"), n.alias("n"))


@query(f"""WITH {TX}, p AS (SELECT tx_id, strand, s0, n, s0 + 50 AS pos FROM tx), h AS (SELECT p.*, k, start FROM p LEFT JOIN ex ON ex.tx_id = p.tx_id AND ex.start <= pos AND pos < ex."end")
SELECT tx_id, CASE WHEN strand = '+' THEN k * n + pos - start ELSE (2 - k) * n + (start + n - 1 - pos) END AS tx_pos FROM h""")
def genome_to_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = transcripts(spark, sf_dir)
    return t.select("tx_id", T.to_transcript(F.col("exons")[0]["start"] + 50, F.col("exons"), F.col("strand")).alias("tx_pos"))


@query(f"""WITH {TX} SELECT tx_id, CASE WHEN strand = '+' THEN s0 + (n + 3) // n * 3 * n + (n + 3) % n ELSE s0 + (2 - (n + 3) // n) * 3 * n + n - 1 - (n + 3) % n END AS pos FROM tx""")
def transcript_to_genome(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = transcripts(spark, sf_dir)
    return t.select("tx_id", T.to_genome(F.col("n") + 3, F.col("exons"), F.col("strand")).alias("pos"))


@query(f"""WITH {TX}, b AS (SELECT tx_id, strand, s0, n, 2 + 3 * 3 AS a, least(2 + 3 * 12, 3 * n - 2) AS z FROM tx), c AS (SELECT tx_id, greatest(a, CASE WHEN strand = '+' THEN k ELSE 2 - k END * n) - CASE WHEN strand = '+' THEN k ELSE 2 - k END * n AS x, least(z, (CASE WHEN strand = '+' THEN k ELSE 2 - k END + 1) * n) - CASE WHEN strand = '+' THEN k ELSE 2 - k END * n AS y, k, strand, s0, n FROM b, unnest([0, 1, 2]) t(k))
SELECT tx_id, count(*) AS n_blocks, sum(y - x)::BIGINT AS bases, min(CASE WHEN strand = '+' THEN s0 + k * 3 * n + x ELSE s0 + k * 3 * n + n - y END) AS start FROM c WHERE x < y GROUP BY tx_id""")
def protein_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = transcripts(spark, sf_dir)
    e = F.col("exons")
    blocks = T.protein_blocks(F.lit(3), F.lit(12), e, F.col("strand"), e[0]["start"] + 2, e[2]["end"] - 2)
    one = t.select("tx_id", F.explode(blocks).alias("b"))
    return one.groupBy("tx_id").agg(F.count("*").alias("n_blocks"), F.sum(F.col("b.end") - F.col("b.start")).alias("bases"), F.min("b.start").alias("start"))


@query(f"""WITH {TX}, r AS (SELECT tx_id AS read, s0 + p AS a, s0 + p + 12 AS z, CASE WHEN tx_id % 3 = 0 THEN '-' ELSE '+' END AS rs FROM tx, unnest([0, 13]) t(p)),
m AS (SELECT r.read, r.a, t.tx_id, t.strand, r.rs, t.n, t.s0, a - t.s0 AS x, z - t.s0 AS y FROM r JOIN tx t ON r.read % 100 = t.gene)
SELECT read, a, tx_id, CASE WHEN rs <> strand THEN 'StrandMismatch' WHEN (x // n) % 3 = 0 AND y <= (x // n) * n + n THEN 'Compatible' WHEN EXISTS (SELECT 1 FROM unnest([0, 1]) t(k) WHERE x < (3 * k + 3) * n AND y > (3 * k + 1) * n) THEN 'Intronic' ELSE 'Incompatible' END AS class FROM m WHERE y > 0 AND x < 7 * n""")
def transcript_match_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = transcripts(spark, sf_dir)
    p = F.explode(F.array(F.lit(0), F.lit(13))).alias("p")
    r = t.select(F.col("tx_id").alias("read"), "gene", F.col("exons")[0]["start"].alias("s0"), F.when(F.col("tx_id") % 3 == 0, "-").otherwise("+").alias("rs"), p)
    r = r.select("read", "gene", "rs", (F.col("s0") + F.col("p")).alias("a")).withColumn("blocks", F.array(F.struct(F.col("a").alias("start"), (F.col("a") + 12).alias("end"))))
    return T.classes_of_pairs(r, t.select("gene", "tx_id", "strand", "exons"), "gene", "rs").select("read", "a", "tx_id", "class")


@query(f"""WITH {TX}, q AS (SELECT tx_id, k, strand, start, "end", s0 + 95 AS pos FROM ex JOIN tx USING (tx_id, strand, gene, n)), span AS (SELECT tx_id FROM tx WHERE s0 + 95 < s0 + 7 * n)
SELECT tx_id, max(CASE WHEN start <= pos AND pos < "end" THEN CASE WHEN strand = '-' THEN 3 - k ELSE k + 1 END END) AS exon, max(CASE WHEN start <= pos AND pos < "end" THEN start + 1 END) AS exon_start FROM q JOIN span USING (tx_id) GROUP BY tx_id""")
def transcripts_at_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = transcripts(spark, sf_dir).withColumn("chr", F.col("tx_id").cast("string"))
    points = t.select("chr", (F.col("exons")[0]["start"] + 95).alias("pos"))
    found = T.at_position(t.select("chr", "tx_id", "strand", "exons"), points)
    return found.select("tx_id", "exon", "exon_start")


@query("""WITH m AS (SELECT l_suppkey AS cell, l_returnflag AS gene, l_orderkey AS umi, list_sort(list(DISTINCT (l_linenumber % 4 * 2)::INT)) AS bits FROM lineitem GROUP BY ALL),
t AS (SELECT * FROM (VALUES ('A', 1, [0, 2]), ('A', 2, [0, 2, 4, 6]), ('N', 3, [0, 4]), ('R', 4, [2, 4, 6])) x(gene, tx, b)),
d AS (SELECT m.*, tx, len(list_filter(bits, lambda x: NOT list_contains(b, x))) + len(list_filter(b, lambda x: x BETWEEN list_min(bits) AND list_max(bits) AND NOT list_contains(bits, x))) AS d FROM m JOIN t USING (gene)),
r AS (SELECT *, row_number() OVER (PARTITION BY cell, gene, umi ORDER BY d, tx) AS k FROM d)
SELECT cell, gene, umi, CASE WHEN d = 0 THEN 'Reference' ELSE 'Novel' END AS kind, CASE WHEN d = 0 THEN tx END AS tx_id FROM r WHERE k = 1""")
def umi_isoforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = read(spark, sf_dir, "lineitem")
    umis = line.groupBy(F.col("l_suppkey").alias("cell"), F.col("l_returnflag").alias("gene"), F.col("l_orderkey").alias("umi")).agg(F.array_sort(F.collect_set((F.col("l_linenumber") % 4 * 2).cast("int"))).alias("bits"))
    tx = spark.createDataFrame([("A", 1, [0, 2]), ("A", 2, [0, 2, 4, 6]), ("N", 3, [0, 4]), ("R", 4, [2, 4, 6])], "gene string, tx_id int, bits array<int>")
    return T.resolve_umis(umis, tx)


@query(f"""WITH {SPARSE}, n AS (SELECT cluster, count(*) AS n FROM cells GROUP BY cluster), f AS (SELECT DISTINCT feature FROM counts), k AS (SELECT feature, cluster, count(*) AS k FROM counts JOIN cells USING (cell) GROUP BY ALL)
SELECT f.feature, n.cluster, round(coalesce(k, 0) / n, 9) AS fraction FROM f CROSS JOIN n LEFT JOIN k ON k.feature = f.feature AND k.cluster = n.cluster""")
def on_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(L.on_fractions(sparse(spark, sf_dir), cells(spark, sf_dir), "cluster"), "fraction", digits=9)


LIGHTS = f"""{GENES}, m AS (SELECT chr, gene AS id, floor((start + "end") / 2)::BIGINT AS mid FROM genes), fr AS (SELECT l_partkey AS id, l_suppkey % 6 AS grp, avg(l_quantity) / 50 AS x FROM lineitem GROUP BY ALL),
p AS (SELECT a.chr, a.id, b.id AS neighbour, abs(a.mid - b.mid) AS distance, row_number() OVER (PARTITION BY a.chr, a.id ORDER BY abs(a.mid - b.mid), b.id) AS rank FROM m a JOIN m b ON a.chr = b.chr AND a.id <> b.id),
l AS (SELECT p.chr, p.id, p.neighbour, distance, rank, round(avg(((f.x >= 0.5) = (g.x >= 0.5))::INT), 6) AS agreement, CASE WHEN count(*) >= 2 THEN round(corr(f.x, g.x), 5) END AS pearson FROM p JOIN fr f ON f.id = p.id JOIN fr g ON g.id = p.neighbour AND g.grp = f.grp WHERE rank <= 2 GROUP BY ALL)"""


@query(f"WITH {LIGHTS} SELECT * FROM l")
def neighbour_lights(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = genes(spark, sf_dir).select("chr", F.col("gene").alias("id"), F.floor((F.col("start") + F.col("end")) / 2).alias("mid"))
    fr = read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("feature"), (F.col("l_suppkey") % 6).alias("grp")).agg((F.avg("l_quantity") / 50).alias("fraction"))
    out = L.lights(g, fr, "grp", 2, 0.5).withColumn("rank", F.col("rank").cast("long"))
    return out.withColumns({"agreement": F.round("agreement", 6), "pearson": F.round("pearson", 5)})


@query("""WITH c AS (SELECT l_quantity > 25 AS called, l_discount > 0.05 AS seen FROM lineitem)
SELECT count(*) FILTER (called AND seen) AS a, count(*) FILTER (called AND NOT seen) AS b, count(*) FILTER (NOT called AND seen) AS c, count(*) FILTER (NOT called AND NOT seen) AS d, round((count(*) FILTER (called AND seen) + 0.5) * (count(*) FILTER (NOT called AND NOT seen) + 0.5) / ((count(*) FILTER (called AND NOT seen) + 0.5) * (count(*) FILTER (NOT called AND seen) + 0.5)), 6) AS odds_ratio FROM c""")
def holdout_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(L.holdout_recovery(read(spark, sf_dir, "lineitem").select((F.col("l_quantity") > 25).alias("called"), (F.col("l_discount") > 0.05).alias("seen"))), "odds_ratio")


@query(f"""WITH {SPARSE}, n AS (SELECT cluster, count(*) AS n_cells FROM cells GROUP BY cluster), s AS (SELECT cluster, sum(value * value) AS s2 FROM counts JOIN cells USING (cell) GROUP BY cluster), m AS (SELECT cluster, sum((s / n_cells) ** 2) AS m2 FROM (SELECT cluster, feature, sum(value) AS s FROM counts JOIN cells USING (cell) GROUP BY ALL) JOIN n USING (cluster) GROUP BY cluster)
SELECT cluster, n_cells, round(greatest(0, coalesce(s2, 0) / n_cells - coalesce(m2, 0)), 5) AS variance_per_cell FROM n LEFT JOIN s USING (cluster) LEFT JOIN m USING (cluster)""")
def cluster_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltbed.operators.summaries import group_means

    v, c = sparse(spark, sf_dir), cells(spark, sf_dir)
    return rounded(L.cluster_quality(v, c, group_means(v, c, "cluster"), "cluster"), "variance_per_cell", digits=5)


@query("SELECT upper(regexp_replace(p_name, '\\s+', '', 'g')) AS sequence, count(*) AS n, list_sort(list(DISTINCT p_type)) AS sources FROM (SELECT replace(p_name, 'u', 'T') AS p_name, p_type FROM part) GROUP BY 1")
def curated_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "part").select(F.col("p_name").alias("sequence"), F.col("p_type").alias("source"), F.lit("x").alias("producer"))
    return L.observe(None, o).drop("producers")


@query("SELECT event_type AS name, floor(value / 10)::BIGINT AS bin, count(*)::DOUBLE * 2 AS value FROM events GROUP BY ALL")
def merged_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("name"), F.floor(F.col("value") / 10).alias("bin")).agg(F.count("*").cast("double").alias("value"))
    return L.merge_metrics(m, m)


@query(f"""WITH b AS (SELECT p_partkey AS id, substr({DNA}, 1, 8) AS umi, CASE WHEN p_partkey % 10 = 0 THEN 'NACGT' ELSE {DNA} END AS r2 FROM part), k AS (SELECT id, umi || substr(r2, 1, 24) AS key FROM b), u AS (SELECT id, key, unnest(range(1, length(key) + 1)) AS i FROM k WHERE NOT contains(key, 'N') AND length(key) <= 31)
SELECT k.id, sum((strpos('ACGT', u.key[i]) - 1)::BIGINT << (2 * (i - 1))::BIGINT)::BIGINT AS molecule FROM k JOIN u USING (id) GROUP BY k.id""")
def molecule_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.substring(F.expr(DNA), 1, 8).alias("umi"), F.when(F.col("p_partkey") % 10 == 0, "NACGT").otherwise(F.expr(DNA)).alias("r2"))
    cell, molecule = G.molecule_key(F.col("umi"), F.col("umi"), F.lit(""), F.col("r2"))
    return s.where(F.length(F.concat("umi", F.substring("r2", 1, 24))) <= 31).select("id", molecule.alias("molecule")).where("molecule is not null")


@query("SELECT p_partkey AS id, 'r' || p_partkey AS read_id, p_brand AS cell, p_type AS umi, CASE WHEN p_size % 2 = 0 THEN 'GEX' ELSE 'VDJ' END AS type FROM part")
def read_name_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("r"), F.col("p_partkey").cast("string")).alias("r"), F.col("p_brand").alias("c"), F.col("p_type").alias("u"), F.when(F.col("p_size") % 2 == 0, "GEX").otherwise("VDJ").alias("t"))
    made = p.select("id", G.read_name(F.col("r"), F.col("c"), F.lit("I"), F.col("u"), F.lit("J"), F.col("t")).alias("n"))
    x = made.select("id", G.parse_read_name(F.col("n")).alias("x"))
    return x.select("id", "x.read_id", "x.cell", "x.umi", "x.type")


@query(f"WITH {READS}, cov AS (SELECT chr, bin, count(*) AS value FROM (SELECT chr, id, unnest(range(start // 50, (\"end\" - 1) // 50 + 1)) AS bin FROM reads) GROUP BY ALL) SELECT chr, bin, round(value * 1e9 / 50 / (SELECT count(*) FROM reads), 5) AS value FROM cov")
def coverage_rpkm(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reads(spark, sf_dir)
    return rounded(I.normalised(I.coverage(r, 50), "RPKM", 50, r), "value", digits=5)


@query()
def same_label_loci(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = genes(spark, sf_dir)
    f = g.select(F.concat(F.col("gene").cast("string"), "chr").alias("id"), "chr", F.lit("+").alias("strand"), (F.col("gene") % 7).cast("string").alias("label"), F.array(F.struct("start", "end")).alias("blocks"))
    return L.collapse_same_label(f).select("id", "label")


@query()
def read_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = G.Grammar.parse("demo", "TYPE:GEX+SEARCH:0..6+FIXED:CGTA:mm=1+CELL:4+UMI:3")
    return G.detect_reads(dna(spark, sf_dir), [g], everywhere=True)
