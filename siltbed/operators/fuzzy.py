"""Fuzzy joins: corrected barcodes, seed and verify, edit distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltbed.functions.sequences import hamming, kmers


def barcode_join(reads: DataFrame, whitelist: DataFrame, max_mismatches: int, parts: int) -> DataFrame:
    """(id, seq, barcode, distance): an exact hit, else the one nearest barcode of at most max_mismatches; ties give none.

    reads: id, seq; whitelist: barcode; all of one length. With more parts than max_mismatches, one part at least is equal
    (pigeonhole), so candidates come from an equi-join on (part number, part). Exact hits never enter the fuzzy stage.
    """
    if parts <= max_mismatches:
        raise ValueError("parts must be over max_mismatches")
    exact = reads.join(whitelist, F.col("seq") == F.col("barcode")).select("id", "seq", "barcode", F.lit(0).alias("distance"))
    rest = reads.join(whitelist, F.col("seq") == F.col("barcode"), "left_anti")

    def cut(c: str) -> Column:
        size = F.ceil(F.length(c) / parts).cast("int")
        return F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda k: F.substring(F.col(c), k * size + 1, size)))

    seeds = rest.select("seq").distinct().select("seq", cut("seq").alias("k", "part"))
    known = whitelist.select("barcode").distinct().select("barcode", cut("barcode").alias("k", "part"))
    near = seeds.join(known, ["k", "part"]).where(F.length("seq") == F.length("barcode")).select("seq", "barcode").distinct()
    near = near.withColumn("distance", hamming(F.col("seq"), F.col("barcode"))).where(F.col("distance") <= max_mismatches)
    least = near.groupBy("seq").agg(F.min(F.struct("distance", "barcode")).alias("b"), F.min("distance").alias("d"), F.collect_list("distance").alias("all"))
    unique = least.where(F.size(F.filter("all", lambda x: x == F.col("d"))) == 1).select("seq", "b.barcode", "b.distance")
    return exact.unionByName(rest.join(unique, "seq").select("id", "seq", "barcode", "distance"))


def seed_join(reads: DataFrame, features: DataFrame, k: int, min_hits: int, top: int = 10) -> DataFrame:
    """(id, feature, offset, hits, mismatches): ungapped placements of features in reads with min_hits shared k-mers.

    reads: id, seq; features: feature, fseq. The top placements of each read by hits are verified over the full overlap;
    ties go by feature and offset. Frequent k-mers of the features are the only ones that multiply rows.
    """
    r = reads.select("id", F.explode(kmers(F.col("seq"), k)).alias("x")).select("id", F.col("x.pos").alias("rp"), F.col("x.kmer").alias("kmer"))
    f = features.select("feature", F.explode(kmers(F.col("fseq"), k)).alias("x")).select("feature", F.col("x.pos").alias("fp"), F.col("x.kmer").alias("kmer"))
    hits = r.join(f, "kmer").groupBy("id", "feature", (F.col("rp") - F.col("fp")).alias("offset")).agg(F.count("*").alias("hits")).where(F.col("hits") >= min_hits)
    w = Window.partitionBy("id").orderBy(F.desc("hits"), "feature", "offset")
    best = hits.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top).drop("_r")
    both = best.join(reads, "id").join(features, "feature")
    start = F.greatest(F.col("offset"), F.lit(0))
    inside = F.substring(F.col("seq"), start + 1, F.length("fseq")), F.substring(F.col("fseq"), F.greatest(F.lit(1), 1 - F.col("offset")), F.length("seq"))
    return both.select("id", "feature", "offset", "hits", hamming(*inside).alias("mismatches"))


def call_best(placed: DataFrame) -> DataFrame:
    """(id, feature, status): the placement of fewest mismatches, then most hits; several features so are a Tie."""
    order = F.struct("mismatches", F.negative("hits").alias("h"))
    best = placed.withColumn("_b", F.min(order).over(Window.partitionBy("id"))).where(order == F.col("_b"))
    one = best.groupBy("id").agg(F.min("feature").alias("feature"), F.count_distinct("feature").alias("n"))
    return one.select("id", F.when(F.col("n") == 1, F.col("feature")).alias("feature"), F.when(F.col("n") == 1, "Mapped").otherwise("Tie").alias("status"))


def edit_join(left: DataFrame, right: DataFrame, a: str, b: str, most: int) -> DataFrame:
    """Pairs of strings within most edits, without case. Candidates share a length class and one of most + 1 pieces.

    A string within most edits of x holds one of x's most + 1 pieces unchanged, moved by at most most positions.
    """
    def pieces(c: str) -> Column:
        n = F.length(c)
        at = lambda k: F.floor(n * k / (most + 1)).cast("int")
        return F.explode(F.transform(F.sequence(F.lit(0), F.lit(most)), lambda k: F.struct(at(k).alias("pos"), F.substring(F.lower(c), at(k) + 1, at(k + 1) - at(k)).alias("piece"), n.alias("n"))))

    x = left.select(a).distinct().select(a, pieces(a).alias("p")).select(a, "p.*")
    lengths = x.select("n", "pos", F.length("piece").alias("size")).distinct()
    y = right.select(b).distinct().withColumn("m", F.length(b))
    spread = F.explode(F.sequence(F.lit(-most), F.lit(most)))
    probes = y.join(F.broadcast(lengths), F.abs(F.col("m") - F.col("n")) <= most).withColumn("d", spread).where((F.col("pos") + F.col("d") >= 0) & (F.col("pos") + F.col("d") + F.col("size") <= F.col("m")))
    probes = probes.select(b, "n", "pos", F.substring(F.lower(b), F.col("pos") + F.col("d") + 1, F.col("size")).alias("piece")).distinct()
    near = x.join(probes, ["n", "pos", "piece"]).select(a, b).distinct()
    return near.withColumn("distance", F.levenshtein(F.lower(a), F.lower(b))).where(F.col("distance") <= most)
