"""Feature tags on reads: placement with qualities, combinatorial barcodes, subsets by tag lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltbed.functions.sequences import reverse_complement
from siltbed.operators.fuzzy import barcode_join, seed_join

#: The quality that counts where none is given, and the highest that does.
DEFAULT_QUALITY, TOP_QUALITY = 30, 60


def weighted_score(a: Column, b: Column, quality: Column) -> Column:
    """Sum over positions of 2 + q / 20 for a match less 2 + q / 5 for a mismatch (whole numbers); quality is an array."""
    bases = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    scored = F.zip_with(bases, quality, lambda p, q: F.when(p["x"].isNull() | p["y"].isNull() | (p["x"] == ""), 0).when(p["x"] == p["y"], 2 + F.floor(F.coalesce(q, F.lit(DEFAULT_QUALITY)) / 20)).otherwise(-(2 + F.floor(F.coalesce(q, F.lit(DEFAULT_QUALITY)) / 5))))
    return F.aggregate(scored, F.lit(0).cast("long"), lambda s, x: s + x)


def qualities(text: Column) -> Column:
    """Phred numbers of a quality string, capped."""
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.least(F.lit(TOP_QUALITY), F.ascii(c) - 33))


def map_tags(reads: DataFrame, features: DataFrame, k: int = 16, min_hits: int = 1, both_strands: bool = True) -> DataFrame:
    """(id, feature, status): the feature of each read that shares seeds. Exact overlaps win, the first feature by ord of several;
    else the best score, and a Tie if two features have it.

    reads: id, seq, qual; features: feature, fseq, ord. At most ten placements of a read and strand are scored.
    """
    strands = [("+", F.col("seq"), qualities(F.col("qual")))]
    if both_strands:
        strands.append(("-", reverse_complement(F.col("seq")), F.reverse(qualities(F.col("qual")))))
    every = None
    for name, seq, q in strands:
        r = reads.select("id", seq.alias("seq"), q.alias("_q"))
        placed = seed_join(r.select("id", "seq"), features.select("feature", "fseq"), k, min_hits)
        j = placed.join(r, "id").join(features, "feature")
        start, skip = F.greatest(F.col("offset"), F.lit(0)), F.greatest(F.lit(0), -F.col("offset"))
        a, b = F.substring(F.col("seq"), start + 1, F.length("fseq")), F.substring(F.col("fseq"), skip + 1, F.length("seq"))
        n = F.least(F.length(a), F.length(b))
        score = weighted_score(F.substring(a, F.lit(1), n), F.substring(b, F.lit(1), n), F.slice("_q", start + 1, n))
        one = j.select("id", "feature", "ord", F.lit(name).alias("strand"), "mismatches", score.alias("score"))
        every = one if every is None else every.unionByName(one)
    exact = F.col("mismatches") == 0
    best = every.withColumn("_e", F.max(exact.cast("int")).over(Window.partitionBy("id"))).where((F.col("_e") == 0) | exact)
    best = best.withColumn("_s", F.max("score").over(Window.partitionBy("id"))).where((F.col("_e") == 1) | (F.col("score") == F.col("_s")))
    out = best.groupBy("id").agg(F.min_by("feature", "ord").alias("f"), F.count_distinct("feature").alias("n"), F.max("_e").alias("e"))
    sure = (F.col("e") == 1) | (F.col("n") == 1)
    return out.select("id", F.when(sure, F.col("f")).alias("feature"), F.when(sure, "Mapped").otherwise("Tie").alias("status"))


def map_tags_at_locus(reads: DataFrame, features: DataFrame, k: int = 8, min_hits: int = 4) -> DataFrame:
    """(id, locus, status, features, hits) of each read, judged among the features of its own locus only.

    reads: id, locus, seq; features: feature, locus, fseq, a row for each locus that a feature belongs to. Words of k bases
    without N vote for (feature, offset). A read that holds just one whole feature, found by a word at a multiple of k, is a
    Hit with 1 hit. Otherwise the placement of most votes wins: a Hit if it stands alone, a Tie of all placements with as
    many; without a vote, or with under min_hits, NoHit. Every read gives one row; features are sorted by name.
    """

    def words(text: Column) -> Column:
        every = F.transform(F.sequence(F.lit(0), F.length(text) - k), lambda p: F.struct(p.alias("pos"), F.substring(text, p + 1, F.lit(k)).alias("word")))
        return F.when(F.length(text) >= k, F.filter(every, lambda w: w["word"].rlike("^[ACGT]+$")))

    r = reads.select("id", "locus", F.upper("seq").alias("seq"))
    # equal reads of a locus are judged once; words are far more than the reads that the planner knows of, so nothing of theirs is
    # broadcast on its estimate
    own = r.select("locus", "seq").distinct().select("locus", "seq", F.explode(words(F.col("seq"))).alias("q"))
    own = own.select("locus", "seq", F.col("q.pos").alias("rp"), F.col("q.word").alias("word"))
    tags = features.select("locus", "feature", F.upper("fseq").alias("fseq")).distinct()
    tags = tags.select("locus", "feature", "fseq", F.explode(words(F.col("fseq"))).alias("q")).select("locus", "feature", "fseq", F.col("q.pos").alias("fp"), F.col("q.word").alias("word"))
    hits = own.hint("merge").join(tags, ["locus", "word"]).withColumn("offset", F.col("rp") - F.col("fp"))
    votes = hits.groupBy("locus", "seq", "feature", "fseq", "offset").agg(F.count("*").alias("n"), F.max(F.col("rp") % k == 0).alias("at"))
    whole = F.col("at") & (F.col("offset") >= 0) & F.col("fseq").rlike("^[ACGT]+$") & (F.substring("seq", F.col("offset") + 1, F.length("fseq")) == F.col("fseq"))
    # rows of one name and offset, where a name has several sequences, vote together
    votes = votes.groupBy("locus", "seq", "feature", "offset").agg(F.sum("n").alias("n"), F.max(whole).alias("whole"))
    votes = votes.withColumn("hits", F.max("n").over(Window.partitionBy("locus", "seq")))
    top = votes.where("whole or n = hits").groupBy("locus", "seq").agg(F.max("hits").alias("hits"), F.collect_set(F.when(F.col("whole"), F.col("feature"))).alias("sure"), F.array_sort(F.collect_list(F.when(F.col("n") == F.col("hits"), F.col("feature")))).alias("best"))
    sure, enough = F.size("sure") == 1, F.col("hits") >= min_hits
    status = F.when(sure | (enough & (F.size("best") == 1)), "Hit").when(enough, "Tie").otherwise("NoHit")
    judged = top.select("locus", "seq", status.alias("status"), F.when(sure, F.col("sure")).when(enough, F.col("best")).alias("features"), F.when(sure, 1).when(enough, F.col("hits")).cast("long").alias("hits"))
    return r.join(judged, ["locus", "seq"], "left").select("id", "locus", F.coalesce("status", F.lit("NoHit")).alias("status"), "features", "hits")


def combinatorial_barcodes(reads: DataFrame, blocks: Sequence[tuple[int, DataFrame]], max_mismatches: int = 1) -> DataFrame:
    """(id, cell, distance) of reads whose every block has one nearest barcode: blocks are (start, whitelist with barcode and
    idx from 0); cell counts up over blocks, the first block highest."""
    out, cell, distance = reads.select("id"), F.lit(0).cast("long"), F.lit(0)
    for n, (start, whitelist) in enumerate(blocks):
        size = F.length("barcode")
        width = whitelist.agg(F.max(size).alias("w"), F.count("*").alias("n")).first()
        part = reads.select("id", F.substring("seq", start + 1, width["w"]).alias("seq"))
        hit = barcode_join(part, whitelist.select("barcode"), max_mismatches, max_mismatches + 1).join(whitelist, "barcode")
        out = out.join(hit.select("id", F.col("idx").alias(f"_i{n}"), F.col("distance").alias(f"_d{n}")), "id")
        cell, distance = cell * width["n"] + F.col(f"_i{n}"), distance + F.col(f"_d{n}")
    return out.select("id", cell.alias("cell"), distance.alias("distance"))


def subset_by_tags(alignments: DataFrame, lists: DataFrame, tag: str) -> DataFrame:
    """alignments with subset: the list that has their tag's value; lists: value, subset, ord; a value in several lists goes
    to the last. Write it with sinks.text.split_by(out, "subset", folder)."""
    last = lists.groupBy("value").agg(F.max_by("subset", "ord").alias("subset"))
    return alignments.join(last, F.col("tags")[tag] == F.col("value")).drop("value")


def of_types(reads: DataFrame, wanted: str) -> DataFrame:
    """Reads of grammar types by their letters, as GV; all takes every read."""
    return reads if wanted.lower() == "all" else reads.where(F.substring("type", 1, 1).isin(*wanted.upper()))


def split_features(observations: DataFrame, features: DataFrame) -> DataFrame:
    """(feature_type, cell, feature, value): molecules of each feature type; cells without any stay out."""
    # molecules are told apart and counted as they are, before names of types make every row longer
    seen = observations.select("cell", "feature", "umi").distinct().groupBy("cell", "feature").agg(F.count("*").alias("value"))
    typed = seen.join(features.select("feature", "feature_type").distinct(), "feature")
    return typed.select("feature_type", "cell", "feature", "value")
