"""Joins of catalog tables: aliases, variants, annotations, sets, samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltbed.functions.sequences import hamming


def strip_version(name: Column) -> Column:
    """ENSG0001.7 becomes ENSG0001; other names stay."""
    return F.regexp_replace(name, r"\.\d+$", "")


def resolve_aliases(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """(name, id): names resolve without case, as they are before without their version; lower priority first, then id.

    aliases: alias, id, priority. An unknown name gives a null id.
    """
    keys = names.withColumn("_k", F.explode(F.array(F.struct(F.lit(0).alias("pass"), F.lower("name").alias("key")), F.struct(F.lit(1).alias("pass"), strip_version(F.lower("name")).alias("key")))))
    table = aliases.select(F.lower("alias").alias("key"), "id", "priority")
    hits = keys.select("name", "_k.*").join(table, "key", "left")
    best = F.min(F.when(F.col("id").isNotNull(), F.struct("pass", "priority", "id")))
    return hits.groupBy("name").agg(best.alias("b")).select("name", F.col("b.id").alias("id"))


def chromosome_key(name: Column) -> Column:
    """chr1, 1 and Chr1 are one; M and MT too."""
    bare = F.regexp_replace(F.upper(name), "^CHR", "")
    return F.when(bare.isin("M", "MT"), "MT").otherwise(bare)


def with_clinical(variants: DataFrame, clinical: DataFrame, present: bool) -> DataFrame:
    """Variants of which any alternative allele is (or is not) in clinical: chr, pos, ref, alt; variants: id, chr, pos, ref, alts."""
    keyed = variants.select("id", "chr", "pos", "ref", F.explode("alts").alias("alt"))
    hit = keyed.join(clinical, ["chr", "pos", "ref", "alt"], "left_semi").select("id").distinct()
    return variants.join(hit, "id", "left_semi" if present else "left_anti")


def snv_only(ref: Column, alts: Column) -> Column:
    """ACGT singles only; one other alternative rejects the record."""
    return ref.rlike("^[ACGTacgt]$") & (F.size(alts) > 0) & F.forall(alts, lambda a: a.rlike("^[ACGTacgt]$"))


def passing(filters: Column) -> Column:
    return filters.isNull() | filters.isin("PASS", ".", "")


def merge_samples(samples: dict[str, DataFrame]) -> DataFrame:
    """Counts of all samples over the union of features, cells named <sample>_<cell>; an equal name in two samples can't meet."""
    out = None
    for name, df in samples.items():
        part = df.select(F.concat(F.lit(name + "_"), F.col("cell").cast("string")).alias("cell"), "feature", "value")
        out = part if out is None else out.unionByName(part)
    return out


def feature_order(samples: Sequence[DataFrame], feature: str, position: str) -> DataFrame:
    """(feature, ord): first-seen order over the samples, in turn."""
    parts = [df.select(F.lit(k).alias("_s"), F.col(position).alias("_p"), F.col(feature).alias("feature")) for k, df in enumerate(samples)]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    first = both.groupBy("feature").agg(F.min(F.struct("_s", "_p")).alias("at"))
    return first.select("feature", (F.row_number().over(Window.orderBy("at")) - 1).alias("ord"))


def import_annotation(cells: DataFrame, annotation: DataFrame, key: str) -> DataFrame:
    """cells with annotation's columns; the keys must be equal sets without repeats, and no column may be there before."""
    clash = set(cells.columns) & set(annotation.columns) - {key}
    if clash:
        raise ValueError(f"columns exist: {sorted(clash)}")
    a = annotation.withColumn("_n", F.count("*").over(Window.partitionBy(key))).withColumn("_b", F.lit(1))
    joined = cells.withColumn("_a", F.lit(1)).join(a, key, "full")
    bad = F.when(F.col("_a").isNull() | F.col("_b").isNull(), "key on one side only: ").when(F.col("_n") > 1, "repeated key: ")
    checked = F.when(bad.isNotNull(), F.raise_error(F.concat(bad, F.col(key).cast("string"))).cast("int")).otherwise(F.lit(1))
    return joined.where(checked == 1).drop("_a", "_b", "_n")


def unique_name_join(left: DataFrame, right: DataFrame, name: str) -> DataFrame:
    """Pairs of rows whose name occurs once on each side."""
    once = [df.withColumn("_n", F.count("*").over(Window.partitionBy(name))).where("_n = 1").drop("_n") for df in (left, right)]
    return once[0].join(once[1], name)


def only_in(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(side, key): keys of one side alone."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").select(F.lit("left").alias("side"), key).union(b.join(a, key, "left_anti").select(F.lit("right").alias("side"), key))


def seed_neighbours(links: DataFrame, seeds: DataFrame, least: int) -> DataFrame:
    """(seed, partner, score): links at least least that touch a seed at either end; the best score of each pair."""
    strong = links.where(F.col("score") >= least)
    s = F.broadcast(seeds.select(F.col("id").alias("seed")))
    both = strong.join(s, strong.a == s.seed).select("seed", F.col("b").alias("partner"), "score").union(strong.join(s, strong.b == s.seed).select("seed", F.col("a").alias("partner"), "score"))
    return both.groupBy("seed", "partner").agg(F.max("score").alias("score"))


def set_token_match(sets: DataFrame, symbols: DataFrame) -> DataFrame:
    """(name, symbol): sets one of whose _-separated name tokens equals the symbol."""
    tokens = sets.select("name", F.explode(F.array_distinct(F.split(F.upper("name"), "_"))).alias("symbol"))
    return tokens.join(symbols.select(F.upper("symbol").alias("symbol")).distinct(), "symbol", "left_semi").select("name", "symbol")


def reverse_lookup(sets: DataFrame, genes: DataFrame) -> DataFrame:
    """(gene, n, names): the sets that hold each gene, without case."""
    long = sets.select("name", F.explode(F.array_distinct(F.transform("genes", F.upper))).alias("gene"))
    hits = long.join(genes.select(F.upper("gene").alias("gene")).distinct(), "gene")
    return hits.groupBy("gene").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("name")).alias("names"))


def fill_left(cells: DataFrame, extra: DataFrame, key: str, fills: dict[str, object]) -> DataFrame:
    """Left join of extra columns with defaults."""
    return cells.join(extra, key, "left").fillna(fills)


def intersect_counts(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: how many keys are on both sides, on the left alone, on the right alone."""
    x, y = a.select(key).distinct().withColumn("x", F.lit(1)), b.select(key).distinct().withColumn("y", F.lit(1))
    j = x.join(y, key, "full")
    return j.agg(F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("both"), F.count_if(F.col("y").isNull()).alias("left_only"), F.count_if(F.col("x").isNull()).alias("right_only"))


def partner_sets(neighbours: DataFrame, isoforms: DataFrame) -> DataFrame:
    """(tx_id, partners): the sorted partners of each isoform's protein; isoforms: tx_id, protein; none gives an empty set."""
    j = isoforms.join(neighbours.select(F.col("seed").alias("protein"), "partner"), "protein", "left")
    return j.groupBy("tx_id").agg(F.array_sort(F.collect_set("partner")).alias("partners"))


def rewrite_ids(df: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """df with column's old ids replaced by mapping (old, new); others stay."""
    m = mapping.select(F.col("old").alias("_old"), F.col("new").alias("_new"))
    return df.join(m, F.col(column) == F.col("_old"), "left").withColumn(column, F.coalesce("_new", F.col(column))).drop("_old", "_new")


def grouped_members(df: DataFrame, group: str, member: str) -> DataFrame:
    """(group, members sorted, n) of a group table; empty group names don't count."""
    return df.where(F.col(group).isNotNull() & (F.col(group) != "")).groupBy(group).agg(F.array_sort(F.collect_set(member)).alias("members"), F.count_distinct(member).alias("n"))


#: Versions of the reference accessions NC_000001 to NC_000024 (X is 23, Y is 24) of hg38.
HG38_VERSIONS = (11, 12, 12, 12, 10, 12, 14, 11, 12, 11, 10, 12, 11, 9, 10, 10, 11, 10, 10, 11, 9, 11, 11, 10)


def reference_accession(chromosome: Column) -> Column:
    """chr1 to chr22, chrX and chrY as hg38's accessions; other names stay."""
    names = [*map(str, range(1, 23)), "X", "Y"]
    known = F.create_map(*[F.lit(x) for k, (n, v) in enumerate(zip(names, HG38_VERSIONS)) for x in (f"chr{n}", f"NC_{k + 1:06}.{v}")])
    return F.coalesce(known[F.regexp_replace(chromosome, "^chr0+(?=[1-9])", "chr")], chromosome)


def matching(df: DataFrame, conditions: Sequence[str]) -> DataFrame:
    """The rows of df that meet every "column=value" of conditions, compared as text; an unknown column is an error."""
    for condition in conditions:
        column, _, value = condition.partition("=")
        if column not in df.columns:
            raise ValueError(f"no column {column!r}")
        df = df.where(F.col(column).cast("string") == value)
    return df


def proteins_with_feature(proteins: DataFrame, features: DataFrame, kind: str) -> DataFrame:
    """proteins (protein_id, ...) that have a feature (protein_id, kind) of the kind."""
    return proteins.join(features.where(F.col("kind") == kind).select("protein_id"), "protein_id", "left_semi")


def least_mismatches(barcodes: DataFrame, barcode: str = "barcode") -> DataFrame:
    """One row (least, radius) of distinct barcodes of one length: the least mismatches of any two, and how many can be corrected,
    (least - 1) // 2. Both null under two barcodes. A pair at e mismatches shares one of e + 1 pieces, so e goes up until a pair is found."""
    b = barcodes.select(F.col(barcode).alias("x")).distinct()
    first = b.agg(F.count("*").alias("n"), F.max(F.length("x")).alias("size")).first()
    found = None
    if first["n"] >= 2:
        for e in range(1, first["size"] + 1):
            cuts = [k * first["size"] // (e + 1) for k in range(e + 2)]
            pieces = F.array(*[F.struct(F.lit(k).alias("k"), F.substring("x", cuts[k] + 1, cuts[k + 1] - cuts[k]).alias("piece")) for k in range(e + 1)])
            keyed = b.select("x", F.explode(pieces).alias("p"))
            pairs = keyed.join(keyed.withColumnRenamed("x", "y"), "p").where("x < y").select("x", "y").distinct()
            found = pairs.agg(F.min(hamming(F.col("x"), F.col("y"))).alias("d")).first()["d"]
            if found is not None and found <= e:
                break
    radius = None if found is None else max(found - 1, 0) // 2
    return barcodes.sparkSession.createDataFrame([(found, radius)], "least int, radius int")
