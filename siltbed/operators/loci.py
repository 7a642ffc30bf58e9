"""Collapsing loci and hits, neighbourhood agreement, gene models, clusters' quality and mixtures, curated candidates."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltbed.operators.intervals import neighbours, with_islands
from siltbed.operators.matrix import pearson
from siltbed.scratch import stored

#: Upper borders of distance bins in bases, with their names.
DISTANCES = ((10_000, "<10kb"), (25_000, "10-25kb"), (50_000, "25-50kb"), (100_000, "50-100kb"), (250_000, "100-250kb"), (1_000_000, "250kb-1Mb"), (None, ">=1Mb"))
#: Names that mean a control, alone or with _, - or a digit right after them, in any ASCII case.
CONTROLS = ("wt", "wildtype", "wild-type", "control", "ctrl", "untreated", "vehicle", "mock")


def _kept_of_label(g: pd.DataFrame, shared: float, length: float) -> list[int]:
    """The rows of one (chr, strand, label) that stay. A feature is held against kept ones that have a block in one of its bins."""
    spans = [[(b["start"], b["end"]) for b in bs] for bs in g["blocks"]]
    ids = g["id"].tolist()
    size = [sum(e - s for s, e in x) for x in spans]
    order = sorted(range(len(g)), key=lambda i: (size[i], spans[i][0][0] if spans[i] else 1 << 62, ids[i]))
    width = max(1, int(np.median([e - s for x in spans for s, e in x] or [1])))
    kept: list[int] = []
    near: dict[int, list[int]] = {}
    for i in order:
        def same(k: int, i: int = i) -> bool:
            short, long = sorted((size[i], size[k]))
            if not (short > 0 and short >= length * long):
                return False
            return sum(max(0, min(e, f) - max(s, t)) for s, e in spans[i] for t, f in spans[k]) >= shared * short

        bins = {b for s, e in spans[i] if s < e for b in range(s // width, (e - 1) // width + 1)}
        if not any(same(k) for k in {k for b in bins for k in near.get(b, ())}):
            kept.append(i)
            for b in bins:
                near.setdefault(b, []).append(i)
    return kept


def collapse_same_label(features: DataFrame, shared: float = 0.8, length: float = 0.5) -> DataFrame:
    """The features that stay: of one (chr, strand, label), from the shortest on, one goes if a kept one covers shared of the
    shorter and the shorter has at least length of the longer. features: id, chr, strand, label, blocks.

    Features without a common base don't bear on each other, so islands of overlapping ones are judged apart, many in a task; a
    feature that is alone in its island stays.
    """
    by = ["chr", "strand", "label"]
    slim = features.select("id", *by, "blocks", F.array_min(F.transform("blocks", lambda b: b["start"])).alias("start"), F.array_max(F.transform("blocks", lambda b: b["end"])).alias("end"))
    placed = with_islands(slim, by).drop("start", "end").withColumn("_n", F.count("*").over(Window.partitionBy(*by, "island")))
    placed = stored(placed.withColumn("island", F.to_json("island")), "islands")
    buckets = max(int(features.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-placed.count() // 20_000))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        out = [p["id"].iloc[i] for _, p in g.groupby([*by, "island"], dropna=False, sort=False) for i in _kept_of_label(p, shared, length)]
        return pd.DataFrame({"id": out})

    kind = dict(features.dtypes)["id"]
    several = placed.where("_n > 1").withColumn("_b", F.pmod(F.xxhash64(*by, "island"), F.lit(buckets)))
    ids = several.groupBy("_b").applyInPandas(run, f"id {kind}").unionByName(placed.where("_n = 1").select("id"))
    return features.join(ids, "id", "left_semi")


def collapse_related(features: DataFrame, reciprocal: float = 0.8) -> DataFrame:
    """features (gene, id, family, tag, start, end) with locus, the smallest id of its component within the gene: linked are
    overlapping features of one tag, and related ones (same family) at reciprocal overlap or more."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["start", "end", "id"], ignore_index=True)
        parent = list(range(len(g)))

        def root(k: int) -> int:
            while parent[k] != k:
                parent[k] = parent[parent[k]]
                k = parent[k]
            return k

        s, e = g["start"].tolist(), g["end"].tolist()
        live: list[int] = []
        for i in range(len(g)):
            live = [k for k in live if e[k] > s[i]]
            for k in live:
                both = min(e[i], e[k]) - s[i]
                long = max(e[i] - s[i], e[k] - s[k])
                if both > 0 and (g["tag"][i] == g["tag"][k] or (g["family"][i] == g["family"][k] and both >= reciprocal * long)):
                    parent[root(i)] = root(k)
            live.append(i)
        least: dict[int, object] = {}
        for i in range(len(g)):
            r = root(i)
            least[r] = min(least.get(r, g["id"][i]), g["id"][i])
        return g.assign(locus=[least[root(i)] for i in range(len(g))])

    fields = ", ".join(f"`{c}` {k}" for c, k in features.dtypes)
    return features.groupBy("gene").applyInPandas(run, f"{fields}, locus {dict(features.dtypes)['id']}")


def collapse_hits(hits: DataFrame, by: Sequence[str] = ("read", "reference", "strand")) -> DataFrame:
    """Hits (read_start, read_end, start, end) that overlap or touch the running hit on the read and on the reference at once
    join it, in order of read_start, then start."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        out: list[list[int]] = []
        for a, b, s, e in g.sort_values(["read_start", "start"])[["read_start", "read_end", "start", "end"]].itertuples(index=False):
            if out and a <= out[-1][1] and s <= out[-1][3]:
                out[-1][1], out[-1][3] = max(out[-1][1], b), max(out[-1][3], e)
            else:
                out.append([a, b, s, e])
        made = pd.DataFrame(out, columns=["read_start", "read_end", "start", "end"])
        for c in reversed(by):
            made.insert(0, c, g[c].iloc[0])
        return made

    kinds = dict(hits.dtypes)
    fields = ", ".join(f"{c} {kinds[c]}" for c in by)
    return hits.groupBy(*by).applyInPandas(run, f"{fields}, read_start long, read_end long, start long, end long")


def on_fractions(counts: DataFrame, cells: DataFrame, group: str) -> DataFrame:
    """(feature, group, fraction): the share of the group's cells with a count, for every feature and group."""
    size = cells.groupBy(group).agg(F.count("*").alias("n"))
    seen = counts.where("value > 0").join(cells, "cell").groupBy("feature", group).agg(F.count("*").alias("k"))
    every = counts.select("feature").distinct().crossJoin(F.broadcast(size))
    return every.join(seen, ["feature", group], "left").select("feature", group, (F.coalesce("k", F.lit(0)) / F.col("n")).alias("fraction"))


def lights(genes: DataFrame, fractions: DataFrame, group: str, k: int, on: float) -> DataFrame:
    """(chr, id, neighbour, distance, rank, agreement, pearson) of each gene and its k nearest: the share of groups in which
    both are on or both off, and the correlation of their fractions (null where one doesn't vary, or with one group)."""
    near = neighbours(genes, k)
    a = fractions.select(F.col("feature").alias("id"), group, F.col("fraction").alias("x"))
    b = fractions.select(F.col("feature").alias("neighbour"), group, F.col("fraction").alias("y"))
    both = near.join(a, "id").join(b, ["neighbour", group])
    same = F.avg(((F.col("x") >= on) == (F.col("y") >= on)).cast("double"))
    s = [F.sum(e) for e in (F.col("x"), F.col("y"), F.col("x") * F.col("x"), F.col("y") * F.col("y"), F.col("x") * F.col("y"))]
    out = both.groupBy("chr", "id", "neighbour", "distance", "rank").agg(same.alias("agreement"), F.count("*").alias("_n"), *[e.alias(f"_{i}") for i, e in enumerate(s)])
    r = pearson(F.col("_n"), *[F.col(f"_{i}") for i in range(5)], degenerate=None)
    return out.select("chr", "id", "neighbour", "distance", "rank", "agreement", F.when(F.col("_n") >= 2, r).alias("pearson"))


def distance_bin(distance: Column) -> Column:
    out = F.lit(DISTANCES[-1][1])
    for limit, name in reversed(DISTANCES[:-1]):
        out = F.when(distance < limit, name).otherwise(out)
    return out


def by_distance(found: DataFrame) -> DataFrame:
    """(bin, n, agreement, pearson): means over the neighbour pairs of each distance bin."""
    return found.groupBy(distance_bin(F.col("distance")).alias("bin")).agg(F.count("*").alias("n"), F.avg("agreement").alias("agreement"), F.avg("pearson").alias("pearson"))


def holdout_recovery(calls: DataFrame) -> DataFrame:
    """One row: called (from the rest of the cells) against seen (in the held-out ones): the 2 x 2 table and its odds ratio
    with 0.5 added; calls: called, seen (booleans). The exact test is statistics.fisher_greater of the four counts."""
    c, s = F.col("called"), F.col("seen")
    t = calls.agg(F.count_if(c & s).alias("a"), F.count_if(c & ~s).alias("b"), F.count_if(~c & s).alias("c"), F.count_if(~c & ~s).alias("d"))
    odds = (F.col("a") + 0.5) * (F.col("d") + 0.5) / ((F.col("b") + 0.5) * (F.col("c") + 0.5))
    return t.withColumn("odds_ratio", odds)


def is_control(name: Column) -> Column:
    return name.rlike(rf"^(?i:{'|'.join(CONTROLS)})(?:[_0-9-]|\z)")


def gene_model(means: DataFrame, group: str) -> DataFrame:
    """(group, feature, centroid) with each feature's mean over groups taken off; a group without a feature has mean 0 of it."""
    every = means.select("feature").distinct().crossJoin(F.broadcast(means.select(group).distinct()))
    full = every.join(means.select(group, "feature", "mean"), [group, "feature"], "left").withColumn("mean", F.coalesce("mean", F.lit(0.0)))
    return full.withColumn("centroid", F.col("mean") - F.avg("mean").over(Window.partitionBy("feature"))).select(group, "feature", "centroid")


def apply_gene_model(model: DataFrame, values: DataFrame, group: str, least: int = 10, share: float = 0.5) -> DataFrame:
    """(cell, group, score, rank): correlation of a cell's values with each centroid over the model's genes, best first.

    The model counts only if at least least of its genes, and that share of them, are in values at all."""
    genes = model.select("feature").distinct()
    found = genes.join(values.select("feature").distinct(), "feature", "left_semi")
    size = found.agg(F.count("*").alias("k")).crossJoin(genes.agg(F.count("*").alias("g"))).where((F.col("k") >= least) & (F.col("k") >= share * F.col("g")))
    used = model.join(found, "feature", "left_semi").crossJoin(F.broadcast(size))
    totals = used.groupBy(group).agg(F.max("k").alias("n"), F.sum("centroid").alias("sy"), F.sum(F.col("centroid") ** 2).alias("syy"))
    v = values.join(found, "feature", "left_semi")
    own = v.groupBy("cell").agg(F.sum("value").alias("sx"), F.sum(F.col("value") ** 2).alias("sxx"))
    cross = v.join(used, "feature").groupBy("cell", group).agg(F.sum(F.col("value") * F.col("centroid")).alias("sxy"))
    j = cross.join(own, "cell").join(F.broadcast(totals), group)
    score = pearson(F.col("n"), F.col("sx"), F.col("sy"), F.col("sxx"), F.col("syy"), F.col("sxy"))
    scored = j.select("cell", group, score.alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("cell").orderBy(F.desc("score"), group)))


def cluster_quality(values: DataFrame, cells: DataFrame, means: DataFrame, group: str) -> DataFrame:
    """(group, n_cells, variance_per_cell): the mean squared distance of a group's cells from its mean, zeros included."""
    n = cells.groupBy(group).agg(F.count("*").alias("n_cells"))
    s2 = values.join(cells, "cell").groupBy(group).agg(F.sum(F.col("value") ** 2).alias("s2"))
    m2 = means.groupBy(group).agg(F.sum(F.col("mean") ** 2).alias("m2"))
    j = n.join(s2, group, "left").join(m2, group, "left")
    return j.select(group, "n_cells", F.greatest(F.lit(0.0), F.coalesce("s2", F.lit(0.0)) / F.col("n_cells") - F.coalesce("m2", F.lit(0.0))).alias("variance_per_cell"))


def simplex_fit(x: np.ndarray, parts: np.ndarray, rounds: int = 2000) -> tuple[np.ndarray, float]:
    """Weights, at least 0 and of sum 1, that bring parts' mix nearest to x, and the squared error: projected gradient."""
    k = len(parts)
    gram, dot = parts @ parts.T, parts @ x
    w, step = np.full(k, 1 / k), 1 / max(np.linalg.eigvalsh(gram)[-1], 1e-12)
    for _ in range(rounds):
        y = w - step * (gram @ w - dot)
        u = np.sort(y)[::-1]
        c = (np.cumsum(u) - 1) / np.arange(1, k + 1)
        new = np.maximum(y - c[np.flatnonzero(u > c)[-1]], 0)
        if np.abs(new - w).max() < 1e-12:
            break
        w = new
    return w, float(((x - w @ parts) ** 2).sum())


def multiplets(means: np.ndarray, sizes: Sequence[int], min_parent: float = 0.02, least_weight: float = 0.15, least_gain: float = 0.35, most: int = 5) -> list[dict]:
    """For each cluster the parents that it looks mixed from, or none: small clusters against large ones; the best pair, then
    further parents while every weight keeps least_weight and the error falls; a gain under least_gain counts as none."""
    total, out = sum(sizes), []
    floor = max(1, int(np.ceil(total * min_parent)))
    parents = [k for k, n in enumerate(sizes) if n >= floor]
    for t, n in enumerate(sizes):
        base = min((float(((means[t] - means[p]) ** 2).sum()) for p in parents), default=0.0)
        if not 0 < n < floor or len(parents) < 2 or base <= 1e-12:
            out.append({"cluster": t, "parts": [], "gain": 0.0})
            continue
        best, error = [], base
        for i, a in enumerate(parents):
            for b in parents[i + 1 :]:
                w, e = simplex_fit(means[t], means[[a, b]])
                if w.min() >= least_weight and e < error:
                    best, error = list(zip((a, b), w.tolist())), e
        while 2 <= len(best) < most:
            ids = [p for p, _ in best]
            tried = [([*ids, p], *simplex_fit(means[t], means[[*ids, p]])) for p in parents if p not in ids]
            tried = [(e, c, w) for c, w, e in tried if w.min() >= least_weight and e + 1e-10 < error]
            if not tried:
                break
            error, c, w = min(tried, key=lambda r: r[:2])
            best = list(zip(c, w.tolist()))
        gain = max(0.0, 1 - error / base)
        out.append({"cluster": t, "parts": best if gain >= least_gain else [], "gain": gain if gain >= least_gain else 0.0})
    return out


# --- curated candidates ---------------------------------------------------------------------------------------------


def observe(candidates: DataFrame | None, observations: DataFrame) -> DataFrame:
    """(sequence, n, sources, producers) of exact normalised sequences: upper case without white space; U counts as T."""
    s = F.replace(F.upper(F.regexp_replace("sequence", r"\s+", "")), F.lit("U"), F.lit("T"))
    new = observations.select(s.alias("sequence"), F.lit(1).cast("long").alias("n"), F.array("source").alias("sources"), F.array("producer").alias("producers"))
    both = new if candidates is None else candidates.select("sequence", "n", "sources", "producers").unionByName(new)
    flat = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))
    return both.where("sequence <> ''").groupBy("sequence").agg(F.sum("n").alias("n"), flat("sources").alias("sources"), flat("producers").alias("producers"))


def resolve_candidates(candidates: DataFrame, resolutions: DataFrame, wanted: str = "all") -> DataFrame:
    """candidates with reference (null while unresolved); wanted: all, resolved or unresolved. A resolution of a sequence that
    nobody has observed raises."""
    lone = resolutions.join(candidates, "sequence", "left_anti").select("sequence").take(1)
    if lone:
        raise ValueError(f"no evidence for {lone[0]['sequence']}")
    out = candidates.join(resolutions.select("sequence", "reference"), "sequence", "left")
    return {"all": out, "resolved": out.where("reference is not null"), "unresolved": out.where("reference is null")}[wanted]


def merge_metrics(*tables: DataFrame) -> DataFrame:
    """Counters, timers and histogram bins (name, bin, value) of several runs added up; a plain counter has a null bin."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.groupBy("name", "bin").agg(F.sum("value").alias("value"))


def add_numeric_ids(cells: DataFrame, ids: DataFrame, column: str, overwrite: bool = False) -> DataFrame:
    """cells with column from ids (cell, id) where it is empty, or everywhere with overwrite; conflict marks rows whose own
    value differs from the id."""
    j = cells.join(ids.select("cell", F.col("id").alias("_id")), "cell", "left")
    own = F.col(column)
    value = F.coalesce("_id", own) if overwrite else F.coalesce(own, F.col("_id"))
    return j.withColumns({"conflict": F.coalesce(own != F.col("_id"), F.lit(False)), column: value}).drop("_id")
