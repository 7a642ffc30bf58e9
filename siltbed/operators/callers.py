"""Iterative statistical callers. Rows stay distributed; what comes to the driver are per-guide, per-class or histogram sums."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltbed.functions import statistics as S
from siltbed.operators.grouped import spread
from siltbed.operators.ranking import bh_over_all
from siltbed.scratch import delete_stored, stored


@dataclass(frozen=True)
class MixtureConfig:
    max_iterations: int = 500
    tolerance: float = 1e-5
    stable_iterations: int = 3
    call_posterior: float = 0.95
    call_fdr: float = 0.05
    prior: float = 0.05
    prior_alpha: float = 1.0
    prior_beta: float = 19.0
    dispersion: float = 10.0
    least_lambda: float = 1e-6
    least_mean: float = 1.0


def _moments(p: np.ndarray, signal: np.ndarray, weight: np.ndarray, least_mean: float) -> tuple[float, float, float]:
    """(sum of posteriors, signal mean, dispersion) of weighted rows."""
    z = float((weight * p).sum())
    if z <= 1e-8:
        return z, least_mean, 1e6
    mean = max(float((weight * signal).sum()) / z, least_mean)
    inferred = np.where(p > 1e-12, signal / np.maximum(p, 1e-300), 0.0)
    var = float((weight * p * (inferred - mean) ** 2).sum()) / z
    return z, mean, float(np.clip(mean * mean / (var - mean), 0.05, 1e6)) if var > mean + 1e-8 else 1e6


def binary_mixture(counts: DataFrame, value: str, config: MixtureConfig = MixtureConfig(), prior: float = 0.5) -> dict[str, object]:
    """Two-component mixture of counts: Poisson background, and that plus a negative binomial signal.

    Equal counts have equal posteriors, so EM runs on the histogram of counts. Returns the parameters and the posterior of
    each count.
    """
    rows = counts.groupBy(F.col(value).cast("long").alias("x")).agg(F.count("*").alias("n")).orderBy("x").collect()
    if not rows:
        raise ValueError("no counts to fit")
    x, w = np.array([r["x"] for r in rows], float), np.array([r["n"] for r in rows], float)
    n, cum = w.sum(), np.cumsum(w)
    quantile = lambda q: float(x[np.searchsorted(cum, q * (n - 1), "right").clip(0, len(x) - 1)])
    background, mean, theta = max(quantile(0.25), 0.05), max(quantile(0.9), config.least_mean), config.dispersion
    for it in range(config.max_iterations):
        old = (background, prior, mean, theta)
        p, _, ambient = S.signal_evidence(x, background, prior, mean, theta)
        signal = p * np.maximum(x - ambient, 0)
        z, mean, theta = _moments(p, signal, w, config.least_mean)
        background = max(float((w * ((1 - p) * x + p * ambient)).sum()) / n, 1e-6)
        prior = float(np.clip((z + config.prior_alpha) / (n + config.prior_alpha + config.prior_beta), 1e-9, 1 - 1e-9))
        if max(abs(a - b) / max(abs(a), abs(b), 1e-9) for a, b in zip(old, (background, prior, mean, theta))) < config.tolerance:
            break
    p = S.signal_evidence(x, background, prior, mean, theta)[0]
    return {"background": background, "prior": prior, "mean": mean, "theta": theta, "iterations": it + 1, "posterior": dict(zip(x.astype(int).tolist(), p.tolist()))}


def guide_mixture(obs: DataFrame, ambient: DataFrame, n_cells: int, config: MixtureConfig = MixtureConfig()) -> DataFrame:
    """EM of guide counts: (cell, guide, count, lambda, p_ambient, posterior, log_odds).

    obs: cell, guide, count; ambient: guide, p. Each cell has its own background depth lambda and each guide its own signal
    (share, mean, dispersion). An iteration is one pass: an E-step over Arrow batches, a cell sum on rows that are already
    together, and per-guide sums that come to the driver. States are tables, so that lineage stays short.
    """
    spark = obs.sparkSession
    depth = obs.groupBy("cell").agg(F.greatest(F.sum("count").cast("double"), F.lit(config.least_lambda)).alias("lam"))
    rows = obs.join(depth, "cell").join(ambient.select("guide", F.col("p").alias("p_ambient")), "guide").select("cell", "guide", F.col("count").cast("double"), "lam", "p_ambient")
    rows = stored(rows.withColumn("posterior", F.lit(0.0)), "guides")
    excess = rows.withColumn("e", F.col("count") - F.col("lam") * F.col("p_ambient")).where("e > 0")
    cut = excess.groupBy("guide").agg(F.percentile("e", 0.5).alias("m"))
    start = excess.join(cut, "guide").where("e >= m").groupBy("guide").agg(F.avg("e").alias("mean")).collect()
    guides = {r["guide"]: (config.prior, config.least_mean, config.dispersion) for r in rows.select("guide").distinct().collect()}
    guides |= {r["guide"]: (config.prior, max(r["mean"], config.least_mean), config.dispersion) for r in start}
    stable = 0

    def e_step(frame: DataFrame, parameters: dict) -> DataFrame:
        shared = spark.sparkContext.broadcast(parameters)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    g = np.array([shared.value[k] for k in b["guide"]], float)
                    p, odds, amb = S.signal_evidence(b["count"].to_numpy(float), (b["lam"] * b["p_ambient"]).to_numpy(float), g[:, 0], g[:, 1], g[:, 2])
                    yield b.assign(before=b["posterior"], posterior=p, log_odds=odds, amb=(1 - p) * b["count"] + p * amb, sig=p * np.maximum(b["count"] - amb, 0))

        kinds = f"cell {dict(frame.dtypes)['cell']}, guide {dict(frame.dtypes)['guide']}, count double, lam double, p_ambient double, posterior double"
        return frame.mapInPandas(run, f"{kinds}, before double, log_odds double, amb double, sig double")

    for it in range(config.max_iterations):
        done = stored(e_step(rows, guides), "guides")
        # per guide: sums for the signal's mean, and its variance about that mean by the second moment of inferred signals
        inferred = F.when(F.col("posterior") > 1e-12, F.col("sig") / F.col("posterior")).otherwise(0.0)
        sums = done.groupBy("guide").agg(F.sum("posterior").alias("z"), F.sum("sig").alias("s"), F.sum(F.col("posterior") * inferred * inferred).alias("s2"), F.sum((F.col("posterior") >= config.call_posterior).cast("int") - (F.col("before") >= config.call_posterior).cast("int")).alias("d"), F.count_if((F.col("posterior") >= config.call_posterior) != (F.col("before") >= config.call_posterior)).alias("changed"))
        after, changed = {}, 0
        for r in sums.collect():
            z = r["z"]
            mean = max(r["s"] / z, config.least_mean) if z > 1e-8 else config.least_mean
            var = r["s2"] / z - 2 * mean * r["s"] / z + mean * mean if z > 1e-8 else 0.0
            theta = float(np.clip(mean * mean / (var - mean), 0.05, 1e6)) if var > mean + 1e-8 else 1e6
            prior = (z + config.prior_alpha) / (n_cells + config.prior_alpha + config.prior_beta)
            after[r["guide"]] = (float(np.clip(prior, 1e-9, 1 - 1e-9)), mean, theta)
            changed += r["changed"]
        delta = max((abs(a - b) / max(abs(a), abs(b), 1e-9) for k in after for a, b in zip(guides[k], after[k])), default=0.0)
        stable = stable + 1 if it and not changed else 0
        guides = after
        lam = done.groupBy("cell").agg((F.sum("amb") + config.least_lambda).alias("lam"))
        nxt = stored(done.drop("lam", "before", "log_odds", "amb", "sig").join(lam, "cell").select("cell", "guide", "count", "lam", "p_ambient", "posterior"), "guides")
        for old in (rows, done):
            delete_stored(old)
        rows = nxt
        if delta < config.tolerance or stable >= config.stable_iterations:
            break
    return e_step(rows, guides).select("cell", "guide", F.col("count").cast("long"), F.col("lam").alias("lambda"), "p_ambient", "posterior", "log_odds")


def call_guides(model: DataFrame, config: MixtureConfig = MixtureConfig()) -> DataFrame:
    """model with p_value (Poisson tail of the background), q (over all observations) and called; several per cell may be."""

    @F.pandas_udf("double")
    def tail(count: pd.Series, mean: pd.Series) -> pd.Series:
        return pd.Series([S.poisson_upper_tail(int(k), float(m)) for k, m in zip(count, mean)])

    tested = model.withColumn("p_value", tail("count", F.col("lambda") * F.col("p_ambient")))
    ranked = bh_over_all(tested.withColumn("_tie", F.xxhash64("cell", "guide")), "p_value", "_tie").drop("_tie")
    return ranked.withColumn("called", (F.col("posterior") >= config.call_posterior) & (F.col("q") <= config.call_fdr))


def candidate_em(classes: list[tuple[tuple, float]], max_iterations: int = 200, epsilon: float = 1e-6) -> dict:
    """Abundance of items from classes (candidate items, count): each class shares its count by the items' abundance."""
    items = sorted({x for c, _ in classes for x in c})
    at = {x: k for k, x in enumerate(items)}
    owner = np.repeat(np.arange(len(classes)), [len(c) for c, _ in classes])
    slot = np.array([at[x] for c, _ in classes for x in c], np.int64)
    count = np.array([n for _, n in classes], float)
    size = np.bincount(owner, minlength=len(classes)).astype(float)
    theta = np.bincount(slot, (count / np.maximum(size, 1))[owner], len(items)) if len(items) else np.empty(0)
    for _ in range(max_iterations):
        mass = np.bincount(owner, theta[slot], len(classes))
        share = np.where(mass[owner] > 0, theta[slot] / np.where(mass[owner] > 0, mass[owner], 1), 1 / size[owner])
        after = np.bincount(slot, count[owner] * share, len(items))
        delta = np.abs(after - theta).max(initial=0)
        theta = after
        if delta < epsilon:
            break
    return dict(zip(items, theta.tolist()))


def abundance_by_group(pairs: DataFrame, group: str, row: str, item: str, max_iterations: int = 200, epsilon: float = 1e-6, replicates: int = 0, seed: int = 0) -> DataFrame:
    """(group, item, abundance, share[, sd]) of multimapping rows: pairs has group, row, item.

    Rows collapse to classes of equal candidate sets before anything else; a group's EM then sees its classes only.
    replicates > 0 adds the sd of the share over multinomial bootstraps of the class counts (sample sd, n - 1).
    """
    sets = pairs.groupBy(group, row).agg(F.array_sort(F.collect_set(item)).alias("items"))
    classes = sets.groupBy(group, "items").agg(F.count("*").alias("n"))
    kind = dict(pairs.dtypes)

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        rows = sorted((tuple(i), int(n)) for i, n in zip(g["items"], g["n"]))
        found = candidate_em(rows, max_iterations, epsilon)
        total = sum(found.values()) or 1.0
        out = pd.DataFrame({group: g[group].iloc[0], item: list(found), "abundance": list(found.values()), "share": [v / total for v in found.values()], "sd": 0.0})
        if replicates > 1:
            rng = np.random.default_rng(seed)
            n = np.array([c for _, c in rows])
            draws = []
            for r in rng.multinomial(n.sum(), n / n.sum(), size=replicates):
                one = candidate_em([(c, float(k)) for (c, _), k in zip(rows, r) if k], max_iterations, epsilon)
                s = sum(one.values()) or 1.0
                draws.append([one.get(x, 0.0) / s for x in found])
            out["sd"] = np.std(draws, axis=0, ddof=1)
        return out

    return spread(classes, [group]).groupBy(group).applyInPandas(fit, f"{group} {kind[group]}, {item} {kind[item]}, abundance double, share double, sd double")


def transcript_posterior(candidates: DataFrame, molecule: str, transcript: str, prior: str, likelihood: str) -> DataFrame:
    """Bayes posterior of each molecule's candidates: prior times likelihood, normalised by molecule; all zero gives zero."""
    joint = F.col(prior) * F.col(likelihood)
    total = F.sum(joint).over(Window.partitionBy(molecule))
    return candidates.select(molecule, transcript, F.coalesce(F.try_divide(joint, total), F.lit(0.0)).alias("posterior"))

