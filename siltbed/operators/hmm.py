"""Hidden Markov models on ordered sequences, in log space; one sequence at a time, whole groups by applyInPandas."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltbed.functions.statistics import logsumexp
from siltbed.operators.grouped import spread

_FLOOR = 1e-300


class Categorical:
    """Symbols 0 to k - 1 by state."""

    def __init__(self, p: Sequence[Sequence[float]]):
        self.p = np.asarray(p, float)

    def log(self, x: np.ndarray) -> np.ndarray:
        return np.log(np.maximum(self.p[:, np.asarray(x, int)].T, _FLOOR))

    def refit(self, x: np.ndarray, weight: np.ndarray, pseudo: float) -> "Categorical":
        n = np.stack([np.bincount(np.asarray(x, int), w, self.p.shape[1]) for w in weight.T]) + pseudo
        return Categorical(n / n.sum(axis=1, keepdims=True))


class Gaussian:
    """Numbers by state; the sd has a floor."""

    def __init__(self, mean: Sequence[float], sd: Sequence[float], least_sd: float = 1e-3):
        self.mean, self.sd, self.least = np.asarray(mean, float), np.maximum(np.asarray(sd, float), least_sd), least_sd

    def log(self, x: np.ndarray) -> np.ndarray:
        z = (np.asarray(x, float)[:, None] - self.mean) / self.sd
        return -0.5 * z * z - np.log(self.sd) - 0.5 * np.log(2 * np.pi)

    def refit(self, x: np.ndarray, weight: np.ndarray, pseudo: float) -> "Gaussian":
        n = weight.sum(axis=0) + 1e-12
        mean = (weight * np.asarray(x, float)[:, None]).sum(axis=0) / n
        return Gaussian(mean, np.sqrt((weight * (np.asarray(x, float)[:, None] - mean) ** 2).sum(axis=0) / n), self.least)


class Histogram(Categorical):
    """Numbers in bins with the given inner borders."""

    def __init__(self, borders: Sequence[float], p: Sequence[Sequence[float]]):
        super().__init__(p)
        self.borders = np.asarray(borders, float)

    def log(self, x: np.ndarray) -> np.ndarray:
        return super().log(np.searchsorted(self.borders, np.asarray(x, float), "right"))

    def refit(self, x: np.ndarray, weight: np.ndarray, pseudo: float) -> "Histogram":
        return Histogram(self.borders, super().refit(np.searchsorted(self.borders, np.asarray(x, float), "right"), weight, pseudo).p)


class Hmm:
    def __init__(self, initial: Sequence[float], transition: Sequence[Sequence[float]], emission: Categorical | Gaussian):
        self.initial, self.transition, self.emission = np.asarray(initial, float), np.asarray(transition, float), emission

    def steps(self, n: int, distance: np.ndarray | None = None, reference: float = 1.0) -> np.ndarray:
        """Log transition matrices between neighbours; given distances d, pull the states' memory down by rho^(d / ref).

        For two states P(d) = Pi + rho^(d / ref) (I - Pi), where Pi has the stationary shares in each row.
        """
        if distance is None:
            return np.broadcast_to(np.log(np.maximum(self.transition, _FLOOR)), (max(n - 1, 0), *self.transition.shape))
        leave, enter = self.transition[0, 1], self.transition[1, 0]
        total = max(leave + enter, _FLOOR)
        share, rho = np.array([enter, leave]) / total, np.clip(1 - leave - enter, 0.0, 1.0)
        memory = rho ** (np.maximum(distance, 0.0) / reference)
        return np.log(np.maximum(share[None, None, :] + memory[:, None, None] * (np.eye(2) - share[None, :])[None], _FLOOR))

    def infer(self, x: np.ndarray, distance: np.ndarray | None = None, reference: float = 1.0) -> dict[str, np.ndarray | float]:
        """path (Viterbi), posterior by state, and the log likelihood."""
        n, k = len(x), len(self.initial)
        if not n:
            return {"path": np.empty(0, int), "posterior": np.empty((0, k)), "log_likelihood": 0.0, "pairs": np.zeros((k, k))}
        e, t = self.emission.log(x), self.steps(n, distance, reference)
        start = np.log(np.maximum(self.initial, _FLOOR)) + e[0]
        f, v, back = np.empty((n, k)), start.copy(), np.zeros((n, k), int)
        f[0] = start
        for i in range(1, n):
            f[i] = logsumexp(f[i - 1][:, None] + t[i - 1], axis=0) + e[i]
            s = v[:, None] + t[i - 1]
            back[i] = s.argmax(axis=0)
            v = s.max(axis=0) + e[i]
        b = np.zeros((n, k))
        for i in range(n - 2, -1, -1):
            b[i] = logsumexp(t[i] + e[i + 1] + b[i + 1], axis=1)
        total = float(logsumexp(f[-1]))
        path = np.empty(n, int)
        path[-1] = v.argmax()
        for i in range(n - 1, 0, -1):
            path[i - 1] = back[i, path[i]]
        pairs = np.exp(f[:-1, :, None] + t + (e[1:] + b[1:])[:, None, :] - total).sum(axis=0) if n > 1 else np.zeros((k, k))
        return {"path": path, "posterior": np.exp(f + b - total), "log_likelihood": total, "pairs": pairs}

    def train(self, sequences: Sequence[np.ndarray], iterations: int = 50, tolerance: float = 1e-6, pseudo: float = 1e-3) -> "Hmm":
        """Baum-Welch over bounded training sequences."""
        model, before = self, -np.inf
        for _ in range(iterations):
            found = [model.infer(x) for x in sequences if len(x)]
            total = sum(r["log_likelihood"] for r in found)
            first = sum(r["posterior"][0] for r in found) + pseudo
            pairs = sum(r["pairs"] for r in found) + pseudo
            weight = np.concatenate([r["posterior"] for r in found])
            emission = model.emission.refit(np.concatenate([x for x in sequences if len(x)]), weight, pseudo)
            model = Hmm(first / first.sum(), pairs / pairs.sum(axis=1, keepdims=True), emission)
            if abs(total - before) < tolerance:
                break
            before = total
        return model


def infer_groups(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, model: Hmm, position: str | None = None, reference: float = 1.0) -> DataFrame:
    """df with state (Viterbi) and p_state (its posterior) for each row, sequence by sequence."""
    names = list(df.columns)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(list(order), ignore_index=True)
        d = np.diff(g[position].to_numpy(float)) if position else None
        r = model.infer(g[value].to_numpy(), d, reference)
        return g[names].assign(state=r["path"], p_state=r["posterior"][np.arange(len(g)), r["path"]])

    fields = ", ".join(f"`{c}` {k}" for c, k in df.dtypes)
    return spread(df, by).groupBy(*by).applyInPandas(run, f"{fields}, state long, p_state double")


def apply_sequences(df: DataFrame, by: Sequence[str], order: Sequence[str], run: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Any processor of one ordered sequence."""
    return spread(df, by).groupBy(*by).applyInPandas(lambda g: run(g.sort_values(list(order), ignore_index=True)), schema)


#: States of a feature model, and the steps between them that get a pseudocount.
FEATURE_STATES = ("background", "pre", "feature", "post")
FEATURE_STEPS = ((0, 0), (0, 1), (1, 1), (1, 2), (2, 2), (2, 3), (3, 3), (3, 0), (3, 1))


def feature_states(tokens: DataFrame, flank: int) -> DataFrame:
    """tokens (seq, pos, symbol, inside) with state: 2 inside a feature, 1 up to flank before one, 3 up to flank after one (the
    nearer of the two; before wins a tie), else 0."""
    w = Window.partitionBy("seq").orderBy("pos")
    at = F.when(F.col("inside"), F.col("pos"))
    after = F.col("pos") - F.last(at, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    before = F.first(at, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)) - F.col("pos")
    pre, post = F.coalesce(before <= flank, F.lit(False)), F.coalesce(after <= flank, F.lit(False))
    nearer = before <= F.coalesce(after, before)
    return tokens.withColumn("state", F.when(F.col("inside"), 2).when(pre & (nearer | ~post), 1).when(post, 3).otherwise(0))


def feature_model(states: DataFrame, symbols: int = 32) -> Hmm:
    """The supervised model of rows (seq, pos, symbol 0 to symbols - 1, state): three counts, with a pseudocount of 1 on initials,
    emissions and FEATURE_STEPS."""
    k = len(FEATURE_STATES)
    initial, transition, emission = np.ones(k), np.zeros((k, k)), np.ones((k, symbols))
    for a, b in FEATURE_STEPS:
        transition[a, b] = 1
    w = Window.partitionBy("seq").orderBy("pos")
    steps = states.withColumn("_p", F.lag("state").over(w))
    for r in steps.groupBy("_p", "state").agg(F.count("*").alias("n")).collect():
        if r["_p"] is None:
            initial[r["state"]] += r["n"]
        else:
            transition[r["_p"], r["state"]] += r["n"]
    for r in states.groupBy("state", "symbol").agg(F.count("*").alias("n")).collect():
        emission[r["state"], r["symbol"]] += r["n"]
    return Hmm(initial / initial.sum(), transition / transition.sum(axis=1, keepdims=True), Categorical(emission / emission.sum(axis=1, keepdims=True)))


def evaluate_feature(predicted: DataFrame) -> DataFrame:
    """One row: precision, recall and F1 of inside against state = 2, by residue."""
    hit, told = F.col("inside"), F.col("state") == 2
    c = predicted.agg(F.count_if(hit & told).alias("tp"), F.count_if(~hit & told).alias("fp"), F.count_if(hit & ~told).alias("fn"))
    p, r = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    return c.select("tp", "fp", "fn", p.alias("precision"), r.alias("recall"), F.try_divide(2 * p * r, p + r).alias("f1"))
