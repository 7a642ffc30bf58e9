"""Vectors: PCA, exact nearest neighbours, trees, clusters. Rows stay distributed; moments and centroids come to the driver."""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltbed.operators.grouped import spread
from siltbed.scratch import delete_stored, stored


def moments(df: DataFrame, vector: str) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, mean, population covariance), by partial sums of each batch; the matrix is dimensions squared."""
    size = df.select(F.size(vector)).first()
    if size is None:
        return 0, np.empty(0), np.empty((0, 0))
    d = size[0]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, q = 0, np.zeros(d), np.zeros((d, d))
        for b in batches:
            if len(b):
                x = np.stack(b[vector].to_numpy()).astype(float)
                n, s, q = n + len(x), s + x.sum(axis=0), q + x.T @ x
        yield pd.DataFrame({"n": [n], "s": [s.tolist()], "q": [q.ravel().tolist()]})

    # sums of partitions meet in a few tasks first, so that the driver reads a bounded number of them
    parts = df.select(vector).mapInPandas(run, "n long, s array<double>, q array<double>")

    def add(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"n": [int(g["n"].sum())], "s": [np.sum(np.stack(g["s"]), axis=0).tolist()], "q": [np.sum(np.stack(g["q"]), axis=0).tolist()]})

    rows = parts.withColumn("k", F.spark_partition_id() % 16).groupBy("k").applyInPandas(lambda g: add(g), "n long, s array<double>, q array<double>").collect()
    n = sum(r["n"] for r in rows)
    mean = sum(np.array(r["s"]) for r in rows) / max(n, 1)
    return n, mean, sum(np.array(r["q"]) for r in rows).reshape(d, d) / max(n, 1) - np.outer(mean, mean)


def pca(df: DataFrame, key: str, vector: str, k: int) -> tuple[DataFrame, np.ndarray]:
    """(key, pcs) and the variance of each component; each axis points so that its largest loading is positive."""
    n, mean, cov = moments(df, vector)
    k = max(0, min(k, n - 1, len(mean) - 1))
    values, axes = np.linalg.eigh(cov) if n else (np.empty(0), np.empty((0, 0)))
    axes = axes[:, ::-1][:, :k]
    if k:
        axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(k)])
    shared = df.sparkSession.sparkContext.broadcast((mean, axes))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, a = shared.value
        for b in batches:
            if len(b):
                yield pd.DataFrame({key: b[key], "pcs": list((np.stack(b[vector].to_numpy()).astype(float) - m) @ a)})

    return df.select(key, vector).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, pcs array<double>"), values[::-1][:k]


def _nearest(names: np.ndarray, q: np.ndarray, k: int, digits: int | None, batches: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, id, distance): the k nearest of all batches (ids, vectors) for each row of q, not the row itself; ties by id.

    A matrix product bounds the squared distances; only pairs that may be among the k best are measured exactly. digits: the
    distance counts as rounded, in the order too.
    """
    step = 10.0**-digits if digits is not None else 0.0
    norm, limit = (q * q).sum(axis=1), np.full(len(q), np.inf)
    at, ids, far = np.empty(0, int), names[:0], np.empty(0)
    for batch_ids, batch in batches:
        for lo in range(0, len(batch), 2048):
            x, xi = batch[lo : lo + 2048], batch_ids[lo : lo + 2048]
            xn, found = (x * x).sum(axis=1), [(at, ids, far)]
            for c in range(0, len(q), 512):
                two = norm[c : c + 512, None] + xn[None]
                d2 = two - 2 * (q[c : c + 512] @ x.T)
                most = limit[c : c + 512]
                if len(x) > k + 1 and np.isinf(most).any():  # itself is one of k + 1
                    most = np.minimum(most, np.sqrt(np.maximum(np.partition(d2, k, axis=1)[:, k] + 1e-11 * two.max(axis=1), 0)))
                i, j = np.nonzero(d2 <= ((most + step) ** 2)[:, None] + 1e-11 * two)
                for m in range(0, len(i), 1 << 16):
                    a, b = i[m : m + (1 << 16)] + c, j[m : m + (1 << 16)]
                    d = np.sqrt(((q[a] - x[b]) ** 2).sum(axis=1))
                    if digits is not None:
                        d = np.floor(d * 10.0**digits + 0.5) / 10.0**digits
                    good = (d <= limit[a]) & (xi[b] != names[a])
                    found.append(_best(a[good], xi[b[good]], d[good], k))
            at, ids, far = _best(*(np.concatenate(p) for p in zip(*found)), k)
            full = np.flatnonzero(np.bincount(at, minlength=len(q)) >= k)
            limit[full] = far[np.searchsorted(at, full, "right") - 1]
    return at, ids, far


def _best(at: np.ndarray, ids: np.ndarray, far: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k first of each at by (far, ids), in order."""
    order = np.lexsort((ids, far, at))
    at, ids, far = at[order], ids[order], far[order]
    first = np.arange(len(at)) - np.searchsorted(at, at, "left") < k
    return at[first], ids[first], far[first]


def knn(queries: DataFrame, table: DataFrame, key: str, vector: str, k: int, block: int = 20_000, digits: int | None = None) -> DataFrame:
    """(key, neighbour, distance, rank): exact Euclidean k nearest rows of table, not the row itself; ties by key. digits: distances
    are rounded before they are compared.

    queries are read in blocks, one after the other; every task holds one block and scans its rows of table once, keeping k
    candidates for each query, so what is shuffled is k rows for each query and partition. A block's result is a table, and the
    driver lets go of the block before it reads the next one.
    """
    spark = table.sparkSession
    n = queries.count()
    kind = dict(table.dtypes)[key]
    blocks = max(1, -(-n // block))
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy(key).orderBy("distance", "neighbour"))
    rows = table.select(key, vector)
    if n > 2000:  # few bytes make much work: as many tasks as there are cores
        rows = stored(rows.repartition(spark.sparkContext.defaultParallelism), "vectors")
    out = None
    for b in range(blocks):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == b)
        mine = part.select(key, vector).toPandas()
        shared = spark.sparkContext.broadcast((mine[key].to_numpy(), np.array(mine[vector].tolist(), float).reshape(len(mine), -1)))

        def scan(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            names, q = shared.value
            each = ((g[key].to_numpy(), np.stack(g[vector].to_numpy()).astype(float)) for g in batches if len(g))
            at, ids, far = _nearest(names, q, k, digits, each) if len(names) else (np.empty(0, int), names, np.empty(0))
            yield pd.DataFrame({key: names[at], "neighbour": ids, "distance": far})

        one = rows.mapInPandas(scan, f"{key} {kind}, neighbour {kind}, distance double").withColumn("rank", rank).where(F.col("rank") <= k)
        one = stored(one, "near")
        shared.destroy()
        out = one if out is None else out.unionByName(one)
    return out


def scaled_graph(neighbours: DataFrame, key: str) -> DataFrame:
    """(a, b, w): neighbour links weighted exp(-d / sqrt(sigma_a sigma_b)), sigma a row's largest distance; the larger of both
    directions counts."""
    sigma = neighbours.groupBy(key).agg(F.max("distance").alias("s"))
    e = neighbours.join(sigma, key).withColumnRenamed("s", "sa").join(sigma.select(F.col(key).alias("neighbour"), F.col("s").alias("sb")), "neighbour")
    w = F.exp(-F.coalesce(F.try_divide("distance", F.sqrt(F.col("sa") * F.col("sb"))), F.lit(0.0)))
    return e.select(F.least(key, "neighbour").alias("a"), F.greatest(key, "neighbour").alias("b"), w.alias("w")).groupBy("a", "b").agg(F.max("w").alias("w"))


def communities(edges: DataFrame, rounds: int = 20) -> DataFrame:
    """(node, community) by deterministic weighted label propagation: a node takes the label of the largest weight around it
    (ties: the smallest), half of the nodes at a time so that two can't swap for ever; ends when no label changes."""
    both = stored(edges.select("a", "b", "w").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")), "graph")
    labels = stored(both.select(F.col("a").alias("node")).distinct().withColumn("community", F.col("node")), "labels")
    # only the nodes whose turn it is look around, so only their edges meet the labels
    halves = [stored(both.where(F.pmod(F.xxhash64(F.lit(7), "a"), F.lit(2)) == p), "half") for p in range(2)]
    for r in range(2 * rounds):
        weight = halves[r % 2].join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node"), "community").agg(F.round(F.sum("w"), 9).alias("w"))
        top = weight.groupBy("node").agg(F.min(F.struct(F.negative("w").alias("w"), F.col("community").alias("new"))).alias("t")).select("node", "t.new")
        after = stored(labels.join(top, "node", "left").select("node", F.coalesce("new", "community").alias("community"), F.col("community").alias("old")), "labels")
        changed = after.where("community <> old").count()
        delete_stored(labels)
        labels = after.select("node", "community")
        if not changed and r:
            break
    least = labels.groupBy("community").agg(F.min("node").alias("least"))
    return labels.join(least, "community").select("node", F.col("least").alias("community"))


def spanning_tree(x: np.ndarray) -> list[tuple[int, int, float]]:
    """Prim's minimum spanning tree of rows; ties go to the smaller row. For one group's rows."""
    n = len(x)
    if not n:
        return []
    dist, near, out, done = np.full(n, np.inf), np.zeros(n, int), [], np.zeros(n, bool)
    at = 0
    for _ in range(n - 1):
        done[at] = True
        d = np.sqrt(((x - x[at]) ** 2).sum(axis=1))
        better = (d < dist) & ~done
        dist[better], near[better] = d[better], at
        at = int(np.where(done, np.inf, dist).argmin())
        out.append((int(near[at]), at, float(dist[at])))
    return out


def trees(df: DataFrame, group: str, key: str, vector: str) -> DataFrame:
    """(group, a, b, length): the spanning tree of each group, rows in key order."""
    kinds = dict(df.dtypes)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(key, ignore_index=True)
        edges = spanning_tree(np.stack(g[vector].to_numpy()).astype(float))
        return pd.DataFrame({group: g[group].iloc[0], "a": [g[key][i] for i, _, _ in edges], "b": [g[key][j] for _, j, _ in edges], "length": [d for *_, d in edges]})

    return spread(df.select(group, key, vector), [group]).groupBy(group).applyInPandas(run, f"{group} {kinds[group]}, a {kinds[key]}, b {kinds[key]}, length double")


def newick(edges: Sequence[tuple], root: object) -> str:
    """A rooted tree in Newick form; children in order of their name."""
    around: dict = {}
    for a, b, d in edges:
        around.setdefault(a, []).append((b, d))
        around.setdefault(b, []).append((a, d))
    out: dict = {}
    stack = [(root, None, False)]
    while stack:
        node, parent, ready = stack.pop()
        children = sorted((c, d) for c, d in around.get(node, []) if c != parent)
        if ready:
            inner = ",".join(f"{out[c]}:{d:g}" for c, d in children)
            out[node] = f"({inner}){node}" if inner else str(node)
        else:
            stack.append((node, parent, True))
            stack += [(c, node, False) for c, _ in children]
    return out[root] + ";"


def parse_newick(text: str) -> list[tuple[str, str | None, float]]:
    """(name, parent, length) of each node, parents first; nameless nodes are numbered."""
    rows: list[list] = []
    stack: list[int] = []
    name, length, at, count = "", "", 0, 0
    current: int | None = None

    def add(parent: int | None) -> int:
        rows.append(["", parent, 0.0])
        return len(rows) - 1

    for token in __import__("re").findall(r"[(),;]|:[^(),;]*|[^(),:;]+", text.strip()):
        if token == "(":
            current = add(stack[-1] if stack else None) if current is None else current
            stack.append(current)
            current = None
        elif token in ",)":
            if current is None:
                add(stack[-1])
            current = None if token == "," else stack.pop()
        elif token == ";":
            break
        elif token.startswith(":"):
            rows[current][2] = float(token[1:])
        else:
            current = add(stack[-1] if stack else None) if current is None else current
            rows[current][0] = token.strip()
    for k, r in enumerate(rows):
        r[0] = r[0] or f"node{k}"
    return [(n, rows[p][0] if p is not None else None, d) for n, p, d in rows]


def spherical_kmeans(x: np.ndarray, k: int = 8, rounds: int = 40) -> np.ndarray:
    """Clusters of directions, 0 for flat rows and 1 and on for the others: farthest-first seeds, then cosine k-means."""
    norm = np.linalg.norm(x, axis=1)
    label = np.zeros(len(x), int)
    rows = np.flatnonzero(norm > 1e-12)
    if not len(rows):
        return label
    u = x[rows] / norm[rows, None]
    seeds = [int(norm[rows].argmax())]
    while len(seeds) < min(k, len(rows)):
        nearest = (u @ u[seeds].T).max(axis=1)
        if nearest.min() > 1 - 1e-9:
            break
        seeds.append(int(nearest.argmin()))
    centers, own = u[seeds], None
    for _ in range(rounds):
        now = (u @ centers.T).argmax(axis=1)
        if own is not None and (now == own).all():
            break
        own = now
        for c in range(len(centers)):
            if (own == c).any():
                m = u[own == c].sum(axis=0)
                centers[c] = m / max(np.linalg.norm(m), 1e-12)
    label[rows] = own + 1
    return label


def merge_correlated(means: np.ndarray, sizes: Sequence[int], cutoff: float, target: int = 1, largest: int | None = None) -> tuple[np.ndarray, list[tuple[int, int, float]]]:
    """Agglomerative merge of cluster means by Pearson's r: the best pair first (ties: lower numbers), until none is over
    cutoff or target clusters are left; pairs over the size cap are passed over. Gives labels and the merge history."""
    live = {k: (np.asarray(m, float), int(n)) for k, (m, n) in enumerate(zip(means, sizes))}
    label, history = np.arange(len(sizes)), []

    def r(a: np.ndarray, b: np.ndarray) -> float:
        a, b = a - a.mean(), b - b.mean()
        d = np.sqrt((a @ a) * (b @ b))
        return float(a @ b / d) if d > 0 else 0.0

    while len(live) > target:
        pairs = [(-r(live[a][0], live[b][0]), a, b) for a in live for b in live if a < b and (largest is None or live[a][1] + live[b][1] <= largest)]
        if not pairs or -min(pairs)[0] < cutoff:
            break
        score, a, b = min(pairs)
        (x, n), (y, m) = live[a], live.pop(b)
        live[a] = ((x * n + y * m) / (n + m), n + m)
        label[label == b] = a
        history.append((a, b, -score))
    return label, history


def spatial_patches(x: np.ndarray, largest: int) -> np.ndarray:
    """Patches of at most largest rows: median splits on the axis of the largest variance, ties by row."""
    label, todo, n = np.zeros(len(x), int), [np.arange(len(x))], 0
    while todo:
        rows = todo.pop()
        if len(rows) <= largest:
            label[rows] = n
            n += 1
            continue
        axis = x[rows].var(axis=0).argmax()
        rows = rows[np.lexsort((rows, x[rows, axis]))]
        todo += [rows[len(rows) // 2 :], rows[: len(rows) // 2]]
    return label
