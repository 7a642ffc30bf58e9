"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by source and exact length, and all decisions use these counts. A source's target is its share of
the budget by weight, at most CAP times its size; what is over is reshared by weight until no target is above its cap.
A target at or over the source's size takes each document once and fits the rest; the fit takes an even share of every
length, then, from the longest, single documents while they fit, and closes the last FINE words by a bounded-knapsack
dynamic programme over the lengths that are left. Which documents of a length are taken follows a seeded hash of doc_id: each group of a source and length
is cut by its hash's buckets, whole buckets are taken by their counts, and only the bucket at the cut is ranked, so a hot
length is never sorted in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltbed.llm.common import as_bytes, fresh, stored

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
CAP = 2.0
SEED = 9
#: Words that the knapsack closes at most, where documents are short enough.
FINE = 16_384
BUCKETS = 1024


def targets(sizes: list[int], weights: list[float], budget: float, cap: float = CAP) -> list[float]:
    """Each source's words: by weight, none over cap times its size; the excess goes to the others by weight."""
    out = [0.0] * len(sizes)
    free, left = set(range(len(sizes))), float(budget)
    while free:
        total = sum(weights[k] for k in sorted(free))
        over = [k for k in sorted(free) if left * weights[k] / total > cap * sizes[k]]
        if not over:
            for k in free:
                out[k] = left * weights[k] / total
            break
        for k in over:
            out[k] = cap * sizes[k]
            free.discard(k)
        left = float(budget) - sum(out[k] for k in range(len(sizes)) if k not in free)
    return out


def fit(lengths: list[int], counts: list[int], goal: int, even: bool = True) -> list[int]:
    """How many documents of each distinct length to take: their words are at most goal and near it.

    even: start from an equal share of every length; else the longest come first.
    """
    total = sum(a * n for a, n in zip(lengths, counts))
    if goal >= total:
        return list(counts)
    take = [n * goal // total if even else 0 for n in counts]
    left = goal - sum(a * k for a, k in zip(lengths, take))
    order = sorted((k for k in range(len(lengths)) if lengths[k] > 0), key=lambda k: -lengths[k])
    for k in order:
        a = lengths[k]
        more = max(0, min(counts[k] - take[k], (left if a > FINE and not even else left - FINE) // a))
        take[k] += more
        left -= more * a
    # bounded knapsack: bit s of a row says that s words can be made; counts are cut in powers of two
    whole = (1 << (left + 1)) - 1
    rows, steps = [1], []
    for k in sorted(order, key=lambda k: abs(8 * lengths[k] - left)):  # lengths that combine to many sums come first
        n = min(counts[k] - take[k], left // lengths[k])
        size = 1
        while n > 0 and not rows[-1] >> left & 1:
            part = min(size, n)
            rows.append((rows[-1] | rows[-1] << part * lengths[k]) & whole)
            steps.append((k, part))
            n -= part
            size *= 2
    s = rows[-1].bit_length() - 1
    for at in range(len(steps) - 1, -1, -1):
        if not rows[at] >> s & 1:
            k, part = steps[at]
            take[k] += part
            s -= part * lengths[k]
    return take


def plan_source(lengths: list[int], counts: list[int], target: float) -> list[int]:
    """Copies taken of all documents of each length, 0 to 2 for each document.

    Every document once and a fit of the rest, if the target is at or over the source's size; where that misses the
    target (a long document is over the rest), fits in which a document may be taken twice before another is taken.
    """
    goal, size = int(round(target)), sum(a * n for a, n in zip(lengths, counts))
    base = int(goal >= size)
    ways = [lambda: [base * n + k for n, k in zip(counts, fit(lengths, counts, goal - base * size))]]
    ways += [lambda even=even: fit(lengths, [2 * n for n in counts], goal, even) for even in (True, False)]
    best, least = [0] * len(counts), goal + 1
    for way in ways:
        copies = way()
        miss = goal - sum(a * k for a, k in zip(lengths, copies))
        if miss < least:
            best, least = copies, miss
        if not least:
            break
    return best


def _sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size: the words of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [len(t.split()) if t else 0 for t in as_bytes(batch.column(2))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(sizes, pa.int64())], ["doc_id", "source", "size"])

    return docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, source string, size long")


def mix(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target and taken for every row of docs (doc_id, source, text).

    Sources in the order of their code points, null last, weigh weights, repeating; budget is a multiple of all words.
    taken is 0, 1 or 2 times size. A null or empty text has size 0; equal doc_ids are ranked by size, and fully equal
    rows are interchangeable; an empty table gives no rows. Reruns agree. Clashing columns are not read. options are those
    of with_source().
    """
    return with_source(docs, **options).drop("source")


def with_source(docs: DataFrame, weights: tuple = WEIGHTS, budget: float = BUDGET, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """mix()'s rows with their source."""
    spark = docs.sparkSession
    hashed = F.xxhash64(F.lit(seed), "doc_id")
    sized = stored(_sized(docs), "sizes").withColumns({"h": hashed, "b": F.pmod(hashed, F.lit(BUCKETS)).cast("int")})
    by_length = sized.groupBy("source", "size").agg(F.count("*").alias("n"))
    sums = by_length.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("s")).collect()
    sums = sorted(((r["source"], int(r["s"])) for r in sums), key=lambda r: (r[0] is None, r[0] or ""))
    goal = targets([s for _, s in sums], [weights[k % len(weights)] for k in range(len(sums))], budget * sum(s for _, s in sums), cap)
    plan = {name: (size, t) for (name, size), t in zip(sums, goal)}
    shared = spark.sparkContext.broadcast(plan)

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        name = None if pd.isna(group["source"].iloc[0]) else group["source"].iloc[0]
        size, target = shared.value[name]
        group = group.sort_values("size", ascending=False, ignore_index=True)
        copies = np.array(plan_source(group["size"].tolist(), group["n"].tolist(), target), np.int64)
        n = group["n"].to_numpy()
        return pd.DataFrame({"s": group["source"], "z": group["size"], "base": (copies // n).astype(np.int32), "take": copies % n, "source_size": size, "target": float(target)})

    chosen = by_length.groupBy("source").applyInPandas(choose, "s string, z long, base int, take long, source_size long, target double")
    chosen = stored(chosen, "lengths")
    buckets = sized.groupBy("source", "size", "b").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source", "size").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # both sides grow with the corpus: merge joins, whatever their compressed size looks like
    cut = buckets.withColumn("before", before).join(chosen.hint("merge"), F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")))
    cut = cut.select("s", "z", F.col("b").alias("c"), "base", "source_size", "target", F.least("n", F.greatest(F.lit(0), F.col("take") - F.col("before"))).alias("k"))
    rows = sized.join(cut.hint("merge"), F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")) & (F.col("b") == F.col("c")))
    rank = F.row_number().over(Window.partitionBy("s", "z", "c").orderBy("h", "doc_id"))
    times = F.col("base") + (F.col("rank") <= F.col("k")).cast("int")
    return rows.withColumn("rank", rank).select("doc_id", "source", "size", "source_size", "target", (F.col("size") * times).alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that mix() takes, with a column times (1 or 2); all columns stay, by any names.

    Rows of one doc_id, source and size are served in the order of their texts, those taken more often first, so the words that are
    taken are mix()'s, repeated rows included. Null and empty texts have no words and are never taken; an empty table gives
    no rows. Texts of any length count whole.
    """
    times, z, place, d, size_of, k, own = (fresh(docs, c) for c in ("times", "words", "place", "of", "size_of", "k", "of_source"))
    size = F.size(F.regexp_extract_all(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).cast("long")
    found = with_source(docs.select("doc_id", "source", "text"), **options).where("size > 0").select(F.col("doc_id").alias(d), F.col("source").alias(own), F.col("size").alias(size_of), (F.col("taken") / F.col("size")).cast("int").alias(times))
    served = found.withColumn(k, F.row_number().over(Window.partitionBy(d, own, size_of).orderBy(F.desc(times)))).where(F.col(times) > 0)
    text = F.col("text").cast("string")
    ranked = docs.withColumn(z, size).withColumn(place, F.row_number().over(Window.partitionBy(F.col("doc_id").cast("long"), F.col("source").cast("string"), z).orderBy(F.xxhash64(text), text)))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(d)) & F.col("source").cast("string").eqNullSafe(F.col(own)) & (F.col(z) == F.col(size_of)) & (F.col(place) == F.col(k))
    return ranked.join(served, same).drop(z, place, d, size_of, k, own)
