"""SimHash near-duplicates by Golay-code fuzzy hashing.

A document's fingerprint is 64 bits: words are runs without ASCII white space of the text with A-Z lower-cased, a
shingle is 3 words joined by spaces (repeats count; fewer words: the whole sequence), and a bit is 1 if it is set in
over half of the shingles' XXH64 values (seed 42). Without words the fingerprint is zero, linked like any other.

Fingerprints at 2 or fewer differing bits link. They are cut into three segments of 22, 21 and 21 bits. With at most 2
errors, some pair of segments has at most 1 error (leave out the worst segment), so one of that pair is equal and the
other differs in at most 1 bit. The key for "segment i equal, segment j nearly equal" joins the bits of i with indices
of words of the perfect binary Golay code (23, 12, 7) near j: every 23-bit word has exactly one codeword within
distance 3, and a word at distance 3 from it has five more at distance 4. Taking all codewords within distance 4 (one or
six), two words at distance 2 or less always share one: the nearest codeword of a word midway is within 4 of both.
So 6 ordered pairs of segments give 6 to 36 keys, no link is missed, and equal keys are verified by bit count.

Copies collapse to one fingerprint before any key is made. A key's fingerprints are read as a sorted run, so no group of
documents meets in a task, only distinct fingerprints with 22 equal bits and a common codeword; a run of over RUN of
them is cut again by the codewords near its third segment, which is exact for the same reason.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltbed.llm.common import as_bytes, delete_stored, fresh, stored

#: The generator polynomial of the cyclic (23, 12) Golay code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GOLAY = 0b101011100011
#: Low bit and width of each segment.
SEGMENTS = ((42, 22), (21, 21), (0, 21))
#: A longer run of fingerprints with one key is cut by its third segment.
RUN = 512
SHINGLE_WORDS = 3
MAX_BITS = 2
#: Most bytes of doc_ids that are broadcast, and what one takes in a hash table.
BROADCAST_BYTES = 64 << 20
ID_BYTES = 32


def fingerprint(text: bytes | None) -> int:
    """The unsigned 64-bit fingerprint of a whole text."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    n = SHINGLE_WORDS
    if len(words) <= n:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[: -n] + 1)).tolist()
    hashes = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, ends[n - 1 :].tolist())), np.uint64, len(words) - n + 1)
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        block = hashes[at : at + 4096]
        total += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    bits = (2 * total > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def with_fingerprint(docs: DataFrame, out: str) -> DataFrame:
    """doc_id and the fingerprint as a signed long named out, one row for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t) for t in as_bytes(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", out])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, {out} long")


def _remainder(words: np.ndarray) -> np.ndarray:
    """Syndromes: remainders of 23-bit polynomials by GOLAY."""
    left = words.astype(np.int64).copy()
    for shift in range(11, -1, -1):
        left ^= np.where(left >> (shift + 11) & 1, GOLAY << shift, 0)
    return left


@cache
def _near() -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome, the error patterns of weight 4 or less, -1 filled, the lightest first; and how many."""
    patterns = [0]
    for _ in range(4):
        patterns = sorted({p | 1 << b for p in patterns for b in range(23)} | set(patterns))
    patterns = np.array(sorted(patterns, key=lambda p: (p.bit_count(), p)), np.int64)
    syndromes = _remainder(patterns)
    weight = np.array([int(p).bit_count() for p in patterns])
    table, count = np.full((2048, 6), -1, np.int64), np.zeros(2048, np.int64)
    for p, s, w in zip(patterns.tolist(), syndromes.tolist(), weight.tolist()):
        if w <= 3 or _first_weight(table, s) == 3:
            table[s, count[s]] = p
            count[s] += 1
    return table, count


def _first_weight(table: np.ndarray, syndrome: int) -> int:
    return int(table[syndrome, 0]).bit_count()


def codewords(words: np.ndarray) -> np.ndarray:
    """For each word of 23 bits or less, indices (0 to 4095) of the codewords within distance 4; -1 fills six columns."""
    errors = _near()[0][_remainder(words)]
    return np.where(errors < 0, -1, (words[:, None] ^ errors) >> 11)


def segment(fps: np.ndarray, k: int) -> np.ndarray:
    low, width = SEGMENTS[k]
    return (fps >> np.uint64(low)).astype(np.int64) & ((1 << width) - 1)


def keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of unsigned fingerprints, and the row of each: 3 bits for the ordered pair, 22 for i, 12 for j's codeword."""
    found, rows = [], []
    near = [codewords(segment(fps, k)) for k in range(3)]
    pair = 0
    for i in range(3):
        for j in range(3):
            if i != j:
                key = (np.int64(pair) << 34) | (segment(fps, i)[:, None] << 12) | near[j]
                r, c = np.nonzero(near[j] >= 0)
                found.append(key[r, c])
                rows.append(r)
                pair += 1
    return np.concatenate(found), np.concatenate(rows)


def _pairs(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows a < b of distinct fingerprints at MAX_BITS or fewer differing bits; blocks bound the memory."""
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for at in range(0, len(fps), RUN):
        d = np.bitwise_count(fps[at : at + RUN, None] ^ fps[None, at:])
        a, b = np.nonzero(d <= MAX_BITS)
        keep = a < b
        left.append(a[keep] + at)
        right.append(b[keep] + at)
    return np.concatenate(left), np.concatenate(right)


def links(fps: np.ndarray, pair: int) -> set[tuple[int, int]]:
    """Links that span the components among the fingerprints of one key."""
    if len(fps) <= RUN:
        found = zip(*_pairs(fps))
    else:
        third = ({0, 1, 2} - {pair // 2, [1, 2, 0, 2, 0, 1][pair]}).pop()
        near = codewords(segment(fps, third))
        r, c = np.nonzero(near >= 0)
        order = np.argsort(near[r, c], kind="stable")
        r, code = r[order], near[r, c][order]
        cuts = np.flatnonzero(np.diff(code)) + 1
        found = ((g[a], g[b]) for g in np.split(r, cuts) for a, b in zip(*_pairs(fps[g])))
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x

    out = set()
    for a, b in found:
        ra, rb = root(int(a)), root(int(b))
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
            x, y = int(fps[a].view(np.int64)), int(fps[b].view(np.int64))
            out.add((min(x, y), max(x, y)))
    return out


def _explode_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        for at in range(0, len(fps), 20_000):
            part = fps[at : at + 20_000]
            k, r = keys(part)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(part[r].view(np.int64))], ["k", "fp"])


def _link_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by key; a run that goes over a batch's end is carried to the next."""
    held_k, held_f = np.empty(0, np.int64), np.empty(0, np.int64)

    def out(k: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
        found: set[tuple[int, int]] = set()
        starts = np.concatenate(([0], np.flatnonzero(np.diff(k)) + 1)) if len(k) else np.empty(0, np.int64)
        ends = np.concatenate((starts[1:], [len(k)])) if len(k) else starts
        for a, b in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist()):
            found |= links(np.unique(f[a:b]).view(np.uint64), int(k[a] >> 34))
        pairs = sorted(found)
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["a", "b"])

    for batch in batches:
        k = np.concatenate((held_k, batch.column(0).to_numpy(zero_copy_only=False)))
        f = np.concatenate((held_f, batch.column(1).to_numpy(zero_copy_only=False)))
        if not len(k):
            continue
        cut = int(np.searchsorted(k, k[-1], "left"))
        yield out(k[:cut], f[:cut])
        held_k, held_f = k[cut:], f[cut:]
    yield out(held_k, held_f)


def close_links(fps: DataFrame) -> DataFrame:
    """Links (a < b) between the distinct signed fingerprints fp of fps; they span every component of the full relation."""
    return fps.select("fp").mapInArrow(_explode_keys, "k long, fp long").repartition(F.col("k")).sortWithinPartitions("k").mapInArrow(_link_runs, "a long, b long").distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether each u has one v, and no v is a u: then every component is a star around its smallest node."""
    nodes = edges.groupBy("u").agg(F.count("*").alias("n"))
    roots = edges.select(F.col("v").alias("u"), F.lit(1).alias("root")).distinct()
    found = nodes.join(roots, "u", "left").agg(F.max("n"), F.count("root")).first()
    return (found[0] or 1) == 1 and found[1] == 0


def components(edges: DataFrame, label: str = "links") -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b); root is the smallest node that can be reached.

    Alternating large-star and small-star steps; each step is a table in the shared folder. Joins, not groups, so that
    a node with very many links is split among tasks.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), label)
    while not _stars(now):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stored(large, label)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("x"), "m").union(least.select(F.col("u").alias("x"), "m")).where("x <> m").distinct().select(F.col("x").alias("u"), F.col("m").alias("v"))
        after = stored(small, label)
        for old in (now, large):
            delete_stored(old)
        now = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint and component_id of every row of docs (doc_id, text; other columns are ignored).

    component_id is the smallest doc_id that can be reached over links, the row's own included. Null and empty texts have
    fingerprint zero. Repeated rows and ties give a row each with equal values; an empty table gives no rows. A null
    doc_id never becomes a component_id unless the component has no other.
    """
    rows = stored(with_fingerprint(docs, "fp"), "fingerprints")
    reps = rows.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    linked = components(close_links(reps))
    own = reps.join(linked, reps.fp == linked.node, "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    least = own.groupBy("root").agg(F.min("rep").alias("component_id"))
    final = own.join(least, "root").select(F.col("fp").alias("f"), "component_id")
    hex16 = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return rows.join(final, rows.fp == final.f).select("doc_id", hex16.alias("fingerprint"), "component_id")


def joined_ids(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """docs joined (left_semi or left_anti) to a table of one column of doc_ids, which is broadcast if it takes at most
    BROADCAST_BYTES; that is counted."""
    name = fresh(docs, "gone")
    right = ids.toDF(name)
    small = right.agg(F.coalesce(F.sum(ID_BYTES + F.coalesce(F.octet_length(F.col(name).cast("string")), F.lit(0))), F.lit(0))).first()[0] <= BROADCAST_BYTES
    return docs.join(F.broadcast(right) if small else right, F.col("doc_id").eqNullSafe(F.col(name)), how)


def deduplicate(docs: DataFrame, groups: Callable[[DataFrame], DataFrame] = near_duplicates) -> DataFrame:
    """The rows of docs, one for each component of groups(docs): that of the smallest doc_id. All columns stay, by any names.

    groups gives doc_id and component_id of every row: near_duplicates, or similar.near_copies. Texts are not shuffled: the
    doc_ids that go are broadcast or joined (joined_ids). A doc_id that stays but occurs more than once keeps the row of the
    smallest hash of its text; rows with a null doc_id count as one doc_id. Null, empty and very long texts are texts as
    others; an empty table gives no rows.
    """
    rows = stored(groups(docs.select("doc_id", "text")).select("doc_id", "component_id"), "components")
    ids = rows.groupBy(F.col("doc_id").alias("gone")).agg(F.max(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("stays"), F.count("*").alias("n"))
    ids = stored(ids, "doc_ids")
    gone, again = ids.where(~F.col("stays")).select("gone"), ids.where("stays and n > 1").select("gone")
    kept = joined_ids(docs, gone, "left_anti")
    if not again.take(1):
        return kept
    place = fresh(docs, "place")
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64(F.col("text").cast("string")), F.col("text").cast("string")))
    one = joined_ids(kept, again, "left_semi").withColumn(place, rank).where(F.col(place) == 1).drop(place)
    return joined_ids(kept, again, "left_anti").unionByName(one)
