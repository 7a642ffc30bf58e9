"""Near copies by SimHash with Golay keys: documents whose sets of word shingles have a Jaccard similarity of SIMILARITY or more.

Two SimHash fingerprints of such documents differ in up to a sixth of their bits, too many for simhash's hard 2-bit rule, so
a sketch keeps BITS bits with their margins: how far each bit's shingles are from a tie. The first bits are TABLES groups of
SEGMENTS segments of 23 bits. Each segment is decoded to nearby words of the perfect Golay code as Chase decoders do: its
WEAK least sure bits are flipped in all ways, each result goes to its nearest codeword, and a codeword costs the margins of
the bits in which it differs. A group's key joins a codeword index of each of its segments; the KEYS cheapest joins are
its keys. Errors of two near copies fall on unsure bits first, so their lists meet: of random sets at a similarity of 0.8
just, one or more of the groups meets for 98 pairs in a hundred; above 0.85 for hardly fewer than all.

Documents with equal shingle sets are one node. Rows of equal keys are read as sorted runs; a node stays in a run if a
fingerprint of the run is plausibly near. Within a run, plausible nodes are paired with leaders: the node that is held by
the most runs takes its partners, the next one of those that are left goes on, and so on. As the middle of a group is
held by most runs, a group of near copies gives a few pairs a node, whatever its size. Each node's pair with the leader of
most runs is verified by the exact Jaccard similarity of the shingle sets, and true ones are joined to components; then
those of the other pairs whose ends are still apart. Then each node asks for the nearest plausible one of another
component in each of its runs; such pairs are verified too, until a round joins nobody.

Keys, plausible distances and nearest partners miss some pairs, so an exact search for what is still apart ends the work.
In any one order of all shingles, two sets of the similarity share a shingle among the first n - s + 1 of each (its prefix;
n: its shingles, s: the least that a partner shares with it). Each node's prefix shingles are dealt out by value; where nodes
of different components meet, a bound of the similarity that can't be too low leaves out pairs, and the others are verified.
Each round takes more of the pairs of a node, until a round has taken all. Shingles that are frequent in a sample come last in
the order, which keeps most of them out of the prefixes; the order changes the cost only.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltbed.llm.common import as_bytes, delete_stored, stored, trimmed
from siltbed.llm.simhash import BROADCAST_BYTES, ID_BYTES, _near, _remainder, components, joined_ids

SHINGLE_WORDS = 5
SIMILARITY = 0.8
LANES, BITS = 6, 384
TABLES, SEGMENTS, KEYS = 5, 3, 32
WEAK, LISTED = 6, 10
#: Differing bits that are plausible at SIMILARITY: the mean of 58 and 3.5 standard deviations; and for one lane of 64 bits.
FAR, LANE_FAR = 83, 20
#: Nodes of a run that are compared with all others at once.
BLOCK = 512
#: Pairs of whole fingerprints that are compared at once.
PAIRS = 1 << 18
#: Sketches that are decoded at once.
ROWS = 500
#: Nodes whose shingles are counted for the order of the exact search, the count from which one is frequent, and most of those.
SAMPLE_NODES, FREQUENT, FREQUENT_MOST = 4000, 3, 1 << 16
#: Parts at least that prefixes are dealt to, about how many shingles one holds, and how many are dealt at once.
PARTS, PART, DEALT = 256, 1 << 19, 1 << 17
#: Rows that Spark hands to Python at once.
BATCH_ROWS = 1000
#: Pairs a node of each run of over SHORT rows of the exact search in its first round, which takes all pairs of shorter runs; each
#: round takes MORE times as many as the last. Rows of short runs that are compared at once.
FIRST, MORE, SHORT, SHORT_ROWS = 16, 8, 64, 4000
#: Most edges whose components are found on the driver: in numpy, 16 bytes each.
LOCAL_EDGES = 1 << 18
_MIX = np.array([xxhash.xxh64_intdigest(bytes([lane])) | 1 for lane in range(LANES)], np.uint64)


def shingle_set(text: bytes | None, words: int = SHINGLE_WORDS) -> np.ndarray:
    """The distinct XXH64 values (seed 42) of a whole text's shingles, sorted; fewer words are one shingle, none give none."""
    ws = (text or b"").lower().split()
    if not ws:
        return np.empty(0, np.uint64)
    joined, digest = b" ".join(ws), xxhash.xxh64_intdigest
    if len(ws) <= words:
        return np.array([digest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1) - 1
    starts = np.concatenate(([0], ends[:-words] + 1)).tolist()
    return np.unique(np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, ends[words - 1 :].tolist())), np.uint64, len(ws) - words + 1))


def node_of(shingles: np.ndarray) -> int:
    """A signed 64-bit name of a shingle set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes(), 7)).view(np.int64))


def sums(shingles: np.ndarray) -> np.ndarray:
    """For each of BITS hashed bits, twice the shingles that set it less their number."""
    total = np.zeros(BITS, np.int64)
    for at in range(0, len(shingles), 4096):
        block = shingles[at : at + 4096, None] ^ (shingles[at : at + 4096, None] >> np.uint64(29))
        block = block * _MIX
        block ^= block >> np.uint64(32)
        total += np.unpackbits(block.view(np.uint8).reshape(len(block), -1), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return 2 * total - len(shingles)


@cache
def _nearest() -> np.ndarray:
    """The error pattern of the nearest codeword by syndrome."""
    return _near()[0][:, 0].copy()


@cache
def _syndromes() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of the low 12 bits and of the high 11 bits of a word."""
    return _remainder(np.arange(1 << 12, dtype=np.int64)), _remainder(np.arange(1 << 11, dtype=np.int64) << 12)


def decoded(margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codeword indices and costs (rows of LISTED, the cheapest first) of rows of 23 signed margins; an absent one costs inf."""
    rows = np.arange(len(margins))
    size = np.abs(margins).astype(np.float32)
    word = ((margins > 0).astype(np.int64) << np.arange(23)).sum(axis=1)
    weak = np.argsort(size, axis=1, kind="stable")[:, :WEAK]
    flips = (np.arange(1 << WEAK)[:, None] >> np.arange(WEAK)) & 1
    tried = word[:, None] ^ ((np.int64(1) << weak) @ flips.T)
    low, high = _syndromes()
    code = tried ^ _nearest()[low[tried & 4095] ^ high[tried >> 12]]
    wrong = ((code ^ word[:, None])[:, :, None] >> np.arange(23)) & 1
    cost = np.einsum("dkb,db->dk", wrong.astype(np.float32), size)
    index = code >> 11
    order = np.argsort(index, axis=1, kind="stable")
    index, cost = np.take_along_axis(index, order, 1), np.take_along_axis(cost, order, 1)
    cost[:, 1:][index[:, 1:] == index[:, :-1]] = np.inf
    order = np.argsort(cost, axis=1, kind="stable")[:, :LISTED]
    return index[rows[:, None], order], cost[rows[:, None], order]


def keys(total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of rows of sums(), and the row of each: 3 bits for the table, 12 for each segment's codeword."""
    found, rows = [], []
    for table in range(TABLES):
        key, cost = np.full((len(total), 1), table, np.int64), np.zeros((len(total), 1), np.float32)
        for s in range(SEGMENTS):
            at = 23 * (table * SEGMENTS + s)
            index, c = decoded(total[:, at : at + 23])
            key = ((key[:, :, None] << 12) | index[:, None, :]).reshape(len(total), -1)
            cost = (cost[:, :, None] + c[:, None, :]).reshape(len(total), -1)
        best = np.argsort(cost, axis=1, kind="stable")[:, :KEYS]
        ok = np.isfinite(np.take_along_axis(cost, best, 1))
        r, k = np.nonzero(ok)
        found.append(np.take_along_axis(key, best, 1)[r, k])
        rows.append(r)
    return np.concatenate(found), np.concatenate(rows)


def parity(shingles: np.ndarray) -> bytes:
    """A bit for each remainder of the shingles by a power of two that is n at least: whether an odd number of them has it."""
    bits = max(256, 1 << (len(shingles) - 1).bit_length()) if len(shingles) else 256
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


@trimmed
def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, node, n, margins, odd): margins are the sums cut to 16 bits, a 16-bit number each; odd is the parity()."""
    for batch in batches:
        made = [shingle_set(t) for t in as_bytes(batch.column(1))]
        margins = [np.clip(sums(s), -32767, 32767).astype("<i2").tobytes() for s in made]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([node_of(s) for s in made], pa.int64()), pa.array([len(s) for s in made], pa.int64()), pa.array(margins, pa.binary()), pa.array([parity(s) for s in made], pa.binary())],
            ["doc_id", "node", "n", "margins", "odd"],
        )


def _margins(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i2").reshape(-1, BITS)


def _lanes(margins: np.ndarray) -> np.ndarray:
    """Fingerprints as LANES unsigned longs a row."""
    return np.packbits(margins > 0, axis=1, bitorder="little").view(np.uint64).reshape(-1, LANES)


@trimmed
def _explode_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k, node, lane): lane is the fingerprint's last 64 bits."""
    for batch in batches:
        node = batch.column(0).to_numpy(zero_copy_only=False)
        for at in range(0, len(node), ROWS):
            margins = _margins(batch.column(1).slice(at, ROWS))
            k, r = keys(margins)
            lane = _lanes(margins)[:, -1].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(node[at : at + ROWS][r]), pa.array(lane[r])], ["k", "node", "lane"])


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """Runs of two or more rows with equal k of sorted batches, as columns; a run may go over the ends of batches."""
    held: list[dict[str, np.ndarray]] = []

    def whole() -> dict[str, np.ndarray]:
        return {c: np.concatenate([h[c] for h in held]) for c in held[0]}

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = {c: batch.column(i).to_numpy(zero_copy_only=False) for i, c in enumerate(batch.schema.names)}
        k = cols["k"]
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(k)) + 1, [len(k)]))
        if held and held[-1]["k"][-1] != k[0]:
            if sum(len(h["k"]) for h in held) > 1:
                yield whole()
            held = []
        if len(cuts) > 2:
            first = {c: v[: cuts[1]] for c, v in cols.items()}
            held.append(first)
            if sum(len(h["k"]) for h in held) > 1:
                yield whole()
            held = []
            long = np.flatnonzero(np.diff(cuts[1:-1]) > 1) + 1
            for a, b in zip(cuts[long].tolist(), cuts[long + 1].tolist()):
                yield {c: v[a:b] for c, v in cols.items()}
            held = [{c: v[cuts[-2] :] for c, v in cols.items()}]
        else:
            held.append(cols)
    if held and sum(len(h["k"]) for h in held) > 1:
        yield whole()


@trimmed
def _plausible_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k, node) of rows that have a partner in their run by one lane; runs of over 8 BLOCK rows go on whole."""
    for run in runs(batches):
        lane, n = run["lane"].view(np.uint64), len(run["k"])
        near = np.ones(n, bool)
        if n <= 8 * BLOCK:
            near[:] = False
            for at in range(0, n, BLOCK):
                close = np.bitwise_count(lane[at : at + BLOCK, None] ^ lane[None, :]) <= LANE_FAR
                near[at : at + BLOCK] = close.sum(axis=1) > 1
        if near.any():
            yield pa.RecordBatch.from_arrays([pa.array(run["k"][near]), pa.array(run["node"][near])], ["k", "node"])


def _distances(lanes: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Differing bits of rows a from rows b, or BITS where they are no plausible near copies: shape (len(a), len(b))."""
    d = np.bitwise_count(lanes[a][:, None, :] ^ lanes[b][None, :, :]).sum(axis=2, dtype=np.int64)
    small, large = np.minimum(n[a][:, None], n[b][None, :]), np.maximum(n[a][:, None], n[b][None, :])
    return np.where((d <= FAR) & (small >= similarity * large), d, BITS)


def leader_pairs(lanes: np.ndarray, n: np.ndarray, first: np.ndarray, similarity: float = SIMILARITY) -> Iterator[tuple[int, int]]:
    """Plausible pairs (leader, other) of a run's rows: the first row by the order first takes all that are plausible, the first
    of those that are left goes on; each row is taken once at most."""
    left = first
    while len(left) > 1:
        leader, left = left[0], left[1:]
        near = _distances(lanes, n, np.array([leader]), left, similarity)[0] < BITS
        yield from ((int(leader), x) for x in left[near].tolist())
        left = left[~near]


def partnered(lanes: np.ndarray, n: np.ndarray, pairs: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """Whether each of a run's rows has a plausible partner in it; pairs are leader_pairs(), whose rows have one."""
    out = np.zeros(len(n), bool)
    out[pairs.ravel()] = True
    rest, every = np.flatnonzero(~out), np.arange(len(n))
    step = max(1, PAIRS // len(n))
    for at in range(0, len(rest), step):
        a = rest[at : at + step]
        out[a] = (_distances(lanes, n, a, every, similarity) < BITS).sum(axis=1) > 1
    return out


def nearest_pairs(lanes: np.ndarray, n: np.ndarray, root: np.ndarray, similarity: float = SIMILARITY) -> Iterator[tuple[int, int]]:
    """Each of a run's rows with the nearest plausible row of another root; rows of the most frequent root are asked by others."""
    names, size = np.unique(root, return_counts=True)
    if len(names) < 2:
        return
    every, rest = np.arange(len(n)), np.flatnonzero(root != names[size.argmax()])
    step = max(1, PAIRS // len(n))
    for at in range(0, len(rest), step):
        a = rest[at : at + step]
        d = np.where(root[a][:, None] == root[None, :], BITS, _distances(lanes, n, a, every, similarity))
        best = d.argmin(axis=1)
        ok = d[np.arange(len(a)), best] < BITS
        yield from zip(a[ok].tolist(), best[ok].tolist())


def _led(similarity: float):
    """The rows that have a plausible partner in their run, with the leader that takes each (or none) and the leader's held_by."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in runs(batches):
            lanes = np.stack([r[f"w{i}"] for i in range(LANES)], axis=1).view(np.uint64)
            at = np.array(list(leader_pairs(lanes, r["n"], np.lexsort((r["node"], -r["held_by"])), similarity)), np.int64).reshape(-1, 2)
            near = partnered(lanes, r["n"], at, similarity)
            if near.any():
                leader = np.full(len(near), -1)
                leader[at[:, 1]] = at[:, 0]
                leader = leader[near]
                none = leader < 0
                columns = [pa.array(r[c][near]) for c in ("k", "node", "n", *(f"w{i}" for i in range(LANES)))]
                columns += [pa.array(r[c][leader], mask=none) for c in ("node", "held_by")]
                yield pa.RecordBatch.from_arrays(columns, ["k", "node", "n", *(f"w{i}" for i in range(LANES)), "leader", "by"])

    return run


def _crossing(similarity: float):
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in runs(batches):
            lanes = np.stack([r[f"w{i}"] for i in range(LANES)], axis=1).view(np.uint64)
            at = np.array(list(nearest_pairs(lanes, r["n"], r["root"], similarity)), np.int64).reshape(-1, 2)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(r["node"][at[:, 0]]), pa.array(r["node"][at[:, 1]])], ["a", "b"])

    return run


def _either_way(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _apart(pairs: DataFrame, linked: DataFrame) -> DataFrame:
    """The pairs (a, b) that linked (node, root) doesn't join."""
    for end in "ab":
        pairs = pairs.join(linked.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}")), end, "left")
    return pairs.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")


def _joined(more: DataFrame, linked: DataFrame | None) -> DataFrame:
    """Edges whose components are those of linked (node, root) joined by the pairs (a, b) of more."""
    return more if linked is None else more.union(linked.where("node <> root").select("node", "root"))


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges, and the smallest node that each can reach."""
    names, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    a, b = ends.reshape(2, -1)
    root = np.arange(len(names))
    while len(open_ := np.flatnonzero(root[a] != root[b])):
        a, b = a[open_], b[open_]
        x, y = root[a], root[b]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    return names, names[root]


def _components(edges: DataFrame) -> DataFrame:
    """components() of edges; up to LOCAL_EDGES are joined on the driver, which spares the tables and stages of each step."""
    edges = edges.where("a <> b")
    if edges.count() > LOCAL_EDGES:
        return components(edges)
    found = edges.toArrow()
    names, root = roots(*(found.column(c).to_numpy() for c in "ab"))
    table = pa.table([pa.array(names, pa.int64()), pa.array(root, pa.int64())], ["node", "root"])
    return stored(edges.sparkSession.createDataFrame(table, "node long, root long").coalesce(1), "roots")


@trimmed
def _lane_columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lanes = _lanes(_margins(batch.column(2))).view(np.int64) if batch.num_rows else np.empty((0, LANES), np.int64)
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(np.ascontiguousarray(lanes[:, i])) for i in range(LANES))], ["node", "n", *(f"w{i}" for i in range(LANES))])


@trimmed
def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [shingle_set(t) for t in as_bytes(batch.column(0))]
        yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in made], pa.int64()), pa.array([s.view(np.int64) for s in made], pa.list_(pa.int64()))], ["node", "shingles"])


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets have the similarity. Sets of other nodes stay where they are: the nodes of the pairs
    are broadcast if they take at most BROADCAST_BYTES, or joined first."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = sets.join(F.broadcast(ends) if ends.count() * ID_BYTES <= BROADCAST_BYTES else ends, "node", "left_semi")
    left, right = (sets.select(F.col("node").alias(c), F.col("shingles").alias(f"{c}_set")) for c in "ab")
    shared = F.size(F.array_intersect("a_set", "b_set"))
    return pairs.join(left, "a").join(right, "b").where(shared / (F.size("a_set") + F.size("b_set") - shared) >= similarity).select("a", "b")


def prefix(shingles: np.ndarray, similarity: float, frequent: np.ndarray | None = None, times: np.ndarray | None = None) -> np.ndarray:
    """The first shingles of a sorted set, as many as a set of the similarity shares one of at least, in the order of times (0 for
    shingles that aren't among frequent, which is sorted), then of value."""
    n = len(shingles)
    least = max(1, int(np.ceil(similarity * n)) - 1)
    while least / max(1, n) < similarity:
        least += 1
    if n and frequent is not None and len(frequent):
        at = np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)
        shingles = shingles[np.argsort(np.where(frequent[at] == shingles, times[at], 0), kind="stable")]
    return shingles[: max(0, n - least + 1)]


def _prefixes(similarity: float, frequent: np.ndarray, times: np.ndarray):
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = {}
            for text in as_bytes(batch.column(0)):
                if len(s := shingle_set(text)):
                    made.setdefault(node_of(s), s)
            first = [prefix(s, similarity, frequent, times).tobytes() for s in made.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(made), pa.int64()), pa.array(first, pa.binary())], ["node", "first"])

    return run


def _dealt(parts: int):
    """Rows (node, first, root) as (part, token, node, root): packed columns of the shingles of a part; a root is its difference from node."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def out() -> pa.RecordBatch:
            token, node, root = (np.concatenate(c) for c in zip(*held))
            mixed = token * _MIX[0]
            part = ((mixed >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
            order = np.argsort(part, kind="stable")
            part, token, node, root = part[order], mixed[order].astype(np.uint32), node[order], root[order]
            starts = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1)) if len(part) else np.empty(0, np.int64)
            ends = [*starts[1:].tolist(), len(part)]
            packed = [pa.array([c[a:b].tobytes() for a, b in zip(starts.tolist(), ends)], pa.binary()) for c in (token, node, root)]
            return pa.RecordBatch.from_arrays([pa.array(part[starts].astype(np.int64)), *packed], ["k", "token", "node", "root"])

        for batch in batches:
            nodes, roots = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
            for first, node, root in zip(batch.column(1).to_pylist(), nodes, roots):
                token = np.frombuffer(first, np.uint64)
                held.append((token, np.full(len(token), node), np.full(len(token), node ^ root)))
                size += len(token)
                if size >= DEALT:
                    yield out()
                    held.clear()
                    size = 0
        if held:
            yield out()

    return run


@trimmed
def _meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k, node, size) of nodes that share a prefix shingle with a node of another root, of batches of _dealt() sorted by k; size is
    the number of rows of equal k."""
    held: list[tuple[int, bytes, bytes, bytes]] = []

    def out() -> Iterator[pa.RecordBatch]:
        token, node, root = (np.frombuffer(b"".join(c), kind) for c, kind in zip(list(zip(*held))[1:], (np.uint32, np.int64, np.int64)))
        order = np.argsort(token, kind="stable")
        token = token[order]
        same = token[1:] == token[:-1]
        more = np.flatnonzero(np.concatenate((same, [False])) | np.concatenate(([False], same)))
        if not len(more):
            return
        token, node, root = token[more], node[order[more]], root[order[more]] ^ node[order[more]]
        starts = np.concatenate(([0], np.flatnonzero(np.diff(token)) + 1))
        apart = np.minimum.reduceat(root, starts) != np.maximum.reduceat(root, starts)
        keep = np.repeat(apart, np.diff(np.concatenate((starts, [len(token)]))))
        rows = np.unique(np.stack([(np.int64(held[0][0]) << 32) | token[keep].astype(np.int64), node[keep]], axis=1), axis=0)
        size = np.unique(rows[:, 0], return_inverse=True, return_counts=True)
        rows = np.column_stack((rows, size[2][size[1]]))
        for at in range(0, len(rows), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[at : at + 100_000, i])) for i in range(3)], ["k", "node", "size"])

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and held[-1][0] != row[0]:
                yield from out()
                held.clear()
            held.append(row)
    if held:
        yield from out()


def _folded(odd: np.ndarray, words: int) -> np.ndarray:
    """parity() of the same sets (rows of unsigned longs) with fewer words."""
    while odd.shape[1] > words:
        half = odd.shape[1] // 2
        odd = odd[:, :half] ^ odd[:, half:]
    return odd


def _classes(odd: np.ndarray) -> tuple[dict[int, np.ndarray], dict[int, np.ndarray]]:
    """The rows of equal length of parity(), and their unsigned longs, by the number of these."""
    words = np.array([len(x) // 8 for x in odd])
    classes = {w: np.flatnonzero(words == w) for w in np.unique(words).tolist()}
    return classes, {w: np.frombuffer(b"".join(odd[rows]), np.uint64).reshape(-1, w) for w, rows in classes.items()}


def short_pairs(k: np.ndarray, node: np.ndarray, n: np.ndarray, root: np.ndarray, odd: np.ndarray, similarity: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows of equal k (sorted) and different roots that can have the similarity, each pair of nodes once; as open_pairs()."""
    one, place = np.unique(node, return_index=True, return_inverse=True)[1:]
    codes, by = [np.empty(0, np.int64)], 1
    while by < len(k) and len(i := np.flatnonzero(k[by:] == k[:-by])):
        j = i + by
        ok = (root[i] != root[j]) & (np.minimum(n[i], n[j]) / np.maximum(n[i], n[j]) >= similarity)
        i, j = place[i[ok]], place[j[ok]]
        codes.append(np.minimum(i, j) * len(one) + np.maximum(i, j))
        by += 1
    a, b = np.divmod(np.unique(np.concatenate(codes)), len(one))
    n, classes, bits = n[one], *_classes(odd[one])
    kind, at = np.zeros(len(one), np.int64), np.zeros(len(one), np.int64)
    for w, rows in classes.items():
        kind[rows], at[rows] = w, np.arange(len(rows))
    keep = np.zeros(len(a), bool)
    for w in classes:
        for v in classes:
            some, m = np.flatnonzero((kind[a] == w) & (kind[b] == v)), min(w, v)
            for s in range(0, len(some), max(1, PAIRS // max(w, v))):
                pairs = some[s : s + max(1, PAIRS // max(w, v))]
                x, y = a[pairs], b[pairs]
                d = np.bitwise_count(_folded(bits[w][at[x]], m) ^ _folded(bits[v][at[y]], m)).sum(axis=1, dtype=np.int64)
                keep[pairs] = (n[x] + n[y] - d) / (n[x] + n[y] + d) >= similarity
    return one[a[keep]], one[b[keep]]


def open_pairs(n: np.ndarray, root: np.ndarray, odd: np.ndarray, most: int, similarity: float = SIMILARITY) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs (a, b) of a run's rows of different roots that can have the similarity: of each row a the likeliest ones, most at most, and
    whether it has others. Rows of the most frequent root are asked by others.

    Sets that differ in d shingles differ in d bits of their parity() at most, so total less d over total and d is no less than
    the similarity; nor is the smaller size over the larger one."""
    names, size = np.unique(root, return_counts=True)
    if len(names) < 2:
        return
    classes, bits = _classes(odd)
    asks = root != names[size.argmax()]
    step = max(1, PAIRS // len(n))
    for w, rows in classes.items():
        mine = np.flatnonzero(asks[rows])
        for at in range(0, len(mine), step):
            a, found = rows[mine[at : at + step]], []
            for v, b in classes.items():
                small, large = np.minimum(n[a][:, None], n[b][None, :]), np.maximum(n[a][:, None], n[b][None, :])
                bound = np.where(root[a][:, None] != root[b][None, :], small / large, 0)
                if bound.max() < similarity:
                    continue
                x, y = _folded(bits[w][mine[at : at + step]], min(w, v)), _folded(bits[v], min(w, v))
                d = np.zeros(bound.shape, np.int64)
                for i in range(min(w, v)):
                    d += np.bitwise_count(x[:, i, None] ^ y[None, :, i])
                bound = np.minimum(bound, (small + large - d) / (small + large + d))
                r, c = np.nonzero(bound >= similarity)
                found.append((r, b[c], bound[r, c]))
            if found:
                r, b, bound = (np.concatenate(c) for c in zip(*found))
                order = np.lexsort((b, -bound, r))
                r, b = r[order], b[order]
                starts = np.searchsorted(r, np.arange(len(a)))
                near = np.arange(len(r)) - starts[r] < most
                cut = np.bincount(r, minlength=len(a)) > most
                yield a[r[near]], b[near], cut[r[near]]


def _open(similarity: float, most: int):
    def row(node: np.ndarray, a: np.ndarray, b: np.ndarray, cut: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b]), pa.array(cut)], ["a", "b", "cut"])

    def short(held: list[dict[str, np.ndarray]]) -> pa.RecordBatch:
        r = {c: np.concatenate([h[c] for h in held]) for c in held[0]}
        a, b = short_pairs(r["k"], r["node"], r["n"], r["root"], r["odd"], similarity)
        return row(r["node"], a, b, np.zeros(len(a), bool))

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for r in runs(batches):
            if len(r["k"]) > SHORT:
                for a, b, cut in open_pairs(r["n"], r["root"], r["odd"], most, similarity):
                    yield row(r["node"], a, b, cut)
            elif most == FIRST:
                held.append(r)
                size += len(r["k"])
                if size >= SHORT_ROWS:
                    yield short(held)
                    held, size = [], 0
        if held:
            yield short(held)

    return run


@contextmanager
def _lean(spark: SparkSession) -> Iterator[None]:
    """Within, shuffle files go with the action that wrote them (they would stay until the driver's collector finds them), and
    Python gets BATCH_ROWS at once."""
    wanted = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS)}
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def near_copies(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id and component_id of every row of docs (doc_id, text; other columns are ignored).

    component_id is the smallest doc_id that can be reached over pairs whose sets of 5-word shingles (A-Z lower-cased, words
    as in simhash; fewer words: the whole sequence) have the Jaccard similarity. Every pair that is joined has it exactly, and
    every pair that has it is joined: most are found by Golay keys, those that keys miss by shared prefix shingles (see above;
    shingles and sets are told apart by 64-bit hashes). Null and empty texts have no shingles and are copies of each other.
    Texts of any length count whole. Repeated rows and ties give a row each with equal values; an empty table gives no rows. A
    null doc_id never becomes a component_id unless there is no other.
    """
    with _lean(docs.sparkSession):
        return _near_copies(docs, similarity)


def _near_copies(docs: DataFrame, similarity: float) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    source = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    rows = stored(source.mapInArrow(_sketches, f"doc_id {kind}, node long, n long, margins binary, odd binary"), "sketches")
    full = stored(rows.groupBy("node").agg(F.min("doc_id").alias("rep"), *(F.first(c).alias(c) for c in ("n", "margins", "odd"))), "nodes")
    ids = stored(rows.select("doc_id", "node"), "ids")
    delete_stored(rows)
    keyed = full.where("n > 0").select("node", "margins").mapInArrow(_explode_keys, "k long, node long, lane long")
    keyed = stored(keyed.repartition(F.col("k")).sortWithinPartitions("k").mapInArrow(_plausible_rows, "k long, node long"), "keys")
    held = stored(keyed.groupBy("node").agg(F.count("*").alias("held_by")), "held")
    wide = ", ".join(f"w{i} long" for i in range(LANES))
    lanes = full.where("n > 0").join(held, "node", "left_semi").select("node", "n", "margins").mapInArrow(_lane_columns, f"node long, n long, {wide}")
    wide_rows = keyed.join(lanes.join(held, "node"), "node").repartition(F.col("k")).sortWithinPartitions("k")
    near = stored(wide_rows.mapInArrow(_led(similarity), f"k long, node long, n long, {wide}, leader long, by long"), "near")
    nodes = stored(full.drop("margins"), "nodes")
    live = nodes.where("n > 0")
    for old in (full, keyed, held):
        delete_stored(old)
    led = stored(near.where("leader is not null").select(F.col("leader").alias("a"), F.col("node").alias("b"), "by").distinct(), "pairs")
    paired = stored(near.select("node").distinct(), "paired")
    again = bool(ids.groupBy("doc_id").count().where("count > 1").take(1))

    def sets_of(some: DataFrame) -> DataFrame:
        texts = joined_ids(source, live.join(some, "node", "left_semi").select("rep"), "left_semi").select("text")
        sets = texts.mapInArrow(_sets, "node long, shingles array<bigint>").join(some, "node", "left_semi")
        return sets.dropDuplicates(["node"]) if again else sets  # else each rep is one row

    sets = stored(sets_of(paired), "sets")
    scratch = [near, led, paired, sets]
    kept = [ids, nodes]
    tested = linked = None
    turn = 0
    while True:
        if turn == 0:  # each node with the leader that most runs hold
            asked = _either_way(led.groupBy("b").agg(F.max(F.struct("by", "a")).alias("top")).select(F.col("top.a").alias("a"), "b"))
        elif turn == 1:  # its other leaders, where those left it apart
            asked = _either_way(_apart(led, linked)).join(tested, ["a", "b"], "left_anti")
        else:
            rooted = near.drop("leader", "by").join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
            across = rooted.repartition(F.col("k")).sortWithinPartitions("k").mapInArrow(_crossing(similarity), "a long, b long")
            asked = _either_way(across).join(tested, ["a", "b"], "left_anti")
        asked = stored(asked, "asked")
        more = stored(verified(asked, sets, similarity), "links")
        kept += [asked, more]
        found = bool(more.take(1))
        tested = asked if turn == 0 else tested.union(asked)
        if found or turn == 0:
            linked = _components(_joined(more, linked))
        elif turn > 1:
            break
        turn += 1
    for old in scratch:
        delete_stored(old)

    met = _met(source, sets_of, live, linked, similarity)
    kept.append(met)
    most = FIRST
    while True:  # what keys have missed
        rooted = (met if most == FIRST else met.where(F.col("size") > SHORT)).drop("size").join(live.select("node", "n", "odd"), "node").join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
        across = stored(rooted.repartition(F.col("k")).sortWithinPartitions("k").mapInArrow(_open(similarity, most), "a long, b long, cut boolean"), "across")
        asked = stored(_either_way(across).join(tested, ["a", "b"], "left_anti"), "asked")
        kept += [across, asked]
        if asked.take(1):
            sets = stored(sets_of(asked.select(F.explode(F.array("a", "b")).alias("node")).distinct()), "sets")
            more = stored(verified(asked, sets, similarity), "links")
            delete_stored(sets)
            kept.append(more)
            tested = tested.union(asked)
            if more.take(1):
                linked = _components(_joined(more, linked))
        if not across.where("cut").take(1):
            break
        most *= MORE
    own = nodes.join(linked, "node", "left").select("node", "rep", F.coalesce("root", "node").alias("root"))
    least = own.groupBy("root").agg(F.min("rep").alias("component_id"))
    out = stored(ids.join(own.join(least, "root").select("node", "component_id"), "node").select("doc_id", "component_id"), "near-copies")
    for old in kept:
        delete_stored(old)
    return out


def _met(source: DataFrame, sets_of, live: DataFrame, linked: DataFrame, similarity: float) -> DataFrame:
    """(k, node, size): runs of nodes that share a prefix shingle, of those that hold nodes of two components or more; see _meeting()."""
    n, shingles = live.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    sample = live.where(F.pmod("node", F.lit(max(1, n // SAMPLE_NODES))) == 0).select("node")
    counts = sets_of(sample).select(F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("times"))
    top = sorted((np.uint64(r.s & (1 << 64) - 1), r.times) for r in counts.where(F.col("times") >= FREQUENT).orderBy(F.desc("times"), "s").limit(FREQUENT_MOST).collect())
    frequent, times = np.array([s for s, _ in top], np.uint64), np.array([t for _, t in top], np.int64)
    small = linked.count() * 2 * ID_BYTES <= BROADCAST_BYTES
    first = stored(source.select("text").mapInArrow(_prefixes(similarity, frequent, times), "node long, first binary"), "first")
    rooted = first.join(F.broadcast(linked) if small else linked, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    parts = max(PARTS, int(shingles * (1 - similarity)) // PART)
    dealt = rooted.mapInArrow(_dealt(parts), "k long, token binary, node binary, root binary")
    met = stored(dealt.repartition(F.col("k")).sortWithinPartitions("k").mapInArrow(_meeting, "k long, node long, size long"), "met")
    delete_stored(first)
    return met
