"""Benchmark decontamination by suffix arrays over shards of the training text.

Words are runs of 0-9, a-z and non-ASCII characters of a text whose A-Z are lower-cased. A window is WINDOW consecutive
words of a benchmark item; an item of fewer words, but not none, is one window. A document word inside any occurrence of
a window is hit.

Each task turns its documents into shards of token ids. Words that no item has become separators, and a suffix counts
only if it starts a run of item words as long as the shortest window: no other suffix can hold a match, so the suffix
array of a shard stays small and whole. It is sorted by the first WINDOW tokens. The items' suffixes are sorted once, on
the driver, as an array of positions; the two sorted arrays meet by binary search, every test suffix in the shard's array
or, where those are more, every distinct training suffix in theirs. Each meeting of a test position and a training
position lies on a diagonal; meetings that follow each other on one are one longest verbatim match of WINDOW words or
more, told with its item and both places. Matches that overlap or touch join into spans, which give the hit words.
Documents go through without a shuffle.

Benchmark items are the stated query set; they are read to the driver in blocks of BLOCK_BYTES, so that a benchmark of
any size passes, block after block, over the same rows. A worker keeps a block's words as a dict and some 12 bytes a word.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltbed.llm.common import as_bytes, fresh

WINDOW = 10
#: Most bytes of benchmark text that are broadcast at once.
BLOCK_BYTES = 32 << 20
#: Words of a shard; a longer document is a shard of its own.
SHARD_WORDS = 1 << 18
#: Test suffixes that are searched, and meetings that are expanded, at once.
CHUNK = 1 << 18
#: Bytes that are part of words once A-Z are lower-cased; the others become spaces.
_WORD = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_WORD).split()


class Items:
    """A block of items: their token ids in one array, closed by 0 each, and the sorted array of their suffixes.

    order holds the positions of suffixes of window tokens or more within their item, sorted by their first window tokens;
    short holds each item of fewer tokens. Both are token positions, and item_at tells a position's item.
    """

    def __init__(self, items: list[tuple[object, bytes | None]], window: int):
        self.window, self.name = window, uuid.uuid4().hex
        ids: dict[bytes, int] = {}
        self.ids, self.starts, parts, short, size = [], [], [], [], 0
        for item, text in items:
            tokens = np.array([ids.setdefault(w, len(ids) + 1) for w in words(text)], np.uint32)
            if not len(tokens):
                continue
            if len(tokens) < window:
                short.append((size, len(tokens)))
            self.ids.append(None if item is None else str(item))
            self.starts.append(size)
            parts += [tokens, np.zeros(1, np.uint32)]
            size += len(tokens) + 1
        self.words = list(ids)
        self.tokens = np.concatenate([*parts, np.zeros(window, np.uint32)])
        self.starts = np.array(self.starts, np.int64)
        self.short = np.array(short, np.int64).reshape(-1, 2)
        whole = np.flatnonzero(_runs(self.tokens) >= window)
        order = whole[np.argsort(self.heads(whole), kind="stable")]
        self.order = order.astype(np.uint32)
        # suffixes with equal heads are one test suffix: groups[g] to groups[g + 1] are its places in order
        new = np.ones(len(order), bool)
        for at in range(0, len(order) - 1, CHUNK):
            h = self.heads(order[at : at + CHUNK + 1])
            new[at + 1 : at + len(h)] = h[1:] != h[:-1]
        self.groups = np.append(np.flatnonzero(new), len(order)).astype(np.int64)
        self.least = min([window] * bool(len(order)) + self.short[:, 1].tolist(), default=0)

    def heads(self, at: np.ndarray) -> np.ndarray:
        """The first window tokens of suffixes, as byte strings that sort as they do."""
        return _heads(self.tokens, at.astype(np.int64), self.window)

    def item_at(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, at, "right") - 1


def _runs(tokens: np.ndarray) -> np.ndarray:
    """For each position the tokens up to the next 0."""
    breaks = np.flatnonzero(tokens == 0)
    ends = np.append(breaks, len(tokens))
    return ends[np.searchsorted(breaks, np.arange(len(tokens)), "left")] - np.arange(len(tokens))


def _heads(tokens: np.ndarray, at: np.ndarray, window: int, run: np.ndarray | None = None) -> np.ndarray:
    out = tokens[at[:, None] + np.arange(window)]
    if run is not None:
        out = np.where(np.arange(window) < run[:, None], out, 0)
    return np.ascontiguousarray(out.astype(">u4")).view(f"S{4 * window}").ravel()


def _search(items: Items, heads: np.ndarray) -> np.ndarray:
    """For distinct heads the group of equal test suffixes, or -1: binary search in the items' array."""
    low, high = np.zeros(len(heads), np.int64), np.full(len(heads), len(items.groups) - 1, np.int64)
    while (live := np.flatnonzero(low < high)).size:
        middle = (low[live] + high[live]) // 2
        less = items.heads(items.order[items.groups[middle]]) < heads[live]
        low[live[less]], high[live[~less]] = middle[less] + 1, middle[~less]
    found = np.full(len(heads), -1, np.int64)
    inside = np.flatnonzero(low < len(items.groups) - 1)
    same = items.heads(items.order[items.groups[low[inside]]]) == heads[inside]
    found[inside[same]] = low[inside[same]]
    return found


def meetings(items: Items, tokens: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(test positions, training positions, words) of equal windows of a shard whose separators are 0, some at a time."""
    if not len(items.starts) or len(tokens) < items.least:
        return
    run = _runs(tokens)
    suffixes = np.flatnonzero(run >= items.least)
    if not len(suffixes):
        return
    window = items.window
    padded = np.concatenate((tokens, np.zeros(window, tokens.dtype)))
    heads = _heads(padded, suffixes, window, run[suffixes])
    order = np.argsort(heads, kind="stable")
    array, heads = suffixes[order], heads[order]
    n = len(items.groups) - 1
    if n <= len(heads):
        for at in range(0, n, CHUNK):
            wanted = items.heads(items.order[items.groups[at : min(at + CHUNK, n)]])
            first, last = np.searchsorted(heads, wanted, "left"), np.searchsorted(heads, wanted, "right")
            hit = np.flatnonzero(last > first)
            yield from _expanded(items, array, hit + at, first[hit], last[hit])
    else:
        whole = np.flatnonzero(run[array] >= window)
        distinct, first, count = np.unique(heads[whole], return_index=True, return_counts=True)
        group = _search(items, distinct)
        hit = np.flatnonzero(group >= 0)
        yield from _expanded(items, array[whole], group[hit], first[hit], first[hit] + count[hit])
    for size in np.unique(items.short[:, 1]).tolist():
        own = items.short[items.short[:, 1] == size, 0]
        wanted = np.ascontiguousarray(items.tokens[own[:, None] + np.arange(size)].astype(">u4")).view(f"S{4 * size}").ravel()
        able = run[array] >= size
        cut = np.ascontiguousarray(padded[array[able][:, None] + np.arange(size)].astype(">u4")).view(f"S{4 * size}").ravel()
        first, last = np.searchsorted(cut, wanted, "left"), np.searchsorted(cut, wanted, "right")
        for k in np.flatnonzero(last > first).tolist():
            at = array[able][first[k] : last[k]]
            yield np.full(len(at), own[k]), at, size


def _expanded(items: Items, array: np.ndarray, group: np.ndarray, first: np.ndarray, last: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Every copy of a test suffix with every place of it in the shard, about CHUNK meetings at a time."""
    copies = items.groups[group + 1] - items.groups[group]
    total = np.cumsum(copies * (last - first))
    cuts = [0, *(np.flatnonzero(np.diff(total // CHUNK)) + 1).tolist(), len(group)]
    for a, b in zip(cuts, cuts[1:]):
        p, t = [], []
        for g, f, to in zip(group[a:b].tolist(), first[a:b].tolist(), last[a:b].tolist()):
            tests = items.order[items.groups[g] : items.groups[g + 1]].astype(np.int64)
            for at in range(0, len(tests), max(1, CHUNK // (to - f))):
                part = tests[at : at + max(1, CHUNK // (to - f))]
                p.append(np.repeat(part, to - f))
                t.append(np.tile(array[f:to], len(part)))
                if sum(map(len, p)) >= CHUNK:
                    yield np.concatenate(p), np.concatenate(t), items.window
                    p, t = [], []
        if p:
            yield np.concatenate(p), np.concatenate(t), items.window


def followed(p: np.ndarray, t: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Matches (test position, training position, words) that overlap or follow on a diagonal, joined; sorted by diagonal."""
    order = np.lexsort((p, t - p))
    p, t, size = p[order], t[order], size[order]
    if not len(p):
        return p, t, size
    # on a diagonal, ends grow with starts: all whole windows have one size, and short items are whole
    new = np.append(True, (t[1:] - p[1:] != t[:-1] - p[:-1]) | (p[1:] > p[:-1] + size[:-1]))
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(p)) - 1
    return p[at], t[at], p[last] + size[last] - p[at]


def matches(items: Items, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The longest verbatim matches of a shard: (test position, training position, words)."""
    parts = [followed(p, t, np.full(len(p), n, np.int64)) for p, t, n in meetings(items, tokens)]
    if not parts:
        return (np.empty(0, np.int64),) * 3
    return followed(*(np.concatenate([x[i] for x in parts]) for i in range(3)))


def _found(items: Items, texts: list[bytes | None], get=None) -> list[tuple[int, list[tuple[int, int]], list[str], list[tuple]]]:
    """For each text its words, the merged spans [from, to) of hit words, the items, and the matches."""
    out: list = [None] * len(texts)
    tokens, owners, size = [], [], 0
    get = get or {w: k + 1 for k, w in enumerate(items.words)}.get

    def flush() -> None:
        nonlocal tokens, owners, size
        if not owners:
            return
        starts = np.array([s for _, s in owners])
        p, t, n = matches(items, np.concatenate(tokens))
        item = items.item_at(p)
        doc = np.searchsorted(starts, t, "right") - 1
        found: dict[int, list[tuple]] = {}
        for d, i, a, b, k in zip(doc.tolist(), item.tolist(), (p - items.starts[item]).tolist(), (t - starts[doc]).tolist(), n.tolist()):
            found.setdefault(d, []).append((items.ids[i], a, b, k))
        for d, own in found.items():
            k = owners[d][0]
            own.sort(key=lambda m: (m[2], m[3], m[0] is not None, m[0] or "", m[1]))
            out[k] = (out[k][0], merged([(b, b + n) for _, _, b, n in own]), sorted({m[0] for m in own} - {None}), own)
        tokens, owners, size = [], [], 0

    for k, text in enumerate(texts):
        ws = words(text)
        out[k] = (len(ws), [], [], [])
        if len(ws) >= max(items.least, 1) and len(items.starts):
            if size + len(ws) > SHARD_WORDS:
                flush()
            owners.append((k, size))
            tokens.append(np.fromiter((get(w, 0) for w in ws), np.uint32, len(ws)))
            tokens.append(np.zeros(1, np.uint32))
            size += len(ws) + 1
    flush()
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of spans, touching ones joined."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[object, bytes | None]]]:
    """The items, some at a time; each block has block_bytes of text in the mean."""
    text = F.col("text").cast("string")
    total = benchmark.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    n = max(1, -(-int(total) // block_bytes))
    for k in range(n):
        part = benchmark if n == 1 else benchmark.where(F.pmod(F.xxhash64("item_id", text), F.lit(n)) == k)
        yield [(r[0], None if r[1] is None else bytes(r[1])) for r in part.select("item_id", text.cast("binary")).collect()]


_OF_WORKER: dict[str, dict] = {}


def _token_of(items: Items):
    """The look-up of a block's words, made once by a worker; of other blocks' ones it keeps a few."""
    if items.name not in _OF_WORKER:
        while len(_OF_WORKER) >= 2:
            _OF_WORKER.pop(next(iter(_OF_WORKER)))
        _OF_WORKER[items.name] = {w: k + 1 for k, w in enumerate(items.words)}
    return _OF_WORKER[items.name].get


_MATCH = "array<struct<item:string,item_from:int,from:int,n:int>>"


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with n_words, hit_spans (word positions [from, to) of matched windows, touching ones merged over all items),
    item_ids (sorted as strings) and matches: the longest verbatim matches, each with its item, the word of the item and
    the word of the document that it begins at, and its words.

    Every row of docs gives one row; null and empty texts have no words; very long texts are a shard of their own; repeated
    rows get equal values; an empty benchmark hits nothing; an item whose id is null hits words, but is not in item_ids;
    other columns of docs stay, and the new ones get a leading _ where names clash.
    """
    spark = docs.sparkSession
    n_words, spans, ids, found_at = (fresh(docs, c) for c in ("n_words", "hit_spans", "item_ids", "matches"))
    span_type = "array<struct<from:int,to:int>>"
    new_columns = {n_words: "long", spans: span_type, ids: "array<string>", found_at: _MATCH}
    docs = docs.withColumns({c: F.lit(None).cast(t) for c, t in new_columns.items()})
    at = docs.columns.index("text")
    arrow = [pa.int64(), pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())])), pa.list_(pa.string()), pa.list_(pa.struct([("item", pa.string()), ("item_from", pa.int32()), ("from", pa.int32()), ("n", pa.int32())]))]
    for block in blocks(benchmark, block_bytes):
        shared = spark.sparkContext.broadcast(Items(block, window))
        schema = docs.schema

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            get = _token_of(items)
            for batch in batches:
                if not batch.num_rows:
                    continue
                n = batch.num_columns
                found = _found(items, as_bytes(batch.column(at)), get)
                was = zip(*(batch.column(n - k).to_pylist() for k in (3, 2, 1)))
                both = [
                    (w, merged(s + [(x["from"], x["to"]) for x in s0 or []]), sorted({*i, *(i0 or [])}), [*(m0 or []), *({"item": x[0], "item_from": x[1], "from": x[2], "n": x[3]} for x in m)])
                    for (w, s, i, m), (s0, i0, m0) in zip(found, was)
                ]
                rows = [[x[0] for x in both], [[{"from": a, "to": b} for a, b in x[1]] for x in both], [x[2] for x in both], [x[3] for x in both]]
                yield pa.RecordBatch.from_arrays([*batch.columns[: n - 4], *(pa.array(r, t) for r, t in zip(rows, arrow))], names=batch.schema.names)

        docs = docs.mapInArrow(run, schema)
    return docs


def digest(found: DataFrame) -> DataFrame:
    """The columns that sum up contamination() for a table doc_id, text."""
    hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda s, x: s + (x["to"] - x["from"]))
    ids = F.sha2(F.concat_ws(",", "item_ids"), 256)
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), ids.alias("items_sha256"), (F.size("hit_spans") > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs without a hit word, with their own columns, whatever these are called.

    Rows with a null or empty text stay, as do all where the benchmark is empty; repeated rows stay or go together; a very
    long text goes for one hit; an empty table gives no rows.
    """
    found = contamination(docs, benchmark, window)
    return found.where(F.size(found.columns[-3]) == 0).select(*docs.columns)


def sha256_of(ids: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
