"""Token counts at every prefix of a text, by dynamic programming, for byte-level BPE.

A text is cut into pieces by the tokenizer's pattern, and BPE works within a piece. The encoding of a piece's prefix
ends with the one token t for which the prefix before it ends with a token that t can follow: two tokens can stand side
by side if no merge across their border comes before both are complete. So last[i] and count[i] = count[i - len(t)] + 1
follow from shorter prefixes, each count is exact, and truncation and budget questions need no second encoding. Counts
of a piece are kept in a bounded cache, as words repeat.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltbed.llm.common import fresh, schema_plus

LIMIT = 512
#: Pieces whose counts a worker keeps in each of two generations: a full one becomes the old one, whose pieces come back as
#: they are met again.
CACHE_PIECES = 600_000
#: Longer pieces are computed each time, to bound the cache's bytes.
CACHE_CHARS = 64
#: Bytes of a piece's beginning whose states are kept, and how many beginnings are.
HEAD, HEADS = 5, 100_000
NEVER = 1 << 60


def _byte_letters() -> dict[str, int]:
    """Byte-level BPE writes printable Latin-1 bytes as themselves and the other bytes, in order, as U+0100 and on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def _ends(text: str) -> np.ndarray:
    """Where each character ends in UTF-8."""
    return np.arange(1, len(text) + 1) if text.isascii() else np.cumsum([len(c.encode()) for c in text])


class _Totals(dict):
    """The last prefix count of pieces met so far."""

    def __init__(self, counter: "PrefixTokens", old: dict[str, int]):
        self.counter, self.old = counter, old

    def __missing__(self, piece: str) -> int:
        total = self.old.get(piece)
        if total is None:
            total = self.counter.piece(piece)[-1]
        if len(piece) <= CACHE_CHARS:
            self[piece] = total
        return total


class PrefixTokens:
    """Prefix counts for a byte-level BPE file of the tokenizers library, without added prefix space or normalizer."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        self.pieces = regex.compile(pattern).findall
        special = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        to_bytes = lambda s: bytes(letters[c] for c in s)
        tokens = [to_bytes(t) for t in spec["model"]["vocab"] if t not in special]
        self.parts: dict[bytes, tuple[bytes, bytes]] = {}
        self.rank: dict[bytes, int] = {}
        self.merge: dict[tuple[bytes, bytes], int] = {}
        for k, m in enumerate(spec["model"]["merges"]):
            a, b = map(to_bytes, m.split(" ") if isinstance(m, str) else m)
            self.merge[a, b] = k
            if a + b not in self.parts:
                self.parts[a + b], self.rank[a + b] = (a, b), k
        #: Every end of a token: its number, or -1 where BPE can't reach the end as a token of its own.
        self.ends: dict[bytes, int] = {}
        self.tokens = [t for t in tokens if len(t) == 1 or t in self.parts]
        for t in tokens:
            for k in range(1, len(t)):
                self.ends.setdefault(t[k:], -1)
        self.ends |= {t: k for k, t in enumerate(self.tokens)}
        self.valid: dict[int, bool] = {}
        self.heads: dict[bytes, tuple[list[int], list[int]]] = {}
        self.totals = _Totals(self, {})

    def _border(self, token: bytes, side: int) -> list[tuple[bytes, int]]:
        """The parts of token at its left (0) or right (1) border, each with the rank at which it goes up in a larger one."""
        out, until = [(token, NEVER)], 0
        while token in self.parts:
            until, token = self.rank[token], self.parts[token][side]
            out.append((token, until))
        return out

    def can_follow(self, a: bytes, b: bytes) -> bool:
        """Whether BPE of a + b gives a, b."""
        # equal merges are done from the left: one across the border comes after an equal one within a
        return not any((m := self.merge.get((x, y))) is not None and m < ux and m <= uy for x, ux in self._border(a, 1) for y, uy in self._border(b, 0))

    def piece(self, text: str) -> list[int]:
        """Token counts of the prefixes of a piece's UTF-8 bytes, from the empty one on."""
        raw = text.encode()
        n = len(raw)
        # words share beginnings: the programme goes on from a beginning that was met before
        known = self.heads.get(raw[:HEAD]) if n > HEAD else None
        last, count = (known[0] + [0] * (n - HEAD), known[1] + [0] * (n - HEAD)) if known else ([0] * (n + 1), [0] * (n + 1))
        end, valid = self.ends.__getitem__, self.valid
        for i in range(HEAD + 1 if known else 1, n + 1):
            j = i - 1
            while True:
                t = end(raw[j:i])
                if t >= 0:
                    if not j:
                        break
                    pair = last[j] << 20 | t
                    ok = valid.get(pair)
                    if ok is None:
                        if len(valid) > 4 * CACHE_PIECES:
                            valid.clear()
                        ok = valid[pair] = self.can_follow(self.tokens[last[j]], self.tokens[t])
                    if ok:
                        break
                j -= 1
            last[i], count[i] = t, count[j] + 1
        if n > HEAD and not known:
            if len(self.heads) > HEADS:
                self.heads.clear()
            self.heads[raw[:HEAD]] = last[: HEAD + 1], count[: HEAD + 1]
        return count

    def _plain(self, text: str) -> int:
        if len(self.totals) > CACHE_PIECES:
            self.totals.old = {}
            self.totals = _Totals(self, self.totals)
        return sum(map(self.totals.__getitem__, self.pieces(text)))

    def count(self, text: str) -> int:
        """Tokens of the whole text: the last entry of each piece's prefix counts; a special string is one token."""
        if self.special is None or "<" not in text:
            return self._plain(text)
        parts = self.special.split(text)
        return sum(map(self._plain, parts)) + len(parts) - 1

    def prefix_counts(self, text: str) -> np.ndarray:
        """Exact token counts of text[:0], text[:1], ... text[:len(text)]."""
        out = np.zeros(len(text) + 1, np.int64)
        at = base = 0
        cuts = [*self.special.finditer(text)] if self.special else []
        for begin, end in [(m.start(), m.end()) for m in cuts] + [(len(text), len(text))]:
            first = at
            for p in self.pieces(text[at:begin]):
                counts = np.array(self.piece(p))
                out[at + 1 : at + 1 + len(p)] = base + counts[_ends(p)]
                at, base, first = at + len(p), base + int(counts[-1]), at
            self._runs(text, begin, out, cuts)
            if end > begin:
                for stop in range(begin + 1, end):  # a part of a special string is plain text
                    start = self._open(text, first, begin)
                    out[stop] = out[start] + self._plain(text[start:stop])
                at, base = end, base + 1
                out[end] = base
        return out

    @staticmethod
    def _open(text: str, first: int, begin: int) -> int:
        """The start of what a text that ends within a special string may cut otherwise: the last piece and white space before it."""
        start = first
        while start and text[start - 1].isspace():
            start -= 1
        return min(start, begin)

    def _runs(self, text: str, end: int, out: np.ndarray, cuts: list) -> None:
        """Prefixes that end in white space: there the run so far is one piece, while before a word it loses its last character."""
        floor = max((m.end() for m in cuts if m.end() <= end), default=0)
        for m in regex.compile(r"\s{2,}").finditer(text, floor, end):
            run = m.group()
            out[m.start() + 1 : m.end() + 1] = out[m.start()] + np.array(self.piece(run))[_ends(run)]

    def fit(self, text: str, budget: int) -> int:
        """Characters of the longest prefix of at most budget tokens."""
        return int(np.flatnonzero(self.prefix_counts(text) <= budget)[-1])


@lru_cache(4)
def prefix_tokens(path: str, pattern: str) -> PrefixTokens:
    return PrefixTokens(path, pattern)


def token_counts(docs: DataFrame, path: str, pattern: str, budget: int | None = None) -> DataFrame:
    """docs with n_bytes (UTF-8), n_tokens and, given a budget, fit_chars: the longest prefix within it, in code points.

    path and pattern are the BPE file and its piece pattern; the file must be where every executor can read it. A null text
    counts as empty; each row gives one row; columns that clash get a leading _.
    """
    names = [fresh(docs, c) for c in ("n_bytes", "n_tokens", "fit_chars")][: 2 if budget is None else 3]
    docs = docs.withColumn("text", F.col("text").cast("string"))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = prefix_tokens(path, pattern)
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            new = [pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array([counter.count(t) for t in texts], pa.int64())]
            if budget is not None:
                new.append(pa.array([counter.fit(t, budget) for t in texts], pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *names])

    return docs.mapInArrow(run, schema_plus(docs, dict.fromkeys(names, "long")))
