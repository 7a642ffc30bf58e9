"""Language identification by prediction by partial matching (PPM).

For each language a variable-order context tree of bytes is learned and frozen: contexts of up to ORDER symbols, counts
c of n symbols of which d differ. A symbol seen in a context has probability c / (n + d); the escape d / (n + d) goes to
the context that is one symbol shorter, without the symbols seen here (exclusion), down to a uniform distribution. A
text's code length under a language is the exact sum of -log2 of these; the shortest code wins, and score is its share
of 2 ** -length among the languages.

Letters are lower-cased, ASCII other than letters is one blank symbol, and its runs count once. As the trees are frozen,
the distribution in every context is a table row, equal for all texts; a text is scored by table look-ups.

The trees are fitted on a bounded sample: about SAMPLE_DOCS documents of each language, by a hash of doc_id, of at most
SAMPLE_CHARS characters each. Every document is scored, over its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltbed.llm.common import fresh, schema_plus

ORDER = 3
SAMPLE_DOCS = 400
SAMPLE_CHARS = 20_000
UNKNOWN = "und"
#: Below this score the pipeline rejects a document.
REJECT_BELOW = 0.5
_LETTERS = bytes(b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
#: Symbols that are scored at once.
BLOCK = 1 << 20


def symbols(text: str | None) -> bytes:
    """The bytes that the models see; empty for a text without a letter."""
    if not text:
        return b""
    raw = b" ".join(text.lower().encode("utf-8", "replace").translate(_LETTERS).split())
    if raw.translate(None, bytes(range(0x80, 256))).strip() or any(map(str.isalpha, text)):
        return b" " + raw + b" "
    return b""


class Trees:
    """Frozen context trees of all languages as tables: bits[row, symbol, language], and the row of each context."""

    def __init__(self, samples: dict[str, list[bytes]]):
        self.langs = sorted(k for k, texts in samples.items() if any(texts))
        seen = np.unique(np.frombuffer(b" " + b"".join(b for bs in samples.values() for b in bs), np.uint8))
        self.size = len(seen) + 1
        self.code = np.zeros(256, np.int32)  # 0: bytes that no sample has
        self.code[seen] = np.arange(1, len(seen) + 1)
        counts = [self._counts([self.code[np.frombuffer(b, np.uint8)] for b in samples[lang]]) for lang in self.langs]
        self.rows = np.zeros(self.size**ORDER, np.int32)
        if not self.langs:
            return
        table = [self._row(counts, 0, 0, np.full((self.size, len(self.langs)), 1 / self.size))]
        before: dict[int, int] = {0: 0}
        for order in range(1, ORDER + 1):
            now: dict[int, int] = {}
            contexts = sorted({c for lang in counts for c in lang[order]})
            for c in contexts:
                now[c] = len(table)
                table.append(self._row(counts, order, c, table[before[c % self.size ** (order - 1)]]))
                # all full contexts that end so, unless a longer one is found
                self.rows.reshape(-1, self.size**order)[:, c] = now[c]
            before = now
        self.bits = -np.log2(np.stack(table)).astype(np.float32).reshape(-1, len(self.langs))

    def _counts(self, texts: list[np.ndarray]) -> list[dict[int, np.ndarray]]:
        """For each order the symbol counts by context; a text starts after blanks."""
        out: list[dict[int, np.ndarray]] = []
        blank = self.code[0x20]
        stream = [np.concatenate((np.full(ORDER, blank, np.int32), t)) for t in texts if len(t)]
        for order in range(ORDER + 1):
            grams = [np.empty(0, np.int64)]
            for t in stream:
                g = np.zeros(len(t) - ORDER, np.int64)
                for k in range(order, -1, -1):
                    g = g * self.size + t[ORDER - k : len(t) - k]
                grams.append(g)
            value, count = np.unique(np.concatenate(grams), return_counts=True)
            found: dict[int, np.ndarray] = {}
            for v, c in zip(value.tolist(), count.tolist()):
                context, symbol = divmod(v, self.size)
                if context not in found:
                    found[context] = np.zeros(self.size)
                found[context][symbol] = c
            out.append(found)
        return out

    def _row(self, counts: list, order: int, context: int, shorter: np.ndarray) -> np.ndarray:
        """Probabilities of all symbols after context, by language; a language without the context uses the shorter one."""
        out = shorter.copy()
        for k, lang in enumerate(counts):
            c = lang[order].get(context)
            if c is not None:
                n, d = c.sum(), np.count_nonzero(c)
                rest = np.where(c > 0, 0, shorter[:, k])
                total = rest.sum()
                out[:, k] = c / (n + d) + (rest / total * d / (n + d) if total > 0 else 0)
                out[:, k] /= out[:, k].sum()
        return out

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text of symbols() under each language."""
        out = np.zeros((len(texts), len(self.langs)))
        blank, size = self.code[0x20], self.size
        for k, text in enumerate(texts):
            for at in range(0, len(text), BLOCK):
                part = self.code[np.frombuffer(text, np.uint8, min(BLOCK, len(text) - at), at)]
                held = self.code[np.frombuffer(text, np.uint8, min(ORDER, at), at - min(ORDER, at))] if at else np.empty(0, np.int32)
                t = np.concatenate((np.full(ORDER - len(held), blank, np.int32), held, part))
                context = np.zeros(len(part), np.int32)
                for j in range(ORDER):
                    context = context * size + t[j : j + len(part)]
                out[k] += self.bits.take(self.rows[context] * np.int64(size) + part, axis=0).sum(axis=0, dtype=np.float64)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        seen = [symbols(t) for t in texts]
        if not self.langs or not any(seen):
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        bits = self.code_lengths(seen)
        best = bits.argmin(axis=1)
        share = 1 / np.exp2(np.clip(bits.min(axis=1, keepdims=True) - bits, -1000, 0)).sum(axis=1)
        return [self.langs[b] if s else UNKNOWN for b, s in zip(best.tolist(), seen)], [round(p, 9) if s else 0.0 for p, s in zip(share.tolist(), seen)]


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from: crc32(doc_id as text) mod 3 is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, per_lang: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> dict[str, list[bytes]]:
    """per_lang labelled texts of each language in the mean, by the hash of doc_id; of all at most 2 * per_lang a language, the
    first by hash and text, so reruns agree."""
    labelled = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    size = labelled.groupBy("lang").count().collect()
    if not size:
        return {}
    share = F.create_map(*[F.lit(x) for r in size for x in (r["lang"], min(1.0, per_lang / r["count"]))])
    mark = (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)) < share[F.col("lang")]
    rows = labelled.where(mark & (F.length("text") <= chars)).orderBy(F.xxhash64("doc_id"), "lang", "text").select("lang", "text").limit(2 * per_lang * len(size)).collect()
    out: dict[str, list[bytes]] = {r["lang"]: [] for r in size}
    for r in sorted(rows):
        out[r["lang"]].append(symbols(r["text"]))
    return out


def identify(docs: DataFrame, per_lang: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> DataFrame:
    """docs with held_out, lang_pred and score; learns from docs' own lang, and from no held-out row.

    lang_pred is und, with score 0, where text is null or has no letter, or where nothing was learned. Predictions use text
    alone. Each row gives one row, repeated rows equal values; clashing names get a leading _.
    """
    names = [fresh(docs, c) for c in ("held_out", "lang_pred", "score")]
    trees = Trees(sample(docs, per_lang, chars))
    shared = docs.sparkSession.sparkContext.broadcast(trees)
    docs = docs.withColumn("text", F.col("text").cast("string")).withColumn(names[0], held_out(F.col("doc_id")))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score = shared.value.predict(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*batch.schema.names, *names[1:]])

    return docs.mapInArrow(run, schema_plus(docs, {names[1]: "string", names[2]: "double"}))


def keep_known(docs: DataFrame, below: float = REJECT_BELOW) -> DataFrame:
    """The rows of docs whose language is known with a score of below or more, with their own columns, whatever their names.

    Null and empty texts, and those without a letter, go; if no row has a lang, nothing is learned and all go; repeated rows
    stay or go together; texts of any length are scored whole; an empty table gives no rows.
    """
    found = identify(docs)
    lang, score = found.columns[-2:]
    return found.where((F.col(lang) != UNKNOWN) & (F.col(score) >= below)).select(*docs.columns)
