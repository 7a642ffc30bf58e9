"""Quality classifier by co-training of a text view and a metadata view.

View A sees a text's content: which words of a learned vocabulary it has, and shares of symbols, capitals, repeats and
the like. View B sees only its metadata: source, language and length class. Both are logistic regressions fitted on a
bounded sample of labelled rows. In each round each view scores a pool of unlabelled rows, which grows with the corpus, and
hands the share of them that it is surest of, as pseudo-labels, to the other view, and both are fitted anew. On labelled
rows that were held back, each view is calibrated and the two are combined by a further logistic regression; a view that
tells nothing gets no weight.
The combined model then scores every document over its whole text, in one pass without a shuffle.

Two targets are trained so: quality (label quality) and toxicity (label toxic); kept asks for the first without the second.
The vocabulary is counted in the sample by a distributed aggregation; only its VOCABULARY best words reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltbed.llm.common import as_bytes, fresh, schema_plus, stored
from siltbed.llm.rules import text_counts

#: Labelled rows in the mean.
LABELLED = 12_000
#: Pool rows in the mean: so many times the square root of the documents without a label, all of them where there are few.
POOL_PER_ROOT = 12
VOCABULARY = 2_000
ROUNDS = 3
#: The share of the pool that a view hands over for each class and round, and how sure it must be.
HANDED = 1 / 30
SURE = 0.95
META = 256
KEEP_FROM = 0.5
TARGETS = ("quality", "toxic")
_EDGES = bytes(b for b in range(33, 128) if not chr(b).isalnum())
N_SHARES = 9


def shares(text: bytes) -> list[float]:
    """Figures of a text's form, each about 0 to 1."""
    n, chars, symbols, dup, repeat, lines, upper, letters, pipes, ends = text_counts(text)
    w = max(n, 1)
    return [min(symbols / w, 3) / 3, upper / max(letters, 1), repeat / w, dup / max(lines, 1), pipes / w, ends / max(lines, 1), min(chars / w, 20) / 20, min(np.log1p(n) / 10, 1.0), float(n < 20)]


def text_words(text: bytes) -> set[bytes]:
    return {w.strip(_EDGES) for w in set(text.lower().split())} - {b""}


def sampled(docs: DataFrame, rows: float, salt: str, total: int) -> DataFrame:
    """About rows of docs' total, by a hash of doc_id."""
    return docs.where(F.pmod(F.xxhash64(F.lit(salt), "doc_id"), F.lit(1 << 30)) / float(1 << 30) < min(1.0, rows / max(total, 1)))


def one_each(rows: DataFrame) -> DataFrame:
    """One row of each doc_id: the least by its other columns."""
    others = [c for c in rows.columns if c != "doc_id"]
    return rows.groupBy("doc_id").agg(F.min(F.struct(*others)).alias("row")).select("doc_id", "row.*")


def meta_slots(source: str | None, lang: str | None, n_chars: int) -> list[int]:
    """Slots of the metadata view: source and language by hash, length class."""
    h = [xxhash.xxh64_intdigest(f"{k}={v}", 8) % (META - 32) for k, v in (("source", source), ("lang", lang))]
    return [*h, META - 32 + min(int(n_chars).bit_length(), 31)]


class Logistic:
    """L2-regularised logistic regression on rows of slots (0/1) and dense columns; full-batch Adagrad."""

    def __init__(self, slots: int, dense: int):
        self.w, self.v, self.b = np.zeros(slots), np.zeros(dense), 0.0

    def raw(self, owner: np.ndarray, slot: np.ndarray, dense: np.ndarray) -> np.ndarray:
        return np.bincount(owner, self.w[slot], len(dense)) + dense @ self.v + self.b

    def fit(self, owner, slot, dense, y, weight, rounds: int = 250, l2: float = 2e-4) -> "Logistic":
        gw, gv, gb = np.full(len(self.w), 1e-8), np.full(len(self.v), 1e-8), 1e-8
        total = weight.sum()
        for _ in range(rounds):
            e = (_sigmoid(self.raw(owner, slot, dense)) - y) * weight / total
            dw, dv, db = np.bincount(slot, e[owner], len(self.w)) + l2 * self.w, e @ dense + l2 * self.v, e.sum()
            gw, gv, gb = gw + dw * dw, gv + dv * dv, gb + db * db
            self.w, self.v, self.b = self.w - 0.5 * dw / np.sqrt(gw), self.v - 0.5 * dv / np.sqrt(gv), self.b - 0.5 * db / np.sqrt(gb)
        return self


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Views:
    """The features of some rows, as arrays for both views."""

    def __init__(self, rows: list):
        self.n = len(rows)
        self.a_slots, self.a_owner = self._flat([r["words"] for r in rows])
        self.b_slots, self.b_owner = self._flat([r["meta"] for r in rows])
        self.dense = np.array([r["shares"] for r in rows], float).reshape(self.n, N_SHARES)
        self.none = np.zeros((self.n, 0))

    @staticmethod
    def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        return np.array([x for v in lists for x in v], np.int64), np.repeat(np.arange(len(lists)), [len(v) for v in lists])

    def of(self, view: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return (self.a_owner, self.a_slots, self.dense) if view == 0 else (self.b_owner, self.b_slots, self.none)

    def only(self, view: int, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        owner, slot, dense = self.of(view)
        to = np.cumsum(keep) - 1
        return to[owner[keep[owner]]], slot[keep[owner]], dense[keep]


class CoTrained:
    """Both views and how their calibrated scores combine; handed holds (round, giving view, label, rows) of each exchange."""

    def __init__(self, views: list[Logistic], mix: np.ndarray, handed: list[tuple[int, int, int, int]]):
        self.views, self.mix, self.handed = views, mix, handed

    @classmethod
    def fit(cls, rows: Views, y: np.ndarray, held: np.ndarray, rounds: int = ROUNDS) -> "CoTrained":
        """y: 0, 1, or -1 for pool rows; held: labelled rows that only calibrate."""
        known = (y >= 0) & ~held
        given = [np.where(known, y, -1).astype(float) for _ in (0, 1)]
        models: list[Logistic] = []
        handed: list[tuple[int, int, int, int]] = []
        most = int(np.ceil(HANDED * (y < 0).sum()))
        for turn in range(rounds + 1):
            models = []
            for view in (0, 1):
                use = given[view] >= 0
                weight = np.where(known[use], 1.0, 0.3)
                models.append(Logistic(VOCABULARY if view == 0 else META, N_SHARES if view == 0 else 0).fit(*rows.only(view, use), given[view][use], weight))
            if turn == rounds:
                break
            for view in (0, 1):
                p = _sigmoid(models[view].raw(*rows.of(view)))
                for label, sure in ((1, p), (0, 1 - p)):
                    free = np.flatnonzero((y < 0) & (given[1 - view] < 0) & (sure >= SURE))
                    picked = free[np.argsort(-sure[free], kind="stable")[:most]]
                    given[1 - view][picked] = label
                    handed.append((turn, view, label, len(picked)))
        if held.sum() < 20 or len(set(y[held].tolist())) < 2:
            return cls(models, np.array([1.0, 0.0, 0.0]), handed)
        x = np.stack([np.clip(m.raw(*rows.of(k)), -10, 10) for k, m in enumerate(models)], axis=1)[held]
        top = Logistic(0, 2)
        top.v = np.array([1.0, 0.0])
        empty = np.empty(0, np.int64)
        top.fit(empty, empty, x, y[held].astype(float), np.ones(len(x)), l2=1e-3)
        return cls(models, np.array([*top.v, top.b]), handed)

    def score(self, rows: Views) -> np.ndarray:
        x = [np.clip(m.raw(*rows.of(k)), -10, 10) for k, m in enumerate(self.views)]
        return _sigmoid(self.mix[0] * x[0] + self.mix[1] * x[1] + self.mix[2])


def features(text: bytes | None, source: str | None, lang: str | None, vocabulary: dict[bytes, int]) -> dict:
    text = text or b""
    known = vocabulary.keys() & text_words(text)
    return {"words": [vocabulary[w] for w in known], "shares": shares(text), "meta": meta_slots(source, lang, len(text))}


def vocabulary(labelled: DataFrame, size: int = VOCABULARY) -> dict[bytes, int]:
    """The words of the labelled sample that tell most about a target, by their share of its mutual information."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count: dict[bytes, list[int]] = {}
            for text, q, t in zip(as_bytes(batch.column(0)), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                for w in text_words(text or b""):
                    c = count.setdefault(w, [0, 0, 0])
                    c[0] += 1
                    c[1] += q
                    c[2] += t
            yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.binary()), *(pa.array([c[i] for c in count.values()], pa.int64()) for i in range(3))], ["w", "n", "q", "t"])

    words = labelled.select(F.col("text").cast("string"), "quality", "toxic").mapInArrow(run, "w binary, n long, q long, t long")
    words = words.groupBy("w").agg(F.sum("n").alias("n"), F.sum("q").alias("q"), F.sum("t").alias("t")).where("n >= 3")
    total = labelled.agg(F.count("*"), F.avg("quality"), F.avg("toxic")).first()
    if not total[0]:
        return {}

    def telling(hits: Column, mean: float) -> Column:
        # how far the word's rows are from the mean, in standard deviations
        mean = min(max(mean, 1e-3), 1 - 1e-3)
        return F.abs(hits - F.col("n") * mean) / F.sqrt(F.col("n") * (mean * (1 - mean)))

    best = words.withColumn("s", F.greatest(telling(F.col("q"), total[1]), telling(F.col("t"), total[2]))).orderBy(F.desc("s"), "w").limit(size)
    return {bytes(r["w"]): k for k, r in enumerate(best.select("w").collect())}


def _with_features(rows: DataFrame, words: dict[bytes, int], others: list[str]) -> DataFrame:
    """others and the features of rows with text, source and lang."""
    shared = rows.sparkSession.sparkContext.broadcast(words)
    fields = ", ".join(f"{c} {dict(rows.dtypes)[c]}" for c in others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            got = [features(t, s, g, shared.value) for t, s, g in zip(as_bytes(cols["text"]), cols["source"].to_pylist(), cols["lang"].to_pylist())]
            new = [pa.array([g["words"] for g in got], pa.list_(pa.int32())), pa.array([g["shares"] for g in got], pa.list_(pa.float64())), pa.array([g["meta"] for g in got], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*(cols[c] for c in others), *new], [*others, "words", "shares", "meta"])

    return rows.mapInArrow(run, f"{fields}, words array<int>, shares array<double>, meta array<int>")


def trained(docs: DataFrame, labels: DataFrame) -> tuple[dict[bytes, int], dict[str, CoTrained], Views, np.ndarray, list]:
    """The vocabulary, the model of each target, and the rows that they were fitted on: views, which are held back, and rows.

    Only features come to the driver: of LABELLED rows in the mean and of a pool that grows as the root of the corpus.
    """
    text_columns = [F.col(c).cast("string").alias(c) for c in ("text", "source", "lang")]
    slim = docs.select("doc_id", *text_columns).where("doc_id is not null")
    told = labels.where("doc_id is not null and quality in (0, 1) and toxic in (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"), F.max("toxic").cast("int").alias("toxic"))
    n_labels, n_docs = told.count(), docs.count()
    picked = sampled(told, LABELLED, "labelled", n_labels)
    labelled = stored(one_each(slim.join(picked.select("doc_id"), "doc_id", "left_semi")).join(picked, "doc_id"), "labelled")
    words = vocabulary(labelled)
    free = max(n_docs - n_labels, 0)
    pool = one_each(sampled(slim, POOL_PER_ROOT * free**0.5, "pool", free).join(told.select("doc_id"), "doc_id", "left_anti"))
    both = labelled.unionByName(pool.withColumns({"quality": F.lit(-1), "toxic": F.lit(-1)}))
    rows = _with_features(both, words, ["doc_id", "quality", "toxic"]).collect()
    rows = sorted(rows, key=lambda r: (str(r["doc_id"]), r["quality"]))
    views = Views(rows)
    held = np.array([r["quality"] >= 0 and xxhash.xxh64_intdigest(str(r["doc_id"]), 5) % 5 == 0 for r in rows], bool)
    return words, {t: CoTrained.fit(views, np.array([r[t] for r in rows], np.int64), held) for t in TARGETS}, views, held, rows


def report(docs: DataFrame, labels: DataFrame) -> dict[str, dict]:
    """For each target what was handed over, the weights of both views and how far each moves the log-odds, and the accuracy on held rows of each view and of both."""
    _, models, views, held, rows = trained(docs, labels)
    out = {}
    for target, model in models.items():
        y = np.array([r[target] for r in rows])[held]
        alone = [float(((m.raw(*views.of(k)) > 0)[held] == y).mean()) for k, m in enumerate(model.views)]
        out[target] = {"handed": model.handed, "weights": model.mix.round(3).tolist(), "spreads": [round(float(abs(model.mix[k]) * m.raw(*views.of(k)).std()), 3) for k, m in enumerate(model.views)], "views": alone, "both": float(((model.score(views) > 0.5)[held] == y).mean()), "held": int(held.sum()), "most common": float(max(y.mean(), 1 - y.mean()))}
    return out


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without text, with score, quality_score, toxic_score (0 to 1) and kept.

    docs has doc_id, text, source and lang; labels has doc_id, quality and toxic (a document labelled more than once takes
    the lowest quality and the highest toxicity). score is quality_score * (1 - toxic_score), kept asks for KEEP_FROM of
    it. Null and empty texts have no words and score by their form; texts of any length count whole. Without labels every
    score is 0.5 or less and follows from the start model. Rows without a doc_id aren't learned from. Every row gives one
    row, and equal rows equal scores; an empty table gives none; clashing names get a leading _.
    """
    names = [fresh(docs, c) for c in ("score", "quality_score", "toxic_score", "kept")]
    words, models, *_ = trained(docs, labels)
    shared, model = (docs.sparkSession.sparkContext.broadcast(x) for x in (words, models))
    at = {c: docs.columns.index(c) for c in ("text", "source", "lang")}
    keep = [i for i, c in enumerate(docs.columns) if c != "text"]
    typed = docs.withColumns({c: F.col(c).cast("string") for c in at})
    schema = schema_plus(typed, dict.fromkeys(names[:3], "double"), without=("text",))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [features(t, s, g, shared.value) for t, s, g in zip(as_bytes(batch.column(at["text"])), *(batch.column(at[c]).to_pylist() for c in ("source", "lang")))]
            v = Views(got)
            q, t = (np.round(model.value[x].score(v), 9) for x in TARGETS)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(np.round(q * (1 - t), 9)), pa.array(q), pa.array(t)], names=schema.names)

    return typed.mapInArrow(run, schema).withColumn(names[3], F.col(names[0]) >= KEEP_FROM)
