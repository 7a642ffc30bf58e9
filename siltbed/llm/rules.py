"""Quality rules by weak supervision.

Each rule votes good (+1), bad (-1) or abstains (0) on counts of a document's words and lines. Expectation-maximisation
over all documents estimates, without labels, each rule's accuracy (how often its vote is right) and the share of good
documents; a document's posterior probability of being good replaces a chain of filters
that all must pass. EM needs only how often each pattern of votes occurs: at most 3 ** len(RULES) counts, whatever the
corpus, so those go to the driver and their posteriors are joined back by a broadcast of the same bounded size.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltbed.llm.common import as_bytes, fresh, schema_plus, stored

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_pipe_words", "n_end_lines")
_SYMBOL = bytes(b for b in range(256) if b not in b"#*$%&|<>")
#: Posterior from which a document is kept.
KEEP_FROM = 0.5


def text_counts(text: bytes | None) -> tuple[int, ...]:
    """COUNTS of a whole text."""
    if not text:
        return (0,) * len(COUNTS)
    words = text.split()
    n = len(words)
    joined = b"".join(words)
    word_chars = len(joined.translate(None, _CONTINUED))
    symbols = len(text.translate(None, _SYMBOL))
    dup = lines = ended = 0
    seen: set[bytes] = set()
    for line in text.split(b"\n"):
        if line.strip(b" \t\n\r\x0b\x0c"):
            lines += 1
            ended += line.rstrip(b" \t\r\x0b\x0c")[-1:] in b".!?"
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    repeat = repeated_words(words)
    decoded = joined.decode("utf-8", "replace")
    low, up = decoded.lower(), decoded.upper()
    letters = upper = 0
    if low != up:
        letters = sum(a != b for a, b in zip(low, up)) if len(low) == len(up) == len(decoded) else sum(c.isalpha() for c in decoded)
        upper = sum(map(str.isupper, decoded)) if decoded != low else 0
    return n, word_chars, symbols, dup, repeat, lines, upper, letters, words.count(b"|"), ended


#: Bytes that continue a UTF-8 character are deleted to count code points.
_CONTINUED = bytes(range(0x80, 0xC0))


def repeated_words(words: list[bytes]) -> int:
    """Words in 3-word windows that occur twice or more, each word once."""
    n = len(words) - 2
    if n < 2:
        return 0
    grams = list(zip(words, words[1:], words[2:]))
    if len(set(grams)) == n:
        return 0
    count = Counter(grams)
    total, covered = 0, 0
    for at, gram in enumerate(grams):
        if count[gram] > 1:
            total += at + 3 - max(at, covered)
            covered = at + 3
    return total


def with_counts(docs: DataFrame, columns: list[str]) -> DataFrame:
    """docs without text but with the COUNTS as long columns of these names."""
    at = docs.columns.index("text")
    keep = [i for i in range(len(docs.columns)) if i != at]
    schema = schema_plus(docs, dict.fromkeys(columns, "long"), without=("text",))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.array([text_counts(t) for t in as_bytes(batch.column(at))], np.int64).reshape(-1, len(COUNTS))
            new = [pa.array(np.ascontiguousarray(got[:, i])) for i in range(len(COUNTS))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), *new], names=schema.names)

    return docs.mapInArrow(run, schema)


def votes(c: dict[str, Column]) -> dict[str, Column]:
    """The rules: name to a vote of -1, 0 or +1.

    A rule that looks for a symptom votes bad or abstains: that a text lacks one symptom says little. Rules that look for
    prose vote good or abstain, and abstain on text whose characters or repeats already look odd.
    """
    words, lines, letters = (F.greatest(c[k], F.lit(1)).cast("double") for k in ("n_words", "n_lines", "n_letters"))

    def bad(symptom: Column) -> Column:
        return F.when(symptom, -1).otherwise(0)

    def good(sign: Column) -> Column:
        return F.when(sign, 1).otherwise(0)

    mean, symbols, caps = c["word_chars"] / words, c["n_symbols"] / words, c["n_upper"] / letters
    repeats, dups, pipes, ends = c["n_repeat_words"] / words, c["n_dup_lines"] / lines, c["n_pipe_words"] / words, c["n_end_lines"] / lines
    plain = (symbols < 0.15) & (caps < 0.25) & (pipes < 0.05) & (repeats < 0.3)
    return {
        "short": bad(c["n_words"] < 20),
        "odd_words": bad((mean < 2) | (mean > 12)),
        "symbols": bad(symbols > 0.3),
        "capitals": bad(caps > 0.4),
        "repeats": bad(repeats > 0.3),
        "same_lines": bad(dups > 0.3),
        "table": bad(pipes > 0.1),
        "no_sentences": bad((ends < 0.2) & (c["n_words"] >= 20)),
        "sentences": good(plain & (ends >= 0.5)),
        "fluent_words": good(plain & (mean >= 3) & (mean <= 9)),
        "long_fresh": good(plain & (c["n_words"] >= 50) & (repeats < 0.1) & (dups < 0.1)),
    }


class LabelModel:
    """Votes that are independent given a hidden class; chance[class, rule, vote + 1], class 0 is bad and 1 is good.

    That a rule abstains tells something too: a class's own share of abstentions is fitted with its votes.
    """

    def __init__(self, prior: float, chance: np.ndarray):
        self.prior, self.chance = prior, chance

    @classmethod
    def fit(cls, patterns: np.ndarray, count: np.ndarray, rounds: int = 500) -> "LabelModel":
        """EM on vote patterns and how often each occurs; it starts from the majority of votes, a tie meaning bad."""
        total = count.sum()
        hot = np.stack([(patterns == v).astype(float) for v in (-1, 0, 1)], axis=2)
        # pseudocounts: a rule votes as it means to in most cases, and each vote is possible in each class
        told = np.array([[2.0, 2.0, 0.1], [0.1, 2.0, 2.0]])[:, None, :]
        good = np.where(patterns.sum(axis=1) > 0, 0.95, 0.05)
        model = cls(0.8, np.full((2, patterns.shape[1], 3), 1 / 3))
        for _ in range(rounds):
            chance = np.stack([np.einsum("n,nkv->kv", w * count, hot) for w in (1 - good, good)]) + told
            model = cls(float((good @ count + 8) / (total + 10)), chance / chance.sum(axis=2, keepdims=True))
            after = model.posterior(patterns)
            if np.abs(after - good).max(initial=0) < 1e-10:
                break
            good = after
        return model

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability that a text with these votes is good."""
        odds = np.log(self.prior / (1 - self.prior)) + sum(np.log(self.chance[1, r, v] / self.chance[0, r, v]) for r, v in enumerate((patterns + 1).T))
        return 1 / (1 + np.exp(-np.clip(odds + np.zeros(len(patterns)), -700, 700)))

    @property
    def accuracy(self) -> np.ndarray:
        """For each rule the probability that a cast vote is right."""
        right = (1 - self.prior) * self.chance[0, :, 0] + self.prior * self.chance[1, :, 2]
        return right / (right + (1 - self.prior) * self.chance[0, :, 2] + self.prior * self.chance[1, :, 0])


def judge_quality(docs: DataFrame, keep_from: float = KEEP_FROM) -> DataFrame:
    """docs without text, with the COUNTS, the vote of each rule (vote_<name>), good_probability, base_failed and kept.

    base_failed: under 50 words, or over half of the words in repeated 3-word windows; such rows are not kept. Null and
    empty texts count zero throughout and so fail. Every row gives one row, repeated ones equal values; an empty table
    gives none. Names that clash with columns of docs get a leading _.
    """
    name = {c: fresh(docs, c) for c in (*COUNTS, "good_probability", "base_failed", "kept", "votes")}
    counted = with_counts(docs.withColumn("text", F.col("text").cast("string")), [name[c] for c in COUNTS])
    rules = votes({c: F.col(name[c]) for c in COUNTS})
    cast = [fresh(docs, f"vote_{r}") for r in rules]
    voted = stored(counted.withColumns({c: v.cast("int") for c, v in zip(cast, rules.values())}), "votes")
    found = voted.groupBy(*cast).count().collect()  # at most 3 ** len(rules) rows
    table = np.array([[*r] for r in found], np.int64).reshape(-1, len(cast) + 1)
    model = LabelModel.fit(table[:, :-1], table[:, -1].astype(float))
    chance = model.posterior(table[:, :-1]) if len(table) else np.empty(0)
    rows = [(",".join(map(str, t[:-1].tolist())), float(round(p, 12))) for t, p in zip(table, chance)]
    known = docs.sparkSession.createDataFrame(rows, f"{name['votes']} string, {name['good_probability']} double")
    out = voted.withColumn(name["votes"], F.concat_ws(",", *cast)).join(F.broadcast(known), name["votes"], "left").drop(name["votes"])
    n, repeat = F.col(name["n_words"]), F.col(name["n_repeat_words"])
    out = out.withColumn(name["base_failed"], (n < 50) | (100 * repeat > 50 * n))
    return out.withColumn(name["kept"], ~F.col(name["base_failed"]) & (F.col(name["good_probability"]) >= keep_from))
