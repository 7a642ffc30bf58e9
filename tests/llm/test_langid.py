from __future__ import annotations

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltbed.llm import langid as L


def brute_bits(samples, text):
    """Code length of one language by recursion over contexts."""
    alphabet = sorted({b for bs in samples["all"] for b in bs} | {0x20})
    code = {b: k + 1 for k, b in enumerate(alphabet)}
    size = len(alphabet) + 1
    counts = {}
    for t in samples["own"]:
        s = [code[0x20]] * L.ORDER + [code.get(b, 0) for b in t]
        for i in range(L.ORDER, len(s)):
            for k in range(L.ORDER + 1):
                counts.setdefault(tuple(s[i - k : i]), {}).setdefault(s[i], 0)
                counts[tuple(s[i - k : i])][s[i]] += 1

    def p(context):
        shorter = p(context[1:]) if context else {x: 1 / size for x in range(size)}
        c = counts.get(context)
        if c is None:
            return shorter
        n, d = sum(c.values()), len(c)
        left = sum(q for x, q in shorter.items() if x not in c)
        out = {x: c[x] / (n + d) if x in c else shorter[x] / left * d / (n + d) for x in shorter}
        total = sum(out.values())
        return {x: q / total for x, q in out.items()}

    s = [code[0x20]] * L.ORDER + [code.get(b, 0) for b in text]
    return sum(-math.log2(p(tuple(s[i - L.ORDER : i]))[s[i]]) for i in range(L.ORDER, len(s)))


def test_code_lengths_equal_recursion(monkeypatch):
    samples = {"a": [L.symbols("the cat sat on the mat"), L.symbols("that hat")], "b": [L.symbols("der hut ist gut, über alles")]}
    trees = L.Trees(samples)
    every = [b for bs in samples.values() for b in bs]
    texts = [L.symbols(t) for t in ("the hut", "ßéx über", "z", "that mat is that")]
    for block in (1 << 20, 3):
        monkeypatch.setattr(L, "BLOCK", block)
        got = trees.code_lengths(texts)
        for k, t in enumerate(texts):
            for j, lang in enumerate(trees.langs):
                assert got[k, j] == pytest.approx(brute_bits({"own": samples[lang], "all": every}, t), rel=1e-5)


def made(seed, syllables, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(n))


def test_held_out_accuracy_and_edges(spark):
    kinds = {"xx": ["ka", "mo", "ri", "tu"], "yy": ["el", "an", "os", "ir"], "zz": ["ша", "го", "ли"]}
    rows = [(k, made(k, kinds[lang], 30), lang) for k, lang in enumerate(list(kinds) * 40)]
    rows += [(1000, None, "xx"), (1001, "", "yy"), (1002, "123 !?", None), (1003, made(3, kinds["zz"], 20_000), None), (0, rows[0][1], "xx"), (None, "kamori", "xx")]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    got = L.identify(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r["_score"] <= 1 and r["score"] == 0.5
        want = {1000: "und", 1001: "und", 1002: "und", 1003: "zz"}.get(r.doc_id, r.lang)
        assert r.lang_pred == want
    assert L.identify(docs.limit(0)).collect() == []
    assert {r.lang_pred for r in L.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert L.keep_known(docs).columns == docs.columns
    assert {r.doc_id for r in L.keep_known(docs).collect()} == {r[0] for r in rows} - {1000, 1001, 1002}


def test_labels_of_held_out_rows_and_predictions_inputs(spark):
    rows = [(k, made(k, ["ka", "mo"] if k % 2 else ["el", "an"], 20), "xx" if k % 2 else "yy", f"s{k}") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    spoilt = docs.withColumn("lang", F.when(L.held_out(F.col("doc_id")), F.lit("qq")).otherwise(F.col("lang")))
    one, two = ({(r.doc_id, r.lang_pred, r.score) for r in L.identify(d).collect()} for d in (docs, spoilt))
    assert one == two and np.isfinite([x[2] for x in one]).all()
