from __future__ import annotations

import re
from collections import Counter

import numpy as np

from siltbed.llm import rules as R

SPACE = r"[^\x20\x09-\x0D]+"
TEXTS = [None, "", " \n ", "a", "a b c a b c", "x " * 60, "# * $ % & | < > word\nword\nword\n \n \nWORD", "äöü ß日本 e\u0301\n\näöü", "one two three. " * 30 + "\nEnd.", "a\u00a0b c", "l\r\nl\r\nl", "SHOUT!! OUT!! LOUD!!" * 40, "w " * 100_000]


def brute(text):
    words = re.findall(SPACE, text or "")
    lines = [x for x in (text or "").split("\n") if re.search(SPACE, x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(grams)
    hit = {i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_counts_equal_brute_force():
    for t in TEXTS:
        assert R.text_counts(None if t is None else t.encode())[:5] == brute(t), t and t[:40]


def test_em_finds_the_bad_rows_and_the_accurate_rules():
    rng = np.random.default_rng(1)
    good = rng.random(20_000) < 0.8
    right = np.array([0.95, 0.9, 0.85, 0.6])
    votes = np.where(rng.random((len(good), 4)) < right, np.where(good, 1, -1)[:, None], np.where(good, -1, 1)[:, None])
    votes[rng.random(votes.shape) < 0.2] = 0
    patterns, count = np.unique(votes, axis=0, return_counts=True)
    model = R.LabelModel.fit(patterns, count.astype(float))
    assert abs(model.prior - 0.8) < 0.05
    assert np.abs(model.accuracy - right).max() < 0.06
    where = {tuple(p): q for p, q in zip(patterns.tolist(), model.posterior(patterns))}
    assert np.mean((np.array([where[tuple(v)] for v in votes.tolist()]) >= 0.5) == good) > 0.93


def test_query_columns_and_edges(spark):
    rows = [(k, t, "x") for k, t in enumerate(TEXTS)] + [(3, "a", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    got = R.judge_quality(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        n, *_, repeat = brute(TEXTS[r.doc_id])
        assert r.base_failed == (n < 50 or 100 * repeat > 50 * n)
        assert r["kept"] == "x" and not (r["_kept"] and r.base_failed)
    assert R.judge_quality(docs.limit(0)).collect() == []


def test_clean_prose_is_kept_and_junk_is_not(spark):
    rng = np.random.default_rng(2)
    prose = [" ".join("".join(rng.choice(list("etaoinshr"), rng.integers(2, 9))) for _ in range(12)).capitalize() + "." for _ in range(600)]
    clean = [(k, "\n".join(prose[k * 10 : k * 10 + 10])) for k in range(60)]
    junk = [(100 + k, "\n".join(p.replace(" ", "### $$$ ") for p in prose[k * 10 : k * 10 + 10])) for k in range(10)]
    junk += [(200 + k, "\n".join(p.upper().replace(" ", "!! | ") for p in prose[k * 10 : k * 10 + 10])) for k in range(10)]
    kept = {r.doc_id for r in R.judge_quality(spark.createDataFrame(clean + junk, "doc_id long, text string")).where("kept").collect()}
    assert kept == {k for k, _ in clean}


def test_columns_of_any_name_stay(spark):
    docs = spark.createDataFrame([(1, "some words here", 5, "v"), (2, None, 6, "w")], "doc_id long, text string, vote_short int, votes string")
    got = R.judge_quality(docs)
    assert {(r.doc_id, r.vote_short, r.votes) for r in got.collect()} == {(1, 5, "v"), (2, 6, "w")} and "_vote_short" in got.columns
