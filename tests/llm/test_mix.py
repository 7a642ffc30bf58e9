from __future__ import annotations

import itertools
import random
from collections import defaultdict

import pytest

from siltbed.llm import mix as M


def test_fit_reaches_the_nearest_sum_below():
    random.seed(1)
    for _ in range(200):
        lengths = random.sample(range(1, 30), random.randint(1, 4))
        counts = [random.randint(1, 3) for _ in lengths]
        goal = random.randint(0, sum(a * n for a, n in zip(lengths, counts)))
        take = M.fit(lengths, counts, goal)
        made = sum(a * k for a, k in zip(lengths, take))
        assert all(0 <= k <= n for k, n in zip(take, counts)) and made <= goal
        share = [n * goal // sum(a * n for a, n in zip(lengths, counts)) for n in counts]
        sums = [sum(a * k for a, k in zip(lengths, ks)) for ks in itertools.product(*[range(s, n + 1) for s, n in zip(share, counts)])]
        assert goal - made <= min(goal - s for s in sums if s <= goal) + max(lengths)


def test_fit_closes_large_budgets():
    random.seed(2)
    lengths = sorted(random.sample(range(1, 20_000), 800))
    counts = [random.randint(1, 40) for _ in lengths]
    total = sum(a * n for a, n in zip(lengths, counts))
    for goal in (total // 3, total // 2 + 1, 12_345, 7):
        assert goal - sum(a * k for a, k in zip(lengths, M.fit(lengths, counts, goal))) <= (0 if goal > 100_000 else lengths[0])


def test_targets_reshare_what_is_over():
    assert M.targets([100, 50, 10], [5, 2, 1], 240) == pytest.approx([220 * 5 / 7, 220 * 2 / 7, 20])
    assert M.targets([0, 0], [5, 2], 0) == [0, 0]
    got = M.targets([10, 1000, 10], [5, 2, 1], 1530)
    assert got == [20, 1490, 20]


def check(rows, got):
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size) for r in got) == sorted((d is None, d or 0, len((t or "").encode().split())) for d, _, t in rows)
    source = defaultdict(int)
    for _, s, t in rows:
        source[s] += len((t or "").encode().split())
    taken, target = defaultdict(int), {}
    name = {}
    for d, s, t in rows:
        name[d, len((t or "").encode().split())] = s
    for r in got:
        s = name[r.doc_id, r.size]
        assert r.source_size == source[s] and r.taken <= 2 * r.size and r.taken % max(r.size, 1) == 0
        taken[s] += r.taken
        target[s] = r.target
    assert sum(target.values()) == pytest.approx(min(1.5, 2) * sum(source.values()))
    return taken, target


def test_every_source_comes_near_its_target(spark):
    random.seed(3)
    rows = [(k, f"s{k % 4}", "w " * random.randint(0, 90)) for k in range(1200)]
    rows += [(5000 + k, "s0", "same words here") for k in range(900)]
    rows += [(9000, None, "a b c"), (9001, None, None), (9002, "s1", ""), (9003, "s2", "w " * 30_000), (9004, "", "x y")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, source string, text string, size int")
    got = M.mix(docs).collect()
    taken, target = check(rows, got)
    for s in ("s0", "s1", "s2", "s3"):
        assert abs(taken[s] - target[s]) <= 2
    again = M.mix(docs.repartition(3)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_edges(spark):
    schema = "doc_id long, source string, text string"
    assert M.mix(spark.createDataFrame([], schema)).collect() == []
    got = M.mix(spark.createDataFrame([(1, None, None), (2, None, "")], schema)).collect()
    assert [(r.size, r.taken, r.target) for r in got] == [(0, 0, 0), (0, 0, 0)]
    docs = spark.createDataFrame([(k, "s", "a b c d") for k in range(10)], schema)
    words = sum(r.times * 4 for r in M.mixed_documents(docs).collect())
    assert words == 60


def test_mixed_documents_are_those_that_mix_takes(spark):
    random.seed(5)
    rows = [(k % 40, random.choice(["a", "b", None]), "w " * random.choice([0, 3, 8]) + random.choice("xy"), 1, 2, "z") for k in range(300)] + [(7, "a", None, 1, 2, "z")] + [(None, "b", "one two", 1, 2, "z")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, times int, _d int, words string")
    taken, made = defaultdict(int), defaultdict(int)
    for r in M.with_source(docs).collect():
        taken[r.doc_id, r.source, r.size] += r.taken
    found = M.mixed_documents(docs)
    assert found.columns == [*docs.columns, "_times"]
    for r in found.collect():
        made[r.doc_id, r.source, len(r.text.split())] += r["_times"] * len(r.text.split())
    assert {k: v for k, v in taken.items() if v} == made
    one = spark.createDataFrame([(1, "s", "a b c d")] * 2, "doc_id long, source string, text string")
    assert sum(4 * r.times for r in M.mixed_documents(one).collect()) == sum(r.taken for r in M.mix(one).collect()) == 12
    assert M.mixed_documents(docs.limit(0)).collect() == []
