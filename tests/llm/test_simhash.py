from __future__ import annotations

import random

import numpy as np
import xxhash

from siltbed.llm import simhash as S


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d, f"{fps[i]:016x}", least[root(i)]) for i, (d, _) in enumerate(rows))


def flipped(x, n, width):
    for b in random.sample(range(width), n):
        x ^= 1 << b
    return x


def test_golay_words_at_two_bits_share_a_codeword():
    random.seed(1)
    for _ in range(500):
        a = random.getrandbits(23)
        x, y = S.codewords(np.array([a, flipped(a, random.randint(0, 2), 23)]))
        assert set(x[x >= 0]) & set(y[y >= 0])


def test_close_fingerprints_share_a_key():
    random.seed(2)
    for _ in range(500):
        a = random.getrandbits(64)
        k, r = S.keys(np.array([a, flipped(a, random.randint(0, 2), 64)], np.uint64))
        assert set(k[r == 0]) & set(k[r == 1])


def test_long_runs_lose_no_link():
    random.seed(3)
    base = random.getrandbits(64)
    fps = np.unique(np.array([flipped(base, random.randint(0, 3), 21) for _ in range(3000)], np.uint64))
    assert len(fps) > S.RUN
    pair = next(p for p, (i, j) in enumerate([(0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1)]) if (i, j) == (0, 1))

    def groups(links):
        parent = {}

        def root(x):
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        for a, b in links:
            parent[root(a)] = root(b)
        return sorted(sorted(int(y) for y in fps.view(np.int64) if root(int(y)) == r) for r in {root(int(x)) for x in fps.view(np.int64)})

    want = [(int(fps[a : a + 1].view(np.int64)[0]), int(fps[b : b + 1].view(np.int64)[0])) for a, b in zip(*S._pairs(fps))]
    assert groups(S.links(fps, pair)) == groups(want)


def test_components_equal_brute_force(spark):
    random.seed(4)
    vocabulary = [f"w{k}" for k in range(300)]
    rows = []
    for base in range(12):
        words = [random.choice(vocabulary) for _ in range(120)]
        for copy in range(6):
            rows.append((base * 10 + copy, " ".join(words)))
            words[random.randrange(len(words))] = random.choice(vocabulary)
    rows += [(500, None), (501, ""), (502, " \t\n"), (503, "One"), (504, "one"), (505, "A b"), (500, None), (7, rows[7][1])]
    rows += [(600, "x " * 40_000), (601, "X " * 40_000)]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, component_id string, fp int")
    got = sorted(tuple(r) for r in S.near_duplicates(docs).collect())
    assert got == brute(rows)


def test_empty_and_null_ids(spark):
    assert S.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    got = S.near_duplicates(spark.createDataFrame([(None, "a b c"), (3, "a b c"), (None, "q")], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(None, 3), (3, 3), (None, None)}


def test_one_of_each_group_stays(spark, monkeypatch):
    rows = [(1, "a b c d", "x"), (2, "A b c d", "y"), (3, "other words here", None), (3, "other words here", None), (None, "third text entirely", "z"), (None, "third text entirely", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, place string")
    for most in (S.BROADCAST_BYTES, 0):
        monkeypatch.setattr(S, "BROADCAST_BYTES", most)
        got = S.deduplicate(df)
        assert got.columns == df.columns and sorted((r.doc_id or 0) for r in got.collect()) == [0, 1, 3]
    assert S.deduplicate(df.limit(0)).collect() == []


def test_components_of_a_long_chain_and_a_hub(spark):
    edges = [(k, k + 1) for k in range(60)] + [(1000, 1000 + k) for k in range(1, 200)]
    got = {r.node: r.root for r in S.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(61)} | {1000 + k: 1000 for k in range(200)}
