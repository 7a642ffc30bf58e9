from __future__ import annotations

import random
import re

from siltbed.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, window=10):
    ws, hit, ids = words(text), set(), set()
    for item, t in items:
        bs = words(t)
        n = min(window, len(bs))
        grams = {tuple(bs[i : i + n]) for i in range(len(bs) - n + 1)} if n else set()
        for i in range(len(ws) - n + 1 if n else 0):
            if tuple(ws[i : i + n]) in grams:
                hit |= set(range(i, i + n))
                ids.add(str(item))
    return len(ws), len(hit), len(ids), D.sha256_of(sorted(ids)), bool(hit)


def rows_and_items():
    random.seed(5)
    vocabulary = ["alpha", "beta", "gamma", "délta", "eps1", "zeta", "日本", "eta"]
    items = [(k, " ".join(random.choices(vocabulary, k=random.choice([3, 9, 10, 11, 30])))) for k in range(12)]
    items += [(100, None), (101, ""), (102, "..."), (103, items[3][1]), (104, "Solo!")]
    rows = [(0, None), (1, ""), (2, "?!"), (3, items[4][1]), (3, items[4][1]), (4, "solo")]
    for k in range(10, 60):
        parts = [" ".join(random.choices([*vocabulary, "other"], k=random.randint(0, 40)))]
        if k % 3 == 0:
            parts.insert(random.randint(0, 1), random.choice(items[:12])[1].upper().replace(" ", ",\n"))
        rows.append((k, " ".join(parts)))
    rows.append((99, ("beta " * 50_000) + items[5][1]))
    return rows, items


def test_equals_brute_force_in_one_block_and_in_many(spark):
    rows, items = rows_and_items()
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, n_words int")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = sorted((d, *brute(t, items)) for d, t in rows)
    for size in (1 << 20, 100):
        found = D.contamination(docs, benchmark, block_bytes=size)
        assert found.columns == ["doc_id", "text", "n_words", "_n_words", "hit_spans", "item_ids", "matches"]
        got = D.digest(found.select("doc_id", found["_n_words"].alias("n_words"), "hit_spans", "item_ids"))
        assert sorted(tuple(r) for r in got.collect()) == want


def test_small_shards_and_empty_tables(spark, monkeypatch):
    rows, items = rows_and_items()
    block = D.Items([(i, None if t is None else t.encode()) for i, t in items], 10)
    texts = [None if t is None else t.encode() for _, t in rows]
    whole = D._found(block, texts)
    for words_of, chunk in ((50, 1 << 18), (1 << 20, 3), (50, 1)):
        monkeypatch.setattr(D, "SHARD_WORDS", words_of)
        monkeypatch.setattr(D, "CHUNK", chunk)
        got = D._found(block, texts)
        assert [(n, sum(b - a for a, b in s), len(i)) for n, s, i, _ in got] == [brute(t, items)[:3] for _, t in rows] and got == whole
    docs = spark.createDataFrame(rows[:5], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r.contaminated for r in D.digest(D.contamination(docs, none)).collect()} == {False}
    assert D.contamination(docs.limit(0), none).collect() == []


def test_affected_documents_go(spark):
    docs = spark.createDataFrame([(1, "so one two three four", 3), (2, "clean", 1), (3, None, 0)], "doc_id long, text string, n_words int")
    benchmark = spark.createDataFrame([(1, "One two, three")], "item_id long, text string")
    assert sorted(tuple(r) for r in D.decontaminate(docs, benchmark).collect()) == [(2, "clean", 1), (3, None, 0)]


def longest(text, items, window=10):
    """Every longest verbatim match, by following each diagonal."""
    ws, out = words(text), []
    for item, t in items:
        bs = words(t)
        least = min(window, len(bs))
        for d in range(-len(bs) + 1, len(ws)) if bs else ():
            run = 0
            for p in range(max(0, -d), min(len(bs), len(ws) - d) + 1):
                same = p < min(len(bs), len(ws) - d) and bs[p] == ws[p + d]
                if same:
                    run += 1
                elif run:
                    if run >= least:
                        out.append((str(item), p - run, p - run + d, run))
                    run = 0
    return sorted(out)


def test_matches_are_the_longest_with_their_places(monkeypatch):
    rows, items = rows_and_items()
    rows = [r for r in rows if len(r[1] or "") < 10_000] + [(200, items[4][1] + " other " + items[5][1] + " " + items[3][1]), (201, " ".join(items[4][1].split()[3:]))]
    block = D.Items([(i, None if t is None else t.encode()) for i, t in items], 10)
    texts = [None if t is None else t.encode() for _, t in rows]
    want = [longest(t, items) for _, t in rows]
    assert sum(map(len, want)) > 12
    for n_of in (None, 0):  # test suffixes in the shard's array, and training suffixes in the items' array
        if n_of == 0:
            monkeypatch.setattr(D, "SHARD_WORDS", 1)
        assert [sorted(m) for *_, m in D._found(block, texts)] == want


def test_null_item_ids_hit_but_have_no_name(spark):
    docs = spark.createDataFrame([(1, "so one two three four")], "doc_id long, text string")
    benchmark = spark.createDataFrame([(None, "one two three"), (7, "two three"), (None, None)], "item_id long, text string")
    r = D.digest(D.contamination(docs, benchmark)).first()
    assert (r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (3, 1, D.sha256_of(["7"]), True)
