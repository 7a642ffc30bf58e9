from __future__ import annotations

import random

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

from siltbed.llm import tokens as T  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def both():
    return T.PrefixTokens(PATH, public_tokenizers.PATTERN), tokenizers.Tokenizer.from_file(PATH)


def size(library, text):
    return len(library.encode(text, add_special_tokens=False).ids)


FIXED = ["", " ", "   ", "a   b\n\n c  ", "it's they're we'll 'r 'l 'v", "x <|endoftext|>  y$$<|endoftext|>z<|end", "<|endoftext|>", " <|endoftext|> ", "éàü 日本語 テスト 🎉🎉", "aaaa aaaaaaa", "\t\t\n  \n####  !!!! 12345 ²Ⅷ", "e\u0301\u00a0x\u3000 y"]


def test_every_prefix_equals_the_library(both):
    counter, library = both
    random.seed(1)
    parts = ["a", "e", "th", " ", "  ", "\n", "'", "s", "re", "1", "23", "é", "ß", "日", "🎉", "<|endoftext|>", "#", "$", ".", "\t", "A", "ll", "<", "|"]
    for text in FIXED + ["".join(random.choices(parts, k=random.randint(1, 25))) for _ in range(300)]:
        want = [size(library, text[:k]) for k in range(len(text) + 1)]
        assert counter.prefix_counts(text).tolist() == want
        assert counter.count(text) == want[-1]
        assert counter.fit(text, 3) == max(k for k, n in enumerate(want) if n <= 3)


def test_long_pieces_and_a_full_cache(both, monkeypatch):
    counter, library = both
    monkeypatch.setattr(T, "CACHE_PIECES", 5)
    for text in ("ab" * 5000, "z" * 3000, " " * 2000 + "x", "word " * 3000, "#!" * 900):
        assert counter.count(text) == size(library, text)


def test_table(spark, both):
    _, library = both
    rows = [(k, t, 1) for k, t in enumerate(FIXED)] + [(50, None, 1), (50, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = T.token_counts(docs, PATH, public_tokenizers.PATTERN, budget=2).collect()
    assert sorted((r.doc_id, r.n_bytes, r["_n_tokens"]) for r in got) == sorted((k, len((t or "").encode()), size(library, t or "")) for k, t, _ in rows)
    for r in got:
        assert size(library, (r.text or "")[: r.fit_chars]) <= 2
    assert T.token_counts(docs.limit(0), PATH, public_tokenizers.PATTERN).collect() == []
