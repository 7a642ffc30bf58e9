from __future__ import annotations

import random

import numpy as np

from siltbed.llm import cotrain as C


def corpus():
    rng = random.Random(3)
    plain = ["the", "river", "stone", "walks", "under", "light", "with", "green", "hills", "and", "birds"]
    docs, labels = [], []
    for k in range(900):
        words = rng.choices(plain, k=rng.randint(30, 80))
        bad, toxic = k % 5 == 0, k % 7 == 0
        if bad:
            words = [w + rng.choice(["###", "$$$", "%%%"]) for w in words]
        if toxic:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["blockhead", "nitwit", "dunce"])
        docs.append((k, " ".join(words), rng.choice(["good", "good", "web"]) if not bad else "web", "en"))
        if k % 2:
            labels.append((k, int(not bad), int(toxic)))
    return docs, labels


def test_rows_without_labels_are_classified(spark):
    docs, labels = corpus()
    got = C.classify(spark.createDataFrame(docs, "doc_id long, text string, source string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    rows = [r for r in got.collect() if r.doc_id % 2 == 0]
    right = [r.kept == (r.doc_id % 5 != 0 and r.doc_id % 7 != 0) for r in rows]
    assert sum(right) / len(right) > 0.97
    assert all(0 <= x <= 1 for r in rows for x in (r.score, r.quality_score, r.toxic_score))


def test_edges(spark):
    docs, labels = corpus()
    odd = [(2000, None, None, None), (2001, "", "web", "en"), (2002, "word " * 60_000, "web", None), (1, docs[1][1], "web", "en"), (None, "the river", None, "en")]
    table = spark.createDataFrame([(*r, 1.0) for r in docs[:200] + odd], "doc_id long, text string, source string, lang string, score double")
    told = spark.createDataFrame([*labels, (1, 0, 1), (None, 1, 0), (5, None, 0), (9999, 1, 1)], "doc_id long, quality int, toxic int")
    got = C.classify(table, told)
    assert got.columns == ["doc_id", "source", "lang", "score", "_score", "quality_score", "toxic_score", "kept"]
    assert got.count() == 205
    assert C.classify(table.limit(0), told).collect() == []
    assert C.classify(table, told.limit(0)).count() == 205


def made_views(n, rng, tell_b):
    """Rows whose label shows in words 0 and 1, and in metadata slot 0 or 1 if tell_b."""
    y = np.array([rng.random() < 0.5 for _ in range(n)]).astype(int)
    rows = [{"words": [int(v) if rng.random() < 0.9 else 1 - int(v), *(rng.randrange(2, 30) for _ in range(5))], "meta": [int(v) if tell_b and rng.random() < 0.95 else rng.randrange(2), 5], "shares": [rng.random() for _ in range(C.N_SHARES)]} for v in y]
    return C.Views(rows), y


def test_regression_equals_a_plain_one():
    rng = random.Random(1)
    views, y = made_views(60, rng, True)
    owner, slot, dense = views.of(0)
    x = np.zeros((60, C.VOCABULARY + C.N_SHARES))
    np.add.at(x, (owner, slot), 1)
    x[:, C.VOCABULARY :] = dense
    weight = np.linspace(0.3, 1, 60)
    model = C.Logistic(C.VOCABULARY, C.N_SHARES).fit(owner, slot, dense, y.astype(float), weight, rounds=40)
    w, b, gw, gb = np.zeros(x.shape[1]), 0.0, np.full(x.shape[1], 1e-8), 1e-8
    for _ in range(40):
        e = (1 / (1 + np.exp(-(x @ w + b))) - y) * weight / weight.sum()
        dw, db = x.T @ e + 2e-4 * w, e.sum()
        gw, gb = gw + dw * dw, gb + db * db
        w, b = w - 0.5 * dw / np.sqrt(gw), b - 0.5 * db / np.sqrt(gb)
    assert np.allclose(np.append(model.w, model.v), w) and np.isclose(model.b, b)


def test_exchange_hands_over_what_each_view_is_surest_of():
    rng = random.Random(2)
    views, y = made_views(600, rng, True)
    known = np.arange(600) < 120
    told = np.where(known, y, -1)
    held = known & (np.arange(600) % 5 == 0)
    model = C.CoTrained.fit(views, told, held, rounds=1)
    # by hand: fit each view on what it knows, take the surest free rows of each class, fit again
    start = [C.Logistic(*size).fit(*views.only(k, known & ~held), told[known & ~held].astype(float), np.ones((known & ~held).sum())) for k, size in enumerate(((C.VOCABULARY, C.N_SHARES), (C.META, 0)))]
    given = [np.where(known & ~held, told, -1) for _ in range(2)]
    handed = []
    for view in (0, 1):
        p = 1 / (1 + np.exp(-start[view].raw(*views.of(view))))
        for label, sure in ((1, p), (0, 1 - p)):
            best = [i for i in sorted(range(600), key=lambda i: (-sure[i], i)) if told[i] < 0 and given[1 - view][i] < 0 and sure[i] >= C.SURE][: int(np.ceil(C.HANDED * 480))]
            given[1 - view][best] = label
            handed.append((0, view, label, len(best)))
    assert model.handed == handed and sum(n for *_, n in handed) > 0
    for view, size in enumerate(((C.VOCABULARY, C.N_SHARES), (C.META, 0))):
        use = given[view] >= 0
        again = C.Logistic(*size).fit(*views.only(view, use), given[view][use].astype(float), np.where((known & ~held)[use], 1.0, 0.3))
        assert np.allclose(again.w, model.views[view].w) and np.isclose(again.b, model.views[view].b)
    assert ((model.score(views) > 0.5) == y).mean() > 0.85 and model.mix[1] > 0.1


def test_a_view_that_tells_nothing_moves_few_scores():
    views, y = made_views(600, random.Random(4), False)
    known = np.arange(600) < 300
    model = C.CoTrained.fit(views, np.where(known, y, -1), known & (np.arange(600) % 5 == 0))
    told = [abs(model.mix[k]) * m.raw(*views.of(k)).std() for k, m in enumerate(model.views)]
    assert told[1] < told[0] / 3 and ((model.score(views) > 0.5) == y)[~known].mean() > 0.8


def test_report_tells_of_the_exchange(spark):
    docs, labels = corpus()
    found = C.report(spark.createDataFrame(docs, "doc_id long, text string, source string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert found["quality"]["both"] > 0.9 and found["toxic"]["both"] > 0.9 and len(found["quality"]["handed"]) == 4 * C.ROUNDS
