from __future__ import annotations

import corpus_pipeline
from siltbed.llm import decontaminate, similar
from siltbed.llm.common import shared_dir, table
from tests.llm.test_decontaminate import brute as hits
from tests.llm.test_similar import brute as components

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    kept = corpus_pipeline.language(spark, docs, SF)
    assert kept.columns == docs.columns and kept.count() >= 0.98 * docs.count()
    one = corpus_pipeline.near_duplicates(spark, kept, SF)
    want = {d for d, c in components([(r.doc_id, r.text) for r in kept.collect()]) if c == d}
    assert {r.doc_id for r in one.collect()} == want and one.count() == len(want)
    items = [tuple(r) for r in table(spark, SF, "benchmark").collect()]
    clean = corpus_pipeline.decontamination(spark, one, SF)
    want = {r.doc_id for r in one.collect() if not hits(r.text, items)[-1]}
    assert {r.doc_id for r in clean.collect()} == want
    safe = corpus_pipeline.privacy(spark, clean, SF)
    assert safe.columns == docs.columns and {r.doc_id for r in safe.collect()} == want
    mixed = corpus_pipeline.mixture(spark, safe, SF)
    assert {r.doc_id for r in mixed.collect()} == want


def test_run_equals_its_stages(spark):
    got = corpus_pipeline.run(spark, SF)
    docs = table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, docs.collect()))
    assert similar.SIMILARITY == 0.8 and similar.SHINGLE_WORDS == 5 and decontaminate.WINDOW == 10


def test_run_leaves_its_result_only(spark, tmp_path):
    import glob

    before = set(glob.glob(f"{shared_dir(spark).removeprefix('file:')}/siltbed/*"))
    got = corpus_pipeline.run(spark, SF)
    left = set(glob.glob(f"{shared_dir(spark).removeprefix('file:')}/siltbed/*")) - before
    assert [p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in left] == ["stage-mixture"] and got.count() > 0


def test_stages_on_odd_rows(spark):
    """Nulls in every column, empty and long texts, repeated rows, clashing names, and an empty table."""
    words = "the cat sat on the mat and looked at the dog that was there all day long".split()
    text = " ".join(words[k * 7 % len(words)] for k in range(80))
    rows = [(1, text, "en", "a", 1), (2, text, "en", "a", 1), (2, text, "en", "a", 1), (None, text + " or so it went", None, None, None), (4, None, "en", "b", 0), (5, "", None, None, None), (6, (text + " ") * 800, "en", "b", 2)]
    extra = "gone int, place int, component_id int, lang_pred string, item_ids string, n_entities int, size int"
    df = spark.createDataFrame([(*r, 1, 2, 3, "x", "y", 4, 5) for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {extra}")
    for docs in (df, df.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            if name != "mixture":
                assert out.columns == df.columns, name
                docs = out
        found = out.collect()
        assert len(found) == docs.count() and {r.doc_id for r in found} <= {1, 2, 4, 5, 6, None}
    assert corpus_pipeline.near_duplicates(spark, df, SF).where("doc_id = 2").count() == 0
