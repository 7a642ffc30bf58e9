from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from siltbed.operators import hmm as H
from siltbed.operators import transcripts as T
from siltbed.operators import variants as V
from siltbed.streaming import runs as R

KIND = "array<struct<start:long,end:long>>"


def test_snps_need_quality_and_straight_flanks(spark):
    seq = "ACGTACGTACGTACG"
    rows = [("ok", 100, "15M", "I" * 15), ("alt", 100, "15M", "I" * 15), ("low", 100, "15M", "I" * 7 + "+" + "I" * 7), ("flank", 100, "15M", "I" * 5 + "$" + "I" * 9), ("gap", 100, "6M1I8M", "I" * 15), ("edge", 104, "15M", "I" * 15), ("intron", 90, "5M5N10M", "I" * 15), ("below", 100, "15M", "I" * 7 + "8" + "I" * 7)]
    reads = spark.createDataFrame([(n, "c", p, c, seq if n != "alt" else seq[:7] + "G" + seq[8:], q) for n, p, c, q in rows], "read string, chr string, pos long, cigar string, seq string, qual string")
    snps = spark.createDataFrame([("c", 107, "T", ["G"], "s1")], "chr string, pos long, ref string, alts array<string>, name string")
    got = {r.read: r.allele for r in V.observe_snps(reads, snps, 20, 5).collect()}
    assert got == {"ok": "ref", "alt": "alt"}
    loose = {r.read: r.allele for r in V.observe_snps(reads, snps, 0, 0).collect()}
    assert loose["below"] == "ref" and loose["gap"] == "other"
    mol = spark.createDataFrame([("ok", "c1", "u1"), ("alt", "c1", "u2"), ("edge", "c2", "u1")], "read string, cell string, umi string")
    counts = V.allele_counts(V.observe_snps(reads, snps, 20, 5), mol)
    assert [tuple(r) for r in counts.collect()] == [("c1", "s1", 1, 1)]
    cells = spark.createDataFrame([("c1",), ("c2",)], "cell string")
    assert sorted(tuple(r) for r in V.cell_genotypes(counts, cells, 1).collect()) == [("c1", "MUT"), ("c2", "NO_INFO")]


def test_snps_in_each_aligned_stretch(spark):
    kinds = ["40M", "10M5D20M", "8=2X3I20M", "12M900N15M", "5S20M3D4M", "300M"]
    made = [(f"r{k}", "c", 37 * k % 2500, kinds[k % 6]) for k in range(60)]
    length = lambda c: sum(int(n) for n, o in re.findall(r"(\d+)([MIS=X])", c))
    reads = spark.createDataFrame([(n, c, p, g, ("ACGT" * 80)[: length(g)], "I" * length(g)) for n, c, p, g in made], "read string, chr string, pos long, cigar string, seq string, qual string")
    snps = spark.createDataFrame([("c", p, "A", ["G"], f"s{p}") for p in range(3, 3600, 7)], "chr string, pos long, ref string, alts array<string>, name string")
    want = set()
    for n, _, p, g in made:
        at, ref = 0, p
        for size, o in re.findall(r"(\d+)([MIDNS=X])", g):
            size = int(size)
            if o in "M=X":
                want |= {(n, f"s{x}", "ACGT"[(at + x - ref) % 4]) for x in range(ref, ref + size) if x % 7 == 3}
            at, ref = at + size * (o in "MIS=X"), ref + size * (o in "MDN=X")
    got = [(r["read"], r["name"], r.base) for r in V.observe_snps(reads, snps, 20, 0).collect()]
    assert set(got) == {w for w in want if int(w[1][1:]) < 3600} and len(got) == len(set(got))
    # a read is held against SNPs of its own surroundings, not of 10,000 bases
    plan = V.observe_snps(reads, snps, 20, 0)._jdf.queryExecution().optimizedPlan().toString()
    assert "/ 10000" not in plan and f"/ {V.READ_BIN}" in plan


def test_refinement_at_introns(spark):
    genome = "AAAACCCCCGGGGTTTTACGT"
    at = lambda a, b: genome[a:b]
    assert V.refine_at_introns("3M1X8N4M", 0, "AAAGGTTT", at) == "3M8N5M"
    assert V.refine_at_introns("3M1X8N4M", 0, "AAATGTTT", at) == "3M1X8N4M"
    assert V.refine_at_introns("4M5N1X3M", 0, "AAAACGGG", at) == "5M5N3M"
    assert V.refine_at_introns("4M5N2X2M", 0, "AAAACCGG", at) == "4M5N2X2M"
    assert V.refine_at_introns("4M5N1X3M", 0, "AAAATGGG", at) == "4M5N1X3M"
    df = spark.createDataFrame([("r", "c", 0, "4M5N1X3M", "AAAACGGG"), ("s", "c", 0, "8M", "AAAACCCC")], "read string, chr string, pos long, cigar string, seq string")
    out = {r.read: r.cigar for r in V.refine_reads(df, spark.createDataFrame([("c", genome)], "chr string, seq string")).collect()}
    assert out == {"r": "5M5N3M", "s": "8M"}


def test_lifted_alignments_and_skips(spark):
    e = [(100, 150), (200, 250), (300, 350)]
    df = spark.createDataFrame([([(40, 60)], e, "+"), ([(40, 60)], e, "-"), ([(0, 10), (12, 20)], e, "+")], f"blocks {KIND}, exons {KIND}, strand string")
    got = [r.c for r in df.select(T.blocks_to_cigar(T.lift_alignment(F.col("blocks"), F.col("exons"), F.col("strand"))).alias("c")).collect()]
    assert got == ["10M50N10M", "10M50N10M", "10M2N8M"]
    tx = spark.createDataFrame([("t", "c", "+", e)], f"tx_id string, chr string, strand string, exons {KIND}")
    more = T.skip_augmented(tx, spark.createDataFrame([("c", 300), ("c", 200), ("c", 77)], "chr string, pos long"))
    assert {r.tx_id: len(r.exons) for r in more.collect()} == {"t": 3, "t_dE2": 2}


def test_feature_model_finds_its_feature(spark):
    rows = []
    for s in range(30):
        for p in range(60):
            inside = 20 <= p < 32
            rows.append((s, p, 5 + (p % 3) if inside else (p * 7 + s) % 5, inside))
    tokens = spark.createDataFrame(rows, "seq long, pos long, symbol int, inside boolean")
    states = H.feature_states(tokens, 4)
    one = [r.state for r in states.where("seq = 0").orderBy("pos").collect()]
    assert one == [0] * 16 + [1] * 4 + [2] * 12 + [3] * 4 + [0] * 24
    model = H.feature_model(states)
    assert model.transition[0, 2] == 0 and model.transition.sum(axis=1) == pytest.approx([1] * 4)
    told = H.infer_groups(tokens, ["seq"], ["pos"], "symbol", model)
    r = H.evaluate_feature(told).first()
    assert r.precision > 0.95 and r.recall > 0.95 and r.f1 > 0.95


def test_resume_pipe_and_progress(spark, tmp_path):
    calls = []

    def make():
        calls.append(1)
        return spark.range(3)

    for n, p in ((1, {"a": 1, "b": 2}), (1, {"b": 2, "a": 1}), (2, {"a": 2})):
        assert R.resumed(spark, str(tmp_path / "stage"), p, make).count() == 3 and len(calls) == n
    import pandas as pd

    df = spark.createDataFrame([("b",), ("a",)], "s string").coalesce(1)
    out = R.piped(df, ["sort"], "s string", lambda b: "\n".join(b["s"]) + "\n", lambda t: pd.DataFrame({"s": t.split()}))
    assert [r.s for r in out.collect()] == ["a", "b"]
    with pytest.raises(Exception, match="ended with"):
        R.piped(df, ["false"], "s string", lambda b: "", lambda t: pd.DataFrame({"s": []})).collect()
    listener = R.Progress()
    spark.streams.addListener(listener)
    spark.range(5).write.parquet(str(tmp_path / "in"))
    q = spark.readStream.schema("id long").parquet(str(tmp_path / "in")).writeStream.format("noop").trigger(availableNow=True).start()
    q.awaitTermination()
    spark._jsc.sc().listenerBus().waitUntilEmpty(20_000)
    spark.streams.removeListener(listener)
    assert sum(listener.rows.values()) == 5
