from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from siltbed.functions import sequences as Q
from siltbed.operators import matrix as X
from siltbed.operators import reads as A
from siltbed.operators import relations as J


def test_names_and_filters(spark):
    df = spark.createDataFrame([("chr1",), ("chr24",), ("chrX",), ("chrY",), ("1",), ("chrM",), (None,)], "c string")
    assert [r.a for r in df.select(J.reference_accession(F.col("c")).alias("a")).collect()] == ["NC_000001.11", "chr24", "NC_000023.11", "NC_000024.10", "1", "chrM", None]
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), (None, 1)], "x string, y int")
    assert [tuple(r) for r in J.matching(rows, ["x=a", "y=1"]).collect()] == [("a", 1)]
    with pytest.raises(ValueError):
        J.matching(rows, ["z=1"])


def test_least_mismatches(spark):
    one = lambda *b: tuple(J.least_mismatches(spark.createDataFrame([(x,) for x in b], "barcode string")).first())
    assert one("AAAA", "AAAT", "CCCC") == (1, 0) and one("AAAA", "TTTT") == (4, 1) and one("AAAAAA", "AATTTA", "CCCCCC") == (3, 1)
    assert one("AAAA") == (None, None) and one("AAAA", "AAAA") == (None, None)


def test_pairs_without_barcodes(spark):
    a, b = "ACGTACGTACGTACGT", "TTTTACGTACGTACGG"
    rows = [(3, a + "A", b), (1, a.lower() + "C", b + "G"), (2, a, b[:15]), (4, a, b[:15]), (5, a[:15] + "N", b), (6, a[:15] + "N", b), (7, b, a)]
    got = A.distinct_pairs(spark.createDataFrame(rows, "ordinal long, r1_seq string, r2_seq string"))
    assert sorted(r.ordinal for r in got.collect()) == [1, 2, 4, 5, 6, 7]


def test_sequence_id_and_welch(spark):
    df = spark.createDataFrame([("ACGT",), ("acnt",), ("",), (None,), ("T" * 40,)], "s string")
    assert [r.v for r in df.select(Q.sequence_id(F.col("s")).alias("v")).collect()] == [0b00011011, 0b00010011, 0, 0, -1]
    rows = [("f", True, 1.0), ("f", True, 3.0), ("f", False, 2.0), ("f", False, 6.0), ("g", True, 1.0), ("h", True, 1.0), ("h", True, 1.0), ("h", False, 1.0), ("h", False, 1.0)]
    got = {r.k: (r.t, r.dof) for r in X.welch_statistics(spark.createDataFrame(rows, "k string, i boolean, v double"), ["k"], "i", "v").collect()}
    assert got["f"] == (pytest.approx(-2 / 5**0.5), pytest.approx(25 / 17)) and got["g"] == got["h"] == (0.0, 0.0)


def test_packing_is_compiled(spark):
    texts = [None, "", "a", "ACGTN", "ttt\nß", "G" * 32, "T" * 40, "ACGTTGCA" * 5]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    low, high = Q.pack_low_first(F.col("s")), Q.pack_high_first(F.col("s"))
    out = df.select("s", low.alias("low"), high.alias("high"), Q.unpack_low_first(low, F.length("s")).alias("again"))
    signed = lambda n: n - (1 << 64) if n >> 63 else n
    for r in out.collect():
        if r.s is None:
            assert r.low is None and r.high is None
            continue
        codes = [max(0, "ACGT".find(x.upper())) for x in r.s[:32]]
        assert r.low == signed(sum(c << 2 * i for i, c in enumerate(codes)))
        assert r.high == signed(sum(c << 2 * (len(codes) - 1 - i) for i, c in enumerate(codes)))
        assert r.again == "".join("ACGT"[codes[i % 32]] for i in range(len(r.s)))
    assert "lambda" not in out._jdf.queryExecution().optimizedPlan().toString()
