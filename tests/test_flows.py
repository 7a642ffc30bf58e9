from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltbed.operators import quantification as U
from siltbed.operators import reads as A
from siltbed.operators import transcripts as T
from siltbed.plans.analysis import Settings, analyse

KIND = "array<struct<start:long,end:long>>"


@pytest.fixture(scope="module")
def tiny(spark):
    tx = spark.createDataFrame([("g1", "t1", "chr1", "+", [(100, 150), (250, 300)]), ("g1", "t2", "chr1", "+", [(100, 150), (200, 220), (250, 300)]), ("g2", "t3", "chr1", "-", [(1000, 1100)])], f"gene string, tx_id string, chr string, strand string, exons {KIND}")
    rows = [
        ("r1", 0, 134, "15M101N15M", "c1", "u1"), ("r2", 0, 134, "15M101N15M", "c1", "u1"), ("r3", 0, 110, "20M", "c1", "u2"), ("r4", 0, 145, "20M", "c1", "u3"), ("r5", 16, 1010, "30M", "c1", "u1"), ("r6", 0, 1010, "30M", "c2", "u9"),
        ("r7", 256, 110, "20M", "c1", "u7"), ("r8", 4, 110, "20M", "c1", "u8"), ("r9", 0, 110, "20M", "c2", None), ("x", 0, 5000, "20M", "c2", "u1"),
    ]
    al = spark.createDataFrame([(q, f, "chr1", p, 60, c, {"CB": cb, "UB": u} if u else {"CB": cb}) for q, f, p, c, cb, u in rows], "qname string, flag int, rname string, pos long, mapq int, cigar string, tags map<string,string>")
    return al, tx


def test_units_and_datasets(spark, tiny):
    al, tx = tiny
    units = {r.gene: [(u.start, u.end) for u in r.units] for r in U.exon_catalogue(tx).collect()}
    assert units == {"g1": [(100, 150), (200, 220), (250, 300)], "g2": [(1000, 1100)]}
    out = U.quantify(al, tx, min_umis=2)
    got = sorted(tuple(r) for r in out["counts"].collect())
    assert got == [("exonic_exprs", "c1", "g1", 2), ("exonic_exprs", "c1", "g2", 1), ("exonic_exprs", "c2", "g2", 1), ("exprs", "c1", "g1", 3), ("exprs", "c1", "g2", 1), ("exprs", "c2", "g2", 1), ("intronic_exprs", "c1", "g1", 1)]
    assert [r.cell for r in out["cells"].collect()] == ["c1"]
    t = sorted(tuple(r) for r in U.transcript_counts(out["evidence"], tx, U.exon_catalogue(tx)).collect())
    assert t == [("c1", "t1", 2), ("c1", "t3", 1), ("c2", "t3", 1)]
    strict = U.quantify(al, tx, min_umis=1, require_strand=True)["counts"].where("feature = 'g2' and dataset = 'exprs'").collect()
    assert [r.cell for r in strict] == ["c1"]


def test_masks_are_made_once_for_equal_shapes(spark, tiny):
    al, tx = tiny
    many = al.crossJoin(spark.range(50)).drop("id")
    catalogue = U.exon_catalogue(tx)
    reads = A.with_blocks(many.where("flag = 0"), "pos", "cigar").select("rname", "blocks").withColumnRenamed("rname", "chr")
    shapes = reads.distinct()
    masks = U.shape_masks(shapes, catalogue, ("chr", "blocks"), 64)
    want = shapes.join(catalogue, "chr").select("blocks", "gene", T.mask_bits(F.col("blocks"), F.col("units")).alias("b")).where(F.size("b") > 0)
    plain = lambda df: sorted(repr((r.blocks, r.gene, r.b)) for r in df.collect())
    assert plain(masks) == plain(want) and masks.count() < reads.count() / 10
    evidence = U.quantify(many, tx)["evidence"]
    assert sorted(map(repr, evidence.collect())) == sorted(map(repr, U.quantify(al, tx)["evidence"].collect()))


def test_identities(spark, tiny):
    al, _ = tiny
    tags = spark.createDataFrame([("r9", "c7", "u7")], "read_id string, cell string, umi string")
    got = {r.qname: (r.cell, r.umi) for r in U.identified(al, tags).collect()}
    assert got["r9"] == ("c7", "u7") and got["r1"] == ("c1", "u1")
    assert U.identified(al).where("qname = 'r9'").count() == 0
    assert {r.cell for r in U.bulk_identity(al, "rname").collect()} == {"chr1"}


def test_analysis_separates_two_groups(spark):
    rng = np.random.default_rng(4)
    rows = []
    for cell in range(60):
        rate = np.full(40, 3.0)
        rate[:10] += 25 * (cell % 2)
        rate[10:20] += 25 * (1 - cell % 2)
        rows += [(cell, f"g{k:02d}", int(n)) for k, n in enumerate(rng.poisson(rate)) if n]
        rows += [(cell, "MT-CO1", 50)]
    rows += [(99, "g01", 3)]
    out = analyse(spark.createDataFrame(rows, "cell long, feature string, value long"), Settings(min_surviving=150, variable_genes=30, components=5, neighbours=8, markers=5))
    groups = {}
    for r in out["clusters"].collect():
        groups.setdefault(r.cluster, set()).add(r.cell % 2)
    assert all(len(g) == 1 for g in groups.values()) and 99 not in {r.cell for r in out["clusters"].collect()}
    assert out["qc"].where("cell = 1").first().mito == 50
    up = {r.feature for r in out["markers"].where("direction = 'up' and rank <= 3").collect()}
    assert up and all(int(f[1:]) < 20 for f in up)
