from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltbed.operators import grammar as G
from siltbed.operators import loci as L
from siltbed.operators import receptors as V


def test_grammar_steps():
    g = G.Grammar.parse("x", "TYPE:VDJ+SEARCH:0..3+FIXED:ACGTAC:mm=1+CELL:4+UMI:3+POLYT:min=2")
    m = G.match_at(g, "GGACGTTCAAAACCCTTTTGATTACA", 0)
    assert (m.kind, m.start, m.parts, m.insert_start) == ("VDJ", 2, {"CELL": "AAAA", "UMI": "CCC"}, 19)
    assert G.match_at(g, "GGGGACGTACAAAACCCTTT", 0) is None
    assert G.match_at(g, "ACGTACAAAACCCTG", 0) is None
    short = G.Grammar.parse("y", "CELL:4+INSERT:GGGG:mm=1")
    assert G.match_at(short, "AAAAGGCGTT", 0).insert_start == 4 and G.match_at(short, "AAAAGCCGTT", 0) is None
    assert not G.Grammar.parse("z", "INSERT:ACGT").barcoded
    for bad in ("CELL:x", "FIXED:", "SEARCH:5..1", "WHAT:1", "POLYT:3"):
        with pytest.raises(ValueError):
            G.Grammar.parse("bad", bad)


def test_all_primers_on_both_strands(spark):
    g = G.Grammar.parse("x", "FIXED:ACGTTGCA+CELL:4+UMI:2")
    one = "ACGTTGCA" + "AAAA" + "CC" + "GATTACAGATTACA"
    rc = one.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    found = G.detect([g], one + one, everywhere=True)
    assert [(m.start, m.insert_end - m.insert_start) for m in found] == [(0, 14), (28, 14)]
    both = G.detect([g], one + rc, everywhere=True, both_strands=True)
    assert sorted((m.strand, m.parts["CELL"]) for m in both) == [("+", "AAAA"), ("-", "AAAA")]
    df = G.detect_reads(spark.createDataFrame([(1, one), (2, "TTTT"), (3, None)], "id long, seq string"), [g], everywhere=True)
    assert [(r.id, r.cell, r.umi, r.insert) for r in df.collect()] == [(1, "AAAA", "CC", "GATTACAGATTACA")]
    assert G.anchor_starts("TTACGTTGCATT", "ACGTTGCA", 2) == [0]
    with pytest.raises(ValueError):
        G.anchor_starts("ACGT", "ACG", 0)


def test_pairs_keep_the_first_of_each_molecule(spark):
    g = G.Grammar.parse("x", "CELL:4+UMI:4")
    tail = "GATTACAGCCATGCATCGATCGGATCCATGCAAT"
    rows = [(2, "late", "AAAACCCC", tail), (1, "first", "AAAACCCC", tail), (3, "other", "AAAACCCG", tail), (4, "unclear", "AANACCCG", tail), (5, "poor", "AAAACCCC", "A" * 40), (6, "short", "AAAAC", tail)]
    df = spark.createDataFrame(rows, "ordinal long, id string, r1_seq string, r2_seq string")
    assert sorted(r.id for r in G.normalise_pairs(df, [g]).collect()) == ["first", "other"]
    none = G.Grammar.parse("n", "INSERT:ACGT")
    mates = [(k, f"r{k}", "ACGT" + "ACGGTCATTGCA" + "TTTT", tail) for k in range(3)]
    assert [r.id for r in G.normalise_pairs(spark.createDataFrame(mates, "ordinal long, id string, r1_seq string, r2_seq string"), [none]).collect()] == ["r0"]
    assert G.trim_readthrough("CCCCGGTTAA", "TTAACC") == "CCCC" and G.trim_readthrough("CCCCAGG", "TTAACC") == "CCCCA" and G.trim_readthrough("CCCC", "TTAACC") == "CCCC"


def test_read_names_round_trip(spark):
    df = spark.createDataFrame([("r1", "ACGT", "IIII", "CC", "##", "VDJ")], "i string, c string, cq string, u string, uq string, t string")
    made = df.select(G.read_name(*(F.col(c) for c in ("i", "c", "cq", "u", "uq", "t"))).alias("n"))
    assert made.first().n == "r1|41434754|49494949|4343|2323|V|"
    r = made.select(G.parse_read_name(F.col("n")).alias("x")).first().x
    assert tuple(r) == ("r1", "ACGT", "IIII", "CC", "##", "VDJ")
    odd = spark.createDataFrame([("r|41|49|43|23|",), ("r|41|49|43|23|Q|",), ("r|41|49",), ("|41|49|43|23|",), ("r|4|49|43|23|",)], "n string")
    assert [x.x.type if x.x else None for x in odd.select(G.parse_read_name(F.col("n")).alias("x")).collect()] == ["GEX", None, None, None, None]


def test_gene_classes(spark):
    names = {"IGHD": "C", "IGHD1-1": "D", "ighv3-23": "V", "TRBJ2-1": "J", "IGHG1": "C", "IGHGP": None, "TRAC": "C", "ACTB": None, "TRAD": None, "IGKC": "C", "TRDD2": "D"}
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", V.gene_kind(F.col("n")).alias("k"), V.gene_chain(F.col("n")).alias("c"))
    assert {r.n: r.k for r in df.collect()} == names
    classes = spark.createDataFrame([("mt-Co1",), ("RPS3",), ("TRAV1",), ("TRAC",), ("IGHD",), ("X",)], "n string").select(V.gene_class(F.col("n")).alias("c")).collect()
    assert [r.c for r in classes] == ["mito", "ribo", "vdj", "other", "vdj", "other"]


def test_productivity():
    v, mid, j = "ATGGCCTGTGCG", "AGAGAT", "TTTGGCCAGGGCACC"
    seq = v + mid + j
    r = V.productivity(seq, (0, len(v)), (len(v) + len(mid), len(seq)), 0, 0)
    assert r["status"] == "productive" and r["junction_aa"] == "CARDF" and r["cdr3_aa"] == "ARD"
    assert V.productivity(seq, (0, len(v)), (len(v) + len(mid), len(seq)))["status"] == "productive"
    stop = v + "TGAGAT" + j
    assert V.productivity(stop, (0, 12), (18, 33), 0, 0)["status"] == "stop_codon"
    assert V.productivity(seq, (0, 6), (18, 33), 0, 0)["status"] == "missing_v_anchor"
    assert V.productivity(seq, (0, 12), (18, 24), 0, 0)["status"] == "missing_j_anchor"
    assert V.productivity("AC", (0, 2), (0, 2), 0, 0)["status"] == "too_short"
    assert V.recombination_id("IGH", "v", None, "j", "acg") == V.recombination_id("IGH", "v", "", "j", "ACG") != V.recombination_id("IGH", "v", "d", "j", "ACG")
    assert V.imgt_translate("TGT---G-CGCN") == "C-XX"


def test_families(spark):
    naive = "ACGTACGTACGTACGTACGT"
    other = "TTTTACGTACCTACGTGGGT"
    mut = lambda s, *at: "".join("A" if k in at and c != "A" else "C" if k in at else c for k, c in enumerate(s))
    rows = [("c1", "AAAA", naive), ("c2", "AAAT", mut(naive, 3)), ("c3", "AATT", mut(naive, 5)), ("c4", "AAAA", mut(naive, 1)), ("c5", "GGGGGGGG", other), ("c6", "AAAA", "GGGGGGGGGGGGGGGGGGGG")]
    df = spark.createDataFrame([(c, "IGH", "v1", "j1", d, naive if c != "c5" else other, o) for c, d, o in rows] + [("c9", "IGH", "", "j1", "A", naive, naive)], "cell string, chain string, v string, j string, cdr3 string, naive string, observed string")
    got = {r.cell: (r.family, r.mutations) for r in V.clone_families(df, 3).collect()}
    assert got == {"c1": ("AAAA", 0), "c2": ("AAAA", 1), "c3": ("AAAA", 1), "c4": ("AAAA", 1), "c5": ("GGGGGGGG", 0), "c6": (None, None)}
    assert V.mad_fence([1, 1, 2, 2]) == 7 and V.mad_fence([1, 2, 3]) is None and V.edits("kitten", "SITTING") == 3 and V.edits("", "ab") == 2
    cons = V.consensus(spark.createDataFrame([("g", "AC-"), ("g", "ACT"), ("g", "GC.")], "g string, s string"), "g", "s")
    assert sorted((r.pos, r.base, r.n) for r in cons.collect()) == [(0, "A", 2), (1, "C", 3), (2, "T", 1)]
    models = V.hypothetical_models(spark.createDataFrame([("IGH", "v", "ACGTACGT", 5), ("IGH", "v", "ACGTACGA", 3), ("IGH", "v", "TTTTTTTT", 1)], "chain string, v string, sequence string, reads long"), least_reads=2)
    assert {r.sequence: r.model for r in models.collect()} == {"ACGTACGT": 0, "ACGTACGA": 0, "TTTTTTTT": None}
    out = V.reference_outliers(spark.createDataFrame([(float(x),) for x in [1] * 20 + [9]], "x double"), "x")
    assert out.where("outlier").count() == 1


def test_loci_and_hits(spark):
    kind = "array<struct<start:long,end:long>>"
    f = spark.createDataFrame([(1, "c", "+", "Ring", [(0, 100)]), (2, "c", "+", "Ring", [(0, 90)]), (3, "c", "+", "Ring", [(0, 30)]), (4, "c", "+", "Loop", [(0, 90)])], f"id long, chr string, strand string, label string, blocks {kind}")
    assert sorted(r.id for r in L.collapse_same_label(f).collect()) == [2, 3, 4]
    rel = spark.createDataFrame([("g", 1, "A", "t", 0, 10), ("g", 2, "B", "t", 9, 20), ("g", 3, "A", "u", 0, 9), ("g", 4, "A", "w", 0, 4), ("h", 5, "A", "t", 0, 10)], "gene string, id long, family string, tag string, start long, end long")
    assert {r.id: r.locus for r in L.collapse_related(rel).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}
    hits = spark.createDataFrame([("r", 0, "+", 0, 10, 100, 110), ("r", 0, "+", 8, 20, 108, 120), ("r", 0, "+", 21, 30, 121, 130), ("r", 0, "-", 0, 5, 0, 5)], "read string, reference long, strand string, read_start long, read_end long, start long, end long")
    assert sorted((r.strand, r.read_start, r.read_end) for r in L.collapse_hits(hits).collect()) == [("+", 0, 20), ("+", 21, 30), ("-", 0, 5)]


def test_same_label_islands_equal_all_pairs(spark):
    rng = random.Random(6)
    made = []
    for k in range(160):
        at, n = rng.randrange(600), rng.randint(1, 30)
        blocks = [(at, at + n)] + ([(at + n + 5, at + n + 5 + rng.randint(1, 9))] if k % 3 == 0 else [])
        made.append((k, "c", rng.choice("+-"), rng.choice("ab"), blocks if k % 40 else []))
    want = []
    for group in {r[1:4] for r in made}:
        kept = []
        size = lambda r: sum(e - s for s, e in r[4])
        for r in sorted((r for r in made if r[1:4] == group), key=lambda r: (size(r), r[4][0][0] if r[4] else 1 << 62, r[0])):
            both = lambda o, r=r: sum(max(0, min(e, f) - max(s, t)) for s, e in r[4] for t, f in o[4])
            if not any(0 < min(size(r), size(o)) and both(o) >= 0.8 * min(size(r), size(o)) and min(size(r), size(o)) >= 0.5 * max(size(r), size(o)) for o in kept):
                kept.append(r)
        want += [r[0] for r in kept]
    f = spark.createDataFrame(made, "id int, chr string, strand string, label string, blocks array<struct<start:int,end:int>>")
    out = L.collapse_same_label(f)
    assert sorted(r.id for r in out.collect()) == sorted(want) and len(want) < 160
    # a group whose features lie apart is no Python group: alone in its island, each stays
    apart = spark.range(3000).select("id", F.lit("c").alias("chr"), F.lit("+").alias("strand"), F.lit("a").alias("label"), F.array(F.struct((F.col("id") * 9).alias("start"), (F.col("id") * 9 + 4).alias("end"))).alias("blocks"))
    assert L.collapse_same_label(apart).count() == 3000



def test_lights_and_models(spark):
    counts = spark.createDataFrame([(c, f, 1.0) for c, f in ((1, "a"), (1, "b"), (2, "a"), (3, "c"), (4, "c"), (4, "b"))], "cell long, feature string, value double")
    cells = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, "y"), (5, "y")], "cell long, grp string")
    fr = L.on_fractions(counts, cells, "grp")
    assert {(r.feature, r.grp): r.fraction for r in fr.collect()}[("c", "y")] == pytest.approx(2 / 3) and fr.count() == 6
    genes = spark.createDataFrame([("a", "1", 5), ("b", "1", 7000), ("c", "1", 90_000)], "id string, chr string, mid long")
    got = {(r.id, r.neighbour): (r.agreement, r.pearson) for r in L.lights(genes, fr, "grp", 1, 0.4).collect()}
    assert got[("a", "b")] == (1.0, pytest.approx(1.0)) and set(got) == {("a", "b"), ("b", "a"), ("c", "b")}
    assert {r.bin for r in L.by_distance(L.lights(genes, fr, "grp", 1, 0.4)).collect()} == {"<10kb", "50-100kb"}
    t = L.holdout_recovery(spark.createDataFrame([(True, True), (True, False), (False, False)], "called boolean, seen boolean")).first()
    assert (t.a, t.b, t.c, t.d) == (1, 1, 0, 1) and t.odds_ratio == pytest.approx(3)
    names = {"WT": True, "ctrl_2": True, "mock-1": True, "control3": True, "wtx": False, "treated": False, "wt3b": True, "Wild-Type": True, "wild_type": False, "dmso": False, "ref": False, " wt": False, "Vehicle_": True, "wt\n": False}
    ctl = spark.createDataFrame([(n,) for n in names], "n string").select(L.is_control(F.col("n")).alias("c")).collect()
    assert [r.c for r in ctl] == list(names.values())
    means = spark.createDataFrame([(g, f"f{k}", float((k % 3 == i) * 2)) for i, g in enumerate("xyz") for k in range(12)], "grp string, feature string, mean double")
    model = L.gene_model(means, "grp")
    values = spark.createDataFrame([(1, f"f{k}", 1.0 + (k % 3 == 1)) for k in range(12)], "cell long, feature string, value double")
    assert [r.grp for r in L.apply_gene_model(model, values, "grp").where("rank = 1").collect()] == ["y"]
    assert L.apply_gene_model(model, values.where("feature in ('f1', 'f2')"), "grp").collect() == []


def test_multiplets():
    means = np.array([[10.0, 0, 0], [0, 10, 0], [0, 0, 10], [5, 5, 0], [9.9, 0, 0.1]])
    found = L.multiplets(means, [500, 500, 500, 8, 8])
    assert [sorted(p for p, _ in f["parts"]) for f in found] == [[], [], [], [0, 1], []]
    w, e = L.simplex_fit(np.array([2.0, 3, 5]), np.eye(3) * 10)
    assert w == pytest.approx([0.2, 0.3, 0.5], abs=1e-6) and e == pytest.approx(0, abs=1e-9)


def test_candidates_and_metrics(spark):
    obs = spark.createDataFrame([("acg u", "s1", "p"), ("ACGT", "s2", "p"), ("GG", "s1", "q"), (" ", "s", "p")], "sequence string, source string, producer string")
    c = L.observe(None, obs)
    assert sorted((r.sequence, r.n, tuple(r.sources)) for r in c.collect()) == [("ACGT", 2, ("s1", "s2")), ("GG", 1, ("s1",))]
    assert L.observe(c, obs.limit(1)).where("sequence = 'ACGT'").first().n == 3
    res = spark.createDataFrame([("GG", "ref1")], "sequence string, reference string")
    assert [r.sequence for r in L.resolve_candidates(c, res, "unresolved").collect()] == ["ACGT"]
    with pytest.raises(ValueError):
        L.resolve_candidates(c, spark.createDataFrame([("TT", "x")], "sequence string, reference string"))
    m = spark.createDataFrame([("reads", None, 2.0), ("len", 3, 1.0)], "name string, bin long, value double")
    assert sorted((r.name, r.value) for r in L.merge_metrics(m, m).collect()) == [("len", 2.0), ("reads", 4.0)]
    ids = L.add_numeric_ids(spark.createDataFrame([("a", 1), ("b", None)], "cell string, n long"), spark.createDataFrame([("a", 5), ("b", 6)], "cell string, id long"), "n")
    assert sorted((r.cell, r.n, r.conflict) for r in ids.collect()) == [("a", 1, True), ("b", 6, False)]
