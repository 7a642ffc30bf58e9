from __future__ import annotations

import random

from siltbed.operators import reconstruction as R


def parts():
    rng = random.Random(8)
    dna = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    v = "ATG" + "".join(rng.choice(["GCC", "GAA", "CTG", "AAA", "GTC"]) for _ in range(26)) + "GCCTGTGCGAGA"
    j = "TTTGGCCAGGGCACC" + "".join(rng.choice(["CTG", "GTC", "ACC"]) for _ in range(6))
    return v, "GGTATAACTGGAACTAC", j, dna(40), dna(90), dna(33)


V, D, J, C, V2, J2 = parts()
SEGMENTS = [("v1", "V", "IGH", V, 0), ("v2", "V", "IGH", V2, None), ("d1", "D", "IGH", D, None), ("j1", "J", "IGH", J, None), ("j2", "J", "IGH", J2, None), ("c1", "C", "IGH", C, None), ("k", "V", "IGK", V, 0)]
FULL = V + "AC" + D + "CC" + J + C


def segments(spark):
    return spark.createDataFrame(SEGMENTS, "name string, kind string, chain string, seq string, coding_start int")


def test_call_in_both_orientations():
    own = [dict(zip(("name", "kind", "chain", "seq", "coding_start"), s)) for s in SEGMENTS if s[2] == "IGH"]
    one = R.call_receptor(FULL, "IGH", own)
    assert (one["v"], one["d"], one["j"], one["c"], one["rev_comp"]) == ("v1", "d1", "j1", "c1", False)
    assert one["status"] in ("productive", "stop_codon", "missing_j_anchor") and one["id"].startswith("r1.igh.")
    back = R.call_receptor(FULL.translate(str.maketrans("ACGT", "TGCA"))[::-1], "IGH", own)
    assert back["rev_comp"] and back["id"] == one["id"] and back["sequence"] == FULL
    assert R.call_receptor(J + V, "IGH", own) is None and R.call_receptor(V + J, "IGH", own) is None and R.call_receptor(V, "IGH", own) is None


def test_assembly_joins_overlapping_pieces():
    a, b, c = FULL[:90], FULL[60:150], FULL[120:]
    got = R.assemble([(a, "I" * len(a), 9), (b, "I" * len(b), 5), (c, "I" * len(c), 3), ("ACGTTGCATTGACCGATCAAGGCT" * 2, "I" * 48, 1)])
    assert got[0] == (FULL, 17) and len(got) == 2
    wrong = a[:20] + ("A" if a[20] != "A" else "C") + a[21:]
    assert R.assemble([(a, "I" * 90, 1), (wrong, "#" * 90, 1)])[0][0] == a


def test_reconstruction_per_cell(spark):
    rows = []
    for umi in range(3):
        for piece in (FULL[:110], FULL[70:160], FULL[125:]):
            rows.append(("c1", "IGH", f"u{umi}", piece, "I" * len(piece)))
    rows += [("c2", "IGH", "u1", V, "I" * len(V)), ("c1", "IGK", "u9", FULL, "I" * len(FULL))]
    ev = spark.createDataFrame(rows, "cell string, chain string, umi string, seq string, qual string")
    got = R.reconstruct(ev, segments(spark)).collect()
    assert [(r.cell, r.chain, r.v, r.j, r.sequence, r.reads, r.call) for r in got] == [("c1", "IGH", "v1", "j1", FULL, 9, 1)]
    frag = spark.createDataFrame([("c1", "IGH", "j1", "c9")] * 2 + [("c1", "IGH", "j1", "c8")], "cell string, chain string, j string, c string")
    calls = R.reconstruct(ev, segments(spark).where("kind <> 'C'"))
    assert [r.c for r in R.constant_links(calls, frag).collect()] == ["c9"]
