from __future__ import annotations

import struct
import zlib

from pyspark.sql import functions as F

from siltbed.operators import tags as T
from siltbed.sinks import reports as P
from siltbed.sources import binary as B

A = "ACGTTGCAGGATCCATTGACCTAG"
Z = "TTGACCGATAGGCATCGATTACCA"


def test_tags_by_exact_and_scored_placements(spark):
    rc = lambda s: s.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    bad = A[:20] + "GGGG"
    rows = [("exact", "GG" + A + "TT"), ("reverse", rc("GG" + A)), ("near", "C" + bad), ("none", "A" * 30), ("inside", A[2:20])]
    reads = spark.createDataFrame([(i, s, "I" * len(s)) for i, s in rows], "id string, seq string, qual string")
    features = spark.createDataFrame([("a", A, 0), ("z", Z, 1), ("a2", A, 2)], "feature string, fseq string, ord int")
    got = {r.id: (r.feature, r.status) for r in T.map_tags(reads, features, k=8).collect()}
    assert got == {"exact": ("a", "Mapped"), "reverse": ("a", "Mapped"), "inside": ("a", "Mapped"), "near": (None, "Tie")}
    one = {r.id: r.feature for r in T.map_tags(reads, features.where("ord < 2"), k=8).collect()}
    assert one["near"] == "a"
    s = spark.createDataFrame([("ACGT", "ACGA", "I5I5")], "a string, b string, q string").select(T.weighted_score(F.col("a"), F.col("b"), T.qualities(F.col("q"))).alias("s")).first().s
    assert s == (2 + 2) + (2 + 1) + (2 + 2) - (2 + 4)


def test_tags_are_judged_inside_their_locus(spark):
    x = "AACCGGTTAACCGGTT"
    local = spark.createDataFrame([("one", 11, x), ("two", 22, x), ("alias", 44, "ACGTTGCAACGTAGGT"), ("alias", 55, "ACGTTGCAACGTAGGT"), ("t1", 66, "TTTTGGGGCCCCAAA"), ("t2", 66, "TTTTGGGGCCCCTTT")], "feature string, locus int, fseq string")
    seqs = [(1, 11, x), (2, 22, x), (3, 33, x), (4, 44, "GG" + "ACGTTGCAACGTAGGT"), (5, 55, "ACGTTGCAACGTAGG"), (6, 66, "TTTTGGGGCCCCGGG"), (7, 11, "AACC"), (8, 11, None), (9, 11, "N" * 30)]
    reads = spark.createDataFrame(seqs, "id int, locus int, seq string")
    got = {r.id: (r.status, r.features, r.hits) for r in T.map_tags_at_locus(reads, local, min_hits=3).collect()}
    assert got[1] == ("Hit", ["one"], 1) and got[2] == ("Hit", ["two"], 1) and got[3] == ("NoHit", None, None)
    assert got[4] == ("Hit", ["alias"], 1) and got[5] == ("Hit", ["alias"], 8)  # whole; eight words of a cut one
    assert got[6] == ("Tie", ["t1", "t2"], 5)
    assert all(got[k] == ("NoHit", None, None) for k in (7, 8, 9)) and len(got) == 9
    # a better feature of another locus doesn't take a read's own away
    far = spark.createDataFrame([("near", 1, "ACGTTGCATCGTAGGT"), ("exact", 2, "ACGTTGCAACGTAGGT")], "feature string, locus int, fseq string")
    one = T.map_tags_at_locus(spark.createDataFrame([(1, 1, "ACGTTGCAACGTAGGT")], "id int, locus int, seq string"), far, min_hits=1).first()
    assert (one.status, one.features) == ("Hit", ["near"])


def test_words_are_never_broadcast_and_equal_reads_are_judged_once(spark, tmp_path):
    spark.createDataFrame([(k, 1, "ACGTTGCATCGTAGGT" * 4) for k in range(400)], "id int, locus int, seq string").write.parquet(str(tmp_path / "r"))
    reads = spark.read.parquet(str(tmp_path / "r"))
    out = T.map_tags_at_locus(reads, reads.where("id < 3").selectExpr("id as feature", "locus", "substr(seq, 1, 16) as fseq"), min_hits=1)
    plan = out._jdf.queryExecution().sparkPlan().toString()
    words = [x for x in plan.split("\n") if "Join" in x and "word" in x]
    assert words and all("SortMergeJoin" in x for x in words)
    got = out.collect()
    assert {(r.status, tuple(sorted(set(r.features)))) for r in got} == {("Tie", (0, 1, 2))} and len(got) == 400


def test_combinatorial_barcodes(spark):
    w1 = spark.createDataFrame([("AAAA", 0), ("CCCC", 1)], "barcode string, idx int")
    w2 = spark.createDataFrame([("GGTT", 0), ("TTGG", 1), ("ACAC", 2)], "barcode string, idx int")
    reads = spark.createDataFrame([(1, "CCCCxxTTGG"), (2, "CCCAxxACAC"), (3, "GGGGxxTTGG"), (4, "AAAAxxGGTC")], "id long, seq string")
    got = sorted(tuple(r) for r in T.combinatorial_barcodes(reads, [(0, w1), (6, w2)]).collect())
    assert got == [(1, 4, 0), (2, 5, 1), (4, 0, 1)]


def test_subsets_types_and_features(spark):
    al = spark.createDataFrame([("r1", {"CB": "a"}), ("r2", {"CB": "b"}), ("r3", {"CB": "c"})], "qname string, tags map<string,string>")
    lists = spark.createDataFrame([("a", "one", 0), ("a", "two", 1), ("b", "one", 0)], "value string, subset string, ord int")
    assert sorted((r.qname, r.subset) for r in T.subset_by_tags(al, lists, "CB").collect()) == [("r1", "two"), ("r2", "one")]
    kinds = spark.createDataFrame([("GEX",), ("VDJ",), ("OTHER",)], "type string")
    assert T.of_types(kinds, "gv").count() == 2 and T.of_types(kinds, "all").count() == 3
    obs = spark.createDataFrame([("c", "f", 1), ("c", "f", 1), ("c", "f", 2), ("c", "h", 1)], "cell string, feature string, umi long")
    split = T.split_features(obs, spark.createDataFrame([("f", "x"), ("h", "y")], "feature string, feature_type string"))
    assert sorted(tuple(r) for r in split.collect()) == [("x", "c", "f", 2), ("y", "c", "h", 1)]


def test_molecules_are_counted_before_they_get_types(spark):
    obs = spark.createDataFrame([("c", "f", 1), ("c", "f", 1), ("d", "f", 2), ("c", "g", 1)], "cell string, feature string, umi long")
    split = T.split_features(obs, spark.createDataFrame([("f", "x"), ("f", "y")], "feature string, feature_type string"))
    assert sorted(tuple(r) for r in split.collect()) == [("x", "c", "f", 1), ("x", "d", "f", 1), ("y", "c", "f", 1), ("y", "d", "f", 1)]
    counted = [x for x in split._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Aggregate" in x and "umi" in x]
    assert counted and not any("feature_type" in x for x in counted)  # molecules are told apart without the names of types


def big(kind, blocks, packed):
    """A small bigWig or bigBed: header, names, data, index."""
    names = struct.pack("<IIIIQQ", 0x78CA8C91, 1, 4, 8, 1, 0) + struct.pack("<BBH", 1, 0, 1) + b"chr1" + struct.pack("<II", 0, 1000)
    data = [zlib.compress(b) if packed else b for b in blocks]
    at = 64 + len(names)
    offsets = []
    for d in data:
        offsets.append(at)
        at += len(d)
    leaves = [struct.pack("<BBH", 1, 0, 1) + struct.pack("<IIIIQQ", 0, 0, 0, 1000, o, len(d)) for o, d in zip(offsets, data)]
    root_size = 4 + 24 * len(leaves)
    first = at + 48 + root_size
    root = struct.pack("<BBH", 0, 0, len(leaves)) + b"".join(struct.pack("<IIIIQ", 0, 0, 0, 1000, first + k * 36) for k in range(len(leaves)))
    index = struct.pack("<IIQIIIIQII", 0x2468ACE0, 2, len(leaves), 0, 0, 0, 1000, at, 1, 0) + root + b"".join(leaves)
    head = struct.pack("<IHHQQQHHQQIQ", kind, 4, 0, 64, 64 + len(names), at, 0, 0, 0, 0, 32768 if packed else 0, 0)
    return head + names + b"".join(data) + index


def test_big_files(spark, tmp_path):
    wig = [
        struct.pack("<IIIIIBBH", 0, 0, 0, 0, 0, 1, 0, 2) + struct.pack("<IIfIIf", 0, 10, 1.5, 10, 30, 2.0),
        struct.pack("<IIIIIBBH", 0, 0, 0, 0, 5, 2, 0, 1) + struct.pack("<If", 40, 4.0),
        struct.pack("<IIIIIBBH", 0, 100, 0, 20, 10, 3, 0, 2) + struct.pack("<ff", 7.0, 8.0),
    ]
    (tmp_path / "a.bw").write_bytes(big(0x888FFC26, wig, True))
    got = sorted((r.start, r.end, r.value) for r in B.read_big(spark, str(tmp_path / "a.bw")).collect())
    assert got == [(0, 10, 1.5), (10, 30, 2.0), (40, 45, 4.0), (100, 110, 7.0), (120, 130, 8.0)]
    assert {r.bin: r.value for r in B.binned(B.read_big(spark, str(tmp_path / "a.bw")), 20).collect()}[0] == 1.75
    bed = [struct.pack("<III", 0, 5, 9) + b"n\t7\0" + struct.pack("<III", 0, 20, 30) + b"\0"]
    (tmp_path / "a.bb").write_bytes(big(0x8789F2EB, bed, False))
    assert sorted((r.start, r.rest) for r in B.read_big(spark, str(tmp_path / "a.bb")).collect()) == [(5, "n\t7"), (20, "")]


def test_reports(spark, tmp_path):
    r = spark.createDataFrame([("s1", "ACGT", True, "c1"), ("s2", "AC", None, None)], "sequence_id string, sequence string, productive boolean, cell_id string")
    rows = [tuple(x) for x in P.airr(r).select("sequence_id", "productive", "cell_id", "v_call").collect()]
    assert rows == [("s1", "T", "c1", ""), ("s2", "", "", "")]
    P.write_airr(r.coalesce(1), str(tmp_path / "airr"))
    P.write_reports({"pcs": spark.createDataFrame([(1, [0.5, 2.0])], "cell long, pcs array<double>").coalesce(1)}, str(tmp_path))
    assert next((tmp_path / "pcs").glob("part-*")).read_text() == "cell\tpcs\n1\t0.5,2.0\n"
