from __future__ import annotations

import gzip
import json

import pytest

from siltbed.functions.statistics import fnv1a
from siltbed.sinks import text as K
from siltbed.sources import text as S


def put(folder, name, text):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    if name.endswith(".gz"):
        path.write_bytes(gzip.compress(text.encode()))
    else:
        path.write_text(text)
    return str(path)


def mex(folder, entries="1 1 3\n2 1 1\n1 2 5\n3 2 9\n", header="3 2 4", features=None, barcodes="AAAA-1\nother label\n"):
    put(folder, "matrix.mtx.gz", f"%%MatrixMarket matrix coordinate integer general\n%note\n{header}\n{entries}")
    put(folder, "features.tsv.gz", features or "g1\tGene1\tGene Expression\ng2\tGene1\tGene Expression\nt1\tTag1\tAntibody\n")
    put(folder, "barcodes.tsv.gz", barcodes)
    return str(folder)


def test_mex_in_any_entry_order(spark, tmp_path):
    a = S.read_mex(spark, mex(tmp_path / "a"), "Gene Expression")
    b = S.read_mex(spark, mex(tmp_path / "b", "3 2 9\n1 2 5\n2 1 1\n1 1 3\n"), "Gene Expression")
    h = fnv1a(b"other label")
    h = h - (1 << 64) if h >> 63 else h
    want = [("AAAA-1", "g1", 3.0), ("AAAA-1", "g2", 1.0), ("other label", "g1", 5.0)]
    for df in (a, b):
        assert sorted((r.label, r.feature, r.value) for r in df.collect()) == want
    assert {r.cell for r in a.collect()} == {0, h}


def test_mex_errors(spark, tmp_path):
    with pytest.raises(ValueError, match="header"):
        S.read_mex(spark, mex(tmp_path / "a", header="3 2 5"))
    with pytest.raises(Exception, match="not a count"):
        S.read_mex(spark, mex(tmp_path / "b", "1 1 2.5\n", "3 2 1")).collect()
    with pytest.raises(Exception, match="share a cell id"):
        S.mex_barcodes(spark, mex(tmp_path / "c", barcodes="AAAA-1\nAAAA-2\n")).collect()
    with pytest.raises(FileNotFoundError):
        S.resolve_mex(spark, str(tmp_path / "none"))
    mex(tmp_path / "d" / "outs" / "filtered_feature_bc_matrix")
    assert S.resolve_mex(spark, str(tmp_path / "d")).endswith("outs/filtered_feature_bc_matrix")


def test_feature_names_first_id_wins(spark, tmp_path):
    f = S.mex_features(spark, mex(tmp_path / "a"))
    assert {r.key: r.ord for r in S.feature_names(f).collect()} == {"g1": 0, "g2": 1, "t1": 2, "Gene1": 0, "Tag1": 2}


def test_mex_round_trip_bytes(spark, tmp_path):
    counts = spark.createDataFrame([(1, "g1", 2), (1, "g3", 1), (5, "g1", 7), (5, "g2", 0)], "cell long, feature string, value long")
    features = spark.createDataFrame([("g1", "G1", "Gene Expression", 0), ("g2", "G2", "Gene Expression", 1), ("g3", "G3", "Gene Expression", 2)], "feature string, name string, feature_type string, ord int")
    cells = spark.createDataFrame([(5, "5"), (1, "1"), (-3, "18446744073709551613")], "cell long, label string")
    n = K.write_mex(counts, features, cells, str(tmp_path / "m"))
    assert n == {"features": 2, "cells": 3, "entries": 3}
    read = lambda f: gzip.decompress((tmp_path / "m" / f).read_bytes()).decode()
    assert read("matrix.mtx.gz") == "%%MatrixMarket matrix coordinate integer general\n2 3 3\n1 1 2\n2 1 1\n1 2 7\n"
    assert read("features.tsv.gz") == "g1\tG1\tGene Expression\ng3\tG3\tGene Expression\n"
    assert read("barcodes.tsv.gz") == "1\n5\n18446744073709551613\n"
    again = S.read_mex(spark, str(tmp_path / "m"))
    assert sorted((r.label, r.feature, r.value) for r in again.collect()) == [("1", "g1", 2.0), ("1", "g3", 1.0), ("5", "g1", 7.0)]


def test_raw_and_filtered_and_dense(spark, tmp_path):
    counts = spark.createDataFrame([(1, "a", 2), (2, "b", 1)], "cell long, feature string, value long")
    features = spark.createDataFrame([("a", "A", "x", 0), ("b", "B", "x", 1)], "feature string, name string, feature_type string, ord int")
    cells = spark.createDataFrame([(1, "c1"), (2, "c2")], "cell long, label string")
    K.write_raw_and_filtered(counts, features, cells, spark.createDataFrame([(2,)], "cell long"), str(tmp_path))
    assert S.read_mex(spark, str(tmp_path / "raw")).count() == 2
    assert [r.feature for r in S.read_mex(spark, str(tmp_path / "filtered")).collect()] == ["b"]
    assert sorted(tuple(r) for r in K.dense_table(counts, cells, ["a", "b"]).collect()) == [(1, 2, 0), (2, 0, 1)]


GTF = 'chr1\tx\texon\t101\t150\t.\t+\t.\tgene_id "g1"; transcript_id "t1"; gene_name "A B";\nchr1\tx\texon\t251\t300\t.\t+\t0\tgene_id "g1"; transcript_id "t1";\n#note\nchr2\tx\texon\t1\t9\t5\t-\t.\tgene_id=g2;transcript_id=t2;Note=a b\n'


def test_gtf_and_splice_tables(spark, tmp_path):
    g = S.read_gtf(spark, put(tmp_path, "a.gtf", GTF))
    rows = sorted(g.collect(), key=lambda r: (r.chr, r.start))
    assert [(r.chr, r.start, r.end, r.strand, r.phase) for r in rows] == [("chr1", 100, 150, "+", None), ("chr1", 250, 300, "+", "0"), ("chr2", 0, 9, "-", None)]
    assert rows[0].attrs == {"gene_id": "g1", "transcript_id": "t1", "gene_name": "A B"} and rows[2].attrs["Note"] == "a b"
    tx = {r.tx_id: (r.start, r.end, r.bases, len(r.exons)) for r in S.splice_tables(g)["transcripts"].groupBy("tx_id").agg({"start": "min", "end": "max"}).join(S.splice_tables(g)["transcripts"], "tx_id").collect()}
    assert tx["t2"] == (0, 9, 9, 1)
    with pytest.raises(Exception, match="nine columns"):
        S.read_gtf(spark, put(tmp_path, "b.gtf", "chr1\tx\texon\t1\t2\n")).collect()
    with pytest.raises(Exception, match="unbalanced"):
        S.read_gtf(spark, put(tmp_path, "c.gtf", 'chr1\tx\texon\t1\t2\t.\t+\t.\tgene_id "g1\n')).collect()


def test_vcf(spark, tmp_path):
    text = "##x\n#CHROM\tPOS\n1\t135\ttiny\tA\tC\t.\tPASS\tX=1\n1\t9\t.\tA\tG,T\t.\t.\t.\n1\t10\t.\tA\tG,AT\t.\tPASS\t.\n1\t11\t.\tA\tC\t.\tq10\t.\n"
    got = sorted(tuple(r) for r in S.read_vcf(spark, put(tmp_path, "a.vcf.gz", text)).select("pos0", "alts", "name").collect())
    assert got == [(8, ["G", "T"], "1:9:A>G,T"), (134, ["C"], "tiny")]
    assert S.read_vcf(spark, str(tmp_path / "a.vcf.gz"), pass_only=False, snv=False).count() == 4


def test_records_over_block_borders(spark, tmp_path):
    fq = "".join(f"@r{k}\n{'ACGT' * (k % 5)}A\n+\n{'@' * (4 * (k % 5) + 1)}\n" for k in range(300))
    fa = "".join(f">c{k} text {k}\n" + "".join(f"{'ACGT'[j % 4] * 5}\n" for j in range(k % 7)) + "\n" * (k % 2) for k in range(300))
    (tmp_path / "a.fastq").write_text(fq)
    (tmp_path / "a.fa").write_text(fa)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "301")
    try:
        assert S.lines(spark, str(tmp_path / "a.fa")).select("block").distinct().count() > 5
        reads = S.read_fastq(spark, str(tmp_path / "a.fastq"))
        got = sorted((r.ordinal, r.id, len(r.seq), r.qual[0]) for r in reads.collect())
        fasta = S.read_fasta(spark, str(tmp_path / "a.fa"))
        found = sorted((r.ord, r.id, r.description, r.seq) for r in fasta.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == [(k, f"r{k}", 4 * (k % 5) + 1, "@") for k in range(300)]
    assert found == [(k, f"c{k}", f"text {k}", "".join("ACGT"[j % 4] * 5 for j in range(k % 7))) for k in range(300)]
    # whole records are not sorted: windows are over blocks, none is over lines
    for df in (reads, fasta):
        windows = [x.split("specifiedwindowframe")[0] for x in df._jdf.queryExecution().optimizedPlan().toString().split("windowspecdefinition(")[1:]]
        assert windows and not any("seq" in x for x in windows)


def test_sam_fastq_fasta(spark, tmp_path):
    sam = "@HD\tVN:1\nq1\t0\tchr1\t101\t60\t15M59N15M\t*\t0\t0\tACGT\tIIII\tCB:Z:AAAC-1\tNH:i:1\n"
    r = S.read_sam(spark, put(tmp_path, "a.sam", sam)).first()
    assert (r.qname, r.pos, r.tags) == ("q1", 100, {"CB": "AAAC-1", "NH": "1"})
    one = "".join(f"@r{k} x\nACG{'ACGT'[k % 4]}\n+\n@III\n" for k in range(50))
    fq = S.read_fastq(spark, put(tmp_path, "a.fastq.gz", one))
    assert [(r.ordinal, r.id, r.seq) for r in fq.orderBy("ordinal").collect()] == [(k, f"r{k} x", f"ACG{'ACGT'[k % 4]}") for k in range(50)]
    pairs = S.read_fastq_pairs(spark, str(tmp_path / "a.fastq.gz"), str(tmp_path / "a.fastq.gz"))
    assert pairs.where("r1_seq = r2_seq").count() == 50
    short = put(tmp_path, "b.fastq.gz", one[: one.index("@r49")])
    with pytest.raises(Exception, match="more reads"):
        S.read_fastq_pairs(spark, str(tmp_path / "a.fastq.gz"), short).collect()
    K.write_fastq(fq, str(tmp_path / "out"))
    assert S.read_fastq(spark, str(tmp_path / "out" / "*.gz")).count() == 50
    fa = S.read_fasta(spark, put(tmp_path, "a.fa", ">c1 first one\nACGT\nACG\n>c2\nTT\n"))
    assert sorted((r.id, r.description, r.seq) for r in fa.collect()) == [("c1", "first one", "ACGTACG"), ("c2", None, "TT")]
    K.write_fasta(fa, str(tmp_path / "fa"), width=3)
    assert sorted(r.seq for r in S.read_fasta(spark, str(tmp_path / "fa" / "part-*")).collect()) == ["ACGTACG", "TT"]


def test_tables_sets_and_tags(spark, tmp_path):
    gmt = S.read_gmt(spark, put(tmp_path, "a.gmt", "TP53_SET\td\tTP53\tCDKN1A\tTP53\nOTHER\td\tMDM2\tTP53\n"))
    assert {r.name: r.genes for r in gmt.collect()} == {"TP53_SET": ["CDKN1A", "TP53"], "OTHER": ["MDM2", "TP53"]}
    for bad, what in (("A\td\n", "three fields"), ("A\td\tx\na\td\ty\n", "repeated set")):
        with pytest.raises(Exception, match=what):
            S.read_gmt(spark, put(tmp_path, "b.gmt", bad)).collect()
    tags = "read_id\traw_cb\traw_umi\nr1\tA\tU1\nr2\t\tU\nr1\tB\tU2\n"
    assert [tuple(r) for r in S.read_tags(spark, put(tmp_path, "t.tsv", tags)).collect()] == [("r1", "B", "U2")]
    assert sorted(r.gene for r in S.read_gene_list(spark, put(tmp_path, "g.txt", "# x\nTP53 # y\n\nMDM2\nTP53\n")).collect()) == ["MDM2", "TP53"]
    links = S.read_links(spark, put(tmp_path, "l.txt", "protein1 protein2 x combined_score\n9606.ENSP1 9606.ENSP2 0 900\n"))
    assert [(r.s, r.score) for r in links.select(S.ensembl_protein(links.a).alias("s"), "score").collect()] == [("ENSP1", 900)]
    defs = put(tmp_path, "f.json", json.dumps([{"column": "c", "levels": ["a", "b"], "numeric": [2.0, 5.0]}, {"column": "d", "levels": ["x"]}]))
    assert sorted(tuple(r) for r in S.read_factor_definitions(spark, defs).collect()) == [("c", "a", 2.0), ("c", "b", 5.0), ("d", "x", 0.0)]


def test_bed_bedpe_rmsk_bedgraph(spark, tmp_path):
    bed = S.read_bed(spark, put(tmp_path, "a.bed", "track x\nchr1\t100\t200\tn\t7\t+\t0\t0\t0\t2\t10,20,\t0,80,\nchr2\t1\t5\n"))
    got = {r.chr: [(b.start, b.end) for b in r.blocks] for r in bed.collect()}
    assert got == {"chr1": [(100, 110), (180, 200)], "chr2": [(1, 5)]}
    assert S.read_bedpe(spark, put(tmp_path, "l.bedpe", "chr1 x1 x2 chr1\nchr1 1 5  chr1\t9 12 z\n"), "e1").count() == 1
    rm = spark.createDataFrame([("chr1", 3000000, 3000123, "-", "L1Md_A", "LINE", "L1")], "genoName string, genoStart long, genoEnd long, strand string, repName string, repClass string, repFamily string")
    line = S.rmsk_to_gtf(rm).first().value.split("\t")
    assert line[3:7] == ["3000001", "3000123", ".", "-"] and 'gene_id "L1Md_A"' in line[8]
    track = spark.createDataFrame([("c", 0, 1.0), ("c", 1, 2.0)], "chr string, bin long, value double")
    K.write_bedgraph(track, 50, str(tmp_path / "bg"), spark.createDataFrame([("c", 70)], "chr string, length long"))
    assert [r.value for r in spark.read.text(str(tmp_path / "bg")).collect()] == ["c\t0\t50\t1.0", "c\t50\t70\t2.0"]


def test_delimited_and_bundle(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan"), None), (2, 0.5, "x")], "k int, v double, s string")
    K.write_delimited(df.coalesce(1), str(tmp_path / "csv"))
    text = next((tmp_path / "csv").glob("part-*")).read_text()
    assert text == "k,v,s\n1,NA,NA\n2,0.5,x\n"
    K.write_bundle({"x": df, "obs": df.select("k"), "var": df.select("s")}, str(tmp_path / "b"))
    assert sorted(S.read_bundle(spark, str(tmp_path / "b"))) == ["obs", "var", "x"]
    K.split_by(df.fillna("none"), "s", str(tmp_path / "split"))
    assert (tmp_path / "split" / "s=x").is_dir()
    t = S.read_table(spark, put(tmp_path, "t.tsv", "a\tb\n1,5\t\n\tx\n"))
    assert [(r.a, r.b) for r in t.orderBy("ordinal").collect()] == [("1,5", None), (None, "x")]


def bam_bytes(records):
    import struct

    body = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 5) + b"chr1\0" + struct.pack("<i", 1000)
    for name, flag, pos, cigar, seq, tags in records:
        ops = b"".join(struct.pack("<I", n << 4 | "MIDNSHP=X".index(o)) for n, o in cigar)
        codes = ["=ACMGRSVTWYHKDBN".index(c) for c in seq] + [0] * (len(seq) % 2)
        packed = bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2]))
        data = struct.pack("<iiBBHHHiiii", 0 if pos >= 0 else -1, pos, len(name) + 1, 60, 0, len(cigar), flag, len(seq), -1, -1, 0)
        data += name.encode() + b"\0" + ops + packed + bytes([40] * len(seq)) + tags
        body += struct.pack("<i", len(data)) + data
    half = len(body) // 2
    return gzip.compress(body[:half]) + gzip.compress(body[half:])


def test_bam_and_2bit(spark, tmp_path):
    import struct

    from siltbed.sources import binary as B

    tags = b"CBZAC-1\0" + b"NHC\x02" + b"ASi" + struct.pack("<i", -5) + b"XBBs" + struct.pack("<i2h", 2, 7, -1)
    (tmp_path / "a.bam").write_bytes(bam_bytes([("r1", 0, 100, [(15, "M"), (59, "N"), (3, "S")], "ACGTN", tags), ("r1", 256, 5, [(5, "M")], "ACGTA", b""), ("r2", 4, -1, [], "", b""), ("r1", 0, 7, [(5, "M")], "ACGTA", b"")]))
    df = B.read_bam(spark, str(tmp_path / "a.bam"))
    rows = df.orderBy("ord").collect()
    assert (rows[0].qname, rows[0].rname, rows[0].pos, rows[0].cigar, rows[0].seq, rows[0].qual) == ("r1", "chr1", 100, "15M59N3S", "ACGTN", "IIIII")
    assert rows[0].tags == {"CB": "AC-1", "NH": "2", "AS": "-5", "XB": "7,-1"} and (rows[2].rname, rows[2].cigar, rows[2].seq) == ("*", "*", "*")
    assert [r.grp for r in B.grouped_by_neighbours(df).orderBy("ord").collect()] == [1, 1, 2, 3]
    seq = "ACGTNNacgtTTG"
    bits = ["TCAG".index(c.upper()) if c != "N" else 0 for c in seq] + [0] * (-len(seq) % 4)
    packed = bytes(a << 6 | b << 4 | c << 2 | d for a, b, c, d in zip(*(bits[k::4] for k in range(4))))
    record = struct.pack("<I", len(seq)) + struct.pack("<3I", 1, 4, 2) + struct.pack("<3I", 1, 6, 4) + struct.pack("<I", 0) + packed
    data = struct.pack("<4I", 0x1A412743, 0, 1, 0) + b"\x04chrX" + struct.pack("<I", 16 + 5 + 4) + record
    (tmp_path / "g.2bit").write_bytes(data)
    got = B.read_two_bit(spark, str(tmp_path / "g.2bit"), window=5).orderBy("start").collect()
    assert "".join(r.seq for r in got) == seq and [r.end for r in got] == [5, 10, 13]


def test_domain_matches_of_wanted_proteins(spark, tmp_path):
    path = put(tmp_path, "d.tsv", "P1\tIPR1\tRing\tPF1\t1\t10\nP2\tIPR1\tRing\tPF1\t5\t9\nP1\tIPR2\tx\tPF2\t7\t6\n")
    got = S.read_domain_matches(spark, path, spark.createDataFrame([("P1",)], "accession string"))
    assert [(r.accession, r.entry, r.aa_start, r.aa_end) for r in got.collect()] == [("P1", "IPR1", 0, 10)]
