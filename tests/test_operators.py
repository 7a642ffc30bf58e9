from __future__ import annotations

import itertools
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from siltbed.functions import sequences as Q
from siltbed.functions import statistics as S
from siltbed.operators import callers as C
from siltbed.operators import embedding as E
from siltbed.operators import fuzzy as Z
from siltbed.operators import grouped as N
from siltbed.operators import hmm as H
from siltbed.operators import intervals as I
from siltbed.operators import matrix as X
from siltbed.operators import molecules as M
from siltbed.operators import ranking as R
from siltbed.operators import reads as A
from siltbed.operators import relations as J
from siltbed.operators import summaries as U
from siltbed.operators import tabular as T


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns or df.columns) for r in df.collect())


def test_molecules_of_the_two_cells(spark):
    mol = [(1, "Gene1", u) for u in range(20)] + [(1, "Gene4", u) for u in range(20, 30)] + [(9, g, u) for g in ("Gene3", "Gene1") for u in range(20)]
    df = spark.createDataFrame(mol + mol[:7], "cell long, feature string, umi long")
    assert rows(M.umi_counts(df)) == [(1, "Gene1", 20), (1, "Gene4", 10), (9, "Gene1", 20), (9, "Gene3", 20)]
    assert rows(M.cells_with_min(M.umi_counts(df), 30)) == [(1,), (9,)] and rows(M.cells_with_min(M.umi_counts(df), 31)) == [(9,)]
    assert rows(M.merge(df, df)) == rows(M.distinct_molecules(df))
    with pytest.raises(Exception, match="no mapping"):
        M.remap_features(df, spark.createDataFrame([("Gene1", "x")], "feature string, new_feature string")).collect()


def spans(n, seed):
    rng = random.Random(seed)
    return [(k, rng.choice("ab"), s, s + rng.randint(1, 60)) for k in range(n) for s in [rng.randint(0, 400)]]


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_overlap_join_equals_brute_force(spark, width):
    a, b = spans(60, 1), spans(60, 2)
    make = lambda x: spark.createDataFrame(x, "id long, chr string, start long, end long")
    got = rows(I.overlap_join(make(a), make(b), width), "id", "id_r")
    assert got == sorted((x[0], y[0]) for x in a for y in b if x[1] == y[1] and x[2] < y[3] and y[2] < x[3])


def test_islands_touch_and_coverage_counts_reads_once(spark):
    df = spark.createDataFrame([("a", 0, 5), ("a", 5, 7), ("a", 8, 9), ("b", 1, 20), ("b", 3, 4)], "chr string, start long, end long")
    assert rows(I.islands(df)) == [("a", 0, 7, 2), ("a", 8, 9, 1), ("b", 1, 20, 2)]
    blocks = spark.createDataFrame([("a", [(0, 5), (8, 12)]), ("a", [(9, 10)]), ("a", [(5, 5)]), ("a", [])], "chr string, blocks array<struct<start:long,end:long>>")
    track = I.block_coverage(blocks, 10)
    assert rows(track) == [("a", 0, 2), ("a", 1, 1)] and rows(I.coverage(df.where("chr = 'a'"), 5)) == [("a", 0, 1), ("a", 1, 2)]
    # four mapped reads, one of them in two bins and two in none
    assert rows(I.normalised(track, "CPM", 10, blocks)) == [("a", 0, 500_000.0), ("a", 1, 250_000.0)]
    assert rows(I.normalised(track, "RPKM", 10, blocks)) == [("a", 0, 5e7), ("a", 1, 2.5e7)]
    assert rows(I.normalised(track, "CPM", 10, blocks.limit(0))) == [("a", 0, 0.0), ("a", 1, 0.0)]


def test_neighbours_with_many_ties(spark):
    rng = random.Random(4)
    genes = [(k, rng.choice("ab"), rng.randint(0, 6)) for k in range(60)]
    got = rows(I.neighbours(spark.createDataFrame(genes, "id long, chr string, mid long"), 4), "id", "rank", "neighbour")
    want = []
    for i, c, m in genes:
        near = sorted((abs(m - n), j) for j, d, n in genes if d == c and j != i)[:4]
        want += [(i, r + 1, j) for r, (_, j) in enumerate(near)]
    assert got == sorted(want)


def test_blocks_and_junctions(spark):
    df = spark.createDataFrame([(100, "15M59N15M"), (0, "5S10M2I5M3D7M"), (7, "4M")], "pos long, cigar string")
    got = [([(b.start, b.end) for b in r.blocks], [(b.start, b.end) for b in r.introns]) for r in A.with_blocks(df, "pos", "cigar").collect()]
    assert got == [([(100, 115), (174, 189)], [(115, 174)]), ([(0, 15), (18, 25)], []), ([(7, 11)], [])]
    j = A.with_blocks(df, "pos", "cigar").select(I.junctions(F.col("blocks")).alias("j"), I.merged_blocks(F.col("blocks")).alias("m")).collect()
    assert [[(x.start, x.end) for x in r.j] for r in j] == [[(115, 174)], [(15, 18)], []]


def test_flags(spark):
    df = spark.createDataFrame([(0, 60), (4, 60), (256, 60), (2048, 60), (64, 9), (64, 10)], "flag int, mapq int")
    assert [r[0] for r in df.select(A.passes(F.col("flag"), F.col("mapq"), 10)).collect()] == [True, False, False, False, False, True]
    assert [r[0] for r in df.select(A.passes(F.col("flag"), F.col("mapq"), 10, True)).collect()][-1]
    assert [r[0] for r in df.select(A.flag_filter(F.col("flag"), 64, 4)).collect()] == [False] * 4 + [True, True]


def test_ranks_and_fdr(spark):
    p = [0.01, 0.02, 0.02, 0.5, 0.04]
    tests = spark.createDataFrame([(k, "g", x) for k, x in enumerate(p)], "k int, g string, p double")
    for found in (R.bh_fdr(tests, "p", ["g"], "k"), R.bh_over_all(tests, "p", "k"), R.bh_over_all(tests, "p", "k", blocks=2)):
        assert [r.q for r in found.orderBy("k").collect()] == pytest.approx([0.1 / 3, 0.1 / 3, 0.1 / 3, 0.5, 0.05])
    df = spark.createDataFrame([(1, v) for v in (3, 1, 3, 2)], "g int, v int")
    assert rows(df.withColumn("r", R.average_rank("v", ["g"])), "v", "r") == [(1, 1.0), (2, 2.0), (3, 3.5), (3, 3.5)]
    assert R.knee(spark.createDataFrame([(1,)] * 5, "total int")).collect() == []


def test_statistics_against_known_values():
    assert S.lgamma(np.array([0.5, 1, 10.3])) == pytest.approx([math.lgamma(x) for x in (0.5, 1, 10.3)], abs=1e-9)
    assert S.t_two_sided(2.0, 10) == pytest.approx(0.07338803, abs=1e-7)
    assert S.fisher_greater(3, 1, 1, 3) == pytest.approx(17 / 70)
    assert S.poisson_upper_tail(5, 2.0) == pytest.approx(0.0526530, abs=1e-6)
    assert S.signal_evidence(np.array([50, 2]), np.array([0.2, 2.0]), 0.05, 40, 10)[0] == pytest.approx([1, 0], abs=1e-2)
    reference = [1, 1, 2, 3, 5, 8, 13, 21, *range(34, 43)]
    assert S.empirical_tail(reference, 42) == 1 / 17 and S.empirical_tail([], 1) == 1 and S.empirical_tail(reference, 44) == 0
    assert S.spearman(np.array([1, 2, 3.0]), np.array([1, 4, 9.0])) == pytest.approx(1) and S.pearson(np.ones(3), np.arange(3.0)) is None
    assert int(S.splitmix64(np.array([0], np.uint64))[0]) == 0xE220A8397B1DCDAF
    assert S.fnv1a(b"a") == 0xAF63DC4C8601EC8C
    t, df, p = S.welch(5.0, 1.0, 10, 4.0, 2.0, 12)
    assert (round(t, 4), round(df, 3)) == (1.5191, 16.748) and 0.1 < p < 0.2


def test_signal_evidence_blocks_agree():
    rng = np.random.default_rng(1)
    x, a = rng.integers(0, 60, 200), rng.random(200) * 5
    one, two = S.signal_evidence(x, a, 0.1, 20, 3.0), S.signal_evidence(x, a, 0.1, 20, 3.0, cells=50)
    for u, v in zip(one, two):
        assert u == pytest.approx(v)


def test_mixtures_find_their_parts(spark):
    rng = np.random.default_rng(2)
    counts = np.concatenate([rng.poisson(1.0, 800), rng.poisson(1.0, 200) + rng.negative_binomial(10, 10 / 50, 200)])
    fit = C.binary_mixture(spark.createDataFrame([(int(c),) for c in counts], "x long"), "x")
    assert fit["mean"] == pytest.approx(40, rel=0.15) and fit["prior"] == pytest.approx(0.2, abs=0.04) and fit["background"] == pytest.approx(1, rel=0.2)
    assert fit["posterior"][0] < 0.01
    obs, truth = [], set()
    for cell in range(60):
        for guide in range(4):
            n = int(rng.poisson(2))
            if cell % 4 == guide:
                n += int(rng.negative_binomial(10, 10 / 50))
                truth.add((cell, guide))
            if n:
                obs.append((cell, guide, n))
    model = C.guide_mixture(spark.createDataFrame(obs, "cell long, guide long, count long"), spark.createDataFrame([(g, 0.25) for g in range(4)], "guide long, p double"), 60, C.MixtureConfig(max_iterations=3))
    called = {(r.cell, r.guide) for r in C.call_guides(model).where("called").collect()}
    assert len(called & truth) >= 0.9 * len(truth) and len(called - truth) <= 3


def test_candidate_em_keeps_the_mass(spark):
    got = C.candidate_em([((1, 2), 10), ((1,), 5), ((2, 3), 4)])
    assert sum(got.values()) == pytest.approx(19) and got[1] > got[2] > got[3]
    pairs = [("g", r, i) for r, c in enumerate([(1, 2)] * 10 + [(1,)] * 5 + [(2, 3)] * 4) for i in c]
    df = C.abundance_by_group(spark.createDataFrame(pairs, "grp string, row long, item long"), "grp", "row", "item", replicates=20)
    assert {r.item: round(r.abundance, 6) for r in df.collect()} == {k: round(v, 6) for k, v in got.items()}
    assert all(r.sd >= 0 for r in df.collect())


def test_hmm_equals_enumeration():
    model = H.Hmm([0.6, 0.4], [[0.7, 0.3], [0.2, 0.8]], H.Categorical([[0.5, 0.4, 0.1], [0.1, 0.3, 0.6]]))
    x = np.array([0, 1, 2, 2, 0])
    joint = {}
    for path in itertools.product((0, 1), repeat=len(x)):
        p = model.initial[path[0]] * model.emission.p[path[0], x[0]]
        for i in range(1, len(x)):
            p *= model.transition[path[i - 1], path[i]] * model.emission.p[path[i], x[i]]
        joint[path] = p
    r = model.infer(x)
    total = sum(joint.values())
    assert r["log_likelihood"] == pytest.approx(math.log(total))
    assert tuple(r["path"]) == max(joint, key=joint.get)
    for i in range(len(x)):
        assert r["posterior"][i, 1] == pytest.approx(sum(p for path, p in joint.items() if path[i] == 1) / total)
    far = model.infer(x, distance=np.full(4, 1e9))
    near = model.infer(x, distance=np.ones(4))
    assert near["log_likelihood"] == pytest.approx(r["log_likelihood"]) and far["log_likelihood"] != pytest.approx(r["log_likelihood"])
    assert model.infer(np.empty(0, int))["log_likelihood"] == 0


def test_baum_welch_raises_the_likelihood():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 1, 80), rng.normal(5, 1, 80), rng.normal(0, 1, 40)])
    start = H.Hmm([0.5, 0.5], [[0.6, 0.4], [0.4, 0.6]], H.Gaussian([1, 3], [2, 2]))
    end = start.train([x])
    assert end.infer(x)["log_likelihood"] > start.infer(x)["log_likelihood"]
    assert sorted(end.emission.mean) == pytest.approx([0, 5], abs=0.4)


def test_knn_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 4, (137, 5)).astype(float)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<double>").repartition(3)
    want = []
    for i in range(137):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        want += [(i, r + 1, int(j)) for r, j in enumerate(sorted((j for j in range(137) if j != i), key=lambda j: (d[j], j))[:6])]
    for block in (20_000, 40):
        assert rows(E.knn(df, df, "id", "v", 6, block), "id", "rank", "neighbour") == sorted(want)


def test_nearest_measures_few_pairs(monkeypatch):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=(900, 6)), np.repeat(rng.normal(size=(1, 6)), 60, axis=0), rng.normal(size=(540, 6)).round(1)])
    ids, measured = np.arange(len(x)), []
    best = E._best
    monkeypatch.setattr(E, "_best", lambda at, *rest: measured.append(len(at)) or best(at, *rest))
    for digits in (None, 2):
        at, near, far = E._nearest(ids, x, 4, digits, ((ids[k::3], x[k::3]) for k in range(3)))
        for i in range(0, len(x), 7):
            d = np.sqrt(((x[i] - x) ** 2).sum(axis=1))
            d = d if digits is None else np.floor(d * 100 + 0.5) / 100
            assert near[at == i].tolist() == sorted((j for j in range(len(x)) if j != i), key=lambda j: (d[j], j))[:4]
    assert sum(measured) < 2 * len(x) ** 2 / 10  # the others are ruled out by the matrix product


def test_knn_rounds_before_it_ranks(spark):
    x = {1: [0.0, 0.0], 5: [0.0, 1.000001], 2: [1.000004, 0.0], 3: [0.0, 1.5], 4: [3.0, 0.0]}
    df = spark.createDataFrame(list(x.items()), "id long, v array<double>")
    exact, near = (rows(E.knn(df, df.where("id = 1"), "id", "v", 1).union(E.knn(df.where("id = 1"), df, "id", "v", 3, digits=d)).where("id = 1"), "rank", "neighbour", "distance") for d in (None, 5))
    assert [r[1] for r in exact] == [5, 2, 3] and near == [(1, 2, 1.0), (2, 5, 1.0), (3, 3, 1.5)]


def test_knn_embed_asks_for_every_vector(spark):
    from siltbed.plans import catalog

    found = catalog.queries()["knn_embed"](spark, "/root/testdata/sf0.001")
    assert found.select("vec_id").distinct().count() == spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").count()


def test_pca_and_tree(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(80, 4)) * [5, 2, 1, 0.1]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<double>")
    scores, var = E.pca(df, "id", "v", 2)
    got = np.array([r.pcs for r in scores.orderBy("id").collect()])
    _, s, vt = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    assert np.abs(got) == pytest.approx(np.abs((x - x.mean(axis=0)) @ vt[:2].T)) and var == pytest.approx(s[:2] ** 2 / 80)
    edges = E.spanning_tree(x[:12])
    total = sum(d for *_, d in edges)
    dist = np.sqrt(((x[:12, None] - x[None, :12]) ** 2).sum(axis=2))
    parent, best = list(range(12)), 0.0

    def root(k):
        return k if parent[k] == k else root(parent[k])

    for d, a, b in sorted((dist[a, b], a, b) for a in range(12) for b in range(a)):
        if root(a) != root(b):
            parent[root(a)] = root(b)
            best += d
    assert total == pytest.approx(best) and len(edges) == 11


def test_newick_round_trip():
    text = E.newick([("r", "a", 1.0), ("r", "b", 2.5), ("b", "c", 0.5), ("b", "d", 4)], "r")
    assert text == "(a:1,(c:0.5,d:4)b:2.5)r;"
    assert {(n, p, d) for n, p, d in E.parse_newick(text)} == {("r", None, 0.0), ("a", "r", 1.0), ("b", "r", 2.5), ("c", "b", 0.5), ("d", "b", 4.0)}


def test_clusters():
    x = np.array([[1, 0], [2, 0.1], [0, 1], [0.1, 3], [0, 0]])
    label = E.spherical_kmeans(x, 2)
    assert label[4] == 0 and label[0] == label[1] != label[2] == label[3]
    merged, history = E.merge_correlated(np.array([[1, 2, 3.0], [2, 4, 6.1], [3, 1, 0.0]]), [1, 1, 1], 0.9)
    assert merged.tolist() == [0, 0, 2] and len(history) == 1
    patches = E.spatial_patches(np.random.default_rng(1).normal(size=(100, 2)), 16)
    assert np.bincount(patches).max() <= 16 and len(set(patches.tolist())) == 8


def test_communities_split_two_cliques(spark):
    edges = [(a, b, 1.0) for g in (range(6), range(10, 16)) for a in g for b in g if a < b] + [(5, 10, 0.1)]
    got = {r.node: r.community for r in E.communities(spark.createDataFrame(edges, "a long, b long, w double")).collect()}
    assert got == {k: 0 for k in range(6)} | {k: 10 for k in range(10, 16)}


def test_sequence_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    lit = F.lit
    assert one(Q.pack_low_first(lit("ACGT"))) == 0b11100100 and one(Q.pack_high_first(lit("ACGT"))) == 0b00011011
    assert one(Q.pack_low_first(lit("T" * 32))) == -1 and one(Q.unpack_low_first(Q.pack_low_first(lit("GATTACA")), lit(7))) == "GATTACA"
    assert one(Q.reverse_complement(lit("AACGTN"))) == "NACGTT"
    assert one(Q.hamming(lit("ACGT"), lit("AGGN"))) == 2 and one(Q.iupac_mismatches(lit("ARN"), lit("GAT"))) == 1
    assert one(Q.translate_dna(lit("ATGGCNTAAC"))) == "MX*" and one(Q.translate_dna(lit("xATG"), 1)) == "M"
    assert one(Q.edit_distance(lit("Kitten"), lit("sitting"))) == 3
    assert one(Q.normalised_barcode(lit("s1_ACGTAC-1"))) == "ACGTAC" and one(Q.normalised_barcode(lit("x" * 20))) == "x" * 16
    assert one(Q.set_distance(lit(6), lit(3))) == pytest.approx(2 / 3) and one(Q.set_distance(lit(0), lit(0))) == 0
    assert [tuple(r) for r in one(Q.kmers(lit("ACGT"), 3))] == [(0, "ACG"), (1, "CGT")] and one(Q.kmers(lit("AC"), 3)) == []
    assert one(Q.snp_name(lit("1"), lit(5), lit("A"), lit("C"), "/")) == "1:5:A/C"


def test_fuzzy_joins(spark):
    reads = spark.createDataFrame([(1, "AAAACCCC"), (2, "AAAACCCT"), (3, "AAATCCCC"), (4, "GGGGGGGG"), (5, "AAAGCCCA")], "id long, seq string")
    white = spark.createDataFrame([("AAAACCCC",), ("AAATCCCT",)], "barcode string")
    assert rows(Z.barcode_join(reads, white, 1, 2), "id", "barcode", "distance") == [(1, "AAAACCCC", 0)]
    assert rows(Z.barcode_join(reads.where("id = 5"), white.limit(1), 2, 4), "id", "distance") == [(5, 2)]
    rng = random.Random(7)
    words = ["".join(rng.choices("abc", k=rng.randint(0, 7))) for _ in range(60)]
    a, b = spark.createDataFrame([(w,) for w in words[:30]], "a string"), spark.createDataFrame([(w,) for w in words[30:]], "b string")

    lev = lambda x, y: duckdb.execute("select levenshtein(?, ?)", [x, y]).fetchone()[0]
    want = sorted({(x, y) for x in words[:30] for y in words[30:] if len(x) > 2 and len(y) > 2 and lev(x, y) <= 2})
    got = [(x, y) for x, y in rows(Z.edit_join(a, b, "a", "b", 2), "a", "b") if len(x) > 2 and len(y) > 2]
    assert got == want


def test_tabular(spark):
    df = spark.createDataFrame([(0, "Red", "1"), (1, "Blue", "2,5"), (2, "NA", "x"), (3, "Red", "")], "ordinal long, Color string, Number string")
    assert T.factor_columns(df.drop("ordinal")) == ["Color", "Number"]
    levels = T.factor_levels(df, "Color", "ordinal")
    assert rows(levels, "level", "numeric") == [("Blue", 1.0), ("Red", 0.0)]
    assert [r.Color for r in T.encode(df, levels, "Color").orderBy("ordinal").collect()] == [0.0, 1.0, None, 0.0]
    assert [r.Color_Red for r in T.one_hot(df, "Color", ["Blue", "Red"]).orderBy("ordinal").collect()] == [1, 0, None, 1]
    assert T.one_hot(df, "Color", ["Red"]).columns == df.columns
    assert rows(T.modify_levels(levels, {"Blue": "Cold", "Red": "Cold"}), "level", "numeric") == [("Cold", 0.0)]
    split = T.train_test_split(spark.range(1001).withColumnRenamed("id", "k"), "k", 0.3, 1)
    assert split.where("train").count() == 300 and rows(split) == rows(T.train_test_split(spark.range(1001).withColumnRenamed("id", "k").repartition(7), "k", 0.3, 1))
    table = spark.createDataFrame([(1, 0.0, 1.0), (2, 0.0, None), (3, 10.0, 7.0)], "k int, a double, b double")
    assert rows(T.impute_knn(table, "k", ["a", "b"], 1, 1))[1] == (2, 0.0, 1.0)
    assert T.drop_sparse_columns(table, ["a", "b"], 0.2).columns == ["k", "a"]


def test_annotation_import_is_strict(spark):
    cells = spark.createDataFrame([(1,), (2,)], "k int")
    good = spark.createDataFrame([(1, "a"), (2, "b")], "k int, t string")
    assert rows(J.import_annotation(cells, good, "k")) == [(1, "a"), (2, "b")]
    for bad, what in (([(1, "a")], "one side"), ([(1, "a"), (2, "b"), (2, "c")], "repeated"), ([(1, "a"), (2, "b"), (3, "c")], "one side")):
        with pytest.raises(Exception, match=what):
            J.import_annotation(cells, spark.createDataFrame(bad, "k int, t string"), "k").collect()
    with pytest.raises(ValueError):
        J.import_annotation(good, good, "k")
    assert [r[0] for r in spark.createDataFrame([("chr1",), ("1",), ("M",), ("chrMT",)], "c string").select(J.chromosome_key(F.col("c"))).collect()] == ["1", "1", "MT", "MT"]


def test_module_controls_and_phase(spark):
    means = spark.createDataFrame([(f"g{k:02d}", float(k)) for k in range(48)], "feature string, mean double")
    module = spark.createDataFrame([("g03",), ("g40",)], "feature string")
    assert rows(X.control_genes(means, module, 24, 100)) == [("g02",), ("g41",)]
    phases = spark.createDataFrame([(-1.0, -2.0), (2.0, 1.0), (0.0, 1.0), (1.0, 1.0), (0.0, 0.0)], "s double, g double").select(X.phase(F.col("s"), F.col("g")).alias("p"))
    assert [r.p for r in phases.collect()] == ["G1", "S", "G2M", "G2M", "G2M"]


def test_positions_with_hot_values(spark):
    rng = random.Random(9)
    rows_in = [(k, rng.choice([0, 0, 0, 0, 5, rng.randint(-3, 9)])) for k in range(700)]
    df = spark.createDataFrame(rows_in, "k long, v long")
    for down in (False, True):
        want = [k for k, v in sorted(rows_in, key=lambda r: (-r[1] if down else r[1], r[0]))]
        got = R.positions(df, "v", "k", down, parts=16).collect()
        assert [r.k for r in sorted(got, key=lambda r: r.position)] == want and sorted(r.position for r in got) == list(range(700))
    assert R.positions(df.limit(0), "v", "k").collect() == []


@pytest.fixture
def small_ranges(monkeypatch):
    """So few rows for a task that groups of a dozen rows have several ranges."""
    monkeypatch.setattr(N, "RANGE_ROWS", 7)


def test_islands_over_ranges(spark, small_ranges):
    rng = random.Random(3)
    spans_in = [(rng.choice(["a", "b", None]), s, s + rng.choice([1, 2, 3, 3, 40])) for s in (rng.randrange(400) for _ in range(150))] + [("c", 0, 500)] + [("c", k * 9, k * 9 + 2) for k in range(40)]
    want = []
    for c in ("a", "b", "c", None):
        at = None
        for s, e in sorted(x[1:] for x in spans_in if x[0] == c):
            if at and s <= at[2]:
                at[2], at[3] = max(at[2], e), at[3] + 1
            else:
                want.append(at := [c, s, e, 1])
    df = spark.createDataFrame(spans_in, "chr string, start long, end long")
    assert sorted(map(repr, map(tuple, I.islands(df).collect()))) == sorted(map(repr, map(tuple, want)))
    ids = I.with_islands(df).groupBy("chr", "island").agg(F.min("start"), F.max("end"), F.count("*")).drop("island").collect()
    assert sorted(map(repr, map(tuple, ids))) == sorted(map(repr, map(tuple, want)))


def test_average_ranks_over_ranges(spark, small_ranges):
    rng = random.Random(4)
    data = [(k, rng.choice(["x", "x", "y", None]), rng.choice([None, float("nan"), *map(float, range(30))])) for k in range(200)]
    df = spark.createDataFrame(data, "k long, g string, v double")
    got, want = R.with_average_rank(df, "v", ["g"], "r"), df.withColumn("r", R.average_rank("v", ["g"]))
    assert rows(got, "k", "r") == rows(want, "k", "r")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "rank(" not in plan.lower()  # no window sorts the rows of a group


def test_fdr_over_ranges(spark, small_ranges):
    rng = random.Random(5)
    data = [(k, rng.choice(["x", "x", "y", None]), rng.choice([None, 0.5, rng.random() ** 2])) for k in range(150)]
    df = spark.createDataFrame(data, "k long, g string, p double")
    want = []
    for g in ("x", "y", None):
        of = sorted((r for r in data if r[1] == g), key=lambda r: (r[2] is not None, r[2] or 0, r[0]))
        least = None
        for n, (k, _, p) in list(enumerate(of, 1))[::-1]:
            raw = None if p is None else p * len(of) / n
            least = raw if least is None else least if raw is None else min(least, raw)
            want.append((k, 1.0 if least is None else min(1.0, least)))
    assert rows(R.bh_fdr(df, "p", ["g"], "k"), "k", "q") == [(k, pytest.approx(q)) for k, q in sorted(want)]
    parts = N.dealt(df, ["g", "p", "k"], "tests").groupBy("_part").count().collect()
    assert len(parts) > 10 and max(r["count"] for r in parts) < 75  # half of the largest group


def test_partner_sets_ids_and_groups(spark):
    links = spark.createDataFrame([("p1", "p2", 900), ("p3", "p1", 800), ("p1", "p4", 100)], "a string, b string, score long")
    near = J.seed_neighbours(links, spark.createDataFrame([("p1",), ("p9",)], "id string"), 700)
    iso = spark.createDataFrame([("t1", "p1"), ("t9", "p9")], "tx_id string, protein string")
    assert {r.tx_id: r.partners for r in J.partner_sets(near, iso).collect()} == {"t1": ["p2", "p3"], "t9": []}
    df = spark.createDataFrame([("a", 1), ("b", 2)], "id string, n int")
    assert rows(J.rewrite_ids(df, "id", spark.createDataFrame([("a", "z")], "old string, new string"))) == [("b", 2), ("z", 1)]
    g = spark.createDataFrame([("x", "m2"), ("x", "m1"), ("", "m3"), (None, "m4")], "clone string, cell string")
    assert [(r.clone, r.members, r.n) for r in J.grouped_members(g, "clone", "cell").collect()] == [("x", ["m1", "m2"], 2)]


def test_marker_scores_by_hand(spark):
    rows_in = [(0.5, 0.25, 3.0, 1.0), (0.0, 0.0, 0.0, 0.0), (0.0, 0.5, 0.0, 1.0), (1.0, 0.0, 1.0, 0.0)]
    df = spark.createDataFrame(rows_in, "d double, b double, x double, y double")
    got = df.select(*[c.alias(n) for n, c in X.marker_scores(*map(F.col, "dbxy")).items()]).collect()
    ln2 = math.log(2)
    assert tuple(got[0]) == pytest.approx((0.25 * (1 + ln2) * 2 * ln2, 2 * ln2 * 0.75 * math.sqrt(0.5) * 0.5 * 0.25, (0.25 + 0.1 * ln2 * 0.5) / 64))
    assert tuple(got[1]) == (0, 0, 0)
    assert tuple(got[2]) == pytest.approx((0, 0, 0.5 / 8)) and tuple(got[3]) == pytest.approx((1 * (1 + ln2) * ln2, 0, 1 / 8))


def test_marker_rankings_of_two_groups(spark):
    cells = spark.createDataFrame([(c, c % 2) for c in range(20)], "cell long, grp long")
    values = spark.createDataFrame([(c, f, float(v)) for c in range(20) for f, v in (("even", 5 * (c % 2 == 0)), ("odd", 5 * (c % 2)), ("all", 2)) if v], "cell long, feature string, value double")
    tests = X.marker_tests(values, cells, "grp", 5)
    one = {r.feature: r for r in tests.where("grp = 0").collect()}
    assert (one["even"].mean, one["even"].other_mean, one["even"].detection, one["even"].other_detection, one["even"].u) == (5, 0, 1, 0, 25)
    assert one["all"].u == 12.5 and one["all"].log2fc == 0 and one["odd"].u == 0 and one["even"].p == pytest.approx(0.0090, abs=2e-4)
    ranked = {(r.ranking, r.grp, r.direction): r.feature for r in X.marker_rankings(tests, "grp").collect()}
    assert ranked[("significance", 0, "up")] == "even" and ranked[("significance", 0, "down")] == "odd" and ranked[("general", 1, "up")] == "odd"
    assert ("sparse", 0, "up") not in ranked and ranked[("low_signal", 0, "down")] == "odd"  # found in every cell: nothing sparse


def test_dense_row_by_hand(spark):
    counts = spark.createDataFrame([(1, "b", 4), (1, "a", 4), (1, "c", 3), (2, "a", 5), (3, "a", 2), (3, "b", 2), (3, "c", 2)], "cell int, feature string, value int")
    assert rows(U.dense_row(counts)) == [(1, 11, "a", pytest.approx(4 / 11), 0.25), (2, 5, "a", 1.0, 1.0), (3, 6, "a", pytest.approx(1 / 3), 0.0)]
