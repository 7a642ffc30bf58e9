"""Receptor sequences: assembled evidence, segment calls, junctions, linked constant regions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltbed.functions.alignment import local_alignment
from siltbed.operators.grouped import spread
from siltbed.operators.ranking import two_calls_per_locus
from siltbed.operators.receptors import WITH_D, productivity, recombination_id

_COMPLEMENT = str.maketrans("ACGTN", "TGCAN")
#: Most bytes of segments that are broadcast: a reference of this kind has a few thousand segments.
MAX_SEGMENT_BYTES = 32 << 20
#: Fixed value: score of an alignment that counts as a call.
LEAST_SCORE = 20
CALL = "cell string, chain string, reads long, umis long, sequence string, rev_comp boolean, v string, d string, j string, c string, v_score long, j_score long, status string, junction string, junction_aa string, cdr3_aa string, id string"


def assemble(pieces: list[tuple[str, str, int]], least: int = 15) -> list[tuple[str, int]]:
    """Consensus sequences and their support of pieces (sequence, qualities as text, reads), the most read first: a piece joins
    the first contig with which it shares least bases exactly at one offset; bases are voted with read-weighted qualities."""
    contigs: list[tuple[dict[int, np.ndarray], int]] = []

    def text(votes: dict[int, np.ndarray]) -> tuple[int, str]:
        at = sorted(votes)
        return at[0], "".join("ACGT"[int(votes[p].argmax())] for p in at)

    for seq, qual, reads in sorted(pieces, key=lambda p: (-p[2], p[0])):
        home = None
        for k, (votes, _) in enumerate(contigs):
            first, have = text(votes)
            score, qs, qe, rs, re = local_alignment(seq, have)
            if score >= 2 * least and qe - qs == re - rs:
                home = (k, first + rs - qs)
                break
        if home is None:
            contigs.append(({}, 0))
            home = (len(contigs) - 1, 0)
        votes, n = contigs[home[0]]
        for i, (b, q) in enumerate(zip(seq, qual)):
            if b in "ACGT":
                votes.setdefault(home[1] + i, np.zeros(4))["ACGT".index(b)] += (ord(q) - 33) * reads
        # a contig is one stretch: positions between pieces are all covered as they overlap
        contigs[home[0]] = (votes, n + reads)
    return [(text(v)[1], n) for v, n in contigs if v]


def _best(seq: str, segments: list[dict], least: int = LEAST_SCORE) -> tuple[dict, tuple[int, int, int, int, int]] | None:
    """The segment of the highest local score, ties by name."""
    found = [((s, *rest), g) for g in segments for s, *rest in [local_alignment(seq, g["seq"])] if s >= least]
    if not found:
        return None
    (aln), g = min(found, key=lambda f: (-f[0][0], f[1]["name"]))
    return g, aln


def call_receptor(seq: str, chain: str, segments: list[dict]) -> dict | None:
    """V, D, J and C of a consensus in its better orientation (ties: as it is), its junction and productivity.

    None without a V and a J, where V ends after J begins, or where a chain with D has none between them.
    """
    kinds = {k: [g for g in segments if g["kind"] == k] for k in "VDJC"}
    tried = []
    for rev in (False, True):
        s = seq.upper().translate(_COMPLEMENT)[::-1] if rev else seq.upper()
        v, j = _best(s, kinds["V"]), _best(s, kinds["J"])
        if v and j:
            tried.append((-(v[1][0] + j[1][0]), rev, s, v, j))
    if not tried:
        return None
    _, rev, s, (v, va), (j, ja) = min(tried, key=lambda t: t[:2])
    if va[2] > ja[1]:
        return None
    d = None
    if chain in WITH_D:
        found = _best(s[va[2] : ja[1]], kinds["D"], least=10)
        if not found:
            return None
        d = found[0]["name"]
    c = _best(s[ja[2] :], kinds["C"])
    p = productivity(s, (va[1], va[2]), (ja[1], ja[2]), va[3], v.get("coding_start"))
    junction = p.get("junction", s[va[2] : ja[1]])
    return {
        "sequence": s, "rev_comp": rev, "v": v["name"], "d": d, "j": j["name"], "c": c[0]["name"] if c else None, "v_score": va[0], "j_score": ja[0], "status": p["status"],
        "junction": p.get("junction"), "junction_aa": p.get("junction_aa"), "cdr3_aa": p.get("cdr3_aa"), "id": recombination_id(chain, v["name"], d, j["name"], junction),
    }


def reconstruct(evidence: DataFrame, segments: DataFrame) -> DataFrame:
    """Receptors of each cell and chain, at most two, by molecules, then reads, then id.

    evidence: cell, chain, umi, seq, qual; segments: name, kind, chain, seq, coding_start. Equal reads of a molecule are counted
    before they meet; a cell's chain is one group, bounded by its receptor molecules.
    """
    size = segments.agg(F.sum(F.length("seq") + 64)).first()[0] or 0
    if size > MAX_SEGMENT_BYTES:
        raise ValueError("too many segments to hold in every task")
    shared = evidence.sparkSession.sparkContext.broadcast([r.asDict() for r in segments.collect()])
    counted = evidence.groupBy("cell", "chain", "umi", "seq").agg(F.count("*").alias("n"), F.max("qual").alias("qual"))
    pieces = counted.groupBy("cell", "chain", "seq").agg(F.sum("n").alias("reads"), F.count("*").alias("umis"), F.max("qual").alias("qual"))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        cell, chain = g["cell"].iloc[0], g["chain"].iloc[0]
        own = [s for s in shared.value if s["chain"] == chain]
        umis = dict(zip(g["seq"], g["umis"]))
        rows = []
        for seq, reads in assemble(list(zip(g["seq"], g["qual"], g["reads"]))):
            found = call_receptor(seq, chain, own)
            if found:
                n = sum(k for s, k in umis.items() if s in seq)
                rows.append({"cell": cell, "chain": chain, "reads": reads, "umis": n, **found})
        return pd.DataFrame(rows, columns=[c.split()[0] for c in CALL.split(", ")])

    calls = spread(pieces, ["cell", "chain"]).groupBy("cell", "chain").applyInPandas(run, CALL)
    return two_calls_per_locus(calls, ["cell", "chain"], ["v", "d", "j"])


def constant_links(calls: DataFrame, fragments: DataFrame) -> DataFrame:
    """calls with c filled in, where it is missing, by the constant segment that most fragments link to the call's J: fragments
    (cell, chain, j, c) come from read pairs; ties and single fragments don't count."""
    n = fragments.groupBy("cell", "chain", "j", "c").agg(F.count("*").alias("n"))
    top = n.groupBy("cell", "chain", "j").agg(F.max(F.struct("n", "c")).alias("b"), F.max("n").alias("m"), F.collect_list("n").alias("all"))
    sure = top.where((F.col("m") >= 2) & (F.size(F.filter("all", lambda x: x == F.col("m"))) == 1)).select("cell", "chain", "j", F.col("b.c").alias("_c"))
    return calls.join(sure, ["cell", "chain", "j"], "left").withColumn("c", F.coalesce("c", "_c")).drop("_c")

