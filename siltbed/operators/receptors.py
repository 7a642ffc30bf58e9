"""Immune receptors: gene classes, segment overlap, productivity, stable ids, clone families."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltbed.functions.alignment import anchored, global_alignment
from siltbed.functions.sequences import AMINO_ACIDS, CODON_ORDER
from siltbed.operators.grouped import spread

#: Chains, and the names of their constant genes (alone or numbered).
CHAINS = ("IGH", "IGK", "IGL", "TRA", "TRB", "TRG", "TRD")
CONSTANT = ("TRAC", "TRBC", "TRGC", "TRDC", "IGKC", "IGLC", "IGHM", "IGHG", "IGHA", "IGHE")
#: Chains that have a D segment.
WITH_D = ("IGH", "TRB", "TRD")
#: Windows of the conserved V and J anchors, in bases.
V_WINDOW, J_WINDOW = 90, 120


def gene_chain(name: Column) -> Column:
    return F.nullif(F.regexp_extract(F.upper(name), f"^({'|'.join(CHAINS)})", 1), F.lit(""))


def gene_kind(name: Column) -> Column:
    """V, D, J or C; IGHD alone is a constant gene; null for others."""
    u = F.upper(name)
    chains, with_d = "|".join(CHAINS), "|".join(WITH_D)
    return F.when(u == "IGHD", "C").when(u.rlike(f"^({chains})V"), "V").when(u.rlike(f"^({with_d})D"), "D").when(u.rlike(f"^({chains})J"), "J").when(u.rlike(f"^({'|'.join(CONSTANT)})([0-9][A-Z0-9-]*)?$"), "C")


def gene_class(name: Column) -> Column:
    """mito, ribo, vdj (segments, no constant genes) or other."""
    u = F.upper(name)
    vdj = u.rlike(f"^({'|'.join(CHAINS)})[VJ]") | u.rlike(f"^({'|'.join(WITH_D)})D")
    return F.when(u.startswith("MT-"), "mito").when(u.startswith("RPS") | u.startswith("RPL"), "ribo").when(vdj, "vdj").otherwise("other")


def qualifies(n_v: Column, n_j: Column) -> Column:
    """Worth a reconstruction: a V, and a J or a second V."""
    return (n_v > 0) & ((n_j > 0) | (n_v >= 2))


def rich_cells(counts: DataFrame, n: int) -> DataFrame:
    """(cell, receptor, total): the n cells of the most receptor counts; ties by total, then cell."""
    c = counts.groupBy("cell").agg(F.sum(F.when(gene_kind(F.col("feature")).isNotNull(), F.col("value")).otherwise(0)).alias("receptor"), F.sum("value").alias("total"))
    return c.orderBy(F.desc("receptor"), F.desc("total"), "cell").limit(n)


def codon(text: str) -> str:
    at = [CODON_ORDER.find(c) for c in text.upper().replace("U", "T")]
    return "X" if len(at) != 3 or min(at) < 0 else AMINO_ACIDS[at[0] * 16 + at[1] * 4 + at[2]]


def translate(text: str) -> str:
    return "".join(codon(text[i : i + 3]) for i in range(0, len(text) - 2, 3))


def imgt_translate(aligned: str) -> str:
    """Codons of a gapped alignment: whole gaps give -, codons with some gaps X."""
    return "".join("-" if set(c) <= set("-.") else "X" if set(c) & set("-.") else codon(c) for c in (aligned[i : i + 3] for i in range(0, len(aligned) - 2, 3)))


def in_frame(observed: str, frame: int, v: tuple[int, int], j: tuple[int, int]) -> dict[str, object]:
    """Status in one frame: the last cysteine of V's end and the first [FW]-G-x-G of J; v and j are their query ranges."""
    end = min(j[1], len(observed))
    if end < 3:
        return {"status": "too_short"}
    acids = {q: codon(observed[q : q + 3]) for q in range(frame, end - 2, 3)}
    cys = [q for q, a in acids.items() if a == "C" and q >= max(v[0], v[1] - V_WINDOW) and q + 3 <= min(v[1], end)]
    if not cys:
        return {"status": "missing_v_anchor"}
    j_end = min(j[1], j[0] + J_WINDOW, end)
    fgxg = [q for q, a in acids.items() if a in "FW" and q >= min(j[0], end) and q + 12 <= j_end and acids.get(q + 3) == "G" and acids.get(q + 9) == "G"]
    if not fgxg:
        return {"status": "missing_j_anchor"}
    a, b = cys[-1], fgxg[0]
    if a >= b:
        return {"status": "invalid_anchor_order"}
    stop = any(codon(observed[q : q + 3]) == "*" for q in range(a, end - 2, 3))
    junction = observed[a : b + 3]
    return {"status": "stop_codon" if stop else "productive", "junction": junction, "junction_aa": translate(junction), "cdr3": junction[3:-3], "cdr3_aa": translate(junction[3:-3])}


def productivity(observed: str, v: tuple[int, int], j: tuple[int, int], v_reference_start: int = 0, v_coding_start: int | None = None) -> dict[str, object]:
    """By the V coding frame where it is known; else by the one frame that has both anchors, and by none if several have."""
    if v_coding_start is not None:
        return in_frame(observed, (v[0] - (v_reference_start - v_coding_start)) % 3, v, j)
    found = [r for r in (in_frame(observed, f, v, j) for f in range(3)) if r["status"] in ("productive", "stop_codon")]
    return found[0] if len(found) == 1 else {"status": "missing_v_coding_start"}


def recombination_id(chain: str, v: str, d: str | None, j: str, junction: str) -> str:
    """A stable id of what was recombined: version, chain and a digest of the segments and the junction."""
    payload = "\x1f".join((chain, v, d or "", j, junction.upper()))
    return f"r1.{chain.lower()}.{hashlib.sha256(payload.encode()).hexdigest()[:24]}"


def unique_sequences(df: DataFrame, sequence: str, key: str) -> DataFrame:
    """(sequence, n, representative): equal sequences with the smallest key as representative."""
    return df.groupBy(sequence).agg(F.count("*").alias("n"), F.min(key).alias("representative"))


def consensus(df: DataFrame, by: str, aligned: str) -> DataFrame:
    """(by, pos, base, n): the most frequent base of each column, gaps aside; ties: the last letter."""
    long = df.select(by, F.posexplode(F.split(F.upper(aligned), "")).alias("pos", "base")).where("base not in ('', '-', '.')")
    n = long.groupBy(by, "pos", "base").agg(F.count("*").alias("n"))
    return n.groupBy(by, "pos").agg(F.max(F.struct("n", "base")).alias("b")).select(by, "pos", F.col("b.base").alias("base"), F.col("b.n").alias("n"))


def upper_median(x: Sequence[int]) -> int:
    return sorted(x)[len(x) // 2]


def mad_fence(depths: Sequence[int], least_extra: int = 5, multiplier: int = 4) -> int | None:
    """median + max(least_extra, multiplier * MAD) with upper medians; None under four values."""
    if len(depths) < 4:
        return None
    m = upper_median(depths)
    return m + max(least_extra, multiplier * upper_median([abs(d - m) for d in depths]))


def edits(a: str, b: str) -> int:
    """Levenshtein distance without case; rows as running minima."""
    x, y = np.frombuffer(a.lower().encode("utf-32-le"), np.uint32), np.frombuffer(b.lower().encode("utf-32-le"), np.uint32)
    row, j = np.arange(len(y) + 1), np.arange(len(y) + 1)
    for i, c in enumerate(x, 1):
        t = np.concatenate(([i], np.minimum(row[:-1] + (y != c), row[1:] + 1)))
        row = np.minimum.accumulate(t - j) + j
    return int(row[-1])


def families_of(g: pd.DataFrame, max_cdr3: int, min_identity: float, hard_identity: float) -> pd.DataFrame:
    """Families of one (chain, V, J): cells in order of CDR3 and id join the first family of which every cell's CDR3 is at most
    max_cdr3 edits away; then each family is aligned to its naive root, and bad fits and cells over the MAD fence are tried on
    the other families, or stay without one."""
    g = g.sort_values(["cdr3", "cell"], ignore_index=True)
    groups: list[list[int]] = []
    for i, c in enumerate(g["cdr3"]):
        home = next((f for f in groups if all(edits(g["cdr3"][k], c) <= max_cdr3 for k in f)), None)
        if home is None:
            groups.append([i])
        else:
            home.append(i)
    roots = [g["naive"][f[0]] for f in groups]
    # a root's name is its first cell's CDR3, also where that cell leaves it
    names = [g["cdr3"][f[0]] for f in groups]
    cache: dict[tuple[int, int], tuple[int, float]] = {}

    def measure(f: int, i: int) -> tuple[int, float]:
        if (f, i) not in cache:
            naive, seen = roots[f], g["observed"][i]
            if len(naive) == len(seen):
                r = anchored(naive, seen, 0)
                cache[f, i] = len(r["substitutions"]), r["identity"]
            else:
                r = global_alignment(naive, seen)
                cache[f, i] = r["mismatches"] + r["gaps"], 1 - r["distance"]
        return cache[f, i]

    out, rejected, members = {}, [], []
    for f, cells in enumerate(groups):
        fit = [(i, *measure(f, i)) for i in cells]
        fence = mad_fence([m for _, m, s in fit if s >= min_identity])
        kept = [(i, m) for i, m, s in fit if s >= min_identity and (fence is None or m <= fence)]
        members.append([m for _, m in kept])
        out |= {i: (f, m) for i, m in kept}
        rejected += [(f, i) for i in cells if i not in out]
    for f, i in rejected:
        for other in range(len(groups)):
            m, s = measure(other, i)
            fence = mad_fence(members[other])
            if other != f and s >= hard_identity and (fence is None or m <= fence):
                out[i] = (other, m)
                members[other].append(m)
                break
    return pd.DataFrame({"cell": g["cell"], "chain": g["chain"], "v": g["v"], "j": g["j"], "family": [names[out[i][0]] if i in out else None for i in range(len(g))], "mutations": [out[i][1] if i in out else None for i in range(len(g))]}).astype({"mutations": "Int64"})


def clone_families(receptors: DataFrame, max_cdr3: int = 3, min_identity: float = 0.7, hard_identity: float = 0.85) -> DataFrame:
    """(cell, chain, v, j, family, mutations) of receptors (cell, chain, v, j, cdr3, naive, observed); no family is null.

    The rule depends on order, so a (chain, V, J) is one group; rows lacking a part are left out."""
    whole = receptors.dropna(subset=["cell", "chain", "v", "j", "cdr3", "naive", "observed"]).where("v <> '' and j <> '' and cdr3 <> '' and naive <> '' and observed <> ''")
    kind = dict(receptors.dtypes)["cell"]
    return spread(whole, ["chain", "v", "j"]).groupBy("chain", "v", "j").applyInPandas(lambda g: families_of(g, max_cdr3, min_identity, hard_identity), f"cell {kind}, chain string, v string, j string, family string, mutations long")


def reference_outliers(values: DataFrame, value: str) -> DataFrame:
    """values with outlier: over mean + 2 population sds of all rows."""
    s = values.agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    return values.crossJoin(F.broadcast(s)).withColumn("outlier", F.col(value) > F.col("_m") + 2 * F.col("_s")).drop("_m", "_s")


def hypothetical_models(evidence: DataFrame, min_identity: float = 0.75, least_reads: int = 1) -> DataFrame:
    """(chain, v, sequence, model): each sequence joins the first earlier model of its chain and V at min_identity or more, else
    registers one; in order of reads (most first), then sequence. Under least_reads nothing is registered."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["reads", "sequence"], ascending=[False, True], ignore_index=True)
        models: list[str] = []
        out = []
        for s, n in zip(g["sequence"], g["reads"]):
            known = next((k for k, m in enumerate(models) if 1 - global_alignment(m, s)["distance"] >= min_identity), None)
            if known is None and n >= least_reads:
                models.append(s)
                known = len(models) - 1
            out.append(known)
        return pd.DataFrame({"chain": g["chain"], "v": g["v"], "sequence": g["sequence"], "model": pd.array(out, "Int64")})

    return spread(evidence, ["chain", "v"]).groupBy("chain", "v").applyInPandas(run, "chain string, v string, sequence string, model long")
