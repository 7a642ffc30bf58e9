"""Read grammars: primers, barcodes and inserts, found by small programs over a read; molecules that they identify.

A grammar is TOKEN+TOKEN+…: TYPE:name, FIXED:seq[:mm=n], CELL:n, UMI:n, TAG:n, FEATURE:n, SKIP:n, POLYT:min=n,
SEARCH:a..b (the window of offsets for the next fixed sequence only) and INSERT:seq[:mm=n], which ends the match. Steps run
from left to right from a start; one that fails rejects the start.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltbed.functions.sequences import pack_low_first, usable_insert

#: Fixed value: bases of a molecule key, and of each mate without a barcode.
KEY_BASES, MATE_BASES = 32, 16
#: One-letter codes of grammar types in read names.
TYPE_CODES = {"GEX": "G", "VDJ": "V", "OTHER": "O"}
_COMPLEMENT = str.maketrans("ACGTNacgtn", "TGCANtgcan")
_PARTS = ("CELL", "UMI", "TAG", "FEATURE", "SKIP")


@dataclass(frozen=True)
class Step:
    kind: str
    size: int = 0
    seq: str = ""
    mismatches: int = 0
    window: tuple[int, int] = (0, 0)


@dataclass(frozen=True)
class Grammar:
    name: str
    kind: str
    steps: tuple[Step, ...]

    @classmethod
    def parse(cls, name: str, text: str) -> "Grammar":
        kind, steps = "GEX", []
        for token in text.split("+"):
            head, _, rest = token.partition(":")
            if head == "TYPE":
                kind = rest
            elif head in _PARTS and rest.isdecimal():
                steps.append(Step(head, int(rest)))
            elif head in ("FIXED", "INSERT") and (m := re.fullmatch(r"([A-Z]+)(?::mm=?(\d+))?", rest)):
                steps.append(Step(head, len(m[1]), m[1], int(m[2] or 0)))
            elif head == "POLYT" and (m := re.fullmatch(r"min=(\d+)", rest)):
                steps.append(Step(head, int(m[1])))
            elif head == "SEARCH" and (m := re.fullmatch(r"(\d+)\.\.(\d+)", rest)) and int(m[2]) >= int(m[1]):
                steps.append(Step(head, window=(int(m[1]), int(m[2]))))
            else:
                raise ValueError(f"bad token {token!r} in {name}")
        return cls(name, kind, tuple(steps))

    @property
    def barcoded(self) -> bool:
        return any(s.kind in ("CELL", "UMI") for s in self.steps)


@dataclass
class Match:
    grammar: str
    kind: str
    strand: str
    start: int
    insert_start: int
    insert_end: int
    parts: dict[str, str] = field(default_factory=dict)


def mismatches(a: str, b: str, most: int) -> int:
    """Positions that differ, N always; counting stops over most."""
    n = 0
    for x, y in zip(a, b):
        n += x != y or x == "N"
        if n > most:
            break
    return n


def find_fixed(seq: str, at: int, step: Step, window: tuple[int, int]) -> int | None:
    """The first offset in the window at which the sequence fits."""
    for p in range(at + window[0], at + window[1] + 1):
        if p + step.size <= len(seq) and mismatches(seq[p : p + step.size], step.seq, step.mismatches) <= step.mismatches:
            return p
    return None


def match_at(grammar: Grammar, seq: str, start: int, strand: str = "+") -> Match | None:
    at, first, window, parts = start, start, (0, 0), {}
    for s in grammar.steps:
        if s.kind == "SEARCH":
            window = s.window
        elif s.kind in ("FIXED", "INSERT"):
            p = find_fixed(seq, at, s, window)
            if p is None:
                return None
            if s.kind == "INSERT":
                return Match(grammar.name, grammar.kind, strand, first, at, len(seq), parts)
            if at == start and window != (0, 0):
                first = p
            at, window = p + s.size, (0, 0)
        elif s.kind == "POLYT":
            n = len(seq) - at - len(seq[at:].lstrip("T"))
            if n < s.size:
                return None
            at += n
        else:
            if at + s.size > len(seq):
                return None
            if s.kind != "SKIP":
                parts[s.kind] = parts.get(s.kind, "") + seq[at : at + s.size]
            at += s.size
    return Match(grammar.name, grammar.kind, strand, first, at, len(seq), parts)


def detect(grammars: Sequence[Grammar], seq: str, everywhere: bool = False, both_strands: bool = False) -> list[Match]:
    """The matches of the first grammar that has any. Inserts end at the next primer on either strand; a reverse match that
    lies over a forward one is dropped."""
    seq = seq.upper()
    for g in grammars:
        found = _scan(g, seq, "+", everywhere)
        if both_strands:
            n = len(seq)
            for m in _scan(g, seq.translate(_COMPLEMENT)[::-1], "-", everywhere):
                a, b = n - m.insert_start, n - m.start
                if not any(x.strand == "+" and a < x.insert_start and x.start < b for x in found):
                    found.append(m)
            edges = sorted((m.start, m.insert_start) if m.strand == "+" else (n - m.insert_start, n - m.start) for m in found)
            for m in found:
                if m.strand == "+":
                    m.insert_end = min([n, *(a for a, _ in edges if a >= m.insert_start)])
                else:
                    m.insert_end = min([n, *(n - b for _, b in edges if b <= n - m.insert_start)])
        else:
            for m, after in zip(found, found[1:]):
                m.insert_end = max(m.insert_start, after.start)
        if found:
            return found
    return []


def _scan(g: Grammar, seq: str, strand: str, everywhere: bool) -> list[Match]:
    out, at = [], 0
    while at < len(seq):
        m = match_at(g, seq, at, strand)
        if m:
            out.append(m)
        if not everywhere:
            break
        at = max(m.insert_start, at + 1) if m else at + 1
    return out


def detect_reads(reads: DataFrame, grammars: Sequence[Grammar], everywhere: bool = False, both_strands: bool = False) -> DataFrame:
    """A row per match of reads' seq: (id, grammar, type, strand, start, insert_start, insert_end, cell, umi, insert); other
    columns of reads stay out, join them back on id."""
    fixed = list(grammars)
    kind = dict(reads.dtypes)["id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, s in zip(b["id"], b["seq"]):
                for m in detect(fixed, s or "", everywhere, both_strands):
                    text = s.upper() if m.strand == "+" else s.upper().translate(_COMPLEMENT)[::-1]
                    rows.append((i, m.grammar, m.kind, m.strand, m.start, m.insert_start, m.insert_end, m.parts.get("CELL"), m.parts.get("UMI"), text[m.insert_start : m.insert_end]))
            yield pd.DataFrame(rows, columns=["id", "grammar", "type", "strand", "start", "insert_start", "insert_end", "cell", "umi", "insert"])

    return reads.select("id", "seq").mapInPandas(run, f"id {kind}, grammar string, type string, strand string, start long, insert_start long, insert_end long, cell string, umi string, insert string")


def anchor_starts(seq: str, anchor: str, offset: int, most: int = 1) -> list[int]:
    """All starts from which anchor follows after offset bases, with at most most mismatches; the first three bases of an
    anchor of twelve or more aren't asked for; anchors under eight bases are refused."""
    if len(anchor) < 8:
        raise ValueError("an anchor has at least eight bases")
    skip = 3 if len(anchor) >= 12 else 0
    want = anchor[skip:]
    return [p - offset - skip for p in range(offset + skip, len(seq) - len(want) + 1) if mismatches(seq[p : p + len(want)], want, most) <= most]


def molecule_key(cell: Column | None, umi: Column | None, r1: Column, r2: Column) -> tuple[Column, Column]:
    """(cell id, molecule id): the UMI filled up with bases of read 2; without a barcode both mates' first bases and cell 1.
    A key with another letter than ACGT is null: such a read is rejected."""
    clean = lambda s: s.rlike("^[ACGTacgt]*$")
    if cell is None or umi is None:
        key = F.concat(F.substring(r1, 1, MATE_BASES), F.substring(r2, 1, MATE_BASES))
        ok = (F.length(r1) >= MATE_BASES) & (F.length(r2) >= MATE_BASES) & clean(key)
        return F.when(ok, F.lit(1).cast("long")), F.when(ok, pack_low_first(key))
    key = F.concat(umi, F.substring(r2, F.lit(1), F.lit(KEY_BASES) - F.length(umi)))
    ok = clean(cell) & clean(key)
    return F.when(ok, pack_low_first(cell)), F.when(ok, pack_low_first(key))


def read_name(read_id: Column, cell: Column, cell_q: Column, umi: Column, umi_q: Column, kind: Column) -> Column:
    """read|cell|quality|umi|quality|type| with the parts in hex."""
    code = F.create_map(*[F.lit(x) for p in TYPE_CODES.items() for x in p])[kind]
    parts = [F.lower(F.hex(c.cast("binary"))) for c in (cell, cell_q, umi, umi_q)]
    return F.concat(F.concat_ws("|", read_id, *parts, code), F.lit("|"))


def parse_read_name(name: Column) -> Column:
    """A struct (read_id, cell, cell_q, umi, umi_q, type) of a name in the five-field form (type GEX) or with a type; else null."""
    p = F.split(name, r"\|")
    text = lambda k: F.decode(F.unhex(F.get(p, F.lit(k))), "utf-8")
    five = (F.size(p) == 6) & (F.get(p, F.lit(5)) == "")
    six = (F.size(p) == 7) & (F.get(p, F.lit(6)) == "") & F.get(p, F.lit(5)).isin(*TYPE_CODES.values())
    names = F.create_map(*[F.lit(x) for k, c in TYPE_CODES.items() for x in (c, k)])
    kind = F.when(five, "GEX").otherwise(names[F.get(p, F.lit(5))])
    hexed = F.forall(F.slice(p, 2, 4), lambda x: x.rlike("^([0-9A-Fa-f]{2})*$"))
    made = F.struct(F.get(p, F.lit(0)).alias("read_id"), text(1).alias("cell"), text(2).alias("cell_q"), text(3).alias("umi"), text(4).alias("umi_q"), kind.alias("type"))
    return F.when((five | six) & hexed & (F.get(p, F.lit(0)) != ""), made)


def trim_readthrough(insert: str, primer: str) -> str:
    """insert up to where the primer's reverse complement begins; at its end, two bases of it are enough."""
    want = primer.upper().translate(_COMPLEMENT)[::-1]
    if len(want) < 2:
        return insert
    at = insert.find(want)
    if at < 0:
        at = next((len(insert) - n for n in range(min(len(want), len(insert)), 1, -1) if insert.endswith(want[:n])), -1)
    return insert if at < 0 else insert[:at]


def normalise_pairs(pairs: DataFrame, grammars: Sequence[Grammar], min_length: int = 25, max_share: float = 0.8) -> DataFrame:
    """(ordinal, id, cell, umi, type, insert, cell_id, molecule): one read for each molecule, the first by ordinal.

    pairs: ordinal, id, r1_seq, r2_seq. The primer is found on read 1, its readthrough is cut from read 2, unusable inserts
    and unclear keys are dropped, and of the reads with one (cell, molecule) the first stays.
    """
    fixed = list(grammars)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for o, i, a, c in zip(b["ordinal"], b["id"], b["r1_seq"], b["r2_seq"]):
                m = next(iter(detect(fixed, a or "")), None)
                if m:
                    rows.append((o, i, m.parts.get("CELL"), m.parts.get("UMI"), m.kind, a, trim_readthrough(c or "", a[m.start : m.insert_start])))
            yield pd.DataFrame(rows, columns=["ordinal", "id", "cell", "umi", "type", "r1", "insert"])

    found = pairs.select("ordinal", "id", "r1_seq", "r2_seq").mapInPandas(run, "ordinal long, id string, cell string, umi string, type string, r1 string, insert string")
    usable = found.where(usable_insert(F.col("insert"), min_length, min_length, max_share))
    keys = molecule_key(F.col("cell"), F.col("umi"), F.col("r1"), F.col("insert")) if all(g.barcoded for g in fixed) else molecule_key(None, None, F.col("r1"), F.col("insert"))
    keyed = usable.withColumns({"cell_id": keys[0], "molecule": keys[1]}).where("cell_id is not null and molecule is not null")
    w = Window.partitionBy("cell_id", "molecule").orderBy("ordinal")
    return keyed.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "r1")


def restore_primers(reads: DataFrame, tags: DataFrame) -> DataFrame:
    """reads (id, seq, qual) with their tag's cell and UMI in front, at quality 40; reads without a tag are left out, and
    counted by only_in(reads, tags)."""
    primer = F.concat("cell", "umi")
    return reads.join(tags.select(F.col("read_id").alias("id"), "cell", "umi"), "id").select("id", F.concat(primer, "seq").alias("seq"), F.concat(F.repeat(F.lit("I"), F.length(primer)), "qual").alias("qual"))
