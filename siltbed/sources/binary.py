"""Binary sources: BAM (blocked gzip) and UCSC 2bit. A file is one task's stream; many files are many tasks.

Rows leave in batches as they are decoded, so memory is bounded by the file's bytes and a batch of rows.
"""

from __future__ import annotations

import gzip
import io
import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the BAM format: letters of four-bit bases and of operations, and sizes of tag values.
_BASES, _OPS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
_TAGS = {"A": "c", "c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}
BATCH = 20_000


def _cstring(data: bytes, at: int) -> tuple[str, int]:
    end = data.index(b"\0", at)
    return data[at:end].decode("latin-1"), end + 1


def _tags(data: bytes, at: int) -> dict[str, str]:
    out = {}
    while at + 3 <= len(data):
        name, kind = data[at : at + 2].decode(), chr(data[at + 2])
        at += 3
        if kind in "ZH":
            out[name], at = _cstring(data, at)
        elif kind == "B":
            item, n = _TAGS[chr(data[at])], struct.unpack_from("<i", data, at + 1)[0]
            values = struct.unpack_from(f"<{n}{item}", data, at + 5)
            out[name], at = ",".join(map(str, values)), at + 5 + n * struct.calcsize(item)
        else:
            (v,) = struct.unpack_from("<" + _TAGS[kind], data, at)
            out[name], at = v.decode() if kind == "A" else str(v), at + struct.calcsize(_TAGS[kind])
    return out


def bam_records(stream: io.BufferedIOBase) -> Iterator[tuple]:
    """(qname, flag, rname, pos, mapq, cigar, seq, qual, tags) of a decompressed BAM stream; pos is 0-based, -1 if unmapped."""
    read = stream.read
    if read(4) != b"BAM\1":
        raise ValueError("not a BAM file")
    read(struct.unpack("<i", read(4))[0])
    names = []
    for _ in range(struct.unpack("<i", read(4))[0]):
        n = struct.unpack("<i", read(4))[0]
        names.append(read(n)[:-1].decode())
        read(4)
    while head := read(4):
        data = read(struct.unpack("<i", head)[0])
        ref, pos, l_name, mapq, _, n_ops, flag, n_seq, _, _, _ = struct.unpack_from("<iiBBHHHiiii", data)
        at = 32
        qname = data[at : at + l_name - 1].decode("latin-1")
        at += l_name
        cigar = "".join(f"{v >> 4}{_OPS[v & 15]}" for v in struct.unpack_from(f"<{n_ops}I", data, at)) or "*"
        at += 4 * n_ops
        packed = data[at : at + (n_seq + 1) // 2]
        seq = "".join(_BASES[b >> 4] + _BASES[b & 15] for b in packed)[:n_seq] or "*"
        at += len(packed)
        qual = data[at : at + n_seq]
        shown = "*" if not qual or qual[0] == 255 else bytes(q + 33 for q in qual).decode("latin-1")
        yield qname, flag, names[ref] if ref >= 0 else "*", pos, mapq, cigar, seq, shown, _tags(data, at + n_seq)


def read_bam(spark: SparkSession, path: str) -> DataFrame:
    """Alignments with the columns of read_sam and ord, the place in the file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["qname", "flag", "rname", "pos", "mapq", "cigar", "seq", "qual", "tags"]
        for b in batches:
            for name, content in zip(b["path"], b["content"]):
                rows, done = [], 0
                for r in bam_records(gzip.GzipFile(fileobj=io.BytesIO(content))):
                    rows.append(r)
                    if len(rows) == BATCH:
                        yield pd.DataFrame(rows, columns=names).assign(file=name, ord=range(done, done + len(rows)))
                        done, rows = done + len(rows), []
                yield pd.DataFrame(rows, columns=names).assign(file=name, ord=range(done, done + len(rows)))

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "qname string, flag int, rname string, pos long, mapq int, cigar string, seq string, qual string, tags map<string,string>, file string, ord long")


def two_bit_index(data: bytes) -> tuple[str, dict[str, int]]:
    """Byte order and the offset of each sequence."""
    order = "<" if struct.unpack_from("<I", data)[0] == 0x1A412743 else ">"
    magic, version, n, _ = struct.unpack_from(order + "4I", data)
    if magic != 0x1A412743 or version != 0:
        raise ValueError("not a 2bit file")
    at, out = 16, {}
    for _ in range(n):
        size = data[at]
        out[data[at + 1 : at + 1 + size].decode()] = struct.unpack_from(order + "I", data, at + 1 + size)[0]
        at += size + 5
    return order, out


def two_bit_sequence(data: bytes, name: str, start: int = 0, end: int | None = None) -> str:
    """Bases [start, end) of a sequence; unknown stretches are N, soft-masked ones in lower case."""
    order, index = two_bit_index(data)
    at = index[name]
    (size,) = struct.unpack_from(order + "I", data, at)
    end = size if end is None else min(end, size)

    def blocks(at: int) -> tuple[list[tuple[int, int]], int]:
        (n,) = struct.unpack_from(order + "I", data, at)
        starts = struct.unpack_from(f"{order}{n}I", data, at + 4)
        sizes = struct.unpack_from(f"{order}{n}I", data, at + 4 + 4 * n)
        return list(zip(starts, sizes)), at + 4 + 8 * n

    unknown, at = blocks(at + 4)
    masked, at = blocks(at)
    at += 4
    out = ["TCAG"[data[at + k // 4] >> (6 - 2 * (k % 4)) & 3] for k in range(start, end)]
    for s, n in unknown:
        for k in range(max(s, start), min(s + n, end)):
            out[k - start] = "N"
    for s, n in masked:
        for k in range(max(s, start), min(s + n, end)):
            out[k - start] = out[k - start].lower()
    return "".join(out)


def read_two_bit(spark: SparkSession, path: str, window: int = 1 << 20) -> DataFrame:
    """(name, start, end, seq): the sequences in windows, so that a chromosome is many rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                order, index = two_bit_index(content)
                for name, at in index.items():
                    (size,) = struct.unpack_from(order + "I", content, at)
                    for s in range(0, size, window):
                        e = min(size, s + window)
                        yield pd.DataFrame({"name": [name], "start": [s], "end": [e], "seq": [two_bit_sequence(content, name, s, e)]})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "name string, start long, end long, seq string")


def grouped_by_neighbours(alignments: DataFrame) -> DataFrame:
    """alignments with grp: rows of one name that follow each other in the file; a name that comes again later is a new group."""
    from pyspark.sql import Window

    w = Window.partitionBy("file").orderBy("ord")
    new = F.when(F.lag("qname").over(w) == F.col("qname"), 0).otherwise(1)
    return alignments.withColumn("_new", new).withColumn("grp", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


# --- bigWig and bigBed ----------------------------------------------------------------------------------------------

#: Fixed values of these formats: magic numbers of the two files and of their trees.
_BIGWIG, _BIGBED, _NAMES, _BLOCKS = 0x888FFC26, 0x8789F2EB, 0x78CA8C91, 0x2468ACE0


def _tree(data: bytes, order: str, at: int, leaf: str, inner: str) -> Iterator[tuple]:
    """Leaf items of a tree of nodes (leaf flag, reserved, count, items); an inner item ends with its child's offset."""
    todo = [at]
    while todo:
        at = todo.pop()
        is_leaf, _, n = struct.unpack_from(order + "BBH", data, at)
        form = order + (leaf if is_leaf else inner)
        size = struct.calcsize(form)
        items = [struct.unpack_from(form, data, at + 4 + k * size) for k in range(n)]
        if is_leaf:
            yield from items
        else:
            todo += [i[-1] for i in reversed(items)]


def big_blocks(data: bytes) -> tuple[bool, str, dict[int, tuple[str, int]], list[bytes]]:
    """Whether a bigWig, the byte order, chromosomes (name, size) by number, and the data blocks, decompressed."""
    order = "<" if struct.unpack_from("<I", data)[0] in (_BIGWIG, _BIGBED) else ">"
    magic, _, _, names, _, index, _, _, _, _, packed, _ = struct.unpack_from(order + "IHHQQQHHQQIQ", data)
    if magic not in (_BIGWIG, _BIGBED):
        raise ValueError("neither bigWig nor bigBed")
    head, _, key, _, _, _ = struct.unpack_from(order + "IIIIQQ", data, names)
    root, *_ = struct.unpack_from(order + "I", data, index)
    if (head, root) != (_NAMES, _BLOCKS):
        raise ValueError("broken index")
    chroms = {i: (k.rstrip(b"\0").decode(), n) for k, i, n in _tree(data, order, names + 32, f"{key}sII", f"{key}sQ")}
    blocks = [data[i[4] : i[4] + i[5]] for i in _tree(data, order, index + 48, "IIIIQQ", "IIIIQ")]
    return magic == _BIGWIG, order, chroms, [zlib.decompress(b) if packed else b for b in blocks]


def big_wig_values(block: bytes, order: str) -> Iterator[tuple[int, int, int, float]]:
    """(chromosome number, start, end, value) of a bigWig block in any of its three forms."""
    chrom, start, _, step, span, kind, _, n = struct.unpack_from(order + "IIIIIBBH", block)
    for k in range(n):
        if kind == 1:
            yield (chrom, *struct.unpack_from(order + "IIf", block, 24 + 12 * k))
        elif kind == 2:
            a, v = struct.unpack_from(order + "If", block, 24 + 8 * k)
            yield chrom, a, a + span, v
        else:
            yield chrom, start + k * step, start + k * step + span, struct.unpack_from(order + "f", block, 24 + 4 * k)[0]


def read_big(spark: SparkSession, path: str) -> DataFrame:
    """(chr, start, end, value, rest): all intervals of bigWig files (value) or bigBed files (rest: the further columns)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                wig, order, chroms, blocks = big_blocks(content)
                for block in blocks:
                    if wig:
                        rows = [(chroms[c][0], s, e, v, None) for c, s, e, v in big_wig_values(block, order)]
                    else:
                        rows, at = [], 0
                        while at + 12 <= len(block):
                            c, s, e = struct.unpack_from(order + "III", block, at)
                            rest, at = _cstring(block, at + 12)
                            rows.append((chroms[c][0], s, e, None, rest))
                    yield pd.DataFrame(rows, columns=["chr", "start", "end", "value", "rest"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "chr string, start long, end long, value double, rest string")


def binned(intervals: DataFrame, width: int) -> DataFrame:
    """(chr, bin, value): each interval's value in every bin that it touches, weighted by the overlap."""
    from siltbed.operators.intervals import bins

    cut = intervals.withColumn("bin", F.explode(bins(F.col("start"), F.col("end"), width)))
    part = F.least(F.col("end"), (F.col("bin") + 1) * width) - F.greatest(F.col("start"), F.col("bin") * width)
    return cut.groupBy("chr", "bin").agg((F.sum(F.col("value") * part) / F.sum(part)).alias("value"))
