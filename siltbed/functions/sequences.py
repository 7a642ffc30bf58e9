"""Sequence functions as column expressions: packing, complements, translation, distances."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Two-bit codes of bases; other letters count as A.
BASES = "ACGT"
#: The standard genetic code in the order of T, C, A, G at each position.
CODON_ORDER = "TCAG"
AMINO_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
#: IUPAC letters as sets of bases A 1, C 2, G 4, T 8.
IUPAC = {"A": 1, "C": 2, "G": 4, "T": 8, "U": 8, "R": 5, "Y": 10, "S": 6, "W": 9, "K": 12, "M": 3, "B": 14, "D": 13, "H": 11, "V": 7, "N": 15}


def base_code(base: Column) -> Column:
    """0 to 3; anything else is 0."""
    return F.greatest(F.lit(0), F.instr(F.lit(BASES), F.upper(base)) - 1).cast("long")


def _letters(seq: Column) -> Column:
    return F.filter(F.split(seq, ""), lambda x: x != "")


def _packed(digits: Column, seq: Column) -> Column:
    """The number of a text of base-4 digits. Whole-text functions are compiled; a lambda for each letter is interpreted."""
    return F.when(F.length(seq) > 0, F.conv(digits, 4, -10).cast("long")).when(seq.isNotNull(), F.lit(0).cast("long"))


def _digits(seq: Column) -> Column:
    """The codes of the first 32 bases as base-4 digits, in order; any letter but ACGT is 0."""
    first = F.regexp_replace(F.substring(seq, 1, 32), "[^ACGTacgt]", "A")
    return F.translate(first, "ACGTacgt", "01230123")


def pack_low_first(seq: Column) -> Column:
    """Two bits a base, the first base in the lowest bits; the first 32 bases. All 64 bits may be set."""
    return _packed(F.reverse(_digits(seq)), seq)


def pack_high_first(seq: Column) -> Column:
    """Two bits a base, each further base in lower bits; the first 32 bases."""
    return _packed(_digits(seq), seq)


def sequence_id(seq: Column) -> Column:
    """Two bits a base, each further base in lower bits; the first 32 bases, anything but ACGT (any case) as A. It never fails, so
    it names sequences that pack_high_first's callers would turn away."""
    return pack_high_first(F.coalesce(seq, F.lit("")))


def unpack_low_first(packed: Column, length: Column) -> Column:
    digits = F.reverse(F.lpad(F.conv(packed.cast("string"), 10, 4), 32, "0"))
    text = F.translate(digits, "0123", BASES)
    # past 32 bases the bits come round again
    return F.when(length > 32, F.substring(F.repeat(text, F.ceil(length / 32).cast("int")), F.lit(1), length.cast("int"))).when(length > 0, F.substring(text, F.lit(1), length.cast("int"))).otherwise("")


def reverse_complement(seq: Column) -> Column:
    """With IUPAC letters; case is kept."""
    return F.translate(F.reverse(seq), "ACGTUacgtuRYKMBDHVrykmbdhv", "TGCAAtgcaaYRMKVHDByrmkvhdb")


def hamming(a: Column, b: Column) -> Column:
    """Differing positions of the common length; N differs from everything but is not special otherwise."""
    return F.aggregate(F.zip_with(_letters(a), _letters(b), lambda x, y: F.when(x.isNull() | y.isNull() | (x == y), 0).otherwise(1)), F.lit(0), lambda s, x: s + x)


def iupac_mask(base: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for p in IUPAC.items() for x in p])[F.upper(base)], F.lit(0))


def iupac_mismatches(a: Column, b: Column) -> Column:
    """Positions whose letters share no base."""
    return F.aggregate(F.zip_with(_letters(a), _letters(b), lambda x, y: F.when(iupac_mask(x).bitwiseAND(iupac_mask(y)) == 0, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)


def edit_distance(a: Column, b: Column) -> Column:
    return F.levenshtein(F.lower(a), F.lower(b))


def translate_dna(seq: Column, frame: int = 0) -> Column:
    """Amino acids of whole codons from frame; a codon with another letter than TCAG gives X."""
    text = F.replace(F.upper(F.substring(seq, frame + 1, 1 << 30)), F.lit("U"), F.lit("T"))
    n = F.floor(F.length(text) / 3).cast("int")

    def acid(i: Column) -> Column:
        at = [F.instr(F.lit(CODON_ORDER), F.substring(text, i * 3 + k, F.lit(1))) - 1 for k in (1, 2, 3)]
        known = reduce(lambda x, y: x & y, [a >= 0 for a in at])
        return F.when(known, F.substring(F.lit(AMINO_ACIDS), at[0] * 16 + at[1] * 4 + at[2] + 1, F.lit(1))).otherwise("X")

    return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), acid), "")).otherwise("")


def set_distance(a: Column, b: Column) -> Column:
    """Bit sets: differing bits over all set bits; 0 for two empty sets."""
    return F.coalesce(F.try_divide(F.bit_count(a.bitwiseXOR(b)), F.bit_count(a.bitwiseOR(b))), F.lit(0.0))


def normalised_barcode(label: Column) -> Column:
    """The first run of ACGT before -digit, else the first 16 characters."""
    found = F.regexp_extract(label, "([ACGT]+)-[0-9]", 1)
    return F.when(found != "", found).otherwise(F.substring(label, 1, 16))


def snp_name(chrom: Column, pos: Column, ref: Column, alt: Column, between: str = ">") -> Column:
    """chr:pos:R>A; the index form has / between."""
    return F.concat(chrom, F.lit(":"), pos.cast("string"), F.lit(":"), ref, F.lit(between), alt)


def kmers(seq: Column, k: int, step: int = 1) -> Column:
    """Array of (pos, kmer), from 0."""
    last = F.length(seq) - k
    made = F.transform(F.sequence(F.lit(0), last, F.lit(step)), lambda i: F.struct(i.alias("pos"), F.substring(seq, i + 1, F.lit(k)).alias("kmer")))
    return F.when(last >= 0, made).otherwise(F.array().cast("array<struct<pos:int,kmer:string>>"))


def base_share(seq: Column, base: str) -> Column:
    """How many of the letters are base, without case."""
    return F.length(seq) - F.length(F.replace(F.upper(seq), F.lit(base)))


def usable_insert(seq: Column, min_length: int, min_acgt: int, max_share: float) -> Column:
    """Long enough, with enough ACGT, and no single base over max_share."""
    n = [base_share(seq, b) for b in BASES]
    return (F.length(seq) >= min_length) & (sum(n[1:], n[0]) >= min_acgt) & (F.greatest(*n) <= max_share * F.length(seq))
