"""Sequence expressions. All but the translation of codons stay inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column
from pyspark.sql import functions as F

from seqtables.functions.rows import let

# Residue, codon and class tables.
AMINO_ACIDS = "ARNDCQEGHILKMFPSTWYV"
START_RESIDUE_FREQUENCY = {"M": 0.83, "V": 0.14, "L": 0.02}
START_CODONS = ("ATG", "GTG", "TTG")
STOP_CODONS = ("TAA", "TAG", "TGA")
NUCLEOTIDES = "ACGTUMRWSYKVHDBNacgtumrwsykvhdbn"
COMPLEMENTS = "TGCAAKYWSRMBDHVNtgcaakywsrmbdhvn"
CODON_BASES = "TCAG"
STANDARD_CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
# Codons that a translation table reads differently from the standard code.
CODE_CHANGES = {
    1: {},
    2: {"AGA": "*", "AGG": "*", "ATA": "M", "TGA": "W"},
    3: {"ATA": "M", "CTT": "T", "CTC": "T", "CTA": "T", "CTG": "T", "TGA": "W"},
    4: {"TGA": "W"},
    5: {"AGA": "S", "AGG": "S", "ATA": "M", "TGA": "W"},
    6: {"TAA": "Q", "TAG": "Q"},
    9: {"AAA": "N", "AGA": "S", "AGG": "S", "TGA": "W"},
    10: {"TGA": "C"},
    11: {},
    12: {"CTG": "S"},
    13: {"AGA": "G", "AGG": "G", "ATA": "M", "TGA": "W"},
    14: {"AAA": "N", "AGA": "S", "AGG": "S", "TAA": "Y", "TGA": "W"},
    15: {"TAG": "Q"},
    16: {"TAG": "L"},
    21: {"AAA": "N", "AGA": "S", "AGG": "S", "ATA": "M", "TGA": "W"},
    22: {"TCA": "*", "TAG": "L"},
    23: {"TTA": "*"},
    24: {"AGA": "S", "AGG": "K", "TGA": "W"},
    25: {"TGA": "G"},
    26: {"CTG": "A"},
    27: {"TAA": "Q", "TAG": "Q", "TGA": "W"},
    28: {"TAA": "Q", "TAG": "Q", "TGA": "W"},
    29: {"TAA": "Y", "TAG": "Y"},
    30: {"TAA": "E", "TAG": "E"},
    31: {"TAA": "E", "TAG": "E", "TGA": "W"},
    32: {"TAG": "W"},
    33: {"AGA": "S", "AGG": "K", "TAA": "Y", "TGA": "W"},
}
# Letters for several nucleotides, and for two residues that cannot be told apart.
AMBIGUOUS_BASES = {
    "A": "A", "C": "C", "G": "G", "T": "T", "U": "T", "M": "AC", "R": "AG", "W": "AT", "S": "CG",
    "Y": "CT", "K": "GT", "V": "ACG", "H": "ACT", "D": "AGT", "B": "CGT", "N": "ACGT",
}
AMBIGUOUS_RESIDUES = {"DN": "B", "EQ": "Z", "IL": "J"}
RESIDUE_CLASSES = {
    "codon": {"T": "FY*CW", "C": "LPHQ", "A": "IMTNKSR", "G": "VADEG"},
    "chemistry": {
        "aliphatic": "AGILPV",
        "aromatic": "FWY",
        "sulfur": "CX",
        "hydroxyl": "ST",
        "basic": "RHK",
        "acidic": "DE",
        "amine": "NQ",
    },
    "charge": {"positive": "RHK", "negative": "DE", "uncharged": "ANCQGILMFPSTWYV"},
    "polarity": {"polar": "RNDQEHKSTY", "nonpolar": "ACGILMFPWV"},
}


def _length(col: Column) -> Column:
    return F.length(col).cast("long")


def has_marker(seq: Column, marker: str) -> Column:
    """True where the sequence holds the marker; null sequences give false."""
    return F.coalesce(seq.contains(marker), F.lit(False))


def first_index(seq: Column, marker: str) -> Column:
    """0-based index of the first marker, null when absent."""
    return F.nullif(F.instr(seq, marker), F.lit(0)).cast("long") - 1


def last_index(seq: Column, marker: str) -> Column:
    """0-based index of the last (one-letter) marker, null when absent."""
    return _length(seq) - F.nullif(F.instr(F.reverse(seq), marker), F.lit(0))


def count_of(seq: Column, letter: str) -> Column:
    """How often a letter occurs."""
    return _length(seq) - _length(F.replace(seq, F.lit(letter), F.lit("")))


def truncate_c(seq: Column, marker: str, min_length: int = 10) -> Column:
    """The part before the first marker; null if it is absent or the part is too short."""
    part = F.substring_index(seq, marker, 1)
    return F.when(has_marker(seq, marker) & (F.length(part) >= min_length), part)


def truncate_n(
    seq: Column,
    marker: str,
    min_length: int = 10,
    starts: Sequence[str] = ("M", "V", "L"),
    bias: str = "codon",
) -> Column:
    """The part after the last marker, from a start residue on.

    ``codon`` tries the start residues by descending frequency, each at its first
    place; ``length`` takes the earliest start residue of any kind.
    """
    tail = F.when(has_marker(seq, marker), F.substring_index(seq, marker, -1))
    if bias == "length":
        part = F.regexp_extract(tail, f"(?s)[{''.join(starts)}].*$", 0)
        return F.when((part != "") & (F.length(part) >= min_length), part)
    if bias != "codon":
        raise ValueError(f"bias must be 'codon' or 'length', not {bias!r}")

    def from_residue(residue: str) -> Column:
        place = F.instr(tail, residue)
        part = F.substring(tail, place, F.length(tail))
        return F.when((place > 0) & (F.length(part) >= min_length), part)

    ranked = sorted(starts, key=START_RESIDUE_FREQUENCY.__getitem__, reverse=True)
    return F.coalesce(*[from_residue(residue) for residue in ranked])


def clean_nucleotides(text: Column) -> Column:
    """Upper-case nucleotides without digits and white space."""
    return F.upper(F.regexp_replace(text, "[\\s0-9]", ""))


def reverse_complement(nt: Column) -> Column:
    """Reverse complement over the full nucleotide alphabet."""
    return F.reverse(F.translate(nt, NUCLEOTIDES, COMPLEMENTS))


def nucleotide_slice(nt: Column, start: Column, stop: Column, strand: Column) -> Column:
    """Nucleotides of a 1-based inclusive interval, read on its strand."""
    piece = F.substring(nt, start.cast("int"), (stop - start + 1).cast("int"))
    return F.when(strand < 0, reverse_complement(piece)).otherwise(piece)


def start_codon(nt: Column) -> Column:
    """First three nucleotides, or 'none' if they are no start codon."""
    codon = F.left(nt, F.lit(3))
    return F.when(codon.isin(*START_CODONS), codon).otherwise("none")


def stop_codon(nt: Column) -> Column:
    """Last three nucleotides, or 'none' if they are no stop codon."""
    codon = F.right(nt, F.lit(3))
    return F.when(codon.isin(*STOP_CODONS), codon).otherwise("none")


def coding_length(start: Column, stop: Column, feature: Column | None = None) -> Column:
    """Length in residues of coding or unlabelled features, null for all others."""
    length = F.floor((stop - start) / 3).cast("long")
    if feature is None:
        return length
    return F.when(feature.isNull() | (feature == "CDS"), length)


def genetic_code(table: int) -> str:
    """The 64 residues of a translation table, codons in TCAG order."""
    if table not in CODE_CHANGES:
        raise ValueError(f"unknown translation table {table}")
    code = list(STANDARD_CODE)
    for codon, residue in CODE_CHANGES[table].items():
        first, second, third = (CODON_BASES.index(base) for base in codon)
        code[16 * first + 4 * second + third] = residue
    return "".join(code)


def ambiguous_code(table: int) -> str:
    """Residues of all codons over AMBIGUOUS_BASES, in its order: X unless all readings agree."""
    code, letters = genetic_code(table), list(AMBIGUOUS_BASES)
    at = {base: i for i, base in enumerate(CODON_BASES)}
    out = []
    for first, second, third in product(letters, repeat=3):
        readings = product(*(AMBIGUOUS_BASES[letter] for letter in (first, second, third)))
        found = "".join(sorted({code[16 * at[x] + 4 * at[y] + at[z]] for x, y, z in readings}))
        out.append(found if len(found) == 1 else AMBIGUOUS_RESIDUES.get(found, "X"))
    return "".join(out)


@lru_cache(maxsize=1)
def _code_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the letters by byte (the last for all others), numbers of the tables, residues by table and codon."""
    size = len(AMBIGUOUS_BASES) + 1
    letters = np.full(256, size - 1, np.int16)
    letters[[ord(base) for base in AMBIGUOUS_BASES]] = np.arange(size - 1)
    tables = sorted(CODE_CHANGES)
    residues = np.full((len(tables), size, size, size), ord("X"), np.uint8)
    for row, table in zip(residues, tables):
        row[:-1, :-1, :-1] = np.frombuffer(ambiguous_code(table).encode(), np.uint8).reshape((size - 1,) * 3)
    return letters, np.array(tables), residues.reshape(len(tables), -1)


def translated(nt: pa.Array, table: pa.Array, codons: int = 1 << 20) -> pa.Array:
    """Residues of the codons but the last, about ``codons`` at a time; null where either is null."""
    letters, tables, residues = _code_tables()
    base = round(residues.shape[1] ** (1 / 3))
    text = nt.cast(pa.large_string())
    ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
    if (data[ends[0] : ends[-1]] > 127).any():  # a letter beyond ASCII is one unknown letter
        return translated(pa.array([t if t is None else t.encode("ascii", "replace").decode() for t in text.to_pylist()], pa.large_string()), table, codons)
    sizes = np.maximum(np.diff(ends) // 3 - 1, 0)
    rows = np.searchsorted(tables, table.fill_null(int(tables[0])).to_numpy(zero_copy_only=False))
    part = np.cumsum(sizes) // codons
    made = []
    for a, b in zip(*(lambda cuts: (cuts[:-1], cuts[1:]))([0, *(np.flatnonzero(np.diff(part)) + 1), len(text)])):
        own = sizes[a:b]
        stops = np.concatenate([[0], np.cumsum(own)])
        at = np.repeat(ends[a:b] - 3 * stops[:-1], own) + 3 * np.arange(stops[-1])
        codon = (letters[data[at]] * base + letters[data[at + 1]]) * base + letters[data[at + 2]]
        found = residues[np.repeat(rows[a:b], own), codon]
        made.append(pa.LargeStringArray.from_buffers(int(b - a), pa.py_buffer(stops.astype(np.int64)), pa.py_buffer(found)))
    valid = pa.compute.and_(nt.is_valid(), table.is_valid())
    return pa.compute.if_else(valid, pa.concat_arrays(made), pa.scalar(None, pa.large_string())).cast(pa.string())


def translate_codons(nt: Column, table: Column | int = 11, readthrough: str = "U") -> Column:
    """Residues of an in-frame sequence without the last symbol.

    Stops before the end become ``readthrough``. A codon with ambiguous letters becomes the residue
    that all its readings give (B, Z or J for the pairs these stand for), else X. ``table`` may
    differ per row; a missing one gives null, an unknown number is an error. Batches of sequences are
    looked up at once on Arrow data.
    """
    if isinstance(table, int):
        genetic_code(table)
        number = F.lit(table)
    else:
        given = table.cast("int")
        told = F.raise_error(F.concat(F.lit("unknown translation table "), given.cast("string"))).cast("int")
        number = F.when(given.isNull() | given.isin(*CODE_CHANGES), given).otherwise(told)

    @F.arrow_udf("string")
    def residues(texts: pa.Array, tables: pa.Array) -> pa.Array:
        return translated(texts, tables)

    return F.replace(residues(nt, number), F.lit("*"), F.lit(readthrough))


def normalize_residues(seq: Column, drop: str = "*B", spaced: bool = False) -> Column:
    """Rare residues U, Z and O to X; the letters in ``drop`` removed."""
    clean = F.translate(seq, "UZO" + drop, "XXX")
    return F.array_join(F.split(clean, ""), " ") if spaced else clean


def composition(seq: Column, letters: str = AMINO_ACIDS, suffix: int | None = None) -> Column:
    """Array of the share of each letter, over the last ``suffix`` residues if given."""
    part = seq if suffix is None else F.right(seq, F.lit(suffix))
    return F.array(*[F.try_divide(count_of(part, x).cast("double"), F.length(part)) for x in letters])


def class_composition(seq: Column, scheme: str, suffix: int | None = None) -> Column:
    """Array of the share of each residue class, classes in the order of the scheme.

    All residues are mapped at once, so no class name is ever mapped again.
    """
    classes = RESIDUE_CLASSES[scheme]
    symbols = "0123456789"[: len(classes)]
    residues = "".join(classes.values())
    mapped = "".join(symbol * len(members) for symbol, members in zip(symbols, classes.values()))
    part = seq if suffix is None else F.right(seq, F.lit(suffix))
    # Digits stand for classes, so digits already in the text are dropped from the count first.
    plain = F.translate(part, symbols, "." * len(symbols))
    coded = F.translate(plain, residues, mapped)
    return F.array(*[F.try_divide(count_of(coded, s).cast("double"), F.length(part)) for s in symbols])


def kmers(seq: Column, k: int, stop_early: bool = False) -> Column:
    """All overlapping k-mers in order; ``stop_early`` leaves out the last one.

    One pass of a lookahead pattern; cutting each k-mer by its position would walk the
    sequence anew every time.
    """
    words = F.regexp_extract_all(seq, F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1))
    if not stop_early:
        return words
    return let(words, lambda bound: F.slice(bound, 1, F.greatest(F.size(bound) - 1, F.lit(0))))


def distinct_kmers(seq: Column, k: int) -> Column:
    """The set of k-mers of a sequence."""
    return F.array_distinct(kmers(seq, k))
