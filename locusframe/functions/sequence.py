"""Scalar functions over protein and DNA strings, as Columns. Nothing here leaves the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

AMINO = "ACDEFGHIKLMNPQRSTVWY"
# The standard genetic code, codons in the order TTT, TTC, TTA, TTG, TCT, ...
GENETIC_CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODONS = dict(zip((a + b + c for a in "TCAG" for b in "TCAG" for c in "TCAG"), GENETIC_CODE, strict=True))
# Background amino-acid frequencies.
BACKGROUND = {
    "A": 0.0787, "C": 0.0157, "D": 0.0530, "E": 0.0660, "F": 0.0399, "G": 0.0693, "H": 0.0229, "I": 0.0593, "K": 0.0595, "L": 0.0960,
    "M": 0.0239, "N": 0.0414, "P": 0.0472, "Q": 0.0393, "R": 0.0534, "S": 0.0683, "T": 0.0541, "V": 0.0672, "W": 0.0120, "Y": 0.0305,
}
# The IUPAC complement and the reduced ten-letter alphabet.
COMPLEMENT = ("ACGTRYKMSWBDHVNacgtrykmswbdhvn", "TGCAYRMKSWVHDBNtgcayrmkswvhdbn")
REDUCED = ("LVIMCAGSTPFYWEDNQKRH", "LLLLCAGSSPFFFEEEEKKH")
LOW_WINDOW, LOW_ENTROPY = 20, 3.0


def clean_protein(s: Column) -> Column:
    """Upper case without outer white space, all but the twenty residues as X."""
    return F.regexp_replace(F.upper(F.regexp_replace(s, r"^\s+|\s+$", "")), f"[^{AMINO}]", "X")


def text_as_protein(s: Column) -> Column:
    """The letters of a text as residues: letters that are none become X, all else is dropped."""
    return F.regexp_replace(F.upper(F.regexp_replace(s, "[^A-Za-z]+", "")), "[BJOUXZ]", "X")


def text_as_dna(s: Column) -> Column:
    """The letters of a text as bases, a to z in turn A, C, G, T."""
    return F.translate(F.lower(F.regexp_replace(s, "[^A-Za-z]", "")), "abcdefghijklmnopqrstuvwxyz", ("ACGT" * 7)[:26])


def reverse_complement(s: Column) -> Column:
    return F.reverse(F.translate(s, *COMPLEMENT))


def translate(s: Column, to_stop: bool = True) -> Column:
    """Frame 0: unknown codons are X, a partial one is dropped, a stop ends the protein or is ``*``."""
    table = F.create_map(*[F.lit(x) for kv in CODONS.items() for x in kv])
    protein = F.array_join(F.transform(F.regexp_extract_all(F.upper(s), F.lit("([\\s\\S]{3})"), F.lit(1)), lambda c: F.coalesce(table[c], F.lit("X"))), "")
    return F.substring_index(protein, "*", 1) if to_stop else protein


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), the value computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def occurrences(s: Column, letters: str) -> Column:
    """How many characters of s are among letters."""
    return sum((F.length(s) - F.length(F.replace(s, F.lit(a), F.lit(""))) for a in letters), F.lit(0))


def _counts(s: Column) -> Column:
    return F.array(*[F.struct(F.lit(a).alias("residue"), occurrences(s, a).alias("n")) for a in AMINO])


def _total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0), lambda t, x: t + x["n"])


def composition(s: Column) -> Column:
    """An array of (residue, frequency) over the twenty residues."""
    shares = lambda own, total: F.transform(own, lambda x: F.struct(x["residue"].alias("residue"), (x["n"] / F.greatest(total, F.lit(1))).alias("frequency")))
    return let(_counts(s), lambda own: let(_total(own), lambda total: shares(own, total)))


def shannon_entropy(s: Column) -> Column:
    """In bits over the residues that s has; 0 without any."""
    part = lambda x, total: F.when(x["n"] > 0, -(x["n"] / total) * F.log2(x["n"] / total)).otherwise(0.0)
    return let(_counts(s), lambda own: let(_total(own), lambda total: F.aggregate(own, F.lit(0.0), lambda e, x: e + part(x, total))))


def gc_content(s: Column) -> Column:
    up = F.upper(s)
    total = occurrences(up, "ACGT")
    return F.when(total > 0, occurrences(up, "GC") / total).otherwise(0.0)


def _matches(a: Column, b: Column) -> Column:
    n = F.least(F.length(a), F.length(b))
    letters = lambda s: F.slice(F.split(s, ""), F.lit(1), n)
    return F.when(n == 0, 0).otherwise(F.size(F.filter(F.zip_with(letters(a), letters(b), lambda x, y: x == y), lambda same: same)))


def hamming(a: Column, b: Column) -> Column:
    """Mismatches over the common length and the difference of lengths."""
    return F.greatest(F.length(a), F.length(b)) - _matches(a, b)


def identity(a: Column, b: Column) -> Column:
    """Matches by position over the greater length."""
    most = F.greatest(F.length(a), F.length(b))
    return F.when(most > 0, _matches(a, b) / most).otherwise(0.0)


def reduce_alphabet(s: Column) -> Column:
    return F.translate(clean_protein(s), *REDUCED)


def kmers(s: Column, k: int) -> Column:
    """All k-mers in order (none of a shorter string)."""
    return F.regexp_extract_all(s, F.lit(f"(?=(.{{{k}}}))"), F.lit(1))


def kmer_set(s: Column, k: int = 4) -> Column:
    """Distinct k-mers of the reduced alphabet, none with an X."""
    return F.array_distinct(F.filter(kmers(reduce_alphabet(s), k), lambda x: ~F.contains(x, F.lit("X"))))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))
