"""Column functions on sequences: cleaning, k-mers, one-hot codes, base counts, runs, complements.

All are built-in expressions: they stay in generated code and are pushed below Python and shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "ATCG"  # the order in which ties between bases are decided
PAD = "Z"


def letters(sequence: Column) -> Column:
    """Upper case, U as T, everything but A, C, G, T, N dropped; null stays null."""
    return F.regexp_replace(F.translate(F.upper(sequence), "U", "T"), "[^ACGTN]", "")


def _left(k: int) -> int:
    return (k + 1) // 2 - 1


def _right(k: int) -> int:
    return (k + 2) // 2 - 1


def padded(seq: Column, k: int, circular: bool = False) -> Column:
    """seq with what centred windows of length k need at both ends: Z, or its own other end (repeated if it is short)."""
    left, right = _left(k), _right(k)
    if not circular:
        return F.concat(F.lit(PAD * left), seq, F.lit(PAD * right))
    n = F.greatest(F.length(seq), F.lit(1))
    turns = F.ceil(F.lit(float(max(left, right, 1))) / n).cast("int")
    around = F.repeat(seq, turns)
    return F.concat(F.right(around, F.lit(left)) if left else F.lit(""), seq, F.left(around, F.lit(right)) if right else F.lit(""))


def kmer_at(seq: Column, pos: Column, k: int, circular: bool = False) -> Column:
    """The k-mer centred at pos (from 0)."""
    return F.substr(padded(seq, k, circular), pos + 1, F.lit(k))


def crosses_edge(seq: Column, pos: Column, k: int) -> Column:
    """Whether the window at pos reaches beyond the sequence (what an unpadded extraction leaves out)."""
    return (pos < _left(k)) | (pos + (k + 2) // 2 > F.length(seq))


def kmers(seq: Column, k: int, circular: bool = False) -> Column:
    """Array of the k-mers at positions 0, 1, ...; empty for an empty sequence, null for null."""
    whole = padded(seq, k, circular)
    n = F.length(seq)
    # The padded sequence is an element of an array of one, so that it is made once and not at every position.
    some = F.transform(F.array(whole), lambda w: F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substr(w, i, F.lit(k))))[0]
    return F.when(n > 0, some).when(n == 0, F.array().cast("array<string>"))


def one_hot(seq: Column, unknown: str = "error") -> Column:
    """Four numbers a letter, A C G T; Z gives zeros. Other letters: an error, or zeros with unknown='zero'."""
    other = F.raise_error(F.concat(F.lit("no one-hot code for a letter of "), seq)).cast("array<int>") if unknown == "error" else F.array(*[F.lit(0)] * 4)

    def code(c: Column) -> Column:
        units = F.when(c == PAD, F.array(*[F.lit(0)] * 4))
        for i, base in enumerate("ACGT"):
            units = units.when(c == base, F.array(*[F.lit(int(i == j)) for j in range(4)]))
        return units.otherwise(other)

    return F.when(F.length(seq) > 0, F.flatten(F.transform(F.split(seq, ""), code))).when(F.length(seq) == 0, F.array().cast("array<int>"))


def base_count(seq: Column, base: str) -> Column:
    return F.length(seq) - F.length(F.translate(seq, base, ""))


def outside_alphabet(seq: Column, alphabet: str = "ACGT") -> Column:
    return seq.rlike(f"[^{alphabet}]")


def longest_run(seq: Column, base: str, compat: bool = False) -> Column:
    """Length of the longest run of a base. compat: a run that ends the sequence isn't counted."""
    if compat:
        seq = F.regexp_replace(seq, r"(.)\1*$", "")
    runs = F.transform(F.regexp_extract_all(seq, F.lit(f"({base}+)"), F.lit(1)), F.length)
    return F.when(seq.isNotNull(), F.coalesce(F.array_max(runs), F.lit(0)))


def longest_base(runs: dict[str, Column]) -> tuple[Column, Column]:
    """(length, base) of the longest of all runs; ties go to the first of A, T, C, G."""
    most = F.greatest(*[runs[b] for b in BASES])
    which = F.when(most.isNull(), F.lit(None).cast("string"))
    for b in BASES:
        which = which.when(runs[b] == most, b)
    return most, which


def complement(seq: Column) -> Column:
    return F.translate(seq, "ATCG", "TAGC")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))
