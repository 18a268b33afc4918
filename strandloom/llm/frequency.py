"""How often every n-letter term occurs, and in how many records.

Suffix array with common-prefix intervals. The suffixes of a block of records are put in order, as far as their first
``longest`` letters (the longest term asked for), and next to each lies the length of the prefix that it has in common with
the one before. For every n, the terms are the maximal intervals whose inner common prefixes have at least n letters, and
the length of an interval is the number of occurrences. Its record count is that number minus the suffixes that follow
another one of the same record within the interval. A suffix ends at an N or with its record; the end comes before all
letters, so that suffixes too short for n never lie inside an interval of n. Blocks hold whole records: their counts add up.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm import letters as L

#: Letters, three bits each, that are compared at once.
STEP = 16
#: Terms up to this length are codes of two bits a letter, longer ones are text.
LONGEST_CODE = 31


@dataclass
class Suffixes:
    """In suffix order: place of each suffix in the letters, its letters up to the longest term, those in common with the one
    before (0 for the first), and its record."""

    places: np.ndarray
    usable: np.ndarray
    common: np.ndarray
    rows: np.ndarray


def _numbers(digits: np.ndarray, usable: np.ndarray, width: int) -> np.ndarray:
    """The first width letters of each suffix in order as one number, 0 from its end on."""
    out, done, power, size, rest = np.zeros(len(digits), np.int64), 0, digits.astype(np.int64), 1, width
    while rest:
        if rest & 1:
            out = out << (3 * size)
            out[: len(digits) - done] |= power[done:] if done else power
            done += size
        rest >>= 1
        if rest:
            power = power << (3 * size) | np.append(power[size:], np.zeros(min(size, len(power)), np.int64))
            size *= 2
    return out & ~((np.int64(1) << (3 * (width - np.minimum(usable, width)))) - 1)


def suffix_array(batch: L.Batch, longest: int) -> Suffixes:
    """Suffixes of a batch in the order of their first ``longest`` letters, equal ones in the order of their places."""
    codes = batch.codes
    digits = np.where(codes > 3, 0, codes + 1).astype(np.uint8)
    at = np.arange(len(codes), dtype=np.int64)
    ends = np.minimum.accumulate(np.where(codes > 3, at, len(codes))[::-1])[::-1]
    usable = np.minimum(ends - at, longest)
    width = min(longest, STEP)
    first = _numbers(digits, usable, width)
    real = np.flatnonzero(usable > 0)
    ranks, size = [first], width  # ranks[t]: order of the first width * 2 ** t letters
    while size < longest:
        now = ranks[-1]
        whole = usable >= size
        after = np.where(whole, np.append(now[size:], np.zeros(min(size, len(now)), np.int64)), 0)
        if len(ranks) == 1:
            now, after = (np.unique(x, return_inverse=True)[1].astype(np.int64) for x in (now, after))
        ranks.append(np.unique(now * (int(after.max(initial=0)) + 1) + after, return_inverse=True)[1].astype(np.int64))
        size *= 2
    places = real[L.order_of(ranks[-1][real])]
    offset = np.zeros(max(0, len(places) - 1), np.int64)
    x, y = places[:-1], places[1:]
    for t in reversed(range(1, len(ranks))):  # from the widest comparison to the narrowest, as far as both suffixes reach
        step = width << (t - 1)
        level = ranks[t - 1]
        for _ in range(2 if t == 1 else 1):
            reach = (np.minimum(usable[x], usable[y]) >= offset + step) & (offset + step <= longest)
            same = reach & (level[np.minimum(x + offset, len(level) - 1)] == level[np.minimum(y + offset, len(level) - 1)])
            offset += step * same
    p, q = np.minimum(x + offset, len(codes) - 1), np.minimum(y + offset, len(codes) - 1)
    apart = first[p] ^ first[q]
    agree = width - 1 - (np.frexp(apart.astype(np.float64))[1] - 1) // 3
    common = np.minimum(np.where(apart == 0, longest, offset + agree), np.minimum(usable[x], usable[y]))
    return Suffixes(places, usable[places], np.append(np.zeros(min(1, len(places)), np.int64), common), batch.rows()[places].astype(np.int64))


def intervals(s: Suffixes, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of a first suffix, occurrences, records) of each term of n letters: the maximal intervals with common prefixes of n."""
    fresh = s.common < n
    starts = np.flatnonzero(fresh)
    if not len(starts):
        return starts, starts, starts
    occurrences = np.diff(np.append(starts, len(fresh)))
    number = np.cumsum(fresh) - 1
    order = L.order_of(number * (int(s.rows.max()) + 1) + s.rows)  # within an interval, suffixes of one record together
    same = s.rows[order][1:] == s.rows[order][:-1]
    again = np.append(False, same & (number[order][1:] == number[order][:-1]))
    records = occurrences - np.add.reduceat(again.astype(np.int64), starts)
    fits = s.usable[starts] >= n
    return s.places[starts[fits]], occurrences[fits], records[fits]


def _names(batch: L.Batch, places: np.ndarray, n: int, coded: bool) -> np.ndarray:
    """The terms at some places: codes of two bits a letter, or text."""
    if coded:
        out = np.zeros(len(places), np.int64)
        for j in range(n):
            out = out << 2 | batch.codes[places + j]
        return out
    flat = np.frombuffer(L.ALPHABET.encode(), np.uint8)[batch.codes[places[:, None] + np.arange(n)]]
    return np.ascontiguousarray(flat).view(f"S{n}").reshape(-1)


def term_counts(df: DataFrame, text_col: str, lengths: tuple[int, ...] = (8,)) -> DataFrame:
    """(n, code, occurrences, records) of every term of the given lengths in all records of df.

    code holds the letters, two bits each; if a length is over 31 there is term, the letters as text, in its place. Null,
    empty and short texts have no terms; an empty table gives no rows. Counts of a task are added up before they are
    shuffled, so frequent terms cost no more than rare ones.
    """
    longest = max(lengths)
    if min(lengths) < 1:
        raise ValueError("lengths of terms must be 1 at least")
    coded = longest <= LONGEST_CODE
    name, kind = ("code", "long") if coded else ("term", "string")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {n: [] for n in lengths}

        def added(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            term, occurrences, records = (np.concatenate(x) for x in zip(*held[n]))
            order = np.argsort(term, kind="stable")
            term = term[order]
            starts = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(term) else np.empty(0, np.int64)
            if not len(starts):
                return term, occurrences, records
            return term[starts], np.add.reduceat(occurrences[order], starts), np.add.reduceat(records[order], starts)

        def sent(n: int) -> pa.RecordBatch:
            term, occurrences, records = added(n)
            column = pa.array(term.astype(np.int64)) if coded else pa.array(term.astype(str), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(term), n), pa.int32()), column, pa.array(occurrences, pa.int64()), pa.array(records, pa.int64())], ["n", name, "occurrences", "records"])

        for b in batches:
            batch = L.normalise(b.column(0))
            if not len(batch.codes):
                continue
            s = suffix_array(batch, longest)
            for n in lengths:
                places, occurrences, records = intervals(s, n)
                held[n].append((_names(batch, places, n, coded), occurrences, records))
                if sum(len(x[0]) for x in held[n]) > 4_000_000:
                    held[n] = [added(n)]
                    if len(held[n][0][0]) > 2_000_000:
                        yield sent(n)
                        held[n] = []
        for n in lengths:
            if held[n]:
                yield sent(n)

    parts = df.select(F.col(text_col).cast("string").alias("text")).filter("text is not null").mapInArrow(count, f"n int, {name} {kind}, occurrences long, records long")
    return parts.groupBy("n", name).agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def spelled(code: F.Column, n: int) -> F.Column:
    """The letters of a code, as an expression."""
    return F.concat(*[F.substring(F.lit("ACGT"), (F.shiftright(code, 2 * (n - 1 - j)).bitwiseAND(F.lit(3)) + 1).cast("int"), F.lit(1)) for j in range(n)])


def records_with_terms(df: DataFrame, text_col: str, n: int) -> DataFrame:
    """(base): the number of records with at least one term of n letters."""
    letters = F.regexp_replace(F.translate(F.upper(F.col(text_col).cast("string")), "U", "T"), "[^ACGTN]", "")
    return df.select(letters.alias("text")).filter(F.col("text").rlike(f"[ACGT]{{{n}}}")).agg(F.count(F.lit(1)).alias("base"))


def marked_terms(df: DataFrame, text_col: str, n: int = 8, rare_records: int = 2, rare_share: int = 20_000, common_percent: int = 1) -> DataFrame:
    """(term, occurrences, records, mark): mark is 'rare' for terms in at most rare_records records or in fewer than
    one of rare_share, 'common' for those in more than common_percent of 100, else null."""
    counts = term_counts(df, text_col, (n,))
    named = spelled(F.col("code"), n) if n <= LONGEST_CODE else F.col("term")
    r, base = F.col("records"), F.col("base")
    mark = F.when((r <= rare_records) | (r * rare_share < base), "rare").when(r * 100 > base * common_percent, "common")
    return counts.crossJoin(F.broadcast(records_with_terms(df, text_col, n))).select(named.alias("term"), "occurrences", "records", mark.alias("mark"))
