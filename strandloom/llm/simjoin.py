"""Links between records whose sets of terms are similar, without comparing all pairs.

Similarity is the Jaccard index of the sets of distinct terms (``term`` consecutive letters without N).
Steps, all distributed:

1. Equal letters form one class; only its least id goes on, so copies never multiply the work.
2. Each class gives seeds, chosen by winnowing, with the letters around them. A stretch of k + w - 1
   letters standing in two records gives both the same seed (letters.sampled). Seeds travel in compressed
   blocks by a bucket of their hash.
3. In a bucket, equal seeds whose surroundings agree for a whole stretch propose a pair.
4. Proposed pairs get the letters of both sides by two joins and are verified exactly.

A pair is proposed for certain if it has a common stretch of ``stretch`` letters. Where every edit breaks at
least ``gap`` neighbouring terms (a substitution breaks 8, an insertion, deletion or cut 7), sure_stretch()
tells how long a stretch all pairs above a threshold must share.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm import blocks as B
from strandloom.llm import letters as L
from strandloom.plans.shared import keep

SKIP = 7
#: Roles of a place in its bucket.
KNOWN, ASKING, BOTH = 0, 1, 2
#: Seeds are sent in blocks of about this many records a task.
BLOCK_ROWS = 60_000


@dataclass(frozen=True)
class Rule:
    """What counts as similar, and how pairs are found.

    threshold, term, min_terms: pairs with at least this Jaccard index of their terms; records with fewer
    than min_terms distinct terms are not compared. stretch: length of the common stretch that proposes a
    pair. gap: terms that a break costs at least, on average (see least_common()).
    hidden: share of the stretches two similar records must have in common that thresholds may hide. seed: length of a seed; None takes 11 or, for larger inputs, more, so that chance matches per
    record stay bounded. It changes the work, never the result.
    """

    threshold: float
    term: int = 8
    min_terms: int = 40
    stretch: int = 16
    seed: int | None = None
    gap: int = 7
    hidden: float = 0.3

    @property
    def distinct(self) -> int:
        """Different terms that a stretch must have to propose pairs: records share many terms, so that repeats
        of a letter or a few letters alone, with a handful of terms, never carry a similarity."""
        return (self.stretch - self.term + 1) * 2 // 3

    def seed_for(self, letters: int) -> int:
        if self.seed:
            return min(self.seed, self.stretch)
        fit = 11
        while fit < min(self.stretch, 24) and 4**fit < letters / 8:
            fit += 1
        return max(min(fit, self.stretch), self.stretch - 7)


def least_common(n: np.ndarray, rule: Rule, width: int) -> np.ndarray:
    """Least number of common windows of width letters, of a record with n distinct terms and any similar one.

    With M common terms in c stretches, M - (width - term) * c windows are common; c - 1 breaks of at least gap
    terms fit into the terms that are not common. Never below 1.
    """
    t, gap, out = rule.threshold, rule.gap, np.empty(len(n), np.int64)
    for i, own in enumerate(n.tolist()):
        other = np.arange(int(np.ceil(t * own)), int(own / t) + 1)
        shared = np.ceil(t / (1 + t) * (own + other) - 1e-9)
        parts = 1 + np.maximum(np.minimum(own, other) - shared, 0) // gap
        out[i] = max(1, (shared - (width - rule.term) * parts).min(initial=1e9))
    return out


def sure_stretch(threshold: float, term: int = 8, min_terms: int = 40, gap: int = 7) -> int:
    """Letters that the longest common stretch of two similar records has at least, in the sense of least_common()."""
    n = np.arange(min_terms, 5000)
    shared = np.ceil(2 * threshold / (1 + threshold) * n - 1e-9)
    parts = 1 + (n - shared) // gap
    return int(np.ceil(shared / parts).min()) + term - 1


def spending(rule: Rule, upto: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """(budget, floor) by number of distinct terms, below ``upto``: of the stretches that two similar records have in
    common at least, the thresholds may hide ``budget``; the pair must then show ``floor`` others."""
    least = np.append(1, least_common(np.arange(1, upto), rule, rule.stretch))
    budget = np.minimum((rule.hidden * least).astype(np.int64), least - 1)
    return budget, least - budget


def rows(df: DataFrame, id_col: str, text_col: str, rule: Rule) -> DataFrame:
    """(id, letters, floor, terms) of the records that are compared: those with an id and at least min_terms distinct terms; written,
    a quarter of the texts' size, as it is read several times.

    floor is the number of common stretches that a pair must show from this record's side (see spending()). It is 1 with an N:
    an N breaks terms of other records that this one doesn't even have, so the bound on breaks doesn't hold. terms is the
    number of its distinct terms.
    """
    term, least, floors = rule.term, rule.min_terms, spending(rule)[1]

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            batch = L.normalise(b.column(1))
            n = np.bincount((L.distinct_terms(batch, term) >> (2 * term)).astype(np.int64), minlength=len(batch))
            fits = pa.array(n >= least)
            floor = np.where(batch.broken(), 1, floors[np.minimum(n, len(floors) - 1)])
            yield pa.RecordBatch.from_arrays([b.column(0).filter(fits), L.pack(batch).filter(fits), pa.array(floor, pa.int32()).filter(fits), pa.array(n, pa.int32()).filter(fits)], ["id", "letters", "floor", "terms"])

    picked = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return keep(picked.filter("id is not null and text is not null").mapInArrow(normal, "id long, letters binary, floor int, terms int"), "rows")


def classes(table: DataFrame) -> DataFrame:
    """(id, letters, copies, floor, terms): one row for all rows of equal letters, with their least id; written, not recomputed."""
    grouped = table.groupBy("letters").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.min("floor").alias("floor"), F.min("terms").alias("terms"))
    return keep(grouped.select("id", "letters", "copies", "floor", "terms"), "classes", free=True)


def size_of(table: DataFrame) -> int:
    """Letters of all classes, about."""
    return 4 * (table.agg(F.sum(F.octet_length("letters") - 1)).first()[0] or 0)


def buckets_for(letters: int, per_bucket: int = 3_000_000) -> int:
    """A power of 2, so that a bucket has the seeds of some 3 million letters."""
    return 1 << max(0, int(np.ceil(np.log2(max(letters, 1) / per_bucket))))


class Seeds:
    """Seeds of one side: place in the hash order, id, surroundings, the stretches that chose it, how many a pair
    must share there, and how many in all; role: BOTH, or, for seeds spread over several buckets, KNOWN or ASKING."""

    FIELDS = ("slot", "id", "left", "right", "chose", "need", "floor", "role")

    def __init__(self, **parts: np.ndarray) -> None:
        self.parts = parts

    def __getattr__(self, name: str) -> np.ndarray:
        return self.parts[name]

    def take(self, which: np.ndarray | slice) -> Seeds:
        return Seeds(**{k: v[which] for k, v in self.parts.items()})

    def block(self) -> bytes:
        """Bytes of the seeds, which are in the order of slot."""
        return B.write([self.parts[f] for f in self.FIELDS])

    @staticmethod
    def joined(blocks: list[bytes]) -> Seeds:
        slot, ids, left, right, chose, need, floor, role = B.read_all(blocks, len(Seeds.FIELDS))
        return Seeds(slot=slot.view(np.uint64), id=ids, left=left.astype(np.uint16), right=right.astype(np.uint16), chose=chose.astype(np.uint8), need=need.astype(np.uint8), floor=floor.astype(np.int32), role=role.astype(np.uint8))


#: Of batch and record, seed and choice of each place: stretches needed there, and buckets the seed is spread over.
Weigh = Callable[[L.Batch, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def seed_blocks(table: DataFrame, rule: Rule, k: int, buckets: int, weigh: Weigh | None = None, side: int = 0) -> DataFrame:
    """(bucket, side, block) of the seeds of table (id, letters, floor).

    weigh(batch, rows, seeds, chose) gives, for each seed, the number of common stretches needed there (SKIP: this
    record proposes nothing by this seed), and over how many buckets its places are spread; without it a single stretch is
    enough everywhere and nothing is spread. A place of a spread seed is KNOWN in one of its buckets and ASKING, unless
    it proposes nothing, in all of them, so that a bucket never holds more than its share of the places of a seed that very
    many records have.
    """
    w = rule.stretch - k + 1
    odd, mask, shift = np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(4**k - 1), np.uint64(2 * k - buckets.bit_length() + 1)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, Seeds]] = []
        count = 0

        def sent() -> pa.RecordBatch:
            target = np.concatenate([t for t, _ in held])
            s = Seeds(**{f: np.concatenate([h.parts[f] for _, h in held]) for f in Seeds.FIELDS})
            order = L.order_of((target.astype(np.uint64) << np.uint64(2 * k)) | s.slot)
            target, s = target[order], s.take(order)
            some, first = np.unique(target, return_index=True)
            blocks = [s.take(slice(x, y)).block() for x, y in zip(first.tolist(), [*first[1:].tolist(), len(target)])]
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(np.full(len(some), side), pa.int32()), pa.array(blocks, pa.binary())], ["bucket", "side", "block"])

        for b in batches:
            batch = L.unpack(b.column(1))
            more, of = L.readings(batch, rule.stretch)
            codes, rows_ = (np.concatenate([batch.codes, more]), np.concatenate([batch.rows(), of])) if len(more) else (batch.codes, batch.rows())
            places, seeds, chose = L.sampled(codes, k, w, rule.term, rule.distinct)
            which = rows_[places]
            left, right = L.flanks(codes, places, k, w - 1)
            need, spread = weigh(batch, which, seeds, chose) if weigh else (np.ones(len(places), np.uint8), np.ones(len(places), np.int64))
            s = Seeds(slot=(seeds.astype(np.uint64) * odd) & mask, id=b.column(0).to_numpy()[which], left=left, right=right, chose=chose, need=need, floor=b.column(2).to_numpy()[which], role=np.full(len(places), BOTH, np.uint8))
            target = (s.slot >> shift).astype(np.int64)
            if (spread > 1).any():
                target, s = _spread(target, s, spread, buckets)
            held.append((target, s))
            count += len(batch)
            if count >= BLOCK_ROWS:
                yield sent()
                held, count = [], 0
        if held and sum(len(t) for t, _ in held):
            yield sent()

    return table.select("id", "letters", "floor").mapInArrow(cut, "bucket int, side int, block binary")


def _spread(target: np.ndarray, s: Seeds, spread: np.ndarray, buckets: int) -> tuple[np.ndarray, Seeds]:
    """Places of spread seeds in further buckets, from number ``buckets`` on."""
    hot = np.flatnonzero(spread > 1)
    own = (L.mixed(s.id[hot].astype(np.uint64)) >> np.uint64(33)).astype(np.int64) % spread[hot]
    asking = hot[s.need[hot] != SKIP]
    n = spread[asking]
    all_ = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    at, part = np.concatenate([hot, np.repeat(asking, n)]), np.concatenate([own, all_])
    cold = np.flatnonzero(spread == 1)
    out = s.take(np.concatenate([cold, at]))
    out.parts["role"] = np.concatenate([np.full(len(cold), BOTH), np.full(len(hot), KNOWN), np.full(len(all_), ASKING)]).astype(np.uint8)
    further = (L.mixed(s.slot[at] ^ (part.astype(np.uint64) << np.uint64(40))) >> np.uint64(20)).astype(np.int64) % buckets + buckets
    return np.concatenate([target[cold], further]), out


def _agreeing(w: int) -> tuple[np.ndarray, np.ndarray]:
    """Of an exclusive-or of two left, and of two right flanks: bit o tells that a stretch which begins o letters
    before the seed agrees on that side."""
    x = np.arange(4 ** (w - 1))
    alike = np.full(len(x), w - 1)
    for j in reversed(range(w - 1)):
        alike[(x >> (2 * j)) & 3 > 0] = j
    return ((2 << alike) - 1).astype(np.uint8), ((1 << w) - (1 << (w - 1 - alike))).astype(np.uint8)


def _meetings(keys: np.ndarray, chunk: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of places with equal keys, in portions; keys must be in order."""
    first, step = np.arange(len(keys) - 1), 1
    while len(first):
        first = first[first + step < len(keys)]
        first = first[keys[first] == keys[first + step]]
        for lo in range(0, len(first), chunk):
            yield first[lo : lo + chunk], first[lo : lo + chunk] + step
        step += 1


def _runs(upto: np.ndarray, chunk: int) -> Iterator[tuple[int, int]]:
    """Ranges of places whose sizes, upto being their running sum, make up about chunk."""
    lo = 0
    while lo < len(upto):
        before = upto[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(upto, before + chunk, "right")))
        yield lo, hi
        lo = hi


def proposals(s: Seeds, w: int, side: np.ndarray | None, chunk: int = 2_000_000, many: int = 50) -> Iterator[tuple[np.ndarray, ...]]:
    """Pairs of ids proposed by the seeds of one bucket, the number of common stretches there and the floor, in portions;
    each portion holds a pair once, in the order of ids.

    Without side, the lower id comes first; with it, that of side 0. The first of a pair decides what it must have in
    common; a second whose floor is 1, as of records with N, may ask for less. Seeds that more than ``many`` places
    share are first told apart by the letters around them, so that only places that agree in a whole stretch
    of k + w - 1 letters ever meet.
    """
    order = L.order_of(s.slot)
    slot = s.slot[order]
    size = np.diff(np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1], [True]])))
    size = np.repeat(size, size)
    by_left, by_right = _agreeing(w)

    def windows(places: np.ndarray, left: int) -> tuple[np.ndarray, np.ndarray]:
        """Those of places that the stretch beginning ``left`` letters before the seed chose, in the order of its letters."""
        places = places[s.chose[places] >> np.uint8(left) & 1 > 0]
        near = (s.left[places] & np.uint16(4**left - 1)).astype(np.uint64) << np.uint64(2 * (w - 1 - left)) | (s.right[places] & np.uint16(4 ** (w - 1 - left) - 1)).astype(np.uint64)
        keys = s.slot[places] << np.uint64(2 * (w - 1)) | near
        by = L.order_of(keys)
        return places[by], keys[by]

    def meetings() -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """Places of one seed, and, where a stretch brought them together, its number."""
        both = s.role[order] == BOTH
        few = order[(size > 1) & (size <= many) & both]
        for x, y in _meetings(s.slot[few], chunk):
            yield few[x], few[y], -1
        crowd, known, asking = order[(size > many) & both], np.flatnonzero(s.role == KNOWN), np.flatnonzero(s.role == ASKING)
        for left in range(w):
            if len(crowd):
                at, keys = windows(crowd, left)
                for x, y in _meetings(keys, chunk):
                    yield at[x], at[y], left
            if len(asking) and len(known):
                (a, ka), (b, kb) = windows(asking, left), windows(known, left)
                low = np.searchsorted(kb, ka, "left")
                n = np.searchsorted(kb, ka, "right") - low
                upto = np.cumsum(n)
                for lo, hi in _runs(upto, chunk):
                    m = n[lo:hi]
                    x = np.repeat(np.arange(lo, hi), m)
                    y = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m) + np.repeat(low[lo:hi], m)
                    yield a[x], b[y], left

    found, held = [], 0

    def portion() -> tuple[np.ndarray, ...]:
        return added(*(np.concatenate(x) for x in zip(*found)))

    for i, j, stretch in meetings():
        if side is None:
            turned = s.id[i] > s.id[j]
            i, j = np.where(turned, j, i), np.where(turned, i, j)
            other = s.id[i] != s.id[j]
        else:
            turned = side[i] > side[j]
            i, j = np.where(turned, j, i), np.where(turned, i, j)
            other = side[i] != side[j]
        shared = by_left[s.left[i] ^ s.left[j]] & by_right[s.right[i] ^ s.right[j]] & s.chose[i] & s.chose[j]
        need = np.where(s.floor[j] == 1, np.minimum(s.need[i], s.need[j]), s.need[i])
        good = other & (np.bitwise_count(shared) >= need)
        if stretch >= 0:  # places that have several stretches in common meet several times: only the first counts
            good &= (shared & (~shared + np.uint8(1))) == np.uint8(1 << stretch)
        good = np.flatnonzero(good)
        if len(good):
            found.append((s.id[i[good]], s.id[j[good]], np.bitwise_count(shared[good]).astype(np.int64), np.minimum(s.floor[i[good]], s.floor[j[good]]).astype(np.int64)))
            held += len(good)
        if held >= chunk:
            found = [portion()]
            held = len(found[0][0])
            if held >= chunk // 2:
                yield found[0]
                found, held = [], 0
    if found:
        yield portion()


def added(a: np.ndarray, b: np.ndarray, n: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each pair once, in order, with the sum of its n."""
    if not len(a):
        return a, b, n, floor
    columns, least = (a, b, floor, n), (a.min(), b.min(), floor.min(), 0)
    bits = [int(c.max() - low).bit_length() for c, low in zip(columns, least)]
    if sum(bits) <= 63:  # all in one number: sorting numbers is far faster than ordering rows
        keys = np.zeros(len(a), np.int64)
        for c, low, w in zip(columns, least, bits):
            keys = (keys << w) | (c - low)
        keys.sort()
        pair = keys >> bits[3]
        new = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
        n, pair = np.add.reduceat(keys & ((1 << bits[3]) - 1), new), pair[new]
        floor, pair = (pair & ((1 << bits[2]) - 1)) + least[2], pair >> bits[2]
        return (pair >> bits[1]) + least[0], (pair & ((1 << bits[1]) - 1)) + least[1], n, floor
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
    return a[new], b[new], np.add.reduceat(n[order], new), floor[order[new]]


def proposed(blocks: DataFrame, rule: Rule, k: int, buckets: int, two_sides: bool = False) -> DataFrame:
    """(a, b): the pairs that show as many common stretches as they must, each once.

    Buckets of seeds tell what they see of each pair, in compressed blocks by a hash of a; there it is added up.
    """
    w = rule.stretch - k + 1

    def probe(table: pa.Table) -> pa.Table:
        blocks_ = table.column("block").to_pylist()
        s = Seeds.joined(blocks_)
        side = None
        if two_sides:
            side = np.repeat(np.array(table.column("side").to_pylist(), np.int8), [B.length(b) for b in blocks_])
        some, out = [], []
        for portion in proposals(s, w, side):
            target = (L.mixed(portion[0].astype(np.uint64)) >> np.uint64(32)).astype(np.int64) % buckets
            order = np.argsort(target, kind="stable")
            edges = np.searchsorted(target[order], np.arange(buckets + 1))
            for t in np.flatnonzero(edges[1:] > edges[:-1]).tolist():
                some.append(t)
                out.append(B.write([c[order[edges[t] : edges[t + 1]]] for c in portion]))
        return pa.table({"target": pa.array(some, pa.int32()), "block": pa.array(out, pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        a, b, n, floor = added(*B.read_all(table.column("block").to_pylist(), 4))
        enough = n >= floor
        return pa.table({"a": a[enough], "b": b[enough]})

    seen = blocks.groupBy("bucket").applyInArrow(probe, "target int, block binary")
    return keep(seen.groupBy("target").applyInArrow(add, "a long, b long"), "pairs", free=True)


def common_terms(left: pa.Array, right: pa.Array, term: int) -> np.ndarray:
    """For packed records side by side: the number of their common distinct terms."""
    (x, of_x), (y, of_y) = (_distinct(c) for c in (left, right))
    shift = np.uint64(2 * term)
    tx, ty = (L.distinct_terms(L.unpack(c), term).astype(np.uint64) for c in (x, y))
    nx = np.bincount((tx >> shift).astype(np.int64), minlength=len(x))
    n, first = nx[of_x], np.cumsum(nx) - nx
    ends = np.cumsum(n)
    mine = tx[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first[of_x] - (ends - n), n)] & ((np.uint64(1) << shift) - np.uint64(1))
    wanted = (np.repeat(of_y, n).astype(np.uint64) << shift) | mine
    place = np.minimum(np.searchsorted(ty, wanted), max(len(ty) - 1, 0))
    upto = np.append(0, np.cumsum(ty[place] == wanted)) if len(ty) else np.zeros(len(wanted) + 1, np.int64)
    return upto[ends] - upto[ends - n]


def at_most_common(left: pa.Array, right: pa.Array, term: int) -> np.ndarray:
    """As common_terms(), but terms that the left record repeats count each time: never too few, and without sorting the
    left records. A bit set over all terms, for terms of up to 8 letters, holds what each right record has."""
    y, of_y = _distinct(right)
    ty = L.distinct_terms(L.unpack(y), term).astype(np.int64)
    table = np.zeros(max(1, len(y) << 2 * term >> 3), np.uint8)
    if len(ty):
        at = ty >> 3
        fresh = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        table[at[fresh]] = np.bitwise_or.reduceat(np.uint8(1) << (ty & 7).astype(np.uint8), fresh)
    x = L.unpack(left)
    value, good = L.rolling(x.codes, term)
    small = np.int32 if len(table) < 1 << 31 else np.int64
    places = np.repeat((of_y << 2 * term >> 3).astype(small), x.lengths + 1)[: len(value)]
    places += value >> 3
    found = (table[places] >> (value & 7).astype(np.uint8)) & good
    upto = np.zeros(len(x.codes) + 1, np.int64)
    np.cumsum(found, out=upto[1 : len(found) + 1])
    upto[len(found) + 1 :] = upto[len(found)]
    return upto[x.starts + x.lengths] - upto[x.starts]


def _distinct(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    coded = column.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def verified(pairs: DataFrame, left: DataFrame, right: DataFrame, rule: Rule) -> DataFrame:
    """(a, b, common, either) of the proposed pairs that reach the threshold, each once."""
    term, t = rule.term, rule.threshold

    def enough(common: np.ndarray, m: np.ndarray, n: np.ndarray) -> np.ndarray:
        return common >= t * (m + n - common) - 1e-9

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            if term <= 8:
                m, n = (b.column(c).to_numpy().astype(np.int64) for c in (3, 5))
                b = b.filter(pa.array(enough(at_most_common(b.column(2), b.column(4), term), m, n)))
            m, n = (b.column(c).to_numpy().astype(np.int64) for c in (3, 5))
            common = common_terms(b.column(2), b.column(4), term)
            good = enough(common, m, n)
            kept = pa.array(good)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(kept), b.column(1).filter(kept), pa.array(common[good], pa.int32()), pa.array((m + n - common)[good], pa.int32())], ["a", "b", "common", "either"])

    # The first join hashes the letters, whose partitions are even as they have one row an id; the second sorts by b, so
    # that pairs of one b come together and its letters are unpacked once.
    with_a = pairs.join(left.select(F.col("id").alias("a"), F.col("letters").alias("la"), F.col("terms").alias("ta")).hint("shuffle_hash"), "a")
    with_b = with_a.join(right.select(F.col("id").alias("b"), F.col("letters").alias("lb"), F.col("terms").alias("tb")).hint("merge"), "b")
    return with_b.select("a", "b", "la", "ta", "lb", "tb").mapInArrow(check, "a long, b long, common int, either int")


def links(table: DataFrame, rule: Rule, weigh_by: Callable[[DataFrame, int, int], Weigh] | None = None) -> DataFrame:
    """(a, b, common, either), a < b: all similar pairs of classes(); every pair once."""
    letters = size_of(table)
    k, n = rule.seed_for(letters), buckets_for(letters)
    weigh = weigh_by(table, k, letters) if weigh_by else None
    return verified(proposed(seed_blocks(table, rule, k, n, weigh), rule, k, n), table, table, rule)


def copies_of(table: DataFrame, groups: DataFrame) -> DataFrame:
    """(rep, id) for every row of rows() whose class has copies: the class's least id and the row's."""
    many = groups.filter("copies > 1").select("letters", F.col("id").alias("rep"))
    return table.join(many, "letters").select("rep", "id")


def every_row(pairs: DataFrame, copies: DataFrame, sides: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Pairs of classes as pairs of rows, (a, b, common, either); copies are as those of copies_of()."""
    of_a, of_b = sides or (copies, copies)
    x = of_a.select(F.col("rep").alias("a"), F.col("id").alias("ia"))
    y = of_b.select(F.col("rep").alias("b"), F.col("id").alias("ib"))
    wide = pairs.join(x, "a", "left").join(y, "b", "left")
    return wide.select(F.coalesce("ia", "a").alias("a"), F.coalesce("ib", "b").alias("b"), "common", "either")
