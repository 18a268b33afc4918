"""Long exact spans that records share, and how much of each record they cover.

Every window of ``length`` letters holds an anchor: the seeds of k letters with the least hash among the
length - k + 1 in the window. Where the window stands again, so does the anchor, at the same place of it. The steps:

1. Each task keeps a count-min sketch of the anchors of its records. The sketches are added up slice by slice. A
   window is never more frequent than its anchor, and an anchor never more frequent than the sketch says: windows
   whose anchor has an estimate of one cannot be shared and are dropped. None that is shared is lost, however full
   the sketch is.
2. The anchors that are left travel with the letters around them to a bucket of their hash, where all windows around
   an anchor are grouped exactly, letter by letter.

Anchors that very many records share are spread over several groups. The windows of such a group go on to a last exact
grouping by window: one entry where several records of the group share it, every place where one record alone holds it;
so no task ever gets all places of a frequent anchor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm import blocks, letters as L

#: Rows of the sketch; its cells in all, at most: 2 ** 27 cells are one bit each in a broadcast of 16 MB.
DEPTH = 2
MOST_CELLS = 27
_SLICES = 64
#: Places of one anchor that go to one group.
GROUP = 2000
#: What a cell of a task's own sketch holds; counts beyond it are sent on at once.
FULL = 65_535
_BLOCK_ROWS = 60_000


def _sliding(values: np.ndarray, w: int, pick: np.ufunc) -> np.ndarray:
    """pick (minimum or maximum) over w neighbours from each place on."""
    out, width = values, 1
    while width < w:
        step = min(width, w - width)
        out = pick(out[:-step], out[step:])
        width += step
    return out


def anchors(codes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, seeds) of the anchors of all windows without N; k is by the length."""
    k = seed_length(length)
    w = length - k + 1
    value, good = L.rolling(codes, k)
    if len(value) < w:
        return np.empty(0, np.int64), value[:0].astype(np.uint64)
    order = (L.mixed(value) >> np.uint64(32)).astype(np.uint32) >> np.uint32(1)
    bad = np.uint32(0xFFFFFFFF)
    order[~good] = bad
    whole = _sliding(order, w, np.maximum) != bad  # no seed of the window holds an N
    least = np.where(whole, _sliding(order, w, np.minimum), np.uint32(0))
    pad = np.zeros(w - 1, np.uint32)
    highest = _sliding(np.concatenate([pad, least, pad]), w, np.maximum)  # of the windows that hold a place
    places = np.flatnonzero((highest == order) & good & _covered(whole, w, len(order)))
    return places, value[places].astype(np.uint64)


def _covered(whole: np.ndarray, w: int, n: int) -> np.ndarray:
    """Whether a place lies in a whole window, seeds counted."""
    edge = np.zeros(n + 1, np.int32)
    starts = np.flatnonzero(whole)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + w, -1)
    return np.cumsum(edge[:-1]) > 0


def seed_length(length: int) -> int:
    return max(1, min(31, length * 3 // 5))


def _surroundings(batch: L.Batch, places: np.ndarray, rows: np.ndarray, k: int, f: int) -> tuple[np.ndarray, ...]:
    """Letters left and right of anchors, (anchors, f) each, nearest first; N and what lies outside are 4."""
    ends = batch.starts + batch.lengths
    left = places[:, None] - 1 - np.arange(f)
    right = places[:, None] + k + np.arange(f)
    left = np.where(left >= batch.starts[rows][:, None], batch.codes[np.maximum(left, 0)], 4).astype(np.uint8)
    right = np.where(right < ends[rows][:, None], batch.codes[np.minimum(right, len(batch.codes) - 1)], 4).astype(np.uint8)
    return left, right


def _good(letters: np.ndarray) -> np.ndarray:
    """How many letters, nearest first, come before an N or the end."""
    bad = letters > 3
    return np.where(bad.any(axis=1), bad.argmax(axis=1), letters.shape[1])


def _cells(seeds: np.ndarray, log_cells: int) -> list[np.ndarray]:
    """The cell of each seed in every row of the sketch."""
    per_row = log_cells - (DEPTH - 1).bit_length()
    h = L.mixed(seeds)
    return [((h >> np.uint64(64 - per_row - 11 * d)) & np.uint64((1 << per_row) - 1)).astype(np.int64) + (d << per_row) for d in range(DEPTH)]


class Sketch:
    """repeated: one bit for each cell with a count over 1. hot, hot_counts: cells with more than GROUP, in order."""

    def __init__(self, log_cells: int, repeated: np.ndarray, hot: np.ndarray, hot_counts: np.ndarray) -> None:
        self.log_cells, self.repeated, self.hot, self.hot_counts = log_cells, repeated, hot, hot_counts
        self.group = GROUP  # travels with the sketch, so that tasks use the driver's value

    def over_one(self, seeds: np.ndarray) -> np.ndarray:
        out = np.ones(len(seeds), bool)
        for c in _cells(seeds, self.log_cells):
            out &= (self.repeated[c >> 3] >> (c & 7).astype(np.uint8)) & 1 > 0
        return out

    def groups(self, seeds: np.ndarray) -> np.ndarray:
        """Into how many groups the places of each seed are spread."""
        least = np.full(len(seeds), np.iinfo(np.int64).max)
        for c in _cells(seeds, self.log_cells):
            at = np.searchsorted(self.hot, c)
            found = (at < len(self.hot)) & (np.append(self.hot, -1)[at] == c)
            least = np.minimum(least, np.where(found, np.append(self.hot_counts, 0)[at], 0))
        return 1 + least // self.group


def sketch(texts: DataFrame, length: int, letters: int) -> Sketch:
    """The merged count-min sketch of all anchors of texts (text)."""
    expected = 2 * letters / (length - seed_length(length) + 2)
    log_cells = int(np.clip(np.ceil(np.log2(max(expected, 1) * 8)), 16, MOST_CELLS))
    width, full, group_size = (1 << log_cells) // _SLICES, FULL, GROUP  # the driver's values, also within tasks

    def sent(at: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        """Counts n of cells, which are in order, by slice."""
        edges = np.searchsorted(at, np.arange(_SLICES + 1) * width)
        some = np.flatnonzero(edges[1:] > edges[:-1]).tolist()
        packed = [blocks.write([at[edges[i] : edges[i + 1]] - i * width, n[edges[i] : edges[i + 1]]]) for i in some]
        return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(packed, pa.binary())], ["slice", "block"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << log_cells, np.uint16)
        for b in batches:
            _, seeds = anchors(L.normalise(b.column(0)).codes, length)
            for c in _cells(seeds, log_cells):
                at, n = np.unique(c, return_counts=True)
                n += cells[at]
                over = n > full
                if over.any():
                    yield sent(at[over], n[over])
                cells[at] = np.where(over, 0, n)
        at = np.flatnonzero(cells)
        yield sent(at, cells[at])

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(width, np.int64)
        for block in group.column("block").to_pylist():
            at, n = blocks.read(block, 2)
            total[at] += n
        hot = np.flatnonzero(total > group_size)
        return pa.table({"slice": group.column("slice")[:1], "block": pa.array([np.packbits(total > 1, bitorder="little").tobytes()], pa.binary()), "hot": pa.array([blocks.write([hot, total[hot]])], pa.binary())})

    merged = texts.mapInArrow(count, "slice int, block binary").groupBy("slice").applyInArrow(add, "slice int, block binary, hot binary")
    repeated, hot, hot_counts = np.zeros((_SLICES, max(1, width // 8)), np.uint8), [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for row in sorted(merged.collect(), key=lambda r: r["slice"]):  # at most 16 MB of bits; hot cells are few: each has over GROUP anchors
        repeated[row["slice"]] = np.frombuffer(bytes(row["block"]), np.uint8)
        at, n = blocks.read(bytes(row["hot"]), 2)
        hot.append(at + row["slice"] * width)
        hot_counts.append(n)
    return Sketch(log_cells, repeated.reshape(-1), np.concatenate(hot), np.concatenate(hot_counts))


def _window_keys(group: np.ndarray, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each number o of letters left of the anchor: exact keys of the windows, equal only for equal windows of a group."""
    n, f = left.shape
    if f <= 16 and int(group.max(initial=0)).bit_length() + 2 * f <= 63:
        lower = np.zeros((f + 1, n), np.int64)
        for o in range(f):
            lower[o + 1] = lower[o] | (right[:, o] & 3).astype(np.int64) << (2 * o)
        upper = group.astype(np.int64) << (2 * f)
        for o in range(f + 1):
            yield o, upper | lower[f - o]
            if o < f:
                upper |= (left[:, o] & 3).astype(np.int64) << (2 * (f - 1 - o))
        return
    to_right = [group.astype(np.int64)]
    for o in range(f):
        to_right.append(np.unique(to_right[-1] * 5 + right[:, o], return_inverse=True)[1].astype(np.int64))
    to_left = group.astype(np.int64)
    for o in range(f + 1):
        yield o, to_left * (n + 1) + to_right[f - o]
        if o < f:
            to_left = np.unique(to_left * 5 + left[:, o], return_inverse=True)[1].astype(np.int64)


def shared_windows(group: np.ndarray, rows: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each anchor place two bit sets over o, the letters of a window left of the anchor: windows that another record
    of its group has too, and windows to compare with other groups: every place of a window that one record alone holds
    here, as all are marked if another group has it, and the first place of one that is marked here already."""
    f = left.shape[1]
    shared, alone = np.zeros(len(group), np.uint64), np.zeros(len(group), np.uint64)
    to_left, to_right = _good(left), _good(right)
    for o, keys in _window_keys(group, left, right):
        which = np.flatnonzero((to_left >= o) & (to_right >= f - o))
        if not len(which):
            continue
        which = which[np.argsort(keys[which], kind="stable")]
        key = keys[which]
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        sizes = np.diff(np.append(starts, len(key)))
        other = rows[which] != np.repeat(rows[which[starts]], sizes)
        both = np.logical_or.reduceat(other, starts)
        shared[which[np.repeat(both, sizes)]] |= np.uint64(1 << o)
        passed = np.repeat(~both, sizes)
        passed[starts] = True
        alone[which[passed]] |= np.uint64(1 << o)
    return shared, alone


def _columns(left: np.ndarray, right: np.ndarray) -> list[np.ndarray]:
    """Letters of both sides as whole numbers, 20 letters each in base 5."""
    both = np.concatenate([left, right], axis=1).astype(np.int64)
    return [both[:, i : i + 20] @ (5 ** np.arange(both[:, i : i + 20].shape[1], dtype=np.int64)) for i in range(0, both.shape[1], 20)]


def _letters(columns: list[np.ndarray], f: int) -> tuple[np.ndarray, np.ndarray]:
    parts = []
    for i, c in enumerate(columns):
        width = min(20, 2 * f - 20 * i)
        parts.append((c[:, None] // 5 ** np.arange(width, dtype=np.int64)) % 5)
    both = np.concatenate(parts, axis=1).astype(np.uint8)
    return both[:, :f], both[:, f:]


def marks(df: DataFrame, id_col: str, text_col: str, length: int = 40) -> DataFrame:
    """(id, place, windows): bit o of windows tells that the window which begins o letters before place is shared."""
    if not 2 <= length <= 94:
        raise ValueError("length must lie between 2 and 94")
    spark = df.sparkSession
    picked = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).filter("id is not null and text is not null")
    total = picked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    known = spark.sparkContext.broadcast(sketch(picked.select("text"), length, total))
    k = seed_length(length)
    f = length - k
    n_columns = 4 + (2 * f + 19) // 20
    buckets = max(1, int(np.ceil(total / 10_000_000)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        count = 0

        def sent() -> pa.RecordBatch:
            columns = [np.concatenate(c) for c in zip(*held)]
            bucket = (L.mixed(columns[0].astype(np.uint64) ^ (columns[1].astype(np.uint64) << np.uint64(48))) >> np.uint64(16)).astype(np.int64) % buckets
            order = np.lexsort((columns[2], bucket))
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
            some = np.flatnonzero(edges[1:] > edges[:-1])
            data = [blocks.write([c[order[edges[b] : edges[b + 1]]] for c in columns]) for b in some]
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(data, pa.binary())], ["bucket", "block"])

        for b in batches:
            batch = L.normalise(b.column(1))
            places, seeds = anchors(batch.codes, length)
            kept = known.value.over_one(seeds)
            places, seeds = places[kept], seeds[kept]
            rows = batch.rows()[places]
            ids = b.column(0).to_numpy()[rows]
            part = (L.mixed(ids.astype(np.uint64)) >> np.uint64(20)).astype(np.int64) % known.value.groups(seeds)
            left, right = _surroundings(batch, places, rows, k, f)
            held.append([seeds.astype(np.int64), part, ids, places - batch.starts[rows] + 1, *_columns(left, right)])
            count += len(batch)
            if count >= _BLOCK_ROWS:
                yield sent()
                held, count = [], 0
        if held and sum(len(h[0]) for h in held):
            yield sent()

    def group(table: pa.Table) -> pa.Table:
        seeds, part, ids, places, *rest = blocks.read_all(table.column("block").to_pylist(), n_columns)
        left, right = _letters(rest, f)
        order = np.lexsort((part, seeds))
        fresh = np.append(True, (seeds[order][1:] != seeds[order][:-1]) | (part[order][1:] != part[order][:-1]))
        gid = np.empty(len(seeds), np.int64)
        gid[order] = np.cumsum(fresh) - 1
        spread = known.value.groups(seeds.astype(np.uint64)) > 1
        lone = np.bincount(gid)[gid] < 2
        use = np.flatnonzero(~lone | spread)
        shared, first = shared_windows(gid[use], ids[use], left[use], right[use])
        done, open_ = shared > 0, spread[use] & (first > 0)
        out_ids = np.concatenate([ids[use][done], ids[use][open_]])
        out_places = np.concatenate([places[use][done], places[use][open_]])
        windows = np.concatenate([shared[done], first[open_]]).astype(np.int64)
        texts = [None] * int(done.sum()) + _spelled(seeds[use][open_], left[use][open_], right[use][open_], k)
        return pa.table({"id": out_ids, "place": pa.array(out_places, pa.int64()), "windows": windows, "around": pa.array(texts, pa.string())})

    first = picked.mapInArrow(cut, "bucket int, block binary").groupBy("bucket").applyInArrow(group, "id long, place long, windows long, around string")
    if not len(known.value.hot):
        return first.select("id", "place", "windows")
    # Of anchors spread over groups: entries of each group and window, exactly grouped by the window's letters.
    o = F.explode(F.filter(F.sequence(F.lit(0), F.lit(f)), lambda i: F.getbit(F.col("windows"), i) > 0)).alias("o")
    entries = first.filter("around is not null").select("id", "place", "around", o)
    entries = entries.select("id", "place", "o", F.substr("around", F.lit(f + 1) - F.col("o"), F.lit(length)).alias("window"))
    several = entries.groupBy("window").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low < high").select("window")
    last = entries.join(several, "window").select("id", "place", F.expr("shiftleft(1L, o)").alias("windows"))
    return first.filter("around is null").select("id", "place", "windows").unionAll(last)


def _spelled(seeds: np.ndarray, left: np.ndarray, right: np.ndarray, k: int) -> list[str]:
    names = np.frombuffer(L.ALPHABET.encode(), np.uint8)
    inner = (seeds.astype(np.uint64)[:, None] >> np.arange(2 * (k - 1), -1, -2, dtype=np.uint64)) & np.uint64(3)
    whole = np.concatenate([left[:, ::-1], inner.astype(np.uint8), right], axis=1)
    return [x.tobytes().decode() for x in names[whole]]


def spans(df: DataFrame, id_col: str, text_col: str, length: int = 40) -> DataFrame:
    """(id, span_start, span_end): every longest run of letters that lie in a window of ``length`` letters without N
    that another record has too; places count letters from 1, ends are inclusive.

    Null ids and null, empty or short texts have no spans. length: 2 to 94 letters.
    """
    f = length - seed_length(length)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.empty(0, np.int64)] * 3

        def runs(ids: np.ndarray, places: np.ndarray, windows: np.ndarray) -> pa.RecordBatch:
            parts = [(ids[on], places[on] - o) for o in range(f + 1) if len(on := np.flatnonzero(windows >> o & 1))]
            who, start = (np.concatenate(x) for x in zip(*parts)) if parts else (ids[:0], places[:0])
            order = np.lexsort((start, who))
            who, start = who[order], start[order]
            fresh = np.append(True, (who[1:] != who[:-1]) | (start[1:] > start[:-1] + length)) if len(who) else np.empty(0, bool)
            first = np.flatnonzero(fresh)
            last = np.append(first[1:], len(who)) - 1 if len(who) else first
            return pa.RecordBatch.from_arrays([pa.array(who[first]), pa.array(start[first], pa.int32()), pa.array(start[last] + length - 1, pa.int32())], ["id", "span_start", "span_end"])

        for b in batches:  # in the order of id: all but the last id are complete
            now = [np.concatenate([r, c.to_numpy()]) for r, c in zip(rest, b.columns)]
            if not len(now[0]):
                continue
            whole = now[0] != now[0][-1]
            yield runs(*(c[whole] for c in now))
            rest = [c[~whole] for c in now]
        yield runs(*rest)

    placed = marks(df, id_col, text_col, length).repartition("id").sortWithinPartitions("id")
    return placed.mapInArrow(merge, "id long, span_start int, span_end int")


def shares(df: DataFrame, id_col: str, text_col: str, length: int = 40) -> DataFrame:
    """(id, letters, shared, share) of every row with an id: its letters, those in spans, and their share (null without letters)."""
    letters = F.regexp_replace(F.translate(F.upper(F.col(text_col).cast("string")), "U", "T"), "[^ACGTN]", "")
    each = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.length(letters), F.lit(0)).alias("letters")).filter("id is not null")
    covered = spans(df, id_col, text_col, length).groupBy("id").agg(F.sum(F.expr("span_end - span_start + 1")).alias("shared"))
    out = each.join(covered, "id", "left").withColumn("shared", F.coalesce("shared", F.lit(0)).cast("long"))
    return out.withColumn("share", F.when(F.col("letters") > 0, F.col("shared") / F.col("letters")))
