import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from strandloom.llm import frequency, spans
from strandloom.llm import letters as L


def plain(s):
    return "".join(c for c in (s or "").upper().replace("U", "T") if c in "ACGTN")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    shared = "".join(rng.choice("ACGT") for _ in range(90))
    out = []
    for _ in range(80):
        s = "".join(rng.choice("ACGT") for _ in range(rng.choice([10, 60, 101, 150])))
        if rng.random() < 0.5 and len(s) > 50:
            at, n = rng.randrange(40), rng.randrange(30, 80)
            s = s[:20] + shared[at : at + n] + s[20:]
            if rng.random() < 0.2:
                i = rng.randrange(len(s))
                s = s[:i] + "N" + s[i + 1 :]
        out.append(s)
    return out + [None, "", " ", "ACGT" * 40, out[0], out[0], "A" * 2000, "a" * 45, "NN" + out[3], out[5] + out[5]]


def test_counts_equal_brute_force(spark, rows):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(rows)], "code int, text string").repartition(3)
    for lengths in ((8,), (2, 5, 11)):
        got = {(r.n, r.code): (r.occurrences, r.records) for r in frequency.term_counts(df, "text", lengths).collect()}
        want_all, want_rows = Counter(), Counter()
        for s in map(plain, rows):
            for n in lengths:
                each = [s[i : i + n] for i in range(len(s) - n + 1) if "N" not in s[i : i + n]]
                want_all.update((n, t) for t in each)
                want_rows.update((n, t) for t in set(each))
        spelled = {(n, L.spell(np.array([c]), n)[0]): v for (n, c), v in got.items()}
        assert spelled == {key: (want_all[key], want_rows[key]) for key in want_all}


def test_suffix_array_is_in_order_with_its_common_prefixes():
    rng = random.Random(15)
    texts = ["".join(rng.choice("ACGTN" if rng.random() < 0.1 else "AC") for _ in range(rng.randint(0, 120))) for _ in range(25)] + ["A" * 90, "AC" * 40]
    batch = L.normalise(pa.array(texts))
    for longest in (1, 3, 8, 16, 17, 33, 40, 70):
        s = frequency.suffix_array(batch, longest)
        letters = "".join("ACGT~"[c] for c in batch.codes)
        each = [letters[p:].split("~")[0][:longest] for p in s.places]
        assert each == sorted(each) and len(each) == letters.replace("~", "").__len__()
        assert [len(e) for e in each] == s.usable.tolist()
        common = [0] + [next((i for i, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y))) for x, y in zip(each, each[1:])]
        assert common == s.common.tolist()


def test_long_terms_equal_brute_force(spark, rows):
    df = spark.createDataFrame([(s,) for s in rows], "text string").repartition(2)
    got = {(r.n, r.term): (r.occurrences, r.records) for r in frequency.term_counts(df, "text", (8, 40, 55)).collect()}
    want = {}
    for s in map(plain, rows):
        for n in (8, 40, 55):
            for t, c in Counter(s[i : i + n] for i in range(len(s) - n + 1) if "N" not in s[i : i + n]).items():
                o, r = want.get((n, t), (0, 0))
                want[n, t] = (o + c, r + 1)
    assert got == want


def test_marks(spark):
    texts = ["ACGTACGT"] * 3 + ["CCCCCCCC"] * 98 + ["GGGGGGGG", None, "", "NNNNNNNNN"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r.term: (r.records, r.mark) for r in frequency.marked_terms(df, "text").collect()}
    assert got == {"ACGTACGT": (3, "common"), "CCCCCCCC": (98, "common"), "GGGGGGGG": (1, "rare")}
    assert frequency.marked_terms(df.limit(0), "text").count() == 0


def brute_spans(rows, n=40):
    rows = list(map(plain, rows))
    where = {}
    for i, s in enumerate(rows):
        for j in range(len(s) - n + 1):
            if "N" not in s[j : j + n]:
                where.setdefault(s[j : j + n], set()).add(i)
    out = set()
    for i, s in enumerate(rows):
        mark = [False] * len(s)
        for j in range(len(s) - n + 1):
            if len(where.get(s[j : j + n], ())) > 1:
                mark[j : j + n] = [True] * n
        j = 0
        while j < len(s):
            if mark[j]:
                e = j
                while e + 1 < len(s) and mark[e + 1]:
                    e += 1
                out.add((i, j + 1, e + 1))
                j = e
            j += 1
    return out


@pytest.mark.parametrize("length", [20, 40, 61])
def test_spans_equal_brute_force(spark, rows, length):
    df = spark.createDataFrame([(i, s, "clash") for i, s in enumerate(rows)], "row_id int, sequence string, place string").repartition(4)
    got = [tuple(r) for r in spans.spans(df, "row_id", "sequence", length).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_spans(rows, length)


def test_spans_with_very_frequent_anchors(spark, rows, monkeypatch):
    monkeypatch.setattr(spans, "GROUP", 3)  # forces the split of groups and the last grouping by window
    df = spark.createDataFrame([(i, s) for i, s in enumerate(rows)], "row_id int, sequence string").repartition(4)
    assert {tuple(r) for r in spans.spans(df, "row_id", "sequence").collect()} == brute_spans(rows)


def test_repeated_windows_of_very_frequent_anchors(spark, monkeypatch):
    """A window that one record of a group holds at several places is marked at all of them."""
    monkeypatch.setattr(spans, "GROUP", 3)
    rng = random.Random(17)

    def some(n):
        return "".join(rng.choice("ACGT") for _ in range(n))

    anchor = min((some(24) for _ in range(500)), key=lambda a: int(L.mixed(L.rolling(L.normalise(pa.array([a])).codes, 24)[0][:1])[0]))
    rows = [some(20) + anchor + some(20) for _ in range(60)]
    for _ in range(8):
        window = some(8) + anchor + some(8)
        rows += [some(30) + window + some(30) + window + some(30) for _ in range(2)]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(rows)], "row_id int, sequence string").repartition(4)
    assert {tuple(r) for r in spans.spans(df, "row_id", "sequence").collect()} == brute_spans(rows)


def test_shares_and_empty(spark, rows):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(rows)], "row_id int, sequence string")
    got = {r.id: (r.letters, r.shared) for r in spans.shares(df, "row_id", "sequence").collect()}
    covered = Counter()
    for i, a, b in brute_spans(rows):
        covered[i] += b - a + 1
    assert got == {i: (len(plain(s)), covered[i]) for i, s in enumerate(rows)}
    assert spans.spans(df.limit(0), "row_id", "sequence").count() == 0


def test_sketch_counts_are_whole_however_full_its_cells(spark, rows, monkeypatch):
    monkeypatch.setattr(spans, "GROUP", 2)
    texts = spark.createDataFrame([(s,) for s in rows * 5], "text string").repartition(2)
    want = spans.sketch(texts, 40, 20_000)
    monkeypatch.setattr(spans, "FULL", 1)
    got = spans.sketch(texts, 40, 20_000)
    assert len(want.hot) and (got.hot == want.hot).all() and (got.hot_counts == want.hot_counts).all() and (got.repeated == want.repeated).all()


def test_suffix_intervals_of_one_text():
    found = frequency.suffix_array(L.normalise(pa.array(["ACACAC"])), 3)
    assert [frequency.intervals(found, n)[1].tolist() for n in (1, 2, 3)] == [[3, 3], [3, 2], [2, 2]]
    assert [frequency.intervals(found, n)[2].tolist() for n in (1, 2, 3)] == [[1, 1], [1, 1], [1, 1]]
