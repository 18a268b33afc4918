import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from strandloom.llm import letters as L

texts = st.lists(st.one_of(st.none(), st.text("ACGTNUacgtnu -é\n", max_size=60)), max_size=12)


def plain(s):
    return "".join(c for c in (s or "").upper().replace("U", "T") if c in "ACGTN")


@settings(max_examples=60, deadline=None)
@given(texts)
def test_normalise_and_pack_are_exact(values):
    batch = L.normalise(pa.array(values, pa.string()))
    assert [batch.text(i) for i in range(len(batch))] == [plain(v) for v in values]
    again = L.unpack(L.pack(batch))
    assert np.array_equal(again.codes, batch.codes) and np.array_equal(again.starts, batch.starts)


@settings(max_examples=40, deadline=None)
@given(texts, st.integers(1, 12))
def test_rolling_windows(values, k):
    batch = L.normalise(pa.array(values, pa.string()))
    value, good = L.rolling(batch.codes, k)
    rows = batch.rows()
    got = [(int(rows[p]), s) for p, s in zip(np.flatnonzero(good), L.spell(value[good], k))]
    want = [(i, t[j : j + k]) for i, t in enumerate(map(plain, values)) for j in range(len(t) - k + 1) if "N" not in t[j : j + k]]
    assert got == want


def test_marks_with_plain_upper_case_letters():
    batch = L.normalise(pa.array(["ŉ", "ﬆa", None, ""]))
    assert [batch.text(i) for i in range(4)] == ["N", "TA", "", ""]


@settings(max_examples=40, deadline=None)
@given(st.text("ACGT", min_size=16, max_size=24), st.text("ACGT", max_size=30), st.text("ACGT", max_size=30))
def test_common_stretch_gives_a_common_seed(stretch, before, after):
    batch = L.normalise(pa.array([before + stretch, stretch + after]))
    k, w = 11, 6
    places, seeds, chose = L.sampled(batch.codes, k, w)
    rows = batch.rows()[places]
    assert (chose > 0).all()
    assert set(seeds[rows == 0].tolist()) & set(seeds[rows == 1].tolist())
