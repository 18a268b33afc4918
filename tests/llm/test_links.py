import random

import pytest

from strandloom.llm import clusters, near, overlap
from strandloom.llm import simjoin as J


def terms(s):
    s = "".join(c for c in (s or "").upper().replace("U", "T") if c in "ACGTN")
    return {s[i : i + 8] for i in range(len(s) - 7) if "N" not in s[i : i + 8]}


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 0


def family(rng, n=60, hub=False):
    """Random records, copies, edited and reordered ones, repeats, hot motifs, nulls."""
    motif = "".join(rng.choice("ACGT") for _ in range(14))
    rows = []
    for _ in range(n):
        s = "".join(rng.choice("ACGT") for _ in range(rng.choice([60, 101, 101, 101, 180])))
        if rng.random() < 0.4:
            s = s[:30] + motif + s[44:]
        rows.append(s)
        if hub:
            rows += [s[:i] + rng.choice("ACGT") + s[i + 1 :] for i in (20, 50)]
        for _ in range(rng.choice([0, 0, 1, 3])):
            t = list(s)
            for _ in range(rng.choice([0, 1, 2, 3])):
                t[rng.randrange(len(t))] = rng.choice("ACGTN")
            t = "".join(t)
            cut = rng.randrange(20, len(t) - 20)
            rows.append(t[cut:] + t[:cut] if rng.random() < 0.3 else t.lower() if rng.random() < 0.3 else t)
    return rows + [None, "", "  ", "A" * 300, "AC" * 150, "N" * 80, "ACGT", rows[0], rows[0], rows[0]]


@pytest.fixture(scope="module")
def data(spark):
    rows = family(random.Random(3))
    df = spark.createDataFrame([(i * 7 + 1, s, "x", i) for i, s in enumerate(rows)] + [(None, rows[0], "y", 0)], "row_id long, sequence string, letters string, id int")
    return rows, df.repartition(5)


def brute(rows, threshold):
    sets = {i * 7 + 1: terms(s) for i, s in enumerate(rows)}
    ids = [i for i, t in sets.items() if len(t) >= 40]
    return {(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if similarity(sets[a], sets[b]) >= threshold}


def test_near_pairs_equal_brute_force(data):
    rows, df = data
    got = [(r.a, r.b) for r in near.near_pairs(df, "row_id", "sequence").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 0.5)


def test_spread_seeds_and_thresholds_lose_nothing(spark, monkeypatch):
    from strandloom.llm import thresholds

    monkeypatch.setattr(thresholds, "SHARE", 1)  # every seed of more than two places is spread
    rng = random.Random(11)
    rows = family(rng, 40, hub=True)
    df = spark.createDataFrame([(i * 7 + 1, s) for i, s in enumerate(rows)], "row_id long, sequence string").repartition(3)
    plain = thresholds.weigher
    monkeypatch.setattr(near, "weigher", lambda rule: plain(rule, crowded=1))
    got = [(r.a, r.b) for r in near.near_pairs(df, "row_id", "sequence").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 0.5)


def components(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {x: find(x) for x in root}


def test_groups_give_every_compared_row_once(data):
    rows, df = data
    got = {r.id: r for r in near.near_groups(df, "row_id", "sequence").collect()}
    assert set(got) == {i * 7 + 1 for i, s in enumerate(rows) if len(terms(s)) >= 40}
    want = components(brute(rows, 0.5))
    assert {i: r.group_id for i, r in got.items()} == {i: want.get(i, i) for i in got}


def test_clusters_are_chains_of_similar_rows(data):
    rows, df = data
    want = components(brute(rows, 0.3))
    sizes = {}
    for c in want.values():
        sizes[c] = sizes.get(c, 0) + 1
    got = {r.id: r.cluster for r in clusters.cluster_rows(df, "row_id", "sequence").collect()}
    assert got == {i: c for i, c in want.items() if sizes[c] >= 3}


def test_links_of_short_stretches_are_found(spark):
    """Six evenly spaced substitutions in 101 letters: similarity 0.324, and no common stretch of 15 letters."""
    rng = random.Random(31)
    rows = []
    for _ in range(30):
        s = "".join(rng.choice("ACGT") for _ in range(101))
        t = list(s)
        for i in range(14, 101, 14)[:6]:
            t[i] = rng.choice([c for c in "ACGT" if c != s[i]])
        rows += [s, "".join(t)]
    df = spark.createDataFrame([(i * 7 + 1, s) for i, s in enumerate(rows)], "row_id long, sequence string").repartition(3)
    want = components(brute(rows, 0.3))
    assert len(want) >= 50
    assert {r.id: r.cluster for r in clusters.cluster_rows(df, "row_id", "sequence", least=2).collect()} == want


def test_records_with_unread_letters_get_no_thresholds(spark):
    """Whatever the rule takes breaks to cost."""
    import numpy as np

    from strandloom.llm import letters as L
    from strandloom.llm.thresholds import weigher

    rng = random.Random(41)
    s = "".join(rng.choice("ACGT") for _ in range(101))
    rule = J.Rule(0.3, stretch=15, gap=12, hidden=0.75)
    table = J.rows(spark.createDataFrame([(1, s), (2, s[:50] + "N" + s[51:])], "id long, sequence string"), "id", "sequence", rule)
    batch = L.unpack(table.orderBy("id").toArrow().column("letters").combine_chunks())
    places, seeds, chose = L.sampled(batch.codes, 11, 5, rule.term, rule.distinct)
    which = batch.rows()[places]
    need, _ = weigher(rule, crowded=0)(table, 11, 200)(batch, which, seeds, chose)
    assert (need[which == 0] > 1).any() and np.all(need[which == 1] == 1)


def test_average_linkage_profile(spark, data):
    rows, df = data
    got = clusters.cluster_profile(df, "row_id", "sequence").collect()
    assert got and all(r.size >= 3 and 1 <= r.member_rank <= 3 and 0 <= r.mean_similarity <= 1 + 1e-9 for r in got)
    edges = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.5), (1, 3, 0.1), (4, 5, 0.4)], "a long, b long, similarity double")
    weights = spark.createDataFrame([(i, 1) for i in range(1, 7)], "id long, weight long")
    from strandloom.llm.linkage import average_linkage

    assert {r.id: r.cluster for r in average_linkage(edges, weights, 0.35).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 6}
    assert {r.id: r.cluster for r in average_linkage(edges, weights, 0.3).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6}


def test_overlaps_equal_brute_force_and_report(spark, data):
    rows, df = data
    rng = random.Random(9)
    other = [s for s in rows if s and rng.random() < 0.5] + family(rng, 10)
    test = spark.createDataFrame([(i, s, " Valid " if i % 2 else "TEST") for i, s in enumerate(other)], "row_id long, sequence string, split string")
    found = overlap.overlaps(df, test, "row_id", "sequence")
    got = [(r.train_id, r.test_id, r.covered, r.first, r.last) for r in found.collect()]
    left, right = {i * 7 + 1: terms(s) for i, s in enumerate(rows)}, dict(enumerate(map(terms, other)))
    want = {(a, b) for a, x in left.items() if len(x) >= 40 for b, y in right.items() if len(y) >= 40 and similarity(x, y) >= 0.5}
    assert {g[:2] for g in got} == want and len(got) == len(want)
    assert all(0 < c <= last - first + 1 for _, _, c, first, last in got)
    report = overlap.report(found, df.withColumnRenamed("id", "source"), test, "row_id", "letters", "split").collect()
    assert {r.split for r in report} == {"valid", "test"} and sum(r.pairs for r in report) == len(want)


def test_empty_tables(spark, data):
    empty = spark.createDataFrame([], "row_id long, sequence string")
    assert near.near_pairs(empty, "row_id", "sequence").count() == 0
    assert near.near_groups(empty, "row_id", "sequence").count() == 0
    assert clusters.cluster_rows(empty, "row_id", "sequence").count() == 0
    assert overlap.overlaps(data[1], empty, "row_id", "sequence").count() == 0


def test_thresholds_spend_at_most_the_budget():
    import itertools

    import numpy as np

    from strandloom.llm.thresholds import allocate

    rng = np.random.default_rng(1)
    sizes, costs, budgets = rng.integers(0, 4, (20, 4)), rng.random((20, 4)) * 100, rng.integers(0, 6, 20)
    got = allocate(sizes, costs, budgets)
    assert (got.sum(1) <= budgets).all()

    def cost(i, e):
        return sum(c / 4.0**x if x < s else 0 for s, c, x in zip(sizes[i], costs[i], e))

    for i in range(20):
        best = min(cost(i, e) for e in itertools.product(range(4), repeat=4) if sum(e) <= budgets[i] and all(x <= s for x, s in zip(e, sizes[i])))
        assert abs(cost(i, got[i]) - best) < 1e-3


def test_sure_stretch():
    assert J.sure_stretch(0.5) == 17 and J.sure_stretch(0.3) == 12


@pytest.mark.parametrize("threshold", [None, 0.3])
def test_rounds_on_the_cluster_equal_those_in_one_task(spark, monkeypatch, threshold):
    from strandloom.llm import linkage

    rng = random.Random(8)
    pairs = {tuple(sorted(rng.sample(range(1, 60), 2))) for _ in range(70)} | {(1, i) for i in range(60, 90)}
    edges = spark.createDataFrame([(a, b, rng.choice([0.3, 0.4, 0.5, 0.9, rng.random()])) for a, b in sorted(pairs)], "a long, b long, similarity double").persist()
    weights = spark.createDataFrame([(i, 1 + i % 2) for i in range(1, 95)], "id long, weight long")

    def result():
        out = linkage.components(edges) if threshold is None else linkage.average_linkage(edges, weights, threshold)
        return {r.id: r.cluster for r in out.collect()}

    here = result()
    monkeypatch.setattr(linkage, "LOCAL", 0)
    assert result() == here
    assert here == {**{i: i for i in here}, **components(pairs)} if threshold is None else len(set(here.values())) < 94


def test_records_with_unread_letters_keep_their_pairs(spark):
    """An N takes terms from its own record only; such pairs show fewer common stretches than the bound for others says."""
    rng = random.Random(21)
    rows = []
    for _ in range(40):
        s = "".join(rng.choice("ACGT") for _ in range(101))
        t = list(s)
        for i in (15, 39, 77, 97)[: rng.randint(1, 4)]:
            t[i] = "N"
        t[41] = t[59] = rng.choice("ACGT")
        rows += [s, "".join(t)]
    df = spark.createDataFrame([(i * 7 + 1, s) for i, s in enumerate(rows)], "row_id long, sequence string").repartition(3)
    got = {(r.a, r.b) for r in near.near_pairs(df, "row_id", "sequence").collect()}
    assert got == brute(rows, 0.5) and len(got) >= 30


def test_long_records_with_regular_unread_letters_keep_their_pairs(spark):
    """202 letters and the same with 12 evenly spaced N: similarity 0.508, and no common stretch of 16 letters."""
    rng = random.Random(51)
    rows = []
    for _ in range(15):
        s = "".join(rng.choice("ACGT") for _ in range(202))
        t = list(s)
        for i in range(1, 13):
            t[i * 203 // 13 - 1] = "N"
        rows += [s, "".join(t)]
    df = spark.createDataFrame([(i * 7 + 1, s) for i, s in enumerate(rows)], "row_id long, sequence string").repartition(3)
    got = {(r.a, r.b) for r in near.near_pairs(df, "row_id", "sequence").collect()}
    assert got == brute(rows, 0.5) and len(got) >= 15


@pytest.mark.parametrize("hot", [128, 6, 2])
def test_counted_windows_propose_every_similar_pair(spark, hot):
    """Also where most windows are hot: by their counts in one task, over tasks, and by hot windows alone."""
    from strandloom.llm import windows

    rng = random.Random(61)
    motif = "".join(rng.choice("ACGT") for _ in range(16))
    rows = [s and s[:20] + motif + s[36:] if s and rng.random() < 0.3 else s for s in family(rng, 40, hub=True)]
    for _ in range(15):  # evenly broken ones, blocks moved, unread letters
        s = "".join(rng.choice("ACGT") for _ in range(101))
        t = list(s)
        for i in range(14, 101, 14)[:6]:
            t[i] = rng.choice([c for c in "ACGT" if c != s[i]])
        u = list(s)
        for i in rng.sample(range(101), rng.randint(1, 4)):
            u[i] = "N"
        cut = rng.randint(20, 60)
        rows += [s, "".join(t), "".join(u), s[cut : cut + 30] + s[:cut] + s[cut + 30 :], s[:40] + "N" * 12 + s[52:]]
    df = spark.createDataFrame([(i * 7 + 1, s) for i, s in enumerate(rows)], "row_id long, sequence string").repartition(3)
    groups = clusters.J.classes(clusters.J.rows(df, "row_id", "sequence", clusters.RULE))
    pairs = [(r.a, r.b) for r in windows.links(groups, clusters.RULE, windows.Windows(hot=hot, member_block=16)).collect()]
    classes = {r.id for r in groups.collect()}
    want = {(a, b) for a, b in brute(rows, 0.3) if a in classes and b in classes}
    assert len(pairs) == len(set(pairs)) and set(pairs) == want


def test_windows_of_very_large_ids(spark):
    """Ids that don't fit beside the windows in one number."""
    rng = random.Random(71)
    rows = [s for s in family(rng, 15) if s]
    small = spark.createDataFrame([(i, s) for i, s in enumerate(rows)], "row_id long, sequence string").repartition(2)
    large = spark.createDataFrame([(i * (1 << 52) - (1 << 61), s) for i, s in enumerate(rows)], "row_id long, sequence string").repartition(2)
    a = {(r.id, r.cluster) for r in clusters.cluster_rows(small, "row_id", "sequence").collect()}
    b = {((r.id + (1 << 61)) >> 52, (r.cluster + (1 << 61)) >> 52) for r in clusters.cluster_rows(large, "row_id", "sequence").collect()}
    assert a and a == b


def test_pairs_of_a_bucket_are_never_held_together():
    """However many records each of its windows has: portions are bounded, and add up to the same counts."""
    import numpy as np

    from strandloom.llm import windows as W

    rng = np.random.default_rng(5)
    n = 4000  # 40 windows of 100 records each: 198,000 meetings, most of them of different pairs
    e = W.Entries(rng.integers(1, 600, n), np.full(n, 94), np.repeat(np.arange(40), 100), np.zeros(n, np.int64), np.zeros(n, np.int64), np.ones(n, np.int64))
    code = np.full((1300, 1300), 5, np.int16)
    whole, of_whole = W.meetings(e, 6, 128, code)
    parts, of_parts = W.meetings(e, 6, 128, code, most=5_000)
    (whole,), parts = list(whole), list(parts)
    assert len(parts) > 5 and max(len(p[0]) for p in parts) <= 3 * 5_000
    assert all(len(set(zip(p[0].tolist(), p[1].tolist()))) == len(p[0]) for p in parts)
    summed = W.J.added(*(np.concatenate(c) for c in zip(*parts)))
    assert all(np.array_equal(x, y) for x, y in zip(summed, whole)) and all(np.array_equal(x, y) for x, y in zip(of_whole, of_parts))


def test_counts_of_a_target_are_added_up_in_parts():
    import numpy as np

    from strandloom.llm import windows as W

    rng = np.random.default_rng(6)
    pairs = [[rng.integers(-9, 500, 1000), rng.integers(0, 50, 1000), np.ones(1000, np.int64), np.full(1000, 5)] for _ in range(8)]
    hot = [[rng.integers(-9, 500, 300), np.full(300, 94), rng.integers(0, 99, 300), np.full(300, 200)] for _ in range(3)]
    blocks = [W.B.write(p) for p in pairs], [W.B.write(h) for h in hot]
    ((one, _),) = list(W.in_parts(blocks, (4, 4)))
    got = list(W.in_parts(blocks, (4, 4), 1000))
    assert len(got) == 9 and max(len(p[0]) + len(h[0]) for p, h in got) < 2000
    owners = [set(p[0].tolist()) | set(h[0].tolist()) for p, h in got]
    assert sum(map(len, owners)) == len(set.union(*owners))
    summed = [W.J.added(*p) for p, _ in got]
    assert {(a, b, n) for a, b, n, _ in zip(*(np.concatenate(c).tolist() for c in zip(*summed)))} == {(a, b, n) for a, b, n, _ in zip(*(c.tolist() for c in W.J.added(*one)))}
    assert sum(len(h[0]) for _, h in got) == 900


def test_targets_follow_the_chance_meetings():
    from strandloom.llm import windows as W

    how = W.Windows()
    assert W.targets_for(1000, how, 1) == 1
    assert all(min(n / 4.0**13, 128) * n / W.targets_for(n, how, 15) <= W.TARGET_PAIRS for n in (10**8, 10**9, 10**10, 10**12))
