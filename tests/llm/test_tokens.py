import random

import numpy as np
import pytest

from strandloom.llm import containers, pieces, tokens

TEXTS = [
    None, "", " ", "\n\n", "Hello, world! It's 1234.5 — naïve café\r\n", "Привет, мир! Пожар в городе.", "<|endoftext|> not special", "a" * 3000, "слово" * 400,
    "word " * 500, "   x​\u0085y", "¿Qué pasa? «Sí», dijo.\n" * 60, "\U0001f600\U0001f1e9\U0001f1ea" * 50, "it's we'll I'd 'tis ''s", "----------\n\n\n  \t\t--", "One. Two! Three?\nFour (five.) \"Six.\" " * 80,
]


@pytest.fixture(scope="module")
def encoder():
    return tokens.encoder(tokens.vocabulary_path())


@pytest.fixture(scope="module")
def reference():
    import base64

    import tiktoken

    with open(tokens.vocabulary_path(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_equals_the_reference_encoder(spark, reference):
    df = spark.createDataFrame([(i, t, [1]) for i, t in enumerate(TEXTS)] + [(None, "x", None)], "doc_id long, text string, ids array<int>")
    got = {r.id: list(r.ids) for r in tokens.encode(df, "doc_id", "text").collect()}
    assert got == {i: reference.encode_ordinary(t) if t else [] for i, t in enumerate(TEXTS)} | {None: reference.encode_ordinary("x")}
    assert {r.id: r.tokens for r in tokens.count(df, "doc_id", "text").collect()} == {i: len(v) for i, v in got.items()}
    assert tokens.encode(df.limit(0), "doc_id", "text").count() == 0


def test_appends_and_edits(encoder, reference):
    rng = random.Random(2)
    for text in TEXTS:
        text = (text or "")[:300]
        live = tokens.Text(encoder, text)
        for _ in range(6):
            a = rng.randint(0, len(text))
            b, new = min(len(text), a + rng.randint(0, 9)), (rng.choice(TEXTS) or "")[: rng.randint(0, 12)]
            live.replace(a, b, new)
            text = text[:a] + new + text[b:]
            assert live.ids() == reference.encode_ordinary(text)
        live.append("'s  end")
        assert live.ids() == reference.encode_ordinary(text + "'s  end")


def test_a_long_piece_is_encoded_anew_only_near_the_edit(encoder):
    piece = tokens.Piece(encoder.vocabulary, b"abcdefghij" * 300)
    redone = piece.replace(1000, 1003, b"XY")
    assert redone < 600 and piece.ids() == encoder.vocabulary.encode(piece.data)
    piece.append(b"tail")
    assert piece.ids() == encoder.vocabulary.encode(piece.data)


def test_containers(spark):
    rng = random.Random(4)
    sizes = [rng.choice([0, 1, 5, 100, 250, 511, 512, 513, 1500]) for _ in range(400)]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)] + [(999, None)], "id long, size long")
    limits = spark.createDataFrame([(1, 512), (2, 2048), (3, None)], "limit_id int, capacity int")
    got = containers.fill(df, limits, open_bins=8, per_shard=20_000).collect()
    for limit, capacity in ((1, 512), (2, 2048)):
        mine = [r for r in got if r.limit_id == limit]
        load, parts = {}, {}
        for r in mine:
            load[r.container] = load.get(r.container, 0) + r.length
            parts.setdefault(r.id, []).append((r.part, r.start, r.length))
        assert max(load.values()) <= capacity and set(parts) == {*range(400), 999}
        for i, p in parts.items():
            p.sort()
            assert sum(x[2] for x in p) == (sizes[i] if i < 400 else 0) and (len(p) == 1 or sizes[i] > capacity)
            assert [x[1] for x in p] == [sum(y[2] for y in p[:n]) for n in range(len(p))]
    again = containers.fill(df.repartition(7), limits, open_bins=8, per_shard=20_000).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    usage = {r.limit_id: r for r in containers.usage(containers.fill(df, limits), limits).collect()}
    assert usage[1].unused_share < 0.2 and set(usage) == {1, 2}
    assert containers.fill(df.limit(0), limits).count() == 0 and containers.fill(df, limits.limit(0)).count() == 0


def test_best_fit_picks_the_tightest_bin_and_closes_the_fullest():
    bins = containers.BestFit(10, open_bins=2)
    assert [bins.put(n) for n in (6, 7, 3, 4)] == [0, 1, 1, 0]
    bins = containers.BestFit(10, open_bins=2)
    assert [bins.put(n) for n in (6, 7, 8)] == [0, 1, 2] and bins.put(4) == 0  # bin 1, the fullest, was closed
    assert bins.place(25) == [(3, 0, 10), (4, 10, 10), (5, 20, 5)]


def test_strongest_cut_equals_brute_force():
    rng = np.random.default_rng(3)
    values = rng.integers(-1, 4, 200).astype(np.int8)
    table = pieces.StrongestCut(values, 64)
    for _ in range(200):
        a = int(rng.integers(0, 150))
        b = a + int(rng.integers(0, 50))
        want = max(range(a, b + 1), key=lambda i: (values[i], i))
        assert table.query(np.array([a]), np.array([b]))[0] == want


def test_pieces(spark, encoder):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, piece int")
    limits = spark.createDataFrame([(4, 128, 0), (5, 128, 20), (6, 100_000, 3)], "limit_id int, max_tokens int, overlap_tokens int")
    got = {}
    for r in pieces.split(df, "doc_id", "text", limits).collect():
        got.setdefault((r.limit_id, r.id), []).append(r)
    counts = dict(enumerate(encoder.counts(TEXTS).tolist()))
    assert set(got) == {(limit, i) for limit in (4, 5) for i, n in counts.items() if n > 128}
    for (limit, i), rows in got.items():
        rows.sort(key=lambda r: r.piece)
        overlap = {4: 0, 5: 20}[limit]
        assert rows[0].start == 0 and rows[-1].start + rows[-1].tokens == counts[i]
        for a, b in zip(rows, rows[1:]):
            assert b.piece == a.piece + 1 and (b.start == a.start + a.tokens - overlap or i == 12 and 0 < a.start + a.tokens - overlap - b.start <= 3)
        assert all(0 < r.tokens <= 128 and encoder.counts([r.text])[0] <= 128 and "�" not in r.text for r in rows)
        if not overlap:
            assert "".join(r.text for r in rows) == TEXTS[i]
    lines = got[4, 11]
    assert all(r.text.endswith("\n") for r in lines) and all(r.strength == 3 for r in lines[:-1])
    assert pieces.split(df.limit(0), "doc_id", "text", limits).count() == 0
