import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandloom.operators import classify, cluster, evaluate, heads, nystrom, svm
from strandloom.operators import kernels as K


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 4))
    y = (x[:, 0] + 0.3 * rng.normal(size=60) > 0).astype(int)
    df = spark.createDataFrame([(i % 2, i, x[i].tolist(), int(y[i])) for i in range(60)], "dataset int, id long, x array<double>, y int")
    return x, y, df.persist()


KERNELS = [K.Linear(), K.Gaussian(0.7), K.Polynomial(1.0, 2), K.Laplace(0.5), K.KmerCosine(0.6), K.KmerDistance(0.6)]


@pytest.mark.parametrize("kernel", KERNELS, ids=str)
def test_blocks_agree_with_expressions(data, kernel, monkeypatch):
    x, _, df = data
    monkeypatch.setattr(K, "BLOCK", 16)
    got = {(r.i, r.j): r.k for r in K.entries(df, None, kernel).collect()}
    pairs = df.selectExpr("dataset", "id as i", "x as a").join(df.selectExpr("dataset", "id as j", "x as b"), "dataset").filter("i <= j")
    want = {(r.i, r.j): r.k for r in pairs.select("i", "j", kernel.pair(F.col("a"), F.col("b")).alias("k")).collect()}
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in got)


@settings(max_examples=25, deadline=None)
@given(st.integers(1, 12), st.floats(0.01, 5))
def test_gaussian_is_symmetric_and_positive(n, gamma):
    x = np.random.default_rng(n).normal(size=(n, 3))
    k = K.Gaussian(gamma).block(x, x)
    assert np.allclose(k, k.T) and np.allclose(np.diag(k), 1) and np.linalg.eigvalsh(k).min() > -1e-9


def test_centred(data):
    x, _, df = data
    got = {(r.i, r.j): r.kc for r in K.centred(K.entries(df, None, K.Gaussian(0.5))).collect()}
    ids = np.arange(0, 60, 2)
    k = K.Gaussian(0.5).block(x[ids], x[ids])
    h = np.eye(30) - 1 / 30
    c = h @ k @ h
    assert all(abs(got[int(ids[i]), int(ids[j])] - c[i, j]) < 1e-9 for i in range(30) for j in range(i, 30))


def test_linear_rule_equals_pairwise(data):
    _, _, df = data
    fast = {r.id: r.score for r in classify.predict_linear(classify.fit_linear(df), df).collect()}
    slow = {r.id: r.score for r in classify.predict(df, df, K.Linear()).collect()}
    assert fast.keys() == slow.keys() and all(abs(fast[i] - slow[i]) < 1e-9 for i in fast)
    assert all(r.accuracy > 0.7 for r in classify.accuracy(classify.predict(df, df, K.Gaussian(0.5))).collect())


def test_folds(spark):
    df = spark.createDataFrame([(i + 1, 11) for i in range(11)], "rn int, n int")
    assert [r.fold for r in evaluate.folds(df, 5).orderBy("rn").collect()] == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4, 5]


def test_cross_validation_equals_direct(spark, data):
    x, y, df = data
    folded = evaluate.folds(df.withColumn("rn", F.expr("id div 2 + 1").cast("int")).withColumn("n", F.lit(30)), 4)
    got = {(r.dataset, r.kernel): r for r in evaluate.cross_validate(folded, [K.Linear(), K.Gaussian(1.0)], 4).collect()}
    for d in (0, 1):
        ids = np.arange(d, 60, 2)
        fold = np.minimum(np.arange(30) // 7, 4)
        for n, kernel in enumerate((K.Linear(), K.Gaussian(1.0))):
            k, lab, val = kernel.block(x[ids], x[ids]), y[ids], []
            for f in range(4):
                t = fold != f
                one, zero = t & (lab == 1), t & (lab == 0)
                b = (k[np.ix_(zero, zero)].mean() - k[np.ix_(one, one)].mean()) / 2
                score = k[:, one].mean(1) - k[:, zero].mean(1) + b
                val.append(((score > 0) == lab)[~t].mean())
            assert np.allclose(got[d, n].val_scores, val) and abs(got[d, n].val_std - np.std(val)) < 1e-9


def test_grid_best_and_vote(spark):
    g = evaluate.grid(spark, gamma=[1.0, 2.0], k=[3, 4])
    assert [(r.run, r.gamma, r.k) for r in g.orderBy("run").collect()] == [(0, 1.0, 3), (1, 1.0, 4), (2, 2.0, 3), (3, 2.0, 4)]
    runs = spark.createDataFrame([(0, 0, 0.5), (0, 1, 0.7), (0, 2, 0.7), (1, 0, 0.0)], "dataset int, run int, val_avg double")
    assert [(r.dataset, r.run) for r in evaluate.best(runs).collect()] == [(0, 1)]
    votes = spark.createDataFrame([(0, 1), (0, 1), (0, 0), (1, 1), (1, 0)], "id int, bound int")
    assert [(r.Id, r.Bound) for r in evaluate.vote(votes).orderBy("Id").collect()] == [(0, 1), (1, 0)]


def test_kmeans(spark):
    pts = [[0.0, 0.0], [0.0, 1.0], [10.0, 0.0], [10.0, 1.0]]
    df = spark.createDataFrame(list(enumerate(pts)), "id long, x array<double>")
    mu, distortion = cluster.kmeans(df, 2)
    assert abs(distortion - 1.0) < 1e-9 and sorted(mu[:, 0].tolist()) == [0.0, 10.0] or distortion > 1
    mu, _ = cluster.kmeans(df, 2, start=np.array([[0.0, 0.5], [99.0, 99.0]]), max_iter=1)
    assert mu[1].tolist() == [99.0, 99.0]  # an empty cluster keeps its centroid
    run, _, best = cluster.kmeans_best_of(df, 2, 3)
    assert best <= distortion and run < 3
    assert len(cluster.mini_batch_kmeans(df, 2, 0.9)) == 2
    assert len(cluster.kmeans(df.limit(0), 2)[0]) == 0


def test_spectral():
    x = np.concatenate([np.random.default_rng(1).normal(size=(10, 2)) * 0.05, 5 + np.random.default_rng(2).normal(size=(8, 2)) * 0.05])
    at, means = cluster.spectral(x, 2, 0.5, 2)
    assert len(set(at[:10])) == 1 and len(set(at[10:])) == 1 and at[0] != at[-1] and len(means) == 2


@pytest.mark.parametrize("lam", [1e-2, 1e-4])
def test_svm_is_optimal(data, lam):
    x, y, df = data
    model = {r.id: r.alpha for r in svm.fit(df, K.Gaussian(0.5), lam).collect()}
    gram_model = {r.id: r.alpha for r in svm.fit_gram(K.entries(df, None, K.Gaussian(0.5)), df, lam).collect()}
    assert model.keys() == gram_model.keys() and max(abs(model[i] - gram_model[i]) for i in model) < 1e-3
    for d in (0, 1):
        ids = np.arange(d, 60, 2)
        a = np.array([model[int(i)] for i in ids])
        assert svm.residual(K.Gaussian(0.5).block(x[ids], x[ids]), 2 * y[ids] - 1, a, lam) < 1e-6
    fitted = svm.fit(df, K.Gaussian(0.5), lam)
    scores = {r.id: r.score for r in svm.predict(fitted, df, df, K.Gaussian(0.5)).collect()}
    ids = np.arange(0, 60, 2)
    want = K.Gaussian(0.5).block(x[ids], x[ids]) @ np.array([model[int(i)] for i in ids])
    assert all(abs(scores[int(i)] - w) < 1e-9 for i, w in zip(ids, want))


def test_kernel_pca(data):
    x, _, df = data
    got = {r.id: r.pc for r in svm.kernel_pca(df, df, K.Linear(), 4).collect()}
    ids = np.arange(0, 60, 2)
    c = x[ids] - x[ids].mean(0)
    p = np.array([got[int(i)] for i in ids])
    assert np.allclose(p @ p.T, c @ c.T, atol=1e-8)  # all components reproduce the centred Gram matrix


def test_heads(data):
    _, _, df = data
    for out in (heads.logistic(df, df), heads.ridge(df, df)):
        assert out.agg(F.avg((F.col("y") == F.col("y_pred")).cast("double"))).first()[0] > 0.75


def test_conv_kernel():
    assert abs(nystrom.conv("A", "A", 1, 0.5) - 1) < 1e-12
    assert abs(nystrom.conv("A", "C", 1, 0.5) - np.exp(-1 / 0.25)) < 1e-12


def test_conv_entries(spark):
    seqs = ["ACGTAC", "ACG", "TTTTTTTTT", "ACGTAC"]
    df = spark.createDataFrame([(0, i, s) for i, s in enumerate(seqs)], "dataset int, id long, seq string")
    got = {(r.i, r.j): r.k for r in nystrom.conv_entries(df, None, 3, 0.5).collect()}
    assert len(got) == 10 and all(abs(v - nystrom.conv(seqs[i], seqs[j], 3, 0.5)) < 1e-12 for (i, j), v in got.items())
    profiles = nystrom.mean_profile(df, 3, "seq", ["dataset"]).collect()
    assert abs(sum(r.w for r in profiles) - 1) < 1e-9


def test_roots():
    names = ["ACG", "CGT", "AAA", "TTZ"]
    t = nystrom.gram(names, 0.5, compat=True) + np.eye(4)
    r = nystrom.triangular_root(t)
    assert np.allclose(r @ r, t)
    k = nystrom.gram(names, 0.5)
    inv = nystrom.inverse_root(k, 1e-9)
    assert np.allclose(inv @ k @ inv, np.eye(4), atol=1e-5)
    assert not np.allclose(nystrom.inverse_root(nystrom.gram(names, 0.5, True), compat=True), nystrom.inverse_root(k))


def test_embedding_with_all_kmers_is_exact(spark):
    seqs = ["ACGTAC", "TTACG", "GGGA"]
    names = sorted({"".join(" ACGTZ"[0:0]) or w for s in seqs for w in [("Z" + s + "Z")[i : i + 3] for i in range(len(s))]})
    df = spark.createDataFrame(list(enumerate(seqs)) + [(9, None), (10, "")], "id long, seq string")
    x = {r.id: r.x for r in nystrom.embed(df, "seq", names, 0.6, beta=1e-10).collect()}
    assert x[9] is None and x[10] is None

    def exact(a, b):
        k = K.KmerCosine(0.6).block(nystrom.windows(a, 3), nystrom.windows(b, 3))
        return k.mean()

    for i in range(3):
        for j in range(3):
            assert abs(np.dot(x[i], x[j]) - exact(seqs[i], seqs[j])) < 1e-4


def test_greedy_anchors(spark):
    names = ["AAA", "AAC", "CCC", "GGT", "TTT"]
    df = spark.createDataFrame([(n, 1) for n in names], "kmer string, n int")
    got = nystrom.greedy_anchors(df, 4, 0.5, first="AAA")
    chosen = ["AAA"]
    for _, name, r in got[1:]:
        rest = nystrom.residuals(nystrom.one_hot(names), nystrom.one_hot(chosen), 0.5).round(9)
        assert name == min(n for n, v in zip(names, rest) if v == rest.max()) and abs(r - rest.max()) < 1e-8
        chosen.append(name)
    assert len(set(chosen)) == 4


@pytest.mark.parametrize("lam", [1e-2, 1e-7, 1e-12])
def test_svm_tells_how_far_it_is_from_optimal(data, lam):
    x, y, df = data
    rows = svm.fit(df, K.Gaussian(0.5), lam).collect()
    assert len(rows) == 60 and all(r.residual < 1e-5 and r.bias == 0 for r in rows)


def test_svm_with_bias(data):
    x, y, df = data
    lam, kernel = 1e-3, K.Gaussian(0.5)
    model = svm.fit(df, kernel, lam, bias=True)
    rows = {r.id: r for r in model.collect()}
    c = 1 / (2 * 30 * lam)
    for d in (0, 1):
        ids = np.arange(d, 60, 2)
        a, sign = np.array([rows[int(i)].alpha for i in ids]), 2 * y[ids] - 1
        assert abs(a.sum()) < 1e-6 and all(rows[int(i)].residual < 1e-5 for i in ids)
        margin = sign * (kernel.block(x[ids], x[ids]) @ a + rows[d].bias)
        inside = (sign * a > 1e-6) & (sign * a < c - 1e-6)
        assert np.allclose(margin[inside], 1, atol=1e-4) and (margin[sign * a <= 1e-6] > 1 - 1e-4).all()
    scores = {r.id: r.score for r in svm.predict(model, df, df, kernel).collect()}
    similar = K.entries(df, df, kernel)
    stored = {r.id: r.score for r in svm.predict_gram(model, similar).collect()}
    assert scores.keys() == stored.keys() and all(abs(scores[i] - stored[i]) < 1e-9 for i in scores)


def test_folds_cut_from_a_stored_gram_matrix(data):
    _, _, df = data
    folded = df.withColumn("fold", (F.col("id") % 3).cast("int"))
    kernel, lams = K.Gaussian(0.5), [1e-2, 1e-3]
    made = {(r.dataset, r.run, r.f): (r.train, r.val) for r in svm.cv_grid(folded, kernel, lams, 3).collect()}
    cut = {(r.dataset, r.run, r.f): (r.train, r.val) for r in svm.cv_gram(K.entries(folded, None, kernel), folded, lams, 3).collect()}
    assert len(made) == 12 and made == cut


def test_spectrum(data):
    x, _, df = data
    got = [r.value for r in svm.spectrum(df.filter("dataset = 0"), K.Linear(), 3).orderBy("place").collect()]
    c = x[::2] - x[::2].mean(0)
    assert np.allclose(got, np.sort(np.linalg.eigvalsh(c @ c.T))[::-1][:3])


def test_conv_kernel_of_rows(spark, monkeypatch):
    rng = np.random.default_rng(3)
    seqs = ["".join(rng.choice(list("ACGTN"), rng.integers(0, 30))) for _ in range(20)] + ["", "A", "NNNN"]
    df = spark.createDataFrame([(0, i, s, i % 2) for i, s in enumerate(seqs)], "dataset int, id long, seq string, y int")
    monkeypatch.setattr(K, "BLOCK", 7)
    kernel = K.REGISTRY["Conv"](0.5, 4)
    rows = nystrom.conv_rows(df, nystrom.longest(df))
    assert {r.id for r in rows.collect()} == {i for i, s in enumerate(seqs) if s}
    got = {(r.i, r.j): r.k for r in K.entries(rows, rows, kernel).collect()}
    assert all(abs(v - nystrom.conv(seqs[i], seqs[j], 4, 0.5)) < 1e-9 for (i, j), v in got.items())
    x = K.matrix(rows.orderBy("id").toArrow().column("x"))
    order = [i for i, s in enumerate(seqs) if s]
    assert np.allclose(kernel.pairs(x, x[::-1]), [got[i, j] for i, j in zip(order, order[::-1])])
    model = svm.fit(rows, kernel, 1e-3)
    scored = svm.predict(model, rows, rows, kernel).collect()
    assert len(scored) == len(order) and {r.y_pred for r in scored} <= {0.0, 0.5, 1.0}


def test_anchor_norm_features(spark):
    names, sigma, k = ["ACG", "TTA"], 0.6, 3
    df = spark.createDataFrame([(1, "ACGTNA"), (2, ""), (3, None), (4, "G")], "id long, seq string")
    got = {r.id: r.x for r in nystrom.embed(df, "seq", names, sigma, root=np.eye(2), anchor_norm=True).collect()}
    assert got[2] is None and got[3] is None
    z = nystrom.one_hot(names)
    for i, s in ((1, "ACGTNA"), (4, "G")):
        w = nystrom.windows(s, k)
        want = np.linalg.norm(z, axis=1) * np.sqrt(k) * np.exp((w @ (z / np.linalg.norm(z, axis=1)[:, None]).T / np.sqrt(k) - 1) / sigma**2)
        assert np.allclose(got[i], want.mean(0))


def test_greedy_anchors_keep_their_state(spark, monkeypatch):
    names = ["".join(x) for x in np.random.default_rng(4).choice(list("ACGT"), (120, 4))]
    df = spark.createDataFrame([(n,) for n in sorted(set(names))], "kmer string").repartition(3)
    whole = nystrom.greedy_anchors(df, 9, 0.5, first=names[0])
    monkeypatch.setattr(nystrom, "EVERY", 2)
    kept = nystrom.greedy_anchors(df, 9, 0.5, first=names[0])
    assert [a[:2] for a in whole] == [a[:2] for a in kept] and len(kept) == 9


def test_drawn_with_replacement(spark):
    from strandloom.operators import kmers

    df = spark.createDataFrame([(c,) for c in "ABCDE"], "kmer string")
    got = [(r.draw, r.kmer) for r in kmers.drawn(df, 40).orderBy("draw").collect()]
    assert [d for d, _ in got] == list(range(40)) and {k for _, k in got} == set("ABCDE")
    assert got == [(r.draw, r.kmer) for r in kmers.drawn(df.repartition(3), 40).orderBy("draw").collect()]
    assert kmers.drawn(df.limit(0), 3).count() == 0
