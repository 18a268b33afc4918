"""Queries on numeric features: classifiers, kernels, validation, clustering, with SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.operators import classify, cluster, evaluate, heads, profile, svm
from strandloom.operators import kernels as K
from strandloom.plans.sequence_queries import table

GAMMA, FOLDS, GAMMAS, LAMBDAS, CLUSTERS, STEPS = 2.0, 5, [0.5, 2.0, 5.0], [1e-3, 1e-5], 4, 3


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, dataset, y, x, rn, n): vectors in three datasets, each in md5 order; the first two thirds are for training."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), (F.col("vec_id") % 3).cast("int").alias("dataset"), (F.col("label") % 2).alias("y"), F.col("embedding").cast("array<double>").alias("x"))
    sizes = e.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))
    return profile.ranked(e, "dataset", F.col("id")).join(F.broadcast(sizes), "dataset")


def halves(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    e, first = features(spark, sf_dir), F.expr("rn <= 2 * n div 3")
    return e.filter(first), e.filter(~first)


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def spr_linear_predict(spark, sf_dir):
    train, test = halves(spark, sf_dir)
    return _rounded(classify.predict_linear(classify.fit_linear(train), test).select("id", "y", "score", "y_pred"), "score")


def spr_gaussian_predict(spark, sf_dir):
    train, test = halves(spark, sf_dir)
    return _rounded(classify.predict(train, test, K.Gaussian(GAMMA)).select("id", "y", "score", "y_pred"), "score")


def spr_laplace_predict(spark, sf_dir):
    train, test = halves(spark, sf_dir)
    return _rounded(classify.predict(train, test, K.Laplace(0.5)).select("id", "y", "score", "y_pred"), "score")


def spr_bias(spark, sf_dir):
    return _rounded(classify.bias(halves(spark, sf_dir)[0], K.Gaussian(GAMMA)), "m0", "m1", "b")


def spr_accuracy(spark, sf_dir):
    train, test = halves(spark, sf_dir)
    return _rounded(classify.accuracy(classify.predict_linear(classify.fit_linear(train), test)), "accuracy")


def spr_train_test(spark, sf_dir):
    train, test = halves(spark, sf_dir)
    model = classify.fit_linear(train)
    a, b = (classify.accuracy(classify.predict_linear(model, part)) for part in (train, test))
    return _rounded(a.withColumnRenamed("accuracy", "train_acc").join(b.withColumnRenamed("accuracy", "test_acc"), "dataset"), "train_acc", "test_acc")


def _gram(spark, sf_dir, kernel):
    return _rounded(K.entries(features(spark, sf_dir), None, kernel).select("i", "j", "k"), "k")


def gram_linear(spark, sf_dir):
    return _gram(spark, sf_dir, K.Linear())


def gram_gaussian(spark, sf_dir):
    return _gram(spark, sf_dir, K.Gaussian(GAMMA))


def gram_laplace(spark, sf_dir):
    return _gram(spark, sf_dir, K.Laplace(0.5))


def gram_poly2(spark, sf_dir):
    return _gram(spark, sf_dir, K.Polynomial(1.0, 2))


def similarity_gaussian(spark, sf_dir):
    train, test = halves(spark, sf_dir)
    return _rounded(K.entries(test, train, K.Gaussian(GAMMA)).select("i", "j", "k"), "k")


def gram_centered(spark, sf_dir):
    return _rounded(K.centred(K.entries(features(spark, sf_dir), None, K.Gaussian(GAMMA))).select("i", "j", "kc"), "kc")


def kfold_assign(spark, sf_dir):
    return evaluate.folds(features(spark, sf_dir), FOLDS).select("id", "dataset", "fold")


def _cv(spark, sf_dir, kernels):
    return evaluate.cross_validate(evaluate.folds(features(spark, sf_dir), FOLDS), kernels, FOLDS)


def kfold_spr_cv(spark, sf_dir):
    return _rounded(_cv(spark, sf_dir, [K.Linear()]).select("dataset", "train_avg", "val_avg", "train_std", "val_std"), "train_avg", "val_avg", "train_std", "val_std")


def grid_search_best(spark, sf_dir):
    runs = _cv(spark, sf_dir, [K.Gaussian(g) for g in GAMMAS]).withColumnRenamed("kernel", "run")
    grid = evaluate.grid(spark, gamma=GAMMAS)
    return _rounded(evaluate.best(runs.withColumn("val_avg", F.round("val_avg", 9)).join(F.broadcast(grid), "run")).select("dataset", "gamma", "val_avg"), "val_avg")


def _centroids(spark, sf_dir):
    rows = features(spark, sf_dir).select("id", "x")
    return rows, cluster.kmeans(rows, CLUSTERS, STEPS)


def kmeans_assign(spark, sf_dir):
    rows, (mu, _) = _centroids(spark, sf_dir)
    return cluster.assign(rows, mu).select("id", "cluster")


def kmeans_centroids(spark, sf_dir):
    mu = _centroids(spark, sf_dir)[1][0]
    return spark.createDataFrame([(c, p, round(float(v), 6)) for c, row in enumerate(mu) for p, v in enumerate(row)], "cluster int, pos int, mu double")


def kmeans_distortion(spark, sf_dir):
    return spark.createDataFrame([(round(_centroids(spark, sf_dir)[1][1], 5),)], "distortion double")


def kmeans_best_of(spark, sf_dir):
    run, _, distortion = cluster.kmeans_best_of(features(spark, sf_dir).select("id", "x"), CLUSTERS, 3, STEPS)
    return spark.createDataFrame([(run, round(distortion, 5))], "run int, distortion double")


def kmeans_mini_batch(spark, sf_dir):
    rows = features(spark, sf_dir).select("id", "x")
    return cluster.assign(rows, cluster.mini_batch_kmeans(rows, CLUSTERS, 0.3)).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("d2").alias("d2"))


def svm_fit(spark, sf_dir):
    return svm.fit(halves(spark, sf_dir)[0], K.Gaussian(GAMMA), 1e-3)


def svm_predict(spark, sf_dir):
    train, test = halves(spark, sf_dir)
    return svm.predict(svm.fit(train, K.Gaussian(GAMMA), 1e-3), train, test, K.Gaussian(GAMMA)).select("id", "y", "score", "y_pred")


def svm_gram_fit(spark, sf_dir):
    train, _ = halves(spark, sf_dir)
    return svm.fit_gram(K.entries(train, None, K.Gaussian(GAMMA)), train, 1e-3)


def svm_cv_grid(spark, sf_dir):
    each = svm.cv_grid(evaluate.folds(features(spark, sf_dir), FOLDS), K.Gaussian(GAMMA), LAMBDAS, FOLDS)
    return evaluate.best(evaluate.summary(each, ["dataset", "run", "lam"])).select("dataset", "lam", "train_avg", "val_avg", "train_std", "val_std")


def kernel_pca_project(spark, sf_dir):
    train, test = halves(spark, sf_dir)
    out = svm.kernel_pca(train, test, K.Gaussian(GAMMA))
    return out.select("dataset", "id", F.col("pc")[0].alias("pc1"), F.col("pc")[1].alias("pc2"))


def logistic_embed(spark, sf_dir):
    train, test = halves(spark, sf_dir)
    return heads.logistic(train, test).select("id", "y", "y_pred")


def ridge_embed(spark, sf_dir):
    train, test = halves(spark, sf_dir)
    return heads.ridge(train, test).select("id", "y", "y_pred")


def constant_prediction(spark, sf_dir):
    return table(spark, sf_dir, "test_df").select(F.col("row_id").alias("Id"), F.lit(0).alias("Bound"))


def final_pipeline(spark, sf_dir):
    """Votes of three models on every evaluation vector."""
    train, test = halves(spark, sf_dir)
    parts = [
        classify.predict(train, test, K.Gaussian(GAMMA)).select("id", F.col("y_pred").cast("int").alias("bound")),
        classify.predict_linear(classify.fit_linear(train), test).select("id", F.col("y_pred").cast("int").alias("bound")),
        svm.predict(svm.fit(train, K.Gaussian(GAMMA), 1e-3), train, test, K.Gaussian(GAMMA)).select("id", F.col("y_pred").cast("int").alias("bound")),
    ]
    return evaluate.vote(parts[0].unionByName(parts[1]).unionByName(parts[2]))


QUERIES = [
    spr_linear_predict, spr_gaussian_predict, spr_laplace_predict, spr_bias, spr_accuracy, spr_train_test, gram_linear, gram_gaussian, gram_laplace, gram_poly2,
    similarity_gaussian, gram_centered, kfold_assign, kfold_spr_cv, grid_search_best, kmeans_assign, kmeans_centroids, kmeans_distortion, kmeans_best_of,
    kmeans_mini_batch, svm_fit, svm_predict, svm_gram_fit, svm_cv_grid, kernel_pca_project, logistic_embed, ridge_embed, constant_prediction, final_pipeline,
]

_E = """e as (select vec_id as id, (vec_id % 3)::integer as dataset, (label % 2)::integer as y, embedding::double[] as x,
row_number() over (partition by vec_id % 3 order by md5(vec_id::varchar)) as rn, count(*) over (partition by vec_id % 3) as n from embeddings),
train as (select * from e where rn <= 2 * n // 3), test as (select * from e where rn > 2 * n // 3)"""
_DOT = "list_dot_product(p.x, q.x)"
_GAUSS = "exp(-{0}::double * power(list_distance(p.x, q.x), 2))"
_LAPLACE = "exp(-0.5::double * list_sum(list_transform(list_zip(p.x, q.x), lambda z: abs(z[1] - z[2]))))"
_POLY = f"power({_DOT} + 1, 2)"
_CLASS = "case when {0} > 0 then 1.0::double when {0} < 0 then 0.0::double else 0.5::double end"


def _spr(kernel: str, rows: str = "test") -> str:
    return f"""b as (select p.dataset, avg(k) filter (p.y = 0) as m0, avg(k) filter (p.y = 1) as m1 from (select p.dataset, p.y, {kernel} as k from train p join train q on p.dataset = q.dataset and p.y = q.y) p group by p.dataset),
s as (select p.id, p.dataset, p.y, avg({kernel}) filter (q.y = 1) - avg({kernel}) filter (q.y = 0) as d from {rows} p join train q on p.dataset = q.dataset group by p.id, p.dataset, p.y),
scored as (select id, s.dataset, y, d + (m0 - m1) / 2 as score from s join b on s.dataset = b.dataset)"""


def _predicted(kernel: str) -> str:
    return f"with {_E}, {_spr(kernel)} select id, y, round(score, 6) as score, {_CLASS.format('score')} as y_pred from scored"


def _cross(kernel: str) -> str:
    return f"""f5 as (select *, least((rn - 1) // greatest(n // {FOLDS}, 1), {FOLDS})::integer as fold from e), f as (select unnest(range({FOLDS}))::integer as f),
pairs as materialized (select p.dataset, p.id, p.fold as fi, q.fold as fj, p.y as yi, q.y as yj, {kernel} as k from f5 p join f5 q on p.dataset = q.dataset),
s as (select dataset, f, id, fi, yi, avg(k) filter (yj = 1) - avg(k) filter (yj = 0) as d from pairs, f where fj <> f group by all),
b as (select dataset, f, (avg(k) filter (yi = 0 and yj = 0) - avg(k) filter (yi = 1 and yj = 1)) / 2 as b from pairs, f where fi <> f and fj <> f group by all),
h as (select dataset, f, fi, (({_CLASS.format('d + b')}) = yi)::int as hit from s join b using (dataset, f)),
each as (select dataset, f, avg(hit) filter (fi <> f) as train, avg(hit) filter (fi = f) as val from h group by all)"""


def _kmeans(steps: int, seed: int = 0) -> str:
    """Lloyd steps written out; c{steps} are the centroids after them."""
    parts = [f"c0 as (select row_number() over (order by md5('{seed}:' || vec_id::varchar)) - 1 as cluster, x from e2 qualify row_number() over (order by md5('{seed}:' || vec_id::varchar)) <= {CLUSTERS})"]
    for i in range(steps + 1):
        parts.append(f"a{i} as materialized (select vec_id, x, arg_min(cluster, (d2, cluster)) as cluster, min(d2) as d2 from (select e2.vec_id, e2.x, cluster, power(list_distance(e2.x, c.x), 2) as d2 from e2, c{i} c) group by vec_id, x)")
        parts.append(f"c{i + 1} as materialized (select cluster, list(v order by pos) as x from (select cluster, pos, avg(v) as v from (select cluster, unnest(x) as v, unnest(range(64)) as pos from a{i}) group by cluster, pos) group by cluster)")
    return "e2 as (select vec_id, embedding::double[] as x from embeddings), " + ", ".join(parts)


SQL = {
    "spr_linear_predict": _predicted(_DOT),
    "spr_gaussian_predict": _predicted(_GAUSS.format(GAMMA)),
    "spr_laplace_predict": _predicted(_LAPLACE),
    "spr_bias": f"with {_E}, {_spr(_GAUSS.format(GAMMA))} select dataset, round(m0, 6) as m0, round(m1, 6) as m1, round((m0 - m1) / 2, 6) as b from b",
    "spr_accuracy": f"with {_E}, {_spr(_DOT)} select dataset, round(avg((({_CLASS.format('score')}) = y)::int), 6) as accuracy from scored group by dataset",
    "spr_train_test": f"with {_E}, {_spr(_DOT, 'e')} select dataset, round(avg((({_CLASS.format('score')}) = y)::int) filter (id in (select id from train)), 6) as train_acc, round(avg((({_CLASS.format('score')}) = y)::int) filter (id in (select id from test)), 6) as test_acc from scored group by dataset",
    "similarity_gaussian": f"with {_E} select p.id as i, q.id as j, round({_GAUSS.format(GAMMA)}, 6) as k from test p join train q on p.dataset = q.dataset",
    "gram_centered": f"with {_E}, g as materialized (select p.dataset, p.id as i, q.id as j, {_GAUSS.format(GAMMA)} as k from e p join e q on p.dataset = q.dataset), r as (select dataset, i, avg(k) as m from g group by all), t as (select dataset, avg(k) as m from g group by dataset) select g.i, g.j, round(k - a.m - b.m + t.m, 6) as kc from g join r a on a.i = g.i join r b on b.i = g.j join t on t.dataset = g.dataset where g.i <= g.j",
    "kfold_assign": f"with {_E} select id, dataset, least((rn - 1) // greatest(n // {FOLDS}, 1), {FOLDS})::integer as fold from e",
    "kfold_spr_cv": f"with {_E}, {_cross(_DOT)} select dataset, round(avg(train), 6) as train_avg, round(avg(val), 6) as val_avg, round(stddev_pop(train), 6) as train_std, round(stddev_pop(val), 6) as val_std from each group by dataset",
    "grid_search_best": "select dataset, gamma, round(val_avg, 6) as val_avg from (select *, row_number() over (partition by dataset order by val_avg desc, gamma) as r from ("
    + " union all ".join(f"select dataset, {g}::double as gamma, val_avg from (with {_E}, {_cross(_GAUSS.format(g))} select dataset, round(avg(val), 9) as val_avg from each group by dataset)" for g in GAMMAS)
    + ") where val_avg > 0) where r = 1",
    "kmeans_assign": f"with {_kmeans(STEPS)} select vec_id as id, cluster::integer as cluster from a{STEPS}",
    "kmeans_centroids": f"with {_kmeans(STEPS)} select cluster::integer as cluster, unnest(range(64))::integer as pos, round(unnest(x), 6) as mu from c{STEPS}",
    "kmeans_distortion": f"with {_kmeans(STEPS)} select round(sum(d2), 5) as distortion from a{STEPS}",
    "kmeans_best_of": "select run, round(distortion, 5) as distortion from (" + " union all ".join(f"select {s}::integer as run, distortion from (with {_kmeans(STEPS, s)} select sum(d2) as distortion from a{STEPS})" for s in range(3)) + ") order by distortion, run limit 1",
    "constant_prediction": "select row_id as \"Id\", 0 as \"Bound\" from test_df",
} | {f"gram_{n}": f"with {_E} select p.id as i, q.id as j, round({k}, 6) as k from e p join e q on p.dataset = q.dataset and p.id <= q.id" for n, k in (("linear", _DOT), ("gaussian", _GAUSS.format(GAMMA)), ("laplace", _LAPLACE), ("poly2", _POLY))}

