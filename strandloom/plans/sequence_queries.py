"""Queries on sequences, with SQL that gives the same rows."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.functions import sequence as S
from strandloom.functions import vector as V
from strandloom.operators import evaluate, kernels, kmers, nystrom, profile
from strandloom.plans.shared import keep
from strandloom.plans.ship import ship

K_LONG, K_SHORT, SIGMA = 9, 4, 0.5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def sequences(spark: SparkSession, sf_dir: str, name: str = "train_df") -> DataFrame:
    df = table(spark, sf_dir, name)
    return df.select("row_id", "dataset", *(["label"] if "label" in df.columns else []), S.letters(F.col("sequence")).alias("seq"))


_LETTERS = "regexp_replace(replace(upper(sequence), 'U', 'T'), '[^ACGTN]', '', 'g')"
_SEQ = f"seqs as (select row_id, dataset, label, {_LETTERS} as seq from train_df)"
_TEST = f"tests as (select row_id, dataset, {_LETTERS} as seq from test_df)"
_COUNTS = "len(seq) as seq_length, " + ", ".join(f"len(seq) - len(replace(seq, '{b}', '')) as \"{b}s\"" for b in "ATCG")


def _runs(seq: str) -> str:
    each = ", ".join(f"case when seq is not null then coalesce(list_max(list_transform(regexp_extract_all({seq}, '({b}+)', 1), lambda r: len(r))), 0) end as {b}_longest" for b in "ATCG")
    return f"""with {_SEQ}, runs as (select row_id, {each} from seqs)
select *, greatest(A_longest, T_longest, C_longest, G_longest) as "Longest",
case greatest(A_longest, T_longest, C_longest, G_longest) when A_longest then 'A' when T_longest then 'T' when C_longest then 'C' when G_longest then 'G' end as "Longest_char" from runs"""


def _kmers(k: int, source: str = "seqs", condition: str = "") -> str:
    left, right = (k + 1) // 2 - 1, (k + 2) // 2 - 1
    return f"""select row_id, dataset, (i - 1)::integer as pos, substr(repeat('Z', {left}) || seq || repeat('Z', {right}), i, {k}) as kmer
from (select row_id, dataset, seq, unnest(range(1, len(seq) + 1)) as i from {source}) {condition}"""


def seq_base_counts(spark, sf_dir):
    return profile.base_counts(sequences(spark, sf_dir)).select("row_id", "seq_length", "As", "Ts", "Cs", "Gs")


def seq_alphabet_check(spark, sf_dir):
    return sequences(spark, sf_dir).agg(F.sum(S.outside_alphabet(F.col("seq")).cast("long")).alias("n_bad"), F.count("seq").alias("n_read"))


def seq_longest_run(spark, sf_dir):
    return profile.longest_runs(sequences(spark, sf_dir)).drop("dataset", "label", "seq")


def seq_longest_run_compat(spark, sf_dir):
    return profile.longest_runs(sequences(spark, sf_dir), compat=True).drop("dataset", "label", "seq")


def seq_duplicates(spark, sf_dir):
    return profile.copies(sequences(spark, sf_dir)).select("row_id", "unique_all")


def seq_label_conflicts(spark, sf_dir):
    return profile.label_conflicts(sequences(spark, sf_dir))


def seq_complement(spark, sf_dir):
    c = F.col("seq")
    return sequences(spark, sf_dir).select("row_id", S.complement(c).alias("complement"), S.reverse_complement(c).alias("reverse_complement"))


def seq_complement_hits(spark, sf_dir):
    return profile.complement_hits(sequences(spark, sf_dir).filter("seq <> ''"))


def seq_describe_by_label(spark, sf_dir):
    counted = profile.base_counts(sequences(spark, sf_dir).filter("seq is not null"))
    out = profile.describe(counted, ["seq_length", "As", "Ts", "Cs", "Gs"], ["dataset", "label"])
    return out.select("dataset", "label", "metric", "count", *[F.round(c, 6).alias(c) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")])


def seq_union(spark, sf_dir):
    train = sequences(spark, sf_dir).select("row_id", "dataset", "seq", F.lit("train").alias("part"))
    test = sequences(spark, sf_dir, "test_df").select("row_id", "dataset", "seq", F.lit("test").alias("part"))
    return train.unionByName(test).groupBy("part", "dataset").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("seq").alias("n_distinct"))


def seq_onehot(spark, sf_dir):
    return sequences(spark, sf_dir).select("row_id", F.array_join(S.one_hot(F.col("seq"), unknown="zero").cast("array<string>"), "").alias("onehot"))


def label_join(spark, sf_dir):
    train, files = table(spark, sf_dir, "train_df").select("row_id", "id", "label"), table(spark, sf_dir, "ytr")
    last = files.groupBy("id").agg(F.max(F.struct("loaded_at", "label")).alias("m")).select("id", F.col("m.label").alias("file_label"))
    return train.join(last, "id").select("row_id", "label", "file_label", (F.col("label") == F.col("file_label")).alias("agrees"))


def kmer_explode(spark, sf_dir):
    return kmers.explode(sequences(spark, sf_dir).select("row_id", "dataset", "seq"), K_LONG)


def kmer_no_padding(spark, sf_dir):
    return kmers.explode(sequences(spark, sf_dir).select("row_id", "dataset", "seq"), K_LONG, padding=False)


def kmer_circular(spark, sf_dir):
    return kmers.explode(sequences(spark, sf_dir).select("row_id", "dataset", "seq"), K_LONG, circular=True)


def kmer_counts(spark, sf_dir):
    return kmers.counts(sequences(spark, sf_dir), K_LONG)


def _distinct_of_all(spark, sf_dir, k):
    """Distinct k-mers without N of all rows; a row with N lacks only those that hold one."""
    return kmers.counts(sequences(spark, sf_dir), k).filter("not contains(kmer, 'N')")


def kmer_onehot(spark, sf_dir):
    return _distinct_of_all(spark, sf_dir, K_SHORT).select("kmer", F.array_join(S.one_hot(F.col("kmer")).cast("array<string>"), "").alias("onehot"))


def anchor_sample(spark, sf_dir):
    return kmers.anchors(_distinct_of_all(spark, sf_dir, K_LONG), 100).select("kmer")


def _anchors(spark, sf_dir, p=50) -> list[str]:
    return sorted(r[0] for r in kmers.anchors(_distinct_of_all(spark, sf_dir, K_LONG), p).collect())


def _anchor_vectors(spark, sf_dir):
    named = kmers.anchors(_distinct_of_all(spark, sf_dir, K_LONG), 50).select("kmer")
    return named.select("kmer", S.one_hot(F.col("kmer")).cast("array<double>").alias("x"))


def _kmer_kernel(spark, sf_dir, kernel):
    """A kernel of the 50 anchors, all pairs of them, as expressions."""
    x = _anchor_vectors(spark, sf_dir)
    pairs = x.selectExpr("kmer as a", "x as xa").join(x.selectExpr("kmer as b", "x as xb"), F.col("a") <= F.col("b"))
    return pairs.select("a", "b", F.round(kernel.pair(F.col("xa"), F.col("xb")), 6).alias("k"))


def kmer_kernel_cos(spark, sf_dir):
    return _kmer_kernel(spark, sf_dir, kernels.KmerCosine(SIGMA))


def kmer_kernel_dist(spark, sf_dir):
    return _kmer_kernel(spark, sf_dir, kernels.KmerDistance(SIGMA))


def kzz_matrix(spark, sf_dir, compat=False):
    names = _anchors(spark, sf_dir)
    gram = nystrom.gram(names, SIGMA, compat)
    return spark.createDataFrame([(a, b, round(float(gram[i, j]), 6)) for i, a in enumerate(names) for j, b in enumerate(names)], "a string, b string, k double")


def kzz_matrix_compat(spark, sf_dir):
    return kzz_matrix(spark, sf_dir, True)


def nystrom_mean_similarity(spark, sf_dir):
    names = _anchors(spark, sf_dir)
    import numpy as np

    some = sequences(spark, sf_dir).filter("seq <> ''").select("row_id", "seq")
    out = nystrom.embed(some, "seq", names, SIGMA, root=np.eye(len(names)))
    keys = F.array(*[F.lit(n) for n in names])
    return out.select("row_id", F.explode(F.arrays_zip(keys.alias("anchor"), F.col("x").alias("s"))).alias("z")).select("row_id", "z.anchor", F.round("z.s", 6).alias("s"))


def nystrom_embed(spark, sf_dir):
    names = _anchors(spark, sf_dir)
    return nystrom.embed(sequences(spark, sf_dir).select("row_id", "dataset", "seq"), "seq", names, SIGMA)


def nystrom_error(spark, sf_dir):
    """How well features reproduce the exact kernel, for random anchors p: all rows in md5 order, each with the next of its slot."""
    names = _anchors(spark, sf_dir, 200)
    rows = sequences(spark, sf_dir).filter("seq <> ''")
    width = nystrom.longest(rows)
    embedded = nystrom.embed(rows.select("row_id", "seq", F.col("seq").alias("s")), "seq", names, SIGMA)
    buckets = embedded.withColumn("slot", F.pmod(F.xxhash64("row_id"), F.lit(1024)))
    w = Window.partitionBy("slot").orderBy(F.md5(F.col("row_id").cast("string")))
    pairs = buckets.select("s", "x", F.lead("s").over(w).alias("t"), F.lead("x").over(w).alias("z")).filter("t is not null")
    coded = pairs.select(V.dot(F.col("x"), F.col("z")).alias("approx"), kernels.letter_codes(F.col("s"), width).alias("s"), kernels.letter_codes(F.col("t"), width).alias("t"))
    conv = kernels.Conv(SIGMA, K_LONG)

    def exact(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(conv.pairs(kernels.matrix(b.column(1)), kernels.matrix(b.column(2))))], ["approx", "exact"])

    values = coded.mapInArrow(exact, "approx double, exact double")
    return values.agg(F.avg(F.abs(F.col("exact") - F.col("approx"))).alias("mean_error"), F.stddev_pop("exact").alias("std_exact"), F.count(F.lit(1)).alias("pairs"))


def greedy_anchors(spark, sf_dir):
    distinct = _distinct_of_all(spark, sf_dir, 6).persist()
    return spark.createDataFrame(nystrom.greedy_anchors(distinct, 8, SIGMA), "step int, kmer string, residual double")


def spectral_cluster(spark, sf_dir):
    names = sorted(r[0] for r in kmers.anchors(_distinct_of_all(spark, sf_dir, K_LONG), 200).collect())
    from strandloom.operators import cluster

    at, means = cluster.spectral(nystrom.one_hot(names), 4, SIGMA, K_LONG)
    return spark.createDataFrame([(n, int(c)) for n, c in zip(names, at)], "kmer string, cluster int")


def _profiles(spark, sf_dir):
    """Mean k-mer profile of each dataset and label, N and Z as they are."""
    known = sequences(spark, sf_dir).filter("label is not null and dataset is not null")
    return nystrom.mean_profile(known.select("dataset", "label", "seq"), K_SHORT, "seq", ["dataset", "label"])


def _h(a: str, b: str, k: int):
    """Aligned equal letters; Z and N equal nothing."""
    return sum(((F.substring(a, i, 1) == F.substring(b, i, 1)) & ~F.substring(a, i, 1).isin("Z", "N")).cast("int") for i in range(1, k + 1))


def conv_gram(spark, sf_dir):
    """Mean convolutional kernel between the classes of all datasets, over all rows with a label, by their k-mer profiles. The join
    is over the at most 6^k distinct k-mers of the parameter k, never over rows."""
    p = _profiles(spark, sf_dir)
    q = p.select(F.col("dataset").alias("dataset_b"), F.col("label").alias("label_b"), F.col("kmer").alias("q"), F.col("w").alias("v"))
    known = F.broadcast(q.select("q").distinct())
    pairs = p.select("kmer").distinct().crossJoin(known).select("kmer", "q", (K_SHORT * F.exp((_h("kmer", "q", K_SHORT) / K_SHORT - 1) / SIGMA**2)).alias("kappa"))
    half = p.join(pairs, "kmer").groupBy("dataset", "label", "q").agg(F.sum(F.col("w") * F.col("kappa")).alias("s"))
    return half.join(q, "q").groupBy("dataset", "label", "dataset_b", "label_b").agg(F.round(F.sum(F.col("s") * F.col("v")), 6).alias("k"))


def conv_similarity(spark, sf_dir):
    """Mean convolutional kernel of every evaluation row with each class of its dataset. What every possible k-mer has with a class is made
    class by class from its profile, at most 6^k rows each; no pairs of k-mers are a table, and the evaluation rows are read once."""
    value = keep(nystrom.kmer_values(_profiles(spark, sf_dir), K_SHORT, SIGMA, ["dataset", "label"]), "values")
    tests = sequences(spark, sf_dir, "test_df").filter("seq <> '' and dataset is not null")
    each = kmers.explode(tests.select("row_id", "dataset", F.length("seq").alias("m"), "seq"), K_SHORT)
    return each.join(value, ["dataset", "kmer"]).groupBy("row_id", "label").agg(F.round(F.sum(F.col("v") / F.col("m")), 6).alias("k"))


def majority_vote(spark, sf_dir):
    return evaluate.vote(evaluate.latest(table(spark, sf_dir, "predictions")))


def vote_agreement(spark, sf_dir):
    return evaluate.agreement(evaluate.latest(table(spark, sf_dir, "predictions")))


def grid_runs_summary(spark, sf_dir):
    """Averages and deviations of stored fold scores, made anew; null folds are left out."""
    g = table(spark, sf_dir, "grid_runs")
    long = g.select("run_no", *[F.explode(F.transform(F.col("val_scores"), lambda v: F.struct(v.alias("v")))).alias("s")]).select("run_no", "s.v")
    return long.groupBy("run_no").agg(F.round(F.avg("v"), 6).alias("val_avg"), F.round(F.stddev_pop("v"), 6).alias("val_std"), F.count("v").alias("folds"))


def grid_runs_best(spark, sf_dir):
    g = table(spark, sf_dir, "grid_runs").filter("dataset is not null")
    return evaluate.best(g, order="run_no").select("dataset", "run_no", "gamma", "reg_lambda", "sigma", "window_size", "val_avg")


QUERIES = [
    seq_base_counts, seq_alphabet_check, seq_longest_run, seq_longest_run_compat, seq_duplicates, seq_label_conflicts, seq_complement, seq_complement_hits,
    seq_describe_by_label, seq_union, seq_onehot, label_join, kmer_explode, kmer_no_padding, kmer_circular, kmer_counts, kmer_onehot, anchor_sample,
    kmer_kernel_cos, kmer_kernel_dist, kzz_matrix, kzz_matrix_compat, nystrom_mean_similarity, nystrom_embed, nystrom_error, greedy_anchors, spectral_cluster,
    conv_gram, conv_similarity, majority_vote, vote_agreement, grid_runs_summary, grid_runs_best,
]

_ANCHORS = f"{_SEQ}, distincts as (select distinct kmer from ({_kmers(K_LONG)}) where not contains(kmer, 'N')), anchors as (select kmer from distincts order by md5(kmer), kmer limit 50)"


def _onehot(kmer: str) -> str:
    return f"flatten(list_transform(string_split({kmer}, ''), lambda c: [(c = 'A')::int, (c = 'C')::int, (c = 'G')::int, (c = 'T')::int]))"


_VECTORS = f"{_ANCHORS}, v as (select kmer, {_onehot('kmer')}::double[] as x from anchors)"
_S2 = SIGMA**2
_COS = f"sqrt(list_dot_product(p.x, p.x) * list_dot_product(q.x, q.x)) * exp((list_dot_product(p.x, q.x) / sqrt(list_dot_product(p.x, p.x) * list_dot_product(q.x, q.x)) - 1) / {_S2}::double)"
_DIST = f"sqrt(list_dot_product(p.x, p.x) * list_dot_product(q.x, q.x)) * exp(-power(list_distance(p.x, q.x), 2) / (2 * sqrt(list_dot_product(p.x, p.x) * list_dot_product(q.x, q.x)) * {_S2}::double))"
_HITS = " + ".join(f"(substr(p.kmer, {i}, 1) = substr(q.kmer, {i}, 1) and substr(p.kmer, {i}, 1) not in ('Z', 'N'))::int" for i in range(1, K_SHORT + 1))
_PROFILES = f"""{_SEQ}, named as (select row_id, {{0}} as dataset, seq from seqs where seq <> '' and label is not null and dataset is not null),
k as ({_kmers(K_SHORT, 'named')}), m as (select row_id, dataset, len(seq) as m from named), sizes as (select dataset, count(*) as rows from named group by dataset),
w as (select k.dataset, kmer, sum(1.0::double / m) / max(rows) as w from k join m using (row_id) join sizes on sizes.dataset = k.dataset group by k.dataset, kmer),
kappa as (select p.kmer as a, q.kmer as b, {K_SHORT} * exp((({_HITS})::double / {K_SHORT} - 1) / {_S2}::double) as kappa from (select distinct kmer from {{1}}) p, (select distinct kmer from w) q)"""
_LATEST = """latest as (select model, id, bound from (select *, row_number() over (partition by model, id order by saved_at desc nulls last, bound desc) as r from predictions
where bound in (0, 1) and model is not null and id is not null) where r = 1)"""

SQL = {
    "seq_base_counts": f"with {_SEQ} select row_id, {_COUNTS} from seqs",
    "seq_alphabet_check": f"with {_SEQ} select sum(regexp_matches(seq, '[^ACGT]')::int)::bigint as n_bad, count(seq) as n_read from seqs",
    "seq_longest_run": _runs("seq"),
    "seq_longest_run_compat": _runs("rtrim(seq, right(seq, 1))"),
    "seq_duplicates": f"with {_SEQ} select row_id, count(*) over (partition by seq) as unique_all from seqs",
    "seq_label_conflicts": f"with {_SEQ} select seq, count(distinct label) as n_labels from seqs where seq is not null group by seq having count(distinct label) > 1",
    "seq_complement": f"with {_SEQ} select row_id, translate(seq, 'ATCG', 'TAGC') as complement, reverse(translate(seq, 'ATCG', 'TAGC')) as reverse_complement from seqs",
    "seq_complement_hits": f"with {_SEQ}, s as (select * from seqs where seq <> '') select dataset, count(*)::bigint as counter from s where exists (select 1 from s t where t.dataset = s.dataset and t.seq = translate(s.seq, 'ATCG', 'TAGC')) group by dataset",
    "seq_describe_by_label": f"with {_SEQ}, c as (select dataset, label, {_COUNTS} from seqs where seq is not null), "
    + "l as (" + " union all ".join(f"select dataset, label, '{m}' as metric, \"{m}\"::double as v from c" for m in ("seq_length", "As", "Ts", "Cs", "Gs")) + ") "
    + "select dataset, label, metric, count(v) as count, round(avg(v), 6) as mean, round(stddev_samp(v), 6) as std, min(v) as min, round(quantile_cont(v, 0.25), 6) as p25, round(quantile_cont(v, 0.5), 6) as p50, round(quantile_cont(v, 0.75), 6) as p75, max(v) as max from l group by dataset, label, metric",
    "seq_union": f"with {_SEQ}, {_TEST} select part, dataset, count(*) as n, count(distinct seq) as n_distinct from (select 'train' as part, dataset, seq from seqs union all select 'test', dataset, seq from tests) group by part, dataset",
    "seq_onehot": f"with {_SEQ} select row_id, case when seq = '' then '' else array_to_string({_onehot('seq')}, '') end as onehot from seqs",
    "label_join": """with last as (select id, label as file_label from (select *, row_number() over (partition by id order by loaded_at desc nulls last, label desc nulls last) as r from ytr) where r = 1)
select row_id, label, file_label, label = file_label as agrees from train_df join last using (id)""",
    "kmer_explode": f"with {_SEQ} {_kmers(K_LONG)}",
    "kmer_no_padding": f"with {_SEQ} {_kmers(K_LONG, condition=f'where i - 1 >= {(K_LONG + 1) // 2 - 1} and i - 1 + {(K_LONG + 2) // 2} <= len(seq)')}",
    "kmer_circular": f"""with {_SEQ} select row_id, dataset, (i - 1)::integer as pos, substr(right(repeat(seq, turns), {(K_LONG + 1) // 2 - 1}) || seq || left(repeat(seq, turns), {(K_LONG + 2) // 2 - 1}), i, {K_LONG}) as kmer
from (select row_id, dataset, seq, ceil({float((K_LONG + 2) // 2 - 1)} / len(seq))::bigint as turns, unnest(range(1, len(seq) + 1)) as i from seqs where seq <> '')""",
    "kmer_counts": f"with {_SEQ} select kmer, count(*) as n from ({_kmers(K_LONG)}) group by kmer",
    "kmer_onehot": f"with {_SEQ} select kmer, array_to_string({_onehot('kmer')}, '') as onehot from (select distinct kmer from ({_kmers(K_SHORT)}) where not contains(kmer, 'N'))",
    "anchor_sample": f"with {_SEQ} select kmer from (select distinct kmer from ({_kmers(K_LONG)})) where not contains(kmer, 'N') order by md5(kmer), kmer limit 100",
    "kmer_kernel_cos": f"with {_VECTORS} select p.kmer as a, q.kmer as b, round({_COS}, 6) as k from v p join v q on p.kmer <= q.kmer",
    "kmer_kernel_dist": f"with {_VECTORS} select p.kmer as a, q.kmer as b, round({_DIST}, 6) as k from v p join v q on p.kmer <= q.kmer",
    "kzz_matrix": f"with {_VECTORS} select p.kmer as a, q.kmer as b, round({_COS}, 6) as k from v p, v q",
    "kzz_matrix_compat": f"with {_VECTORS} select p.kmer as a, q.kmer as b, round(case when p.kmer < q.kmer then {_COS} when p.kmer = q.kmer then {_COS} / 2 else 0 end, 6) as k from v p, v q",
    "nystrom_mean_similarity": f"""with {_VECTORS}, filled as (select * from seqs where seq <> ''), k as ({_kmers(K_LONG, 'filled')}), d as (select kmer, {_onehot('kmer')}::double[] as x from (select distinct kmer from k)),
kk as (select p.kmer as anchor, q.kmer, case when list_sum(q.x) > 0 then {_COS} else 0 end as s from v p, d q) select row_id, anchor, round(avg(s), 6) as s from k join kk using (kmer) group by row_id, anchor""",
    "conv_gram": f"with {_PROFILES.format('dataset || chr(58) || label', 'w')} select split_part(x.dataset, ':', 1)::int as dataset, split_part(x.dataset, ':', 2)::int as label, split_part(y.dataset, ':', 1)::int as dataset_b, split_part(y.dataset, ':', 2)::int as label_b, round(sum(x.w * y.w * kappa), 6) as k from w x join kappa on x.kmer = a join w y on y.kmer = b group by x.dataset, y.dataset",
    "conv_similarity": f"""with {_TEST}, ts as (select * from tests where seq <> '' and dataset is not null), tk as ({_kmers(K_SHORT, 'ts')}), {_PROFILES.format('dataset || chr(58) || label', 'tk')},
v as (select split_part(dataset, ':', 1)::int as dataset, split_part(dataset, ':', 2)::int as label, a as kmer, sum(w * kappa) as v from w join kappa on kmer = b group by all)
select row_id, label, round(avg(v), 6) as k from tk join v on v.dataset = tk.dataset and v.kmer = tk.kmer group by row_id, label""",
    "majority_vote": f"with {_LATEST} select id as \"Id\", (avg(bound) > 0.5)::int as \"Bound\" from latest group by id",
    "vote_agreement": f"with {_LATEST} select x.model as a, y.model as b, count(*) as n_common, sum((x.bound = y.bound)::int)::bigint as n_equal from latest x join latest y on x.id = y.id and x.model < y.model group by 1, 2",
    "grid_runs_summary": "select run_no, round(avg(v), 6) as val_avg, round(stddev_pop(v), 6) as val_std, count(v) as folds from (select run_no, unnest(val_scores) as v from grid_runs) group by run_no",
    "grid_runs_best": "select dataset, run_no, gamma, reg_lambda, sigma, window_size, val_avg from (select *, row_number() over (partition by dataset order by val_avg desc nulls last, run_no) as r from grid_runs where dataset is not null and val_avg > 0) where r = 1",
}
