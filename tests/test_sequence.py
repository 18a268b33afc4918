import pytest
from pyspark.sql import functions as F

from strandloom.functions import sequence as S
from strandloom.functions import vector as V
from strandloom.operators import kmers, profile
from strandloom.plans import sequence_queries


def value(spark, expression, **columns):
    df = spark.createDataFrame([tuple(columns.values())], ", ".join(f"{n} {t}" for n, t in zip(columns, ("string", "string")))) if columns else spark.range(1)
    return df.select(expression.alias("v")).first()["v"]


@pytest.mark.parametrize("k, circular, want", [(3, False, "ZAC ACG CGT GTA TAZ"), (4, False, "ZACG ACGT CGTA GTAZ TAZZ"), (3, True, "AAC ACG CGT GTA TAA"), (1, False, "A C G T A")])
def test_kmers(spark, k, circular, want):
    assert value(spark, S.kmers(F.col("s"), k, circular), s="ACGTA") == want.split()


def test_kmer_edges(spark):
    assert value(spark, S.kmers(F.col("s"), 3), s="") == [] and value(spark, S.kmers(F.col("s"), 3), s=None) is None
    assert value(spark, S.kmers(F.col("s"), 9, True), s="AC") == ["ACACACACA", "CACACACAC"]
    assert value(spark, S.kmers(F.col("s"), 9), s="AC") == ["ZZZZACZZZ", "ZZZACZZZZ"]
    df = spark.createDataFrame([(1, "ACGTA")], "id int, seq string")
    assert [r.kmer for r in kmers.explode(df, 3, padding=False).orderBy("pos").collect()] == ["ACG", "CGT", "GTA"]
    assert value(spark, S.kmer_at(F.col("s"), F.lit(0), 3), s="ACGTA") == "ZAC"


def test_one_hot(spark):
    assert value(spark, S.one_hot(F.col("s")), s="AZ") == [1, 0, 0, 0, 0, 0, 0, 0]
    assert value(spark, S.one_hot(F.col("s"), "zero"), s="TN") == [0, 0, 0, 1, 0, 0, 0, 0]
    with pytest.raises(Exception, match="no one-hot code"):
        value(spark, S.one_hot(F.col("s")), s="AN")


@pytest.mark.parametrize("seq, compat, want", [
    ("AACCC", False, (2, 0, 3, 0, 3, "C")), ("AACCC", True, (2, 0, 0, 0, 2, "A")), ("AAAA", True, (0, 0, 0, 0, 0, "A")), ("AAAA", False, (4, 0, 0, 0, 4, "A")),
    ("TTAAC", False, (2, 2, 1, 0, 2, "A")), ("", False, (0, 0, 0, 0, 0, "A")), (None, False, (None,) * 6),
])
def test_longest_runs(spark, seq, compat, want):
    r = profile.longest_runs(spark.createDataFrame([(seq,)], "seq string"), compat=compat).first()
    assert (r.A_longest, r.T_longest, r.C_longest, r.G_longest, r.Longest, r.Longest_char) == want


def test_complements(spark):
    assert value(spark, S.complement(F.col("s")), s="AACG") == "TTGC"
    assert value(spark, S.reverse_complement(F.col("s")), s="AACG") == "CGTT"
    assert value(spark, S.letters(F.col("s")), s="ac-g\nu!n") == "ACGTN"


def test_profile(spark):
    df = spark.createDataFrame([(1, "AC", 0), (2, "AC", 1), (3, "TG", 1), (4, None, 1), (5, "GG", None)], "dataset int, seq string, label int").withColumn("dataset", F.lit(0))
    assert [r.unique_all for r in profile.copies(df).orderBy("seq").collect()] == [1, 2, 2, 1, 1]
    assert [(r.seq, r.n_labels) for r in profile.label_conflicts(df).collect()] == [("AC", 2)]
    assert profile.complement_hits(df).first().counter == 3
    d = {(r.metric): r for r in profile.describe(profile.base_counts(df), ["seq_length", "As"], ["dataset"]).collect()}
    assert (d["As"]["count"], d["As"]["mean"], d["As"]["p50"]) == (4, 0.5, 0.5)


def test_vectors(spark):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(1.0), F.lit(0.0))
    got = spark.range(1).select(V.dot(a, b), V.norm(a), V.distance1(a, b), V.distance2(a, b), V.normalised(a), *[V.to_class(F.lit(v)) for v in (2.0, -1.0, 0.0)]).first()
    assert tuple(got) == (3.0, 5.0, 6.0, 20.0, [0.6, 0.8], 1.0, 0.0, 0.5)


def test_anchors_keep_clean_kmers_of_rows_with_n(spark, tmp_path):
    rows = [(1, 0, 1, "ACGTACGTTGCANGGCATTACA"), (2, 0, 0, "ACGTACG")]
    spark.createDataFrame(rows, "row_id long, dataset int, label int, sequence string").write.parquet(str(tmp_path / "train_df.parquet"))
    got = {r.kmer for r in sequence_queries._distinct_of_all(spark, str(tmp_path), 6).collect()}
    assert {"TTGCAN", "CANGGC"}.isdisjoint(got) and {"GTTGCA", "GGCATT", "ACGTAC"} <= got
    chosen = [r.kmer for r in sequence_queries.greedy_anchors(spark, str(tmp_path)).collect()]
    assert len(chosen) == 8 and set(chosen) <= got
    clustered = {r.kmer for r in sequence_queries.spectral_cluster(spark, str(tmp_path)).collect()}
    assert "ACGTACGTT" in clustered and not any("N" in k for k in clustered)


def test_conv_similarity_makes_no_table_of_pairs_of_kmers(spark, tmp_path):
    """Such a table, however few its rows seem to Spark, may be broadcast through the driver; and the rows are read once."""
    from strandloom.operators import nystrom

    train = [(1, 0, 1, "ACGTNACGGT"), (2, 0, 0, "TTACG"), (3, 0, 1, "GGCATTA"), (4, 1, 1, "AC"), (5, 1, None, "ACGT"), (6, 0, 0, "")]
    spark.createDataFrame(train, "row_id long, dataset int, label int, sequence string").write.parquet(f"{tmp_path}/train_df.parquet")
    test = [(1, 0, "ACGNNTAC"), (2, 0, "G"), (3, 1, "ACGTT"), (4, 0, ""), (5, 0, None), (6, 2, "ACGT")]
    spark.createDataFrame(test, "row_id long, dataset int, sequence string").write.parquet(f"{tmp_path}/test_df.parquet")
    out = sequence_queries.conv_similarity(spark, str(tmp_path))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan and plan.count("posexplode") == 1
    want = {}
    for i, d, s in test:
        for label in (0, 1):
            others = [t for _, e, c, t in train if t and (e, c) == (d, label)]
            if s and others:
                want[i, label] = sum(nystrom.conv(s, t, sequence_queries.K_SHORT, sequence_queries.SIGMA) for t in others) / len(others)
    got = {(r.row_id, r.label): r.k for r in out.collect()}
    assert got.keys() == want.keys() and all(abs(got[x] - k) < 1e-6 for x, k in want.items())
