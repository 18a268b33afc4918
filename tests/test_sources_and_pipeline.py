import random

import pytest
from pyspark.sql import functions as F

from strandloom import cli
from strandloom.operators import classify
from strandloom.plans import pipeline
from strandloom.plans.shared import keep
from strandloom.sources import files
from strandloom.streaming import score


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    out, rng = tmp_path_factory.mktemp("data"), random.Random(1)
    for d in range(2):
        for s, n, first in (("tr", 24, 0), ("te", 10, 1000)):
            labels = [rng.randrange(2) for _ in range(n)]
            seqs = ["".join(rng.choice("ACGT" if y else "AAAT") for _ in range(20)) for y in labels]
            (out / f"X{s}{d}.csv").write_text("Id,seq\n" + "".join(f"{first + i},{q}\n" for i, q in enumerate(seqs)))
            (out / f"X{s}{d}_mat100.csv").write_text("".join(" ".join(f"{rng.gauss(3 * y, 1):.4f}" for _ in range(5)) + "\n" for y in labels))
            if s == "tr":
                (out / f"Ytr{d}.csv").write_text("Id,Bound\n" + "".join(f"{first + i},{y}\n" for i, y in enumerate(labels)))
    return out


def test_readers(spark, folder):
    rows = files.read_matrix(spark, f"{folder}/Xtr0_mat100.csv").orderBy("pos").collect()
    text = (folder / "Xtr0_mat100.csv").read_text().splitlines()
    assert [r.pos for r in rows] == list(range(24)) and rows[3].x == [float(v) for v in text[3].split()]
    train, test = files.read_dataset(spark, str(folder), 1)
    assert (train.count(), test.count()) == (24, 10) and train.columns == ["id", "seq", "label"]


def test_predictions_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(0, 1.0), (1, 0.5), (2, 0.0)], "Id int, Bound double")
    files.write_predictions(df, str(tmp_path / "p"), 3)
    got = files.read_predictions(spark, [str(tmp_path / "p")]).orderBy("Id").collect()
    assert [(r.Id, r.Bound) for r in got] == [(0, 1.0), (1, 0.0), (2, 0.0)]
    with pytest.raises(ValueError):
        files.write_predictions(df, str(tmp_path / "q"))
    with pytest.raises(ValueError):
        files.write_predictions(df.withColumn("Id", F.lit(0)), str(tmp_path / "q"), 3)
    assert files.constant_predictions(spark, 5).count() == 5


def test_embedding_names(spark):
    df = spark.createDataFrame([("embedding_d2_s0.35_k9.npy",), ("other.npy",)], "n string")
    assert [tuple(r.p) for r in df.select(files.parse_embedding_name(F.col("n")).alias("p")).collect()] == [(2, 0.35, 9), (None, None, None)]


def test_pipeline_and_cli(spark, folder, tmp_path):
    vote = pipeline.run(spark, str(folder), str(tmp_path / "out"), (0,), anchors=20)
    assert vote.count() == 10 and {r.Bound for r in vote.collect()} <= {0, 1}
    best = cli.main(["tune", "--data", str(folder), "--datasets", "0", "--clf", "SPR", "--k-fold", "3", "--gamma-min", "0.1", "--gamma-max", "1", "--gamma-num", "2"], spark)
    assert best.count() == 1
    cli.main(["embed", "--data", str(folder), "--out", str(tmp_path / "emb"), "--datasets", "0", "--window-size", "5", "--sigma", "0.4", "--anchors", "12"], spark)
    stored = ["tune-embeddings", "--embeddings", str(tmp_path / "emb" / "d0_s0.4_k5"), "--datasets", "0", "--k-fold", "3", "--lambda-num", "1", "--gamma-num", "1", "--gamma-min", "1"]
    assert cli.main(stored, spark).count() == 1
    anchors = cli.main(["greedy", "--data", str(folder), "--out", str(tmp_path / "anchors"), "--datasets", "0", "--batch", "1", "--n-anchors-per-batch", "3"], spark)
    assert anchors.count() == 3
    read = files.read_anchors(spark, str(tmp_path / "anchors"))
    assert sorted(map(tuple, read.collect())) == sorted(map(tuple, anchors.collect()))


@pytest.mark.parametrize("more", [[], ["--precomputed"]])
def test_tuning_with_the_conv_kernel(spark, folder, tmp_path, more):
    log = tmp_path / "runs.log"
    grid = ["--sigma-num", "2", "--window-size-min", "4", "--window-size-max", "6", "--window-size-num", "2", "--lambda-num", "2", "--lambda-min", "-3", "--lambda-max", "-2"]
    best = cli.main(["tune", "--data", str(folder), "--datasets", "0", "--kernel", "Conv", "--k-fold", "3", "--log", str(log), *grid, *more], spark).collect()
    assert len(best) == 1 and best[0].window_size in (4, 6) and best[0].sigma in (0.3, 0.5)
    assert log.read_text().count("window_size") >= 8


def test_pipeline_numbers_rows_by_counted_test_rows(spark, folder, tmp_path):
    vote = pipeline.run(spark, str(folder), str(tmp_path / "out"), (0, 1), anchors=20)
    assert sorted(r.Id for r in vote.collect()) == list(range(20))


def test_streamed_scores_equal_batch(spark, tmp_path):
    df = spark.createDataFrame([(0, i, [float(i), 1.0], i % 2) for i in range(8)], "dataset int, id long, x array<double>, y int")
    df.write.parquet(str(tmp_path / "in"))
    model = keep(classify.fit_linear(df))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = score.score_linear(stream, model).writeStream.format("memory").queryName("scored").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.awaitTermination()
    want = {r.id: r.score for r in classify.predict_linear(model, df).collect()}
    assert {r.id: r.score for r in spark.table("scored").collect()} == want
