"""Queries of the llm operators over the driver's tables; their SQL is in sql.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.llm import clusters, containers, frequency, near, overlap, pieces, spans, tokens
from strandloom.plans.shared import keep
from strandloom.plans.ship import ship


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clusters.cluster_rows(_table(spark, sf_dir, "train_df"), "row_id", "sequence")
    return found.select(F.col("id").alias("row_id"), F.col("cluster").alias("cluster_id"))


def p1_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = clusters.cluster_profile(_table(spark, sf_dir, "train_df"), "row_id", "sequence")
    return out.select(F.col("cluster").alias("cluster_id"), "size", "member_rank", F.col("member").alias("row_id"), F.round("mean_similarity", 6).alias("mean_similarity"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency.marked_terms(_table(spark, sf_dir, "train_df"), "sequence").filter("mark is not null").select("term", "mark")


def p2_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency.marked_terms(_table(spark, sf_dir, "train_df"), "sequence")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.spans(_table(spark, sf_dir, "train_df"), "row_id", "sequence").withColumnRenamed("id", "row_id")


def p3_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spans.shares(_table(spark, sf_dir, "train_df"), "row_id", "sequence").withColumnRenamed("id", "row_id")
    return out.withColumn("share", F.round("share", 6))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = overlap.overlaps(_table(spark, sf_dir, "train_df"), _table(spark, sf_dir, "test_df"), "row_id", "sequence")
    return out.select(F.col("train_id").alias("train_row_id"), F.col("test_id").alias("test_row_id"))


def p4_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.overlaps(_table(spark, sf_dir, "train_df"), _table(spark, sf_dir, "test_df"), "row_id", "sequence").withColumn("similarity", F.round("similarity", 6))


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _table(spark, sf_dir, "train_df"), _table(spark, sf_dir, "test_df")
    out = overlap.report(overlap.overlaps(train, test, "row_id", "sequence"), train, test, "row_id", "dataset", "split")
    return out.withColumnRenamed("source", "dataset").withColumn("mean_covered", F.round("mean_covered", 6))


def p4_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_report(spark, sf_dir).select("split", "dataset", "pairs", "test_rows")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = near.near_pairs(_table(spark, sf_dir, "train_df"), "row_id", "sequence")
    return pairs.select(F.col("a").alias("row_id_a"), F.col("b").alias("row_id_b"))


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near.near_groups(_table(spark, sf_dir, "train_df"), "row_id", "sequence")
    return out.select(F.col("id").alias("row_id"), "class_id", "group_id", "links")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode(_table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def p6_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count(_table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def _fill_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "size_limits").filter("purpose = 'fill'").select("limit_id", F.col("max_tokens").alias("capacity"))


def _filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = keep(tokens.count(_table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("tokens", "size"), "sizes")
    return containers.fill(sizes, _fill_limits(spark, sf_dir))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filled(spark, sf_dir).withColumnRenamed("id", "doc_id")


def p7_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containers.usage(_filled(spark, sf_dir), _fill_limits(spark, sf_dir)).withColumn("unused_share", F.round("unused_share", 6))


def p7_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold for every capacity: each document placed whole and once, none divided that fits, no container overfull."""
    sizes = keep(tokens.count(_table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("tokens", "size"), "sizes")
    limits = _fill_limits(spark, sf_dir)
    placed = keep(containers.fill(sizes, limits), "placed").join(F.broadcast(limits), "limit_id")
    full = placed.groupBy("limit_id", "container").agg(F.sum("length").alias("used"), F.first("capacity").alias("capacity"))
    full = full.groupBy("limit_id").agg(F.count_if(F.col("used") > F.col("capacity")).alias("overfull"))
    each = placed.groupBy("limit_id", "id").agg(F.sum("length").alias("placed"), F.count(F.lit(1)).alias("parts"), F.first("capacity").alias("capacity")).join(sizes, "id")
    sound = each.groupBy("limit_id").agg(
        F.count(F.lit(1)).alias("documents"),
        F.count_if(F.coalesce("placed", F.lit(0)) != F.coalesce("size", F.lit(0))).alias("not_whole"),
        F.count_if((F.col("parts") > 1) & (F.col("size") <= F.col("capacity"))).alias("divided_though_fitting"),
    )
    return sound.join(full, "limit_id").select("limit_id", "documents", "not_whole", "divided_though_fitting", "overfull")


def p8_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold for every limit: no piece over it, none beginning later than the overlap asks for, all tokens of longer texts covered."""
    limits = _table(spark, sf_dir, "size_limits").filter("purpose = 'cut'")
    documents = _table(spark, sf_dir, "documents")
    sizes = tokens.count(documents, "doc_id", "text").withColumnRenamed("tokens", "size")
    asked = F.broadcast(limits.select("limit_id", "max_tokens", F.coalesce("overlap_tokens", F.lit(0)).alias("overlap")))
    by_text = Window.partitionBy("limit_id", "id").orderBy("piece")
    before = F.lag(F.col("start") + F.col("tokens")).over(by_text)
    each = pieces.split(documents, "doc_id", "text", limits).drop("text").withColumn("before", before).join(asked, "limit_id")
    wrong = each.groupBy("limit_id", "id").agg(
        F.count_if(F.col("tokens") > F.col("max_tokens")).alias("over"),
        F.count_if((F.col("start") > F.col("before") - F.col("overlap")) | (F.col("before").isNull() & (F.col("start") > 0))).alias("late"),
        F.max(F.col("start") + F.col("tokens")).alias("upto"),
    )
    longer = sizes.join(asked).filter(F.col("size") > F.col("max_tokens"))
    all_ = longer.join(wrong, ["limit_id", "id"], "full")
    sums = all_.groupBy("limit_id").agg(F.sum("over").alias("over"), F.sum("late").alias("late"), F.count_if(~F.col("upto").eqNullSafe(F.col("size"))).alias("not_covered"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("over", "late", "not_covered")]
    return limits.select("limit_id").join(sums, "limit_id", "left").select("limit_id", *zero)


def p8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = _table(spark, sf_dir, "size_limits").filter("purpose = 'cut'")
    return pieces.split(_table(spark, sf_dir, "documents"), "doc_id", "text", limits).withColumnRenamed("id", "doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_clusters, p2_found, p2_counts, p3_found, p3_shares, p4_found, p4_coverage, p4_report, p4_counts, p5_found, p5_groups, p6_ids, p6_counts, p7_containers, p7_usage, p7_checks, p8_pieces, p8_checks)}
