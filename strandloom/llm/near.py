"""Near-duplicate records with small edits: pairs and groups above a similarity.

Candidates come from the generalised pigeonhole principle (thresholds), are probed by seed (simjoin) and
verified on whole texts. Records with null ids or texts, or with too few terms, are in no pair and no group.
Columns beside the two named ones are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm import simjoin as J
from strandloom.llm.linkage import components
from strandloom.llm.thresholds import weigher
from strandloom.plans.shared import keep

#: Similarity of at least a half: all such pairs share 17 letters (sure_stretch), 16 if all their breaks are long unread stretches.
RULE = J.Rule(0.5)


@dataclass(frozen=True)
class Found:
    """table: rows() of the collection; groups: its classes(); links: (a, b, common, either) of similar classes."""

    table: DataFrame
    groups: DataFrame
    links: DataFrame


def find(df: DataFrame, id_col: str, text_col: str, rule: J.Rule = RULE) -> Found:
    table = J.rows(df, id_col, text_col, rule)
    groups = J.classes(table)
    return Found(table, groups, J.links(groups, rule, weigher(rule)))


def near_pairs(df: DataFrame, id_col: str, text_col: str, rule: J.Rule = RULE) -> DataFrame:
    """(a, b, common, either), a < b: every pair of rows whose similarity common / either reaches the threshold.

    Pairs of equal rows are there too: k copies are k * (k - 1) / 2 pairs. Use near_groups() where a text may
    be repeated very often.
    """
    found = find(df, id_col, text_col, rule)
    copies = J.copies_of(found.table, found.groups)
    copies = keep(copies, "copies")
    x, y = copies.select("rep", F.col("id").alias("a")), copies.select("rep", F.col("id").alias("b"))
    same = x.join(y, "rep").filter("a < b").select("a", "b", F.lit(1).alias("common"), F.lit(1).alias("either"))
    pairs = J.every_row(found.links, copies)
    turned = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "common", "either")
    return turned.unionByName(same)


def near_groups(df: DataFrame, id_col: str, text_col: str, rule: J.Rule = RULE) -> DataFrame:
    """(id, class_id, group_id, links): one row for each compared row.

    class_id is the least id with the same letters, links its number of similar classes, and group_id the least id
    that a chain of similar rows leads to. Copies are never expanded into pairs.
    """
    found = find(df, id_col, text_col, rule)
    links = keep(found.links, "links")
    ends = links.select(F.col("a").alias("id")).unionAll(links.select(F.col("b").alias("id"))).groupBy("id").agg(F.count(F.lit(1)).alias("links"))
    group = components(links.select("a", "b", (F.col("common") / F.col("either")).alias("similarity")))
    classes = found.groups.select("id", "letters").join(group, "id", "left").join(ends, "id", "left")
    classes = classes.select("letters", F.col("id").alias("class_id"), F.coalesce("cluster", "id").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
    return found.table.join(classes, "letters").select("id", "class_id", "group_id", "links")
