"""Connected components of a graph of links, by contraction: nothing is collected, no node needs all its links at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gearsight.llm.common import attach, stage


def components(links: DataFrame) -> DataFrame:
    """Rows (node, label) for every node of ``links`` (a, b: binary); the label is the same within a component.

    Each round hooks every node onto its smallest neighbour or itself and keeps the links between different parents;
    the parents of all rounds are then followed in order. A node with very many links is spread by ``attach``.
    """
    links = stage(links.select("a", "b").filter(F.col("a") != F.col("b")).distinct(), "links")
    left, rounds = links.count(), []
    while left:
        ends = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = stage(ends.groupBy(F.col("a").alias("node")).agg(
            F.least(F.min("b"), F.col("node")).alias("parent"), F.count(F.lit(1)).alias("n")), "parents")
        rounds.append(parents)
        for end in ("a", "b"):
            other = "b" if end == "a" else "a"
            links = attach(links.withColumnRenamed(end, "node"), parents, "node", "n", left,
                           F.unhex(F.hex(F.xxhash64(other)))).select(F.col("parent").alias(end), other)
        links = stage(links.filter("a != b").distinct(), "links")
        left = links.count()
    if not rounds:
        return links.select(F.col("a").alias("node"), F.col("b").alias("label"))
    out = rounds[0].select("node", F.col("parent").alias("label"))
    for parents in rounds[1:]:
        out = out.join(parents.select(F.col("node").alias("label"), "parent"), "label", "left").select(
            "node", F.coalesce("parent", "label").alias("label"))
    return out
