"""Connected components of a link table, by label contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def components(links: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``links`` (``a, b``, not null): the label is the smallest node of its component.

    Each round sends every node to its smallest neighbour (or itself), follows those pointers to their roots, replaces
    the ends of all links by their roots and drops links inside a root. Each component that is not done at least halves
    its nodes in a round, so the rounds are logarithmic in the largest component. Every step is an aggregate with a
    map-side part or an equi-join that adaptive execution can split; each round is cut off by written tables. Only row
    counts reach the driver.
    """
    links = written(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    while not links.isEmpty():
        both = links.union(links.select("b", "a"))
        parents = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("label")))
        while True:
            up = parents.select(F.col("node").alias("label"), F.col("label").alias("root"))
            jumped = written(parents.join(up, "label").select("node", F.col("root").alias("label"), (F.col("root") != F.col("label")).alias("moved")))
            parents = jumped.select("node", "label")
            if jumped.where("moved").isEmpty():
                break
        if labels is None:
            labels = parents
        else:
            up = parents.select(F.col("node").alias("label"), F.col("label").alias("root"))
            labels = written(labels.join(up, "label", "left").select("node", F.coalesce("root", "label").alias("label")))
        ends = links.join(parents.select(F.col("node").alias("a"), F.col("label").alias("u")), "a")
        ends = ends.join(parents.select(F.col("node").alias("b"), F.col("label").alias("v")), "b").where("u <> v")
        links = written(ends.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct())
    return labels if labels is not None else links.select(F.col("a").alias("node"), F.col("b").alias("label"))
