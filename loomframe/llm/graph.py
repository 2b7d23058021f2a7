"""Connected components of a link table by contraction; the links are never gathered in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Rounds after which something must be wrong: node ids are hashes, so each round leaves a part of the nodes.
MAX_ROUNDS = 100


def components(links: DataFrame) -> DataFrame:
    """(node, label) of each node of ``links`` (a long, b long); the label is a node of its component.

    Each round points every node at its least neighbour or itself, and puts the links between what is pointed at;
    it ends when no link is left. A node with very many links is only ever seen by sums with map-side
    combining, and by joins that adaptive execution can split.
    """
    left = cut(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    labels = None
    for _ in range(MAX_ROUNDS):
        if left.isEmpty():
            break
        ends = left.union(left.select("b", "a")).toDF("node", "other")
        parents = cut(ends.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("to")), "parents")
        one, two = parents.toDF("a", "a_to"), parents.toDF("b", "b_to")
        moved = left.join(one, "a").join(two, "b").filter("a_to <> b_to")
        left = cut(moved.select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct(), "links")
        if labels is None:
            labels = parents.toDF("node", "label")
        else:
            step = parents.toDF("label", "to")
            labels = cut(labels.join(step, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
    else:
        raise RuntimeError("components did not settle")
    return labels if labels is not None else left.toDF("node", "label")
