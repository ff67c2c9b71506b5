"""Connected components of edge tables, by least label with shortcuts; each round is a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import remove, table


def components(edges: DataFrame, folder: str) -> DataFrame:
    """node and label, the least node that edges (a, b) reach from it, for nodes that have an edge."""
    both = table(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), f"{folder}/edges")
    labels = table(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("label")), f"{folder}/labels-0")
    number, before = 0, None
    while True:
        state = labels.agg(F.count("*"), F.sum(F.col("label").cast("decimal(38,0)"))).first()
        if state == before:
            return labels
        before, number = state, number + 1
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        near = table(labels.join(near, "node").select("node", F.least("label", "near").alias("label")), f"{folder}/near-{number}")
        jump = near.alias("x").join(near.select(F.col("node").alias("at"), F.col("label").alias("far")), F.col("x.label") == F.col("at"), "left")
        new = table(jump.select("node", F.least("label", F.coalesce("far", "label")).alias("label")), f"{folder}/labels-{number}")
        for old in (f"{folder}/labels-{number - 1}", f"{folder}/near-{number}"):
            remove(old)
        labels = new


class Forest:
    """Union-find in one task."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        return x != y
