"""Connected components of a table of links, by union-find inside tasks and star contraction between them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillwork.llm.common import attach, dropped, stored

EDGE = "a bigint, b bigint"


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each batch become a star for each of its components: (smallest member, member)."""
    for batch in batches:
        parent: dict[int, int] = {}

        def root(x: int, parent=parent) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent.setdefault(up, up)
            return x

        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        rows = [(root(x), x) for x in parent]
        rows = np.array([r for r in rows if r[0] != r[1]], np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1])], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """From links (a, b) of longs: one row (node, root) for each linked node; root is the smallest node it reaches.

    Each round links every larger neighbour of a node to the node's smallest neighbour, then does so for smaller ones, until the links
    are stars: every node with a smaller neighbour has that one alone. The number of rounds grows with the logarithm of the longest
    path. A node with many links is met in parts.
    """
    now = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").mapInArrow(_forest, EDGE).distinct(), "links")
    while True:
        both = now.union(now.select("b", "a"))
        least = stored(both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("_n")).select("a", F.least("a", "m").alias("m"), "_n"), "least")
        if least.filter("m < a and _n > 1").isEmpty():
            dropped(least)
            return now.select(F.col("b").alias("node"), F.col("a").alias("root")).union(now.select("a", "a").distinct())
        total = now.count()
        large = stored(attach(both, least, "a", "_n", 2 * total, "inner").filter("b > a").select(F.col("m").alias("a"), "b").filter("a < b").distinct(), "large")
        low = stored(large.groupBy("b").agg(F.min("a").alias("m"), F.count("*").alias("_n")), "low")
        met = attach(large, low, "b", "_n", total, "inner")
        new = stored(met.select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).filter("a < b").mapInArrow(_forest, EDGE).distinct(), "links")
        dropped(now, large, least, low)
        now = new
