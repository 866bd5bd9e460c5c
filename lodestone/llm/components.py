"""Connected components over an edge table, without collecting links or labels anywhere."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts_for, stored

#: Links that one task brings down to a forest.
TOGETHER = 1 << 20


def stars(links: DataFrame) -> DataFrame:
    """As many of ``links(a, b)`` as each task's own nodes need: every node with the smallest one that the task connects it to."""

    def reduce_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def root(x: int) -> int:
            top = x
            while (above := up.setdefault(top, top)) != top:
                top = above
            while up[x] != top:
                up[x], x = top, up[x]
            return top

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x, y = root(a), root(b)
                if x != y:
                    up[max(x, y)] = min(x, y)
        nodes = [x for x in up if root(x) != x]
        yield pa.RecordBatch.from_arrays([pa.array(np.array(nodes, dtype=np.int64)), pa.array(np.array([up[x] for x in nodes], dtype=np.int64))], names=["a", "b"])

    return links.select("a", "b").coalesce(parts_for(links.count(), TOGETHER)).mapInArrow(reduce_links, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node reachable) for every node of ``links(a, b)``.

    Each task first brings its links down to stars. Labels then spread to neighbours and jump to their label's label, until
    a whole round changes nothing; each round is written to the shared folder. However dense the links are, what moves is at
    most one row for each node and task.
    """
    few = stored(stars(links))
    both = stored(few.union(few.select("b", "a")).filter("a <> b").distinct())
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("component")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("near"))
        spread = labels.join(near, labels["node"] == near["a"]).select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        onward = spread.select(F.col("node").alias("at"), F.col("component").alias("onward"))
        labels = stored(spread.join(onward, spread["component"] == onward["at"], "left").select("node", "old", F.coalesce("onward", "component").alias("component")))
        if labels.filter("old <> component").isEmpty():
            return labels.select("node", "component")
