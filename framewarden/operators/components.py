"""Connected components of large graphs, by alternating stars."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written

#: Nodes that a task holds while it joins the edges that it reads.
HELD = 1 << 20


def contracted(edges: DataFrame) -> DataFrame:
    """(grp, u, v) with u > v: the edges of each task replaced by one from each node to the least node that it reaches within the
    task. Of more than HELD nodes the task gives out what it has and starts again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict[tuple, tuple] = {}

        def find(x: tuple) -> tuple:
            top = x
            while root[top] != top:
                top = root[top]
            while root[x] != top:
                root[x], x = top, root[x]
            return top

        def out() -> pa.RecordBatch:
            rows = [(*x, top[1]) for x in root if (top := find(x)) != x]
            grp, u, v = zip(*rows, strict=True) if rows else ((), (), ())
            root.clear()
            return pa.record_batch([pa.array(grp, pa.string()), pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["grp", "u", "v"])

        for batch in batches:
            for grp, u, v in zip(*(batch.column(c).to_pylist() for c in ("grp", "u", "v")), strict=True):
                a, b = (grp, u), (grp, v)
                root.setdefault(a, a)
                root.setdefault(b, b)
                a, b = find(a), find(b)
                if a != b:
                    root[max(a, b)] = min(a, b)
            if len(root) > HELD:
                yield out()
        yield out()

    return edges.mapInArrow(run, "grp string, u long, v long")


def large_star(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours joined to the least node around it."""
    both = edges.unionByName(edges.select("grp", F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("grp", "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least.hint("merge"), ["grp", "u"]).select("grp", F.col("v").alias("u"), F.col("m").alias("v"))


def small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours joined to the least of these."""
    least = edges.groupBy("grp", "u").agg(F.min("v").alias("m"))
    others = edges.join(least.hint("merge"), ["grp", "u"]).where("v > m").select("grp", F.col("v").alias("u"), F.col("m").alias("v"))
    return others.unionByName(least.select("grp", "u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(grp, node, component) of every node that has an edge (grp, u, v): the component is its least node.

    Each round is written; they end when every node hangs on a node that hangs on none. Only counts come to the driver."""
    now = written(contracted(edges).distinct(), "star")
    while True:
        roots = now.select("grp", F.col("u").alias("v")).distinct()
        deep = now.join(roots.hint("merge"), ["grp", "v"], "left_semi").limit(1).count()
        split = 0 if deep else now.groupBy("grp", "u").count().where("count > 1").limit(1).count()
        if not deep and not split:
            break
        now = written(small_star(written(large_star(now), "star")), "star")
    tops = now.select("grp", F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select("grp", F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops)
