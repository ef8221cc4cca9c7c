"""Exact joins by cosine within groups, without a join on the group alone.

A group of no more residents than a block holds is one block, which each visitor meets once. A larger one has a few pivots. A vector of the one side lives in the cell of its nearest pivot; one of the other side visits the
cells that can hold a partner: the angle is a metric, so a cell with the largest angle r to its pivot can only hold one if the
visitor's angle to that pivot is at most r plus the angle of the threshold. Large cells are cut into blocks of a stated size. The
task of a block reads its residents as one matrix and streams the visitors past it, so no pair is a row of a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from ..sources.shared import written

#: Pivots of a group and residents of a block, about.
PIVOTS, BLOCK = 16, 1024
#: Groups whose pivots are broadcast; their number is counted.
BROADCAST_GROUPS = 256
#: Angles are rounded: a visitor is let in this much beyond the bound.
SLACK = 1e-6
#: Scores of a matrix product worked on at a time.
SCORES = 1 << 20

#: (residents, resident vectors, visitors, visitor vectors, scores) -> result rows
Found = Callable[[pa.StructArray, pa.StructArray, np.ndarray], pa.RecordBatch]


def matrix(column: pa.Array) -> np.ndarray:
    """A list column without nulls, all lists equally long, as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def with_angles(side: DataFrame, pivots: DataFrame, n_groups: int) -> DataFrame:
    """``side`` (grp, row, v) with the angles of its unit vectors to the pivots of the group."""
    hinted = F.broadcast(pivots) if n_groups <= BROADCAST_GROUPS else pivots.hint("merge")

    def angles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for v, p in zip(batch.column("v"), batch.column("pivots"), strict=True):
                rows.append(np.arccos(np.clip(matrix(p.values) @ v.values.to_numpy(), -1, 1)))
            yield pa.record_batch([*(batch.column(c) for c in ("grp", "row", "v")), pa.array(rows, pa.list_(pa.float64()))], ["grp", "row", "v", "angles"])

    schema = StructType([side.schema[c] for c in ("grp", "row", "v")]).add("angles", ArrayType(DoubleType()))
    return side.join(hinted, "grp").select("grp", "row", "v", "pivots").mapInArrow(angles, schema)


def blocks_of(left: DataFrame, right: DataFrame, min_sim: float, pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """Residents (role 0, row in a) and visitors (role 1, row in b) of blocks: grp, cell, block, role, a, b, v. Both sides are (grp, row, v) with unit
    vectors of one width a group; ``row`` is a struct with a field ``key``, unique in its group.

    Results don't depend on the pivots, which are vectors of the left side chosen by a hash; the work does. ``left`` is read several
    times."""
    large = written(left.groupBy("grp").count().where(F.col("count") > block).select("grp"), "large")
    n_large = large.count()
    if not n_large:
        return one_block(left, right)
    marks = F.broadcast(large) if n_large <= BROADCAST_GROUPS else large.hint("merge")
    of = lambda side, how: side.join(marks, "grp", how).select("grp", "row", "v")
    small = one_block(of(left, "left_anti"), of(right, "left_anti"))
    left, right = of(left, "left_semi"), of(right, "left_semi")
    chosen = written(pivots_of(left, pivots), "pivots")
    n_groups = chosen.count()
    residents = written(with_angles(left, chosen, n_groups).withColumn("cell", F.expr("cast(array_position(angles, array_min(angles)) as int)")), "residents")
    cells = residents.groupBy("grp", "cell").agg(F.max(F.array_min("angles")).alias("reach"), F.count("*").alias("n"))
    cells = cells.select("grp", F.struct("cell", "reach", F.ceil(F.col("n") / block).cast("int").alias("blocks")).alias("c"))
    table = written(cells.groupBy("grp").agg(F.collect_list("c").alias("cells")), "cells")  # a row per group, as many cells as pivots at most
    hint = F.broadcast if n_groups <= BROADCAST_GROUPS else (lambda df: df.hint("merge"))
    reach = math.acos(max(-1.0, min(1.0, min_sim))) + SLACK
    own = residents.join(hint(table), "grp").withColumn("c", F.element_at(F.filter("cells", lambda c: c["cell"] == F.col("cell")), 1))
    own = own.select("grp", "cell", F.pmod(F.xxhash64("row.key"), F.col("c.blocks")).cast("int").alias("block"), F.lit(0).alias("role"), F.col("row").alias("a"), none_of(right).alias("b"), "v")
    seen = with_angles(right, chosen, n_groups).join(hint(table), "grp")
    near = F.filter("cells", lambda c: F.get("angles", c["cell"] - 1) <= c["reach"] + reach)
    into = F.flatten(F.transform(near, lambda c: F.transform(F.sequence(F.lit(0), c["blocks"] - 1), lambda b: F.struct(c["cell"].alias("cell"), b.alias("block")))))
    visits = seen.select("grp", F.explode(into).alias("to"), "row", "v").select("grp", "to.cell", "to.block", F.lit(1).alias("role"), none_of(left).alias("a"), F.col("row").alias("b"), "v")
    return small.unionByName(own).unionByName(visits)


def none_of(side: DataFrame) -> Column:
    return F.lit(None).cast(side.schema["row"].dataType)


def one_block(left: DataFrame, right: DataFrame) -> DataFrame:
    """Each group as one block."""
    place = ["grp", F.lit(1).alias("cell"), F.lit(0).alias("block")]
    own = left.select(*place, F.lit(0).alias("role"), F.col("row").alias("a"), none_of(right).alias("b"), "v")
    return own.unionByName(right.select(*place, F.lit(1).alias("role"), none_of(left).alias("a"), F.col("row").alias("b"), "v"))


def pivots_of(left: DataFrame, pivots: int) -> DataFrame:
    """(grp, pivots): up to ``pivots`` vectors of each group, those with the least hash of each of twice as many parts."""
    salted = left.select("grp", F.pmod(F.xxhash64("row.key"), F.lit(2 * pivots)).alias("salt"), F.xxhash64("row.key", F.lit(7)).alias("rank"), "v")
    parts = salted.groupBy("grp", "salt").agg(F.min_by(F.struct("rank", "v"), "rank").alias("least"))
    return parts.groupBy("grp").agg(F.slice(F.array_sort(F.collect_list("least")), 1, pivots).alias("some")).select("grp", F.col("some.v").alias("pivots"))


def matched(blocks: DataFrame, found: Found, schema: str | StructType) -> DataFrame:
    """Each block's residents as one matrix, its visitors streamed past them: ``found`` gets some residents' rows, some visitors' rows
    and their scores (visitors x residents), and makes rows of them."""
    tasks = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # the work goes with pairs, so few bytes are no reason for few tasks
    ordered = blocks.repartition(tasks, "grp", "cell", "block").sortWithinPartitions("grp", "cell", "block", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, vectors = None, [], []
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("grp", "cell", "block", "role")), strict=True))
            start = 0
            for i in range(1, len(keys) + 1):
                if i < len(keys) and keys[i] == keys[start]:
                    continue
                part = batch.slice(start, i - start)
                *key, role = keys[start]
                if key != now:
                    now, rows, vectors = key, [], []
                if role == 0:
                    rows.append(part.column("a"))
                    vectors.append(matrix(part.column("v")))
                elif rows:
                    if len(rows) > 1:
                        rows, vectors = [pa.concat_arrays(rows)], [np.concatenate(vectors)]
                    step = max(1, SCORES // len(vectors[0]))
                    for a in range(0, part.num_rows, step):
                        some = part.slice(a, step)
                        yield found(rows[0], some.column("b"), matrix(some.column("v")) @ vectors[0].T)
                start = i

    return ordered.mapInArrow(run, schema)


def similar_pairs(left: DataFrame, right: DataFrame, min_sim: float, pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """(a, b, similarity): all pairs of a row of ``left`` and a row of ``right`` of one group with a cosine of ``min_sim`` or more,
    which must be above 0. Exact; sides as in `blocks_of`."""
    schema = StructType().add("a", left.schema["row"].dataType).add("b", right.schema["row"].dataType).add("similarity", "double")

    def found(residents: pa.StructArray, visitors: pa.StructArray, scores: np.ndarray) -> pa.RecordBatch:
        i, j = np.nonzero(scores >= min_sim)
        return pa.record_batch([residents.take(pa.array(j)), visitors.take(pa.array(i)), pa.array(scores[i, j])], ["a", "b", "similarity"])

    return matched(blocks_of(left, right, min_sim, pivots, block), found, schema)


def nearest(queries: DataFrame, identities: DataFrame, min_sim: float, pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """(key, object_id, similarity): the identity of each query with the best cosine, of ``min_sim`` or more, which must be above 0; the
    least ``insert_order`` on ties. Identities' rows are (key, object_id, insert_order), queries' (key, exclude: ids left out).

    A block sends one row a query, its best."""

    def found(residents: pa.StructArray, visitors: pa.StructArray, scores: np.ndarray) -> pa.RecordBatch:
        ids, order = (residents.field(c).to_numpy(zero_copy_only=False) for c in ("object_id", "insert_order"))
        for i, out in enumerate(visitors.field("exclude").to_pylist()):
            if out:
                scores[i, np.isin(ids, out)] = -2.0
        first = np.argsort(order, kind="stable")
        best = first[np.argmax(scores[:, first], axis=1)]
        top = scores[np.arange(len(best)), best]
        good = np.flatnonzero(top >= min_sim)
        return pa.record_batch([visitors.field("key").take(pa.array(good)), pa.array(ids[best[good]]), pa.array(order[best[good]]), pa.array(top[good])], ["key", "object_id", "insert_order", "similarity"])

    key, order = queries.schema["row"].dataType["key"].dataType, identities.schema["row"].dataType["insert_order"].dataType
    schema = StructType().add("key", key).add("object_id", "long").add("insert_order", order).add("similarity", "double")
    bests = matched(blocks_of(identities, queries, min_sim, pivots, block), found, schema)
    one = bests.groupBy("key").agg(F.max_by(F.struct("object_id", "similarity"), F.struct("similarity", -F.col("insert_order"))).alias("b"))
    return one.select("key", "b.object_id", "b.similarity")
