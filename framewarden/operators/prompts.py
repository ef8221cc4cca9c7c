"""Prompts, class catalogs and prompt ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import prompt_segments, strip
from .places import with_place

#: Terms of one prompt, at most.
MOST_TERMS = 10_000


def prompt_ids(prompts: DataFrame) -> DataFrame:
    """(prompt_id, term, term_id): the place, from 1, of the first segment with that text; repeats count as places."""
    seg = prompts.select("prompt_id", F.posexplode(prompt_segments(F.col("prompt"))).alias("pos", "seg"))
    return seg.groupBy("prompt_id", F.lower("seg").alias("term")).agg((F.min("pos") + 1).alias("term_id"))


def resolve_prompt_id(instances: DataFrame, lookup: DataFrame) -> DataFrame:
    """prompt_ref of each instance: the exact term, else the first term where one contains the other, else new ids. A blank or null
    label has none.

    ``lookup`` is (term, term_id) of one prompt, MOST_TERMS rows at most, and becomes a literal. New ids count on from the largest, per
    frame, by first appearance."""
    label = F.lower(strip(F.col("label")))
    told = F.coalesce(label != "", F.lit(False))
    terms = sorted((r.term_id, r.term) for r in lookup.select("term_id", "term").limit(MOST_TERMS + 1).collect())
    if len(terms) > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} terms: not the lookup of one prompt")
    top = max((i for i, _ in terms), default=0)
    known = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(t).alias("term")) for i, t in terms]) if terms else F.array().cast("array<struct<id:int,term:string>>")
    exact = F.filter(known, lambda t: t["term"] == label)
    near = F.filter(known, lambda t: t["term"].contains(label) | label.contains(t["term"]))
    joined = instances.withColumn("found", F.when(told, F.coalesce(F.get(exact, F.lit(0))["id"], F.get(near, F.lit(0))["id"]))).withColumn("_new", told & F.col("found").isNull())
    per_label = Window.partitionBy("run_id", "frame_idx", label)
    first = F.when(F.col("_new"), F.min("inst_idx").over(per_label))
    new = F.when(F.col("_new"), F.lit(top) + F.dense_rank().over(Window.partitionBy("run_id", "frame_idx", "_new").orderBy("_first")))
    return joined.withColumn("_first", first).withColumn("prompt_ref", F.coalesce("found", new).cast("int")).drop("_first", "found", "_new")


def filter_classes(classes: DataFrame, query: str) -> DataFrame:
    """Classes whose name contains the query, or whose id it is; an empty query keeps all."""
    q = query.strip().lower()
    return classes.where(F.lower("name").contains(q) | (F.col("class_id").cast("string") == q)) if q else classes


def catalogs_in_sync(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row (in_sync): do both catalogs have the same names in the order of ids?"""
    number = lambda df, name: with_place(df, [F.col("class_id")], "n").select("n", F.col("name").alias(name))
    odd = number(a, "na").join(number(b, "nb").hint("merge"), "n", "full").where(~F.col("na").eqNullSafe(F.col("nb")))
    return odd.agg((F.count("*") == 0).alias("in_sync"))
