"""Tracklets, their links over gaps, and the remapping of ids."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import Box, as_struct, box, center, crop_ok, crop_rect, diag
from ..functions.vectors import dot, l2_normalize
from ..sources.shared import written
from .components import components
from .similarity import nearest, similar_pairs

ID = ["run_id", "object_id"]


def build_tracklets(instances: DataFrame) -> DataFrame:
    """One row per identity > 0: first and last frame and box, number of rows. One aggregation."""
    at = F.struct("frame_idx", "inst_idx")
    return instances.where("object_id > 0").groupBy(*ID).agg(
        F.min("frame_idx").alias("start_frame"), F.max("frame_idx").alias("end_frame"), F.count("*").alias("n_frames"),
        F.min_by(as_struct(box()), at).alias("first_box"), F.max_by(as_struct(box()), at).alias("last_box"), F.min_by("inst_idx", at).alias("first_inst_idx"),
    )


def mean_embedding(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, embedding): the mean of the rows' vectors at length 1, at length 1 again; invalid vectors are left out.

    The mean is taken by position, so no task holds the vectors of a key."""
    unit = rows.select(*keys, l2_normalize(F.col("embedding")).alias("v")).where("v is not null")
    parts = unit.select(*keys, F.posexplode("v").alias("pos", "x")).groupBy(*keys, "pos").agg(F.avg("x").alias("x"))
    whole = parts.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("m"))
    return whole.select(*keys, l2_normalize(F.col("m")).alias("embedding"))


def sample_tracklets(instances: DataFrame, k: int = 8) -> DataFrame:
    """k evenly spaced rows of each tracklet: all if it has no more, the middle one if k is 1."""
    order = Window.partitionBy(*ID).orderBy("frame_idx", "inst_idx")
    rows = instances.where("object_id > 0").withColumn("i", F.row_number().over(order) - 1).withColumn("n", F.count("*").over(Window.partitionBy(*ID)))
    places = F.array(F.floor(F.col("n") / 2)) if k == 1 else F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.bround(j * (F.col("n") - 1) / (k - 1)).cast("long"))
    return rows.where((F.col("n") <= k) | F.array_contains(places, F.col("i").cast("long"))).select("run_id", "object_id", "frame_idx", "inst_idx")


def _bin_pairs(tracklets: DataFrame, max_gap: int) -> DataFrame:
    """Pairs of tracklets a and b of a run with b starting after a ends, their ``gap``, their vectors at length 1.

    With a largest gap the time is cut into bins one frame longer: what can follow a tracklet starts in the bin of its end or
    in the next, so the join is one on run and bin. Without one (0) it is on the run."""
    cols = ["object_id", "start_frame", "end_frame", "first_box", "last_box"]
    unit = F.when(F.col("embedding").isNotNull(), F.coalesce(l2_normalize(F.col("embedding")), F.transform("embedding", lambda x: F.lit(0.0))))
    bin_of = lambda frame: F.floor(frame / (max_gap + 1))
    ends, starts = F.array(F.lit(0)), F.array(F.lit(0))
    if max_gap > 0:
        before = F.col("start_frame") - 1
        ends, starts = F.array(bin_of(F.col("end_frame"))), F.array_distinct(F.array(bin_of(before - max_gap), bin_of(before)))
    a = tracklets.select("run_id", F.explode(ends).alias("bin"), unit.alias("a_embedding"), *[F.col(c).alias(f"a_{c}") for c in cols]).hint("merge")
    b = tracklets.select("run_id", F.explode(starts).alias("bin"), unit.alias("b_embedding"), *[F.col(c).alias(f"b_{c}") for c in cols])
    pairs = a.join(b, ["run_id", "bin"]).where("a_object_id <> b_object_id and a_end_frame < b_start_frame").withColumn("gap", F.col("b_start_frame") - F.col("a_end_frame") - 1)
    return pairs.where(F.col("gap") <= max_gap) if max_gap > 0 else pairs


def _alike_pairs(tracklets: DataFrame, min_sim: float) -> DataFrame:
    """Pairs of tracklets with a cosine of ``min_sim`` (above 0) or more, whatever their gap: by `similar_pairs`, exact, without a join
    on the run alone. Vectors of different widths don't meet, those of length 0 are like nothing."""
    row = F.struct(F.col("object_id").alias("key"), "start_frame", "end_frame", "first_box", "last_box").alias("row")
    unit = tracklets.withColumn("v", l2_normalize(F.col("embedding").cast("array<double>"))).where("v is not null")
    side = written(unit.select(F.struct("run_id", F.size("v").alias("width")).alias("grp"), row, "v"), "vectors")
    with_run = side.withColumn("row", F.col("row").withField("run_id", F.col("grp.run_id")))
    pairs = similar_pairs(with_run, side, min_sim).where("a.key <> b.key and a.end_frame < b.start_frame")
    columns = [F.col(f"{n}.{'key' if c == 'object_id' else c}").alias(f"{n}_{c}") for n in "ab" for c in ("object_id", "start_frame", "end_frame", "first_box", "last_box")]
    return pairs.select(F.col("a.run_id").alias("run_id"), *columns, (F.col("b.start_frame") - F.col("a.end_frame") - 1).alias("gap"), "similarity")


def link_candidates(tracklets: DataFrame, max_gap: int = 300, min_sim: float = 0.60, spatial_weight: float = 0.15, gap_weight: float = 0.10, require_embedding: bool = True) -> DataFrame:
    """Pairs (run_id, id_a ends before id_b starts) worth merging: gap, similarity, score.

    With a largest gap the pairs are those of bins of time (`_bin_pairs`); without one (0) those with like vectors
    (`_alike_pairs`), and where a vector may lack, those a few frames apart. A threshold of 0 or less leaves nothing out: then
    all pairs of a run are formed. Vectors are brought to length 1 once, before the join."""
    both = F.col("a_embedding").isNotNull() & F.col("b_embedding").isNotNull()
    close = 5 if max_gap <= 0 else max(5, max_gap // 20)
    if max_gap <= 0 < min_sim:
        pairs = _alike_pairs(tracklets, min_sim)
        if not require_embedding:
            lacking = _bin_pairs(tracklets, close).where(~both).withColumn("similarity", F.lit(float(min_sim)))
            pairs = pairs.unionByName(lacking.select(pairs.columns))
    else:
        sim = F.when(both, dot(F.col("a_embedding"), F.col("b_embedding")))
        if not require_embedding:
            sim = F.when(both, sim).when(F.col("gap") <= close, F.lit(float(min_sim)))
        pairs = _bin_pairs(tracklets, max_gap).withColumn("similarity", sim).where(F.col("similarity") >= min_sim)
    last, first = (Box(*(F.col(f"{n}.{c}") for c in Box._fields)) for n in ("a_last_box", "b_first_box"))
    (ax, ay), (bx, by) = center(last), center(first)
    apart = F.hypot(ax - bx, ay - by) / F.greatest(F.lit(1.0), 0.5 * (diag(last) + diag(first)))
    score = F.col("similarity") - F.least(F.lit(1.0), apart) * spatial_weight
    if max_gap > 0:
        score = score - F.col("gap") / float(max(1, max_gap)) * gap_weight
    return pairs.select("run_id", F.col("a_object_id").alias("id_a"), F.col("b_object_id").alias("id_b"), "gap", "similarity", score.alias("score"),
                        F.col("a_start_frame").alias("start_a"), F.col("a_end_frame").alias("end_a"), F.col("b_start_frame").alias("start_b"), F.col("b_end_frame").alias("end_b"))


class Clusters:
    """Greedy merging of intervals: a merge is refused if any members of the two clusters overlap.

    A cluster is its intervals in order of time, which are apart; the smaller one is looked up in the larger one."""

    def __init__(self) -> None:
        self.of: dict[int, tuple[list, list, list]] = {}  # id -> starts, ends, ids of its cluster

    def add(self, oid: int, start: int, end: int) -> None:
        if oid not in self.of:
            self.of[oid] = ([start], [end], [oid])

    def merge(self, a: int, b: int) -> bool:
        one, two = self.of[a], self.of[b]
        if one is two:
            return False
        small, large = (one, two) if len(one[0]) <= len(two[0]) else (two, one)
        starts, ends, ids = large
        places = [bisect_right(starts, s) for s in small[0]]
        for place, s, e in zip(places, small[0], small[1], strict=True):
            if (place and ends[place - 1] >= s) or (place < len(starts) and starts[place] <= e):
                return False
        for place, s, e, oid in reversed(list(zip(places, *small, strict=True))):
            starts.insert(place, s)
            ends.insert(place, e)
            ids.insert(place, oid)
        for oid in small[2]:
            self.of[oid] = large
        return True

    def final(self, oid: int) -> int:
        """The least id of the cluster of an id."""
        return min(self.of[oid][2])

    def finals(self) -> dict[int, int]:
        """The least id of the cluster of each id."""
        least = {id(c): min(c[2]) for c in self.of.values()}
        return {oid: least[id(c)] for oid, c in self.of.items()}


def link_tracklets(tracklets: DataFrame, candidates: DataFrame) -> DataFrame:
    """(run_id, object_id, n_frames, final_id): candidates by falling score (ties by start frames, then ids), merged while the
    clusters stay apart in time; the final id is the least of the cluster.

    Merges never join two components of the graph of the candidates, so each component is merged by itself: tasks get
    components, not runs. The candidates are written once."""
    known = written(candidates.select("run_id", "id_a", "id_b", "score", "start_a", "end_a", "start_b", "end_b"), "candidates")
    parts = components(known.select(F.col("run_id").alias("grp"), F.col("id_a").alias("u"), F.col("id_b").alias("v")))
    named = parts.select(F.col("grp").alias("run_id"), F.col("node").alias("id_a"), "component")
    edges = known.join(named.hint("merge"), ["run_id", "id_a"]).repartition("run_id", "component")
    edges = edges.sortWithinPartitions("run_id", "component", F.desc("score"), "start_a", "start_b", "id_a", "id_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, clusters = None, Clusters()

        def out() -> pa.RecordBatch:
            finals = clusters.finals()
            return pa.record_batch([pa.array([now[0]] * len(finals), pa.string()), pa.array(list(finals), pa.int64()), pa.array(list(finals.values()), pa.int64())], ["run_id", "object_id", "final_id"])

        for batch in batches:
            for run_id, part, a, b, start_a, end_a, start_b, end_b in zip(*(batch.column(c).to_pylist() for c in ("run_id", "component", "id_a", "id_b", "start_a", "end_a", "start_b", "end_b")), strict=True):
                if (run_id, part) != now:
                    if now is not None:
                        yield out()
                    now, clusters = (run_id, part), Clusters()
                clusters.add(a, start_a, end_a)
                clusters.add(b, start_b, end_b)
                clusters.merge(a, b)
        if now is not None:
            yield out()

    found = edges.mapInArrow(run, "run_id string, object_id long, final_id long")
    return tracklets.select(*ID, "n_frames").join(found.hint("merge"), ID, "left").select(*ID, "n_frames", F.coalesce("final_id", "object_id").alias("final_id"))


def remap_ids(instances: DataFrame, id_map: DataFrame) -> DataFrame:
    """Instances with ``object_id`` replaced by the final id and ``changed`` telling where."""
    joined = instances.join(id_map.select(*ID, "final_id").hint("merge"), ID, "left")
    new = F.coalesce("final_id", "object_id")
    columns = [new.alias("object_id") if c == "object_id" else F.col(c) for c in instances.columns]
    return joined.select(*columns, (new != F.col("object_id")).alias("changed"))


def changed_ids(id_map: DataFrame) -> DataFrame:
    return id_map.where("final_id <> object_id")


def link_summary(id_map: DataFrame) -> DataFrame:
    """Per run: tracklets in, ids out, merges, remapped instances (the rows of the tracklets whose id changes)."""
    moved = F.sum(F.when(F.col("final_id") != F.col("object_id"), F.col("n_frames")).otherwise(0))
    ids = id_map.groupBy("run_id").agg(F.count("*").alias("tracklets_in"), F.countDistinct("final_id").alias("ids_out"), moved.alias("remapped_instances"))
    return ids.withColumn("merges", F.col("tracklets_in") - F.col("ids_out"))


def gallery_query(queries: DataFrame, gallery: DataFrame, exclude: DataFrame | None = None, min_sim: float = 0.65) -> DataFrame:
    """(query_id, object_id, similarity): the best identity by cosine, the first inserted on ties, of ``min_sim`` or more.

    ``gallery`` is (run_id, object_id, embedding, insert_order); ``exclude`` (query_id, object_id) leaves identities out.
    Queries visit blocks of identities (`nearest`); with a floor of 0 or less, where vectors of length 0 count too, every query
    meets every identity of its run."""
    if min_sim <= 0:
        return _gallery_scan(queries, gallery, exclude, min_sim)
    unit = lambda df: df.withColumn("v", l2_normalize(F.col("embedding").cast("array<double>"))).where("v is not null")
    grp = F.struct("run_id", F.size("v").alias("width")).alias("grp")
    out = F.array().cast("array<long>")
    asked = queries.withColumn("exclude", out)
    if exclude is not None:
        lists = exclude.groupBy("query_id").agg(F.collect_set(F.col("object_id").cast("long")).alias("exclude"))
        asked = queries.join(lists.hint("merge"), "query_id", "left").withColumn("exclude", F.coalesce("exclude", out))
    known = written(unit(gallery).select(grp, F.struct(F.col("object_id").alias("key"), F.col("object_id").cast("long").alias("object_id"), "insert_order").alias("row"), "v"), "identities")
    return nearest(unit(asked).select(grp, F.struct(F.col("query_id").alias("key"), "exclude").alias("row"), "v"), known, min_sim).withColumnRenamed("key", "query_id")


def _gallery_scan(queries: DataFrame, gallery: DataFrame, exclude: DataFrame | None, min_sim: float) -> DataFrame:
    unit = lambda c: F.coalesce(l2_normalize(F.col(c)), F.transform(c, lambda x: F.lit(0.0)))
    g = gallery.select("run_id", "object_id", unit("embedding").alias("g"), "insert_order").hint("merge")
    pairs = queries.select("run_id", "query_id", unit("embedding").alias("q")).join(g, "run_id")
    if exclude is not None:
        pairs = pairs.join(exclude.hint("merge"), ["query_id", "object_id"], "left_anti")
    scored = pairs.withColumn("similarity", dot(F.col("q"), F.col("g")))
    best = scored.groupBy("query_id").agg(F.max_by(F.struct("object_id", "similarity"), F.struct("similarity", -F.col("insert_order"))).alias("b"))
    return best.where(F.col("b.similarity") >= min_sim).select("query_id", "b.object_id", "b.similarity")


def enrich_tracklets(tracklets: DataFrame, instances: DataFrame, embeddings: DataFrame, k: int = 8, runs: DataFrame | None = None) -> DataFrame:
    """Fill missing tracklet embeddings from sampled rows: the mean of the (run, frame, inst) vectors of k samples.

    With ``runs`` (run_id, width, height) a sample counts only if its crop is good enough. ``filled`` tells which were
    missing and are filled; those without any usable sample stay null."""
    key = ["run_id", "frame_idx", "inst_idx"]
    lacking = tracklets.where("embedding is null").select(*ID)
    some = sample_tracklets(instances.join(lacking, ID, "left_semi"), k)
    if runs is not None:
        sized = some.join(instances.select(*key, *Box._fields), key).join(runs.select("run_id", "width", "height"), "run_id")
        w, h = F.col("width").cast("double"), F.col("height").cast("double")
        some = sized.where(crop_ok(crop_rect(box(), w, h), box(), w, h)).select(*ID, "frame_idx", "inst_idx")
    mean = mean_embedding(some.join(embeddings, key), ID).withColumnRenamed("embedding", "sampled")
    joined = tracklets.join(mean.hint("merge"), ID, "left")
    filled = F.col("embedding").isNull() & F.col("sampled").isNotNull()
    return joined.withColumn("filled", filled).withColumn("embedding", F.coalesce("embedding", "sampled")).drop("sampled")

