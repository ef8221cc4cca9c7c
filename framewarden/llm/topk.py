"""Exact top-k by inner product with the three-phase uniform threshold (Cao and Wang, 2004).

The dimensions are cut into m blocks; each block is a list in which every vector has a local score, its part of the inner
product, and the score is the sum over the lists. Local scores are shifted by the list's least, so none is negative.

1. Each task gathers, for each query and list, its highest local scores; the lists of a vector are in one row, so the
   vectors gathered are summed there, and the task sends the k highest sums and each list's least. The k-th highest sum of
   all tasks is tau1: no vector of the result sums to less, so it has some local score >= tau1 / m.
2. tau1 / m is broadcast as the cutoff. Each task collects the local scores at or above it and adds them up by vector: a
   lower bound. With the cutoff in place of the others it is an upper bound; what is below tau1 goes. The k-th highest
   lower bound, or tau1 if that is more, is tau2.
3. The vectors with an upper bound of tau2 or more are looked up and scored exactly, in integers.

Components are integers that doubles hold exactly, whatever their size. Local scores are doubles too: exact while all sums stay
below 2**53; else each carries the bound of its rounding error, sums are taken at their lower or upper end, and only phase 3
tells. A score must be a 64-bit integer to be returned; one that may not be never raises a threshold.

Rows go by a number of their own, so rows that repeat a vec_id are all there. One broadcast holds as many queries as a stated
size allows, and a task works on them in blocks; more queries take further rounds over all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import stage, unstage

ENTRY = "query long, known double, least array<double>"
#: Local scores gathered from each list, at least.
DEPTH = 64
#: Bytes of query vectors in a broadcast, and queries that a task works on at a time.
SENT, BLOCK = 64 << 20, 512
BOUNDS = "query long, row long, lower double, upper double"
#: Scores must be below this, and not below its negative.
LONG = 2.0**63
#: Doubles hold all integers up to this.
EXACT = 2.0**53


def _parts(batches: Iterator[pa.RecordBatch], rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that a block of queries against one is a few megabytes."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _matrix(column: pa.ListArray, width: int, scale: int) -> np.ndarray:
    """floor(scale * x) of the rows of the list column as doubles, shorter rows filled with zeros. That is exact: beyond 2**53 a double is
    an integer. Where the product overflows it is infinite, and so are the bounds made of it."""
    with np.errstate(over="ignore"):
        return np.floor(_filled(column, width) * scale)


def _filled(column: pa.ListArray, width: int) -> np.ndarray:
    sizes = np.diff(column.offsets.to_numpy())  # of the slice; flatten() is too
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _local(queries: np.ndarray, rows: np.ndarray, cuts: list[tuple[int, int]]) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """Local scores (queries x rows) list by list, each with a bound of its error: None where all sums are exact."""
    largest = np.abs(queries).max(initial=0.0) * np.abs(rows).max(initial=0.0)
    exact = largest * max(1, queries.shape[1]) < EXACT
    for a, b in cuts:
        q, r = queries[:, a:b], rows[:, a:b].T
        if exact:
            yield q @ r, None
            continue
        with np.errstate(over="ignore", invalid="ignore"):
            scores, error = q @ r, (np.abs(q) @ np.abs(r)) * ((b - a + 4) * 2.0**-51)
        lost = ~(np.isfinite(scores) & np.isfinite(error))
        yield np.where(lost, 0.0, scores), np.where(lost, np.inf, error)


def _sums(parts: list[tuple[np.ndarray, np.ndarray | None]]) -> tuple[np.ndarray, np.ndarray]:
    """The whole scores' lower and upper ends; the lower one is -inf where the score may not be a 64-bit integer, the upper one where it
    surely isn't. Exact sums are below 2**53, so they are both."""
    score = parts[0][0] if len(parts) == 1 else np.sum([s for s, _ in parts], axis=0)
    if parts[0][1] is None:
        return score, score
    error = sum(e for _, e in parts)
    slack = np.abs(score) * 2.0**-50
    low, high = score - error - slack, score + error + slack
    return np.where((low >= -LONG) & (high < LONG), low, -np.inf), np.where((low >= LONG) | (high < -LONG), -np.inf, high)


def _highest(scores: np.ndarray, k: int) -> np.ndarray:
    return scores if scores.shape[1] <= k else np.partition(scores, -k, axis=1)[:, -k:]


def _exact(q: np.ndarray, v: np.ndarray, scale: int) -> list[int | None]:
    """Inner products row by row in integers; null beyond 64 bits. Both hold x, not scale * x."""
    with np.errstate(over="ignore", invalid="ignore"):
        a, b = np.floor(q * scale), np.floor(v * scale)
        size = (np.abs(a) * np.abs(b)).sum(axis=1)
    small = size < 2.0**62
    out: list[int | None] = [None] * len(q)
    for i, x in zip(np.flatnonzero(small).tolist(), (a[small].astype(np.int64) * b[small].astype(np.int64)).sum(axis=1).tolist(), strict=True):
        out[i] = x
    for i in np.flatnonzero(~small).tolist():
        x = sum(_whole(x, scale) * _whole(y, scale) for x, y in zip(q[i].tolist(), v[i].tolist(), strict=True))
        out[i] = x if -(2**63) <= x < 2**63 else None
    return out


def _whole(x: float, scale: int) -> int:
    return int(x) * scale if abs(x) >= EXACT else int(np.floor(x * scale))


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, lists: int = 2, sent: int = SENT, block: int = BLOCK, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row its k highest integer inner products with the other rows.

    A component x counts as floor(scale * x). Ties go to the smaller vec_id; fewer rows than k give all. Null vectors and those
    with null or non-finite components take no part, nor do null ids; a pair whose inner product isn't a 64-bit integer has
    no score. Of rows that repeat an id each is a candidate, also of the others, and each a query of its own. Shorter vectors
    are filled with zeros, so an empty one scores 0. ``sent`` bytes of queries at most go out in a broadcast, and ``block``
    queries are held against some rows at a time.
    """
    spark = vectors.sparkSession
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    whole = F.col(vector_col).isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = vectors.where(F.col(id_col).isNotNull() & whole).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    rows = stage(good.withColumn("row", F.monotonically_increasing_id()), "vectors")
    n_queries, width = rows.agg(F.count_if("is_query"), F.max(F.size("v"))).first()
    width = max(1, width or 1)
    edges = np.linspace(0, width, max(1, min(lists, width)) + 1).astype(int).tolist()
    cuts = list(zip(edges[:-1], edges[1:], strict=True))
    out = None
    rounds = max(1, -(-n_queries * 8 * width // sent))
    for number in range(rounds):
        # some of the stated queries, of a size that doesn't grow with the table
        some = rows.where("is_query").where(F.pmod(F.xxhash64("row"), F.lit(rounds)) == number).select("row", "vec_id", "v").collect()
        found = _round(spark, rows, some, k, cuts, width, block, scale)
        out = found if out is None else out.unionByName(found)
    return out


def _round(spark, rows: DataFrame, some: list, k: int, cuts: list[tuple[int, int]], width: int, block: int, scale: int) -> DataFrame:
    q_rows, q_ids = (np.array([r[i] for r in some], np.int64) for i in (0, 1))
    raw = np.zeros((len(some), width))
    for i, r in enumerate(some):
        raw[i, : len(r[2])] = r[2]
    m = len(cuts)
    sent = spark.sparkContext.broadcast((q_rows, q_ids, raw))
    blocks = [slice(a, a + block) for a in range(0, len(some), block)]

    def scaled(x: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return np.floor(x * scale)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, _, queries = sent.value
        queries = scaled(queries)
        best = [np.full((len(own[b]), 0), -np.inf) for b in blocks]
        least = np.full((m, len(own)), np.inf)
        for batch in _parts(batches):
            at_rows, v = batch.column("row").to_numpy(), _matrix(batch.column("v"), width, scale)
            for number, b in enumerate(blocks):
                parts = list(_local(queries[b], v, cuts))
                gathered = np.zeros(parts[0][0].shape, bool)
                for i, (x, error) in enumerate(parts):
                    least[i, b] = np.minimum(least[i, b], (x if error is None else x - error).min(axis=1))
                    at = min(max(k + 1, DEPTH), x.shape[1])
                    gathered |= x >= np.partition(x, -at, axis=1)[:, -at][:, None]
                known = np.where(gathered & (own[b][:, None] != at_rows), _sums(parts)[0], -np.inf)
                best[number] = _highest(np.concatenate([best[number], known], axis=1), k)
        for number, b in enumerate(blocks):
            known = best[number]
            if known.shape[1]:
                mins = np.repeat(least[:, b].T, known.shape[1], axis=0)
                flat = pa.FixedSizeListArray.from_arrays(pa.array(mins.ravel()), m).cast(pa.list_(pa.float64()))
                yield pa.record_batch([pa.array(np.repeat(own[b], known.shape[1])), pa.array(known.ravel()), flat], ["query", "known", "least"])

    # Phase 1: k rows a query from each task. A query without k other vectors gets no cutoff.
    local = stage(rows.select("row", "v").mapInArrow(gather, ENTRY), "lists")
    least = local.groupBy("query").agg(F.array(*[F.min(F.col("least")[i]) for i in range(m)]).alias("least"))
    by_known = Window.partitionBy("query").orderBy(F.desc("known"))
    top = local.where(F.col("known") > float("-inf")).select("query", "known").withColumn("n", F.row_number().over(by_known)).where(F.col("n") == k)
    cut = least.join(top.hint("merge"), "query", "left").select("query", "least", "known").collect()  # a row per query of the round
    unstage(local)
    where = {int(x): i for i, x in enumerate(q_rows)}
    tau, shift, bounded = np.full(len(q_rows), -np.inf), np.zeros((m, len(q_rows))), np.zeros(len(q_rows), bool)
    for r in cut:
        if np.isfinite(r.least).all():  # else some local score has no bound, and nothing is cut off
            shift[:, where[r.query]], bounded[where[r.query]] = r.least, True
            if r.known is not None:
                total = r.known - sum(r.least)
                size = abs(r.known) + sum(map(abs, r.least))
                tau[where[r.query]] = total - size * 2.0**-50 if size >= EXACT / 4 else total
    cutoff = spark.sparkContext.broadcast((tau, shift, bounded))

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, _, queries = sent.value
        queries = scaled(queries)
        tau1, mins, known = cutoff.value
        size = np.abs(mins).sum(axis=0) + np.where(np.isfinite(tau1), np.abs(tau1), 0.0)
        rounding = np.where(size < EXACT / 4, 0.0, size * 2.0**-49)  # of shifted scores and of their sums
        for batch in _parts(batches):
            at_rows, v = batch.column("row").to_numpy(), _matrix(batch.column("v"), width, scale)
            for b in blocks:
                parts = list(_local(queries[b], v, cuts))
                cap = tau1[b][:, None]
                low = high = 0.0
                keep = own[b][:, None] != at_rows
                some = np.isneginf(cap) & keep  # a local score at or above the cutoff: without one a vector stays below
                loose = rounding[b][:, None]
                for i, (scores, error) in enumerate(parts):
                    shifted = scores - mins[i][b][:, None]
                    if error is None and not loose.any():
                        top = bottom = shifted
                    else:
                        give = loose if error is None else error + loose + 1
                        top, bottom = shifted + give, np.maximum(shifted - give, 0.0)
                    over = top >= cap / m
                    some |= over
                    low = low + np.where(over, bottom, 0.0)
                    high = high + np.where(over, top, np.maximum(cap, 0.0) / m)
                lower = low
                keep &= some
                if parts[0][1] is not None:
                    sure, possible = _sums(parts)
                    lower = np.where(sure > -np.inf, low, -np.inf)
                    keep &= possible > -np.inf
                if not known[b].all():
                    lower = np.where(known[b][:, None], lower, -np.inf)
                keep &= high >= cap
                at_q, at_v = np.nonzero(keep)
                columns = [own[b][at_q], at_rows[at_v], lower[at_q, at_v], high[at_q, at_v]]
                yield pa.record_batch([pa.array(c) for c in columns], ["query", "row", "lower", "upper"])

    # Phase 2.
    bounds = stage(rows.select("row", "v").mapInArrow(collect, BOUNDS), "bounds")
    by_lower = Window.partitionBy("query").orderBy(F.desc("lower"))
    tau1 = spark.createDataFrame([(int(a), float(b)) for a, b in zip(q_rows, tau, strict=True)], "query long, tau1 double")
    ranked = bounds.where(F.col("lower") > float("-inf")).select("query", "lower").withColumn("n", F.row_number().over(by_lower))
    kth = ranked.where(F.col("n") <= k).groupBy("query").agg(F.when(F.count("*") == k, F.min("lower")).alias("kth"))
    tau2 = tau1.join(F.broadcast(kth), "query", "left").select("query", F.greatest("tau1", "kth").alias("tau2"))
    open_pairs = bounds.join(F.broadcast(tau2), "query").where("upper >= tau2").select("query", "row")  # tau2: a row per query of the round

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, ids, queries = sent.value
        order = np.argsort(own)
        for batch in _parts(batches, 1024):
            at = order[np.searchsorted(own[order], batch.column("query").to_numpy())]
            scores = _exact(queries[at], _filled(batch.column("v"), width), scale)
            yield pa.record_batch([batch.column("query"), pa.array(ids[at]), batch.column("row"), batch.column("vec_id"), pa.array(scores, pa.int64())], ["query", "query_id", "row", "vec_id", "score"])

    # Phase 3.
    pairs = open_pairs.join(rows.select("row", "vec_id", "v").hint("merge"), "row").select("query", "row", "vec_id", "v")
    scored = pairs.mapInArrow(resolve, "query long, query_id long, row long, vec_id long, score long").where("score is not null")
    by_score = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")
    return scored.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
