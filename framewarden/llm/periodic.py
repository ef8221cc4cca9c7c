"""Periodic runs of words: the maximal stretches of a text that repeat with a smallest period, two times at least.

A run of period q is a maximal interval of places i with word[i] == word[i + q], at least q long. Periods go by octave
[2^k, 2^(k+1)). In an octave such an interval holds one of the evenly spaced blocks of about 2^(k-1) words, and that block equals the one q
words on; so only blocks whose hashes agree are looked at. Around each of them lies a tile of some 2^k words, which is solved
alone: Z-functions at the block's boundary, forward and backward, give for all periods of the octave how far the words agree.
What a tile sees of an interval is a fragment; fragments of neighbouring tiles overlap. They are shuffled by document and period
and stitched. A tile can tell whether the period is the smallest: it isn't if the first q words repeat with a proper divisor
of q, so multiples of a period never leave the task.

Texts of more than ``spread`` words are exploded into tiles that are shuffled over all tasks; of shorter ones the tiles are solved
where the text was read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import stage, text_batches
from .words import POWERS, give_back, mix, text_slices

#: The shortest run, in words.
SHORTEST = 12
#: Texts with more words are spread over tasks as tiles.
SPREAD = 1 << 18
#: Words of a tile that is shuffled, without its margins; four times the octave's first period at least.
TILE = 1 << 16

Fragment = tuple[int, int, int]


def split_words(text: str) -> list[bytes]:
    """Words are what ASCII white space separates, as bytes."""
    return text.encode("utf-8", "surrogatepass").split()


def least(q: int) -> int:
    """How long the interval of equal places is at least for a run of period q."""
    return max(q, SHORTEST - q)


@lru_cache(None)
def octave_sizes(k: int) -> tuple[int, int, int]:
    """Block, core of a tile and margin of a tile: every interval of the octave holds an aligned block, none that counts is longer
    than the margin needs to show."""
    periods = range(1 << k, 2 << k) if k < 4 else (1 << k, (2 << k) - 1)
    return (min(map(least, periods)) + 1) // 2, max(64, 4 << k), max(map(least, periods))


@lru_cache(1 << 16)
def largest_divisors(q: int) -> tuple[int, ...]:
    """q / p for each prime p that divides q."""
    out, rest, p = [], q, 2
    while p * p <= rest:
        if rest % p == 0:
            out.append(q // p)
            while rest % p == 0:
                rest //= p
        p += 1
    return (*out, q // rest) if rest > 1 else tuple(out)


def z_function(s: list) -> list[int]:
    """For each place the length of the longest common start of s and of s from there on (0 at place 0)."""
    n, z = len(s), [0] * len(s)
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        if i + k > right:
            left, right = i, i + k
        z[i] = k
    return z


def block_hashes(x: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all stretches of ``size`` words, to leave out blocks that can't be equal."""
    if len(x) < size:
        return np.zeros(0, np.uint64)
    up, down = POWERS.get(len(x) + 1)
    sums = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(mix(x.astype(np.uint64)) * up[:-1], out=sums[1:])
    return (sums[size:] - sums[:-size]) * down[: len(x) - size + 1]


class Known:
    """For each word a run of a lower octave that holds it: its period (0: none) and end. Blocks inside a run whose period divides
    the one asked for belong to no smallest period."""

    def __init__(self, n: int) -> None:
        self.period, self.end = np.zeros(n, np.int64), np.zeros(n, np.int64)

    def add(self, found: list[Fragment]) -> None:
        for q, start, stop in found:
            self.period[start : stop + q], self.end[start : stop + q] = q, stop + q

    def multiples(self, m: np.ndarray, q: np.ndarray) -> np.ndarray:
        period = self.period[m]
        return (period > 0) & (q % np.maximum(period, 1) == 0) & (self.end[m] >= m + q)


def solve_octave(x: np.ndarray, k: int, most: int, known: Known | None = None) -> Iterator[Fragment]:
    """(period, start, stop) of intervals of places equal to the one a period on, as far as the tiles around them show; smallest
    periods of octave k up to ``most`` only. Intervals overlap where tiles do."""
    first, last = 1 << k, min((2 << k) - 1, most)
    block, core, margin = octave_sizes(k)
    hashes = block_hashes(x, block)
    starts = np.arange(0, max(0, len(hashes) - first), block)
    if last < first or not len(starts):
        return
    ahead = sliding_window_view(np.concatenate([hashes[first:], np.zeros(last - first + 1, np.uint64)]), last - first + 1)
    rows, periods = np.nonzero(ahead[starts] == hashes[starts][:, None]) if len(starts) * (last - first + 1) < 1 << 22 else _in_parts(ahead, hashes, starts)
    at_block, at_period = starts[rows], periods + first
    if known is not None:
        left = ~known.multiples(at_block, at_period)
        at_block, at_period = at_block[left], at_period[left]
    tile = low = high = -1
    covered: dict[int, int] = {}
    at, forward, backward, ends = -1, [], [], 0
    for m, q in zip(at_block.tolist(), at_period.tolist(), strict=True):
        if m // core != tile:
            tile, covered = m // core, {}
            low, high = max(0, tile * core - margin), min(len(x), (tile + 1) * core + margin)
        if covered.get(q, -1) > m:
            continue
        if at != m:  # the boundary's Z-functions serve all periods of the octave
            at, ends = m, min(last, len(x) - m)
            forward = z_function(x[m : min(len(x), high + last)].tolist())
            before = x[low:m][::-1].tolist()
            backward = z_function([*before, None, *x[low : m + ends][::-1].tolist()])
        if q > ends or q >= len(forward):
            continue
        start, stop = m - min(backward[m - low + 1 + ends - q], m - low), min(m + forward[q], high)
        covered[q] = stop
        if stop - start >= least(q) and not any(np.array_equal(x[start : start + q - d], x[start + d : start + q]) for d in largest_divisors(q)):
            yield q, start, stop


def _in_parts(ahead: np.ndarray, hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The blocks that agree, for so many places at a time that the comparison stays small."""
    step = max(1, (1 << 22) // ahead.shape[1])
    found = [np.nonzero(ahead[starts[i : i + step]] == hashes[starts[i : i + step]][:, None]) for i in range(0, len(starts), step)]
    return np.concatenate([a + i * step for i, (a, _) in enumerate(found)]), np.concatenate([b for _, b in found])


def fragments(words: list[list[bytes]]) -> list[list[Fragment]]:
    """The fragments of each of some texts. Their words are numbered together and lie in one array, with a number of its own
    after each text: no interval that counts crosses it."""
    sizes = np.array([len(w) for w in words], np.int64)
    number = {w: i for i, w in enumerate(dict.fromkeys(chain.from_iterable(words)))}
    firsts = np.concatenate([[0], np.cumsum(sizes + 1)])
    x = -np.arange(1, firsts[-1] + 1)
    inside = np.ones(len(x), bool)
    inside[firsts[1:] - 1] = False
    x[inside] = np.fromiter(map(number.__getitem__, chain.from_iterable(words)), np.int64, int(sizes.sum()))
    out: list[list[Fragment]] = [[] for _ in words]
    most, known = int(sizes.max(initial=0)) // 2, Known(len(x))
    for k in range(most.bit_length()):
        found = list(solve_octave(x, k, most, known))
        known.add(found)
        for q, start, stop in found:
            i = int(np.searchsorted(firsts, start, "right")) - 1
            out[i].append((q, start - int(firsts[i]), stop - int(firsts[i])))
    return out


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words, one space between, without those that a run (start, length, period) has after its first period."""
    if not runs:
        return b" ".join(words)
    marks = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        marks[start + period] += 1
        marks[start + length] -= 1
    return b" ".join([w for w, inside in zip(words, np.cumsum(marks).tolist(), strict=False) if not inside])


def tiles_of(x: np.ndarray, size: int = TILE) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(octave, largest period, place of the first word, words) of the tiles of one text, with margins on both sides."""
    most = len(x) // 2
    for k in range(most.bit_length()):
        core, margin = max(size, 4 << k), octave_sizes(k)[2]
        for at in range(0, len(x), core):
            low = max(0, at - margin)
            yield k, most, low, x[low : at + core + margin + (2 << k)]


FRAGMENT = "struct<period:int,start:long,stop:long>"
RUN = "struct<start:long,length:long,period:long>"


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: bool = False, spread: int = SPREAD, tile: int = TILE) -> DataFrame:
    """One row per row of ``docs``: doc_id, runs (start, length, period in words, by start and period), collapsed_sha256 of the
    text that is left when each run keeps its first period (words with one space between); with ``texts`` that text as well.

    A run is maximal, its period the smallest, its length at least 12 words and two periods. Null texts and texts without words
    have no runs and collapse to an empty text. Rows that repeat, null ids included, are rows of their own; other columns are
    not read. Tables written on the way hold the fragments and the texts that have some.
    """
    text_batches(docs.sparkSession)

    def closing(text: bytes) -> str:
        return text.decode("utf-8", "surrogatepass") if texts else hashlib.sha256(text).hexdigest()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("period", pa.int32()), ("start", pa.int64()), ("stop", pa.int64())]))
        for batch in batches:
            for part, bodies in text_slices(batch):
                words = [split_words(t) for t in bodies]
                long = [len(w) > spread for w in words]
                found = fragments([[] if much else w for w, much in zip(words, long, strict=True)])
                is_open = [much or bool(f) for much, f in zip(long, found, strict=True)]
                left = [None if o else closing(b" ".join(w)) for w, o in zip(words, is_open, strict=True)]
                columns = [part.column("key"), part.column("doc_id"), pa.array([t if o else None for t, o in zip(bodies, is_open, strict=True)], pa.string()), pa.array(long), pa.array(found, kind), pa.array(left, pa.string())]
                yield pa.record_batch(columns, ["key", "doc_id", "text", "long", "found", "left"])
        give_back()

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, bodies in text_slices(batch):
                for key, text in zip(part.column("key").to_pylist(), bodies, strict=True):
                    words = split_words(text)
                    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
                    x = np.fromiter(map(number.__getitem__, words), np.int32, len(words))
                    for octave, most, at, piece in tiles_of(x, tile):
                        yield pa.record_batch([pa.array([v]) for v in (key, octave, most, at)] + [pa.array([piece.tobytes()])], ["key", "octave", "most", "at", "words"])
        give_back()

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                got = [(q, row["at"] + a, row["at"] + b) for q, a, b in solve_octave(np.frombuffer(row["words"], np.int32).astype(np.int64), row["octave"], row["most"])]
                q, a, b = np.array(got, np.int64).reshape(-1, 3).T
                yield pa.record_batch([pa.array(np.full(len(q), row["key"])), pa.array(q.astype(np.int32)), pa.array(a), pa.array(b)], ["key", "period", "start", "stop"])
        give_back()

    base = docs.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    read = stage(base.mapInArrow(scan, f"key long, doc_id long, text string, long boolean, found array<{FRAGMENT}>, left string"), "fragments")
    parts = read.select("key", F.inline("found"))
    if read.where("long").limit(1).count():
        spread_tiles = read.where("long").select("key", "text").mapInArrow(explode, "key long, octave long, most long, at long, words binary").repartition("key", "octave", "at")
        parts = parts.unionByName(spread_tiles.mapInArrow(solve, "key long, period int, start long, stop long"))
    runs = stitch(parts).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "length", "period"))).alias("runs"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, bodies in text_slices(batch):
                runs = [[(r["start"], r["length"], r["period"]) for r in one or ()] for one in part.column("runs").to_pylist()]
                left = [closing(collapse(split_words(t), r)) for t, r in zip(bodies, runs, strict=True)]
                yield pa.record_batch([part.column("doc_id"), part.column("runs"), pa.array(left, pa.string())], ["doc_id", "runs", "left"])
        give_back()

    is_open = read.where("text is not null").select("key", "doc_id", "text").join(runs.hint("merge"), "key", "left")
    done = is_open.select("doc_id", "text", F.coalesce("runs", F.array().cast(f"array<{RUN}>")).alias("runs")).mapInArrow(finish, f"doc_id long, runs array<{RUN}>, left string")
    out = read.where("text is null").select("doc_id", F.array().cast(f"array<{RUN}>").alias("runs"), "left").unionByName(done)
    digest = F.sha2("left", 256) if texts else F.col("left")
    return out.select("doc_id", "runs", digest.alias("collapsed_sha256"), *([F.col("left").alias("collapsed")] if texts else []))


def stitch(parts: DataFrame) -> DataFrame:
    """(key, start, length, period) of the runs whose fragments (key, period, start, stop) overlap or touch."""
    group = Window.partitionBy("key", "period")
    order = group.orderBy("start", "stop")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = parts.withColumn("new", F.coalesce((F.col("start") > reach).cast("int"), F.lit(1)))
    numbered = marked.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = numbered.groupBy("key", "period", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    return whole.select("key", "start", (F.col("stop") - F.col("start") + F.col("period")).alias("length"), F.col("period").cast("long").alias("period"))


def repeated_tail(doc_id: Column, text: Column) -> Column:
    """The text that the contract gives the query: of documents whose crc32(doc_id) is a multiple of 10, the words from one place
    on repeat. Null ids change nothing."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    n = F.size(words)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    tail = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    made = F.array_join(F.concat(F.slice(words, F.lit(1), a), F.slice(tail, F.lit(1), n - a)), " ")
    return F.when((h % 10 == 0) & (n > 0), made).otherwise(text)


def run_digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (ties: smallest start, then period) with its exponent, digests of all runs and of what is left."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    told = found.select("doc_id", "runs", "collapsed_sha256", best.alias("best"))
    start, length, period = -F.col("best.start"), F.col("best.length"), -F.col("best.period")
    return told.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), "collapsed_sha256",
    )
