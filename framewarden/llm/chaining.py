"""Fuzzy passages that documents share: k-mer seeds, collinear chains, alignment of the chains.

Seeds. Of the hashes of the 5-word k-mers in each window of 8 the least is a seed (a minimizer), so two texts that agree
over 12 words share one. Equal texts are one node; nodes are numbered in the order of their least ids. The occurrences of a
seed are linked to its hub alone, the occurrence in the least node; rows stay in proportion to the occurrences however many
documents share a passage. The hubs are a table of their own, so that the join with a frequent seed can be split.

Chains. Seeds that a document shares with a hub document are matches (x, y). A chain ascends in both; its score is the words
of its seeds less a cost for the words passed over in either text. The best predecessor of a match is a prefix maximum,
kept in a Fenwick tree over y.

Whole runs. A hub may hold no more than a part of a passage. Where the seeds that a document shares lie densely enough for
it, all runs of 50 words are keys too, and each is linked to the least id that holds the run: no equal passage is missed,
however its parts are spread over smaller ids. These keys are at most the words of such places.

Pairs of seeds. Of two documents that share a passage with differences, the hubs of its seeds may each hold a part too small to
be one. What no passage covers yet is therefore linked again: its keys are pairs of seeds, 16 words from end to end, as a chain
needs them, and each goes to the least node that holds the pair. The nodes that are looked up emit only keys that are in a
bitmap of the open ones.

Alignment. From each seed of a chain the words of both texts are compared outwards; after a difference the nearest place
at which three words agree again is taken. Of such a path the longest part that is long and alike enough is a passage, then
the longest ones on its left and right.

Loss. The least node with a pair of seeds may hold too little of a passage as well; where that is so for all pairs of a passage
that differs, it can be lost. Passages that differ need two shared seeds 16 words apart, so some of those below 0.9 alike are not found; the README
has the measured recall.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .collocations import Bitmap, bitmap, marked
from .staging import BROADCAST_ROWS, fresh, stage, text_batches, unstage
from .words import POWERS, give_back, mix, shingles, slices, text_slices, word_hashes, word_spans

#: Rows of an Arrow batch that holds arrays, and their elements together; shared seeds paired at a time.
ROWS, ELEMENTS, PAIRED = 512, 1 << 16, 1 << 15


@dataclass
class Settings:
    k: int = 5
    window: int = 8
    #: Words of a passage, at least, in the document that it is reported for.
    min_words: int = 50
    #: Share of those words that are equal in both texts, at least.
    min_alike: float = 0.8
    #: Words from the first to the last seed of a chain worth aligning, at least; a passage of min_words has more.
    min_span: int = 16
    #: Cost of each word passed over between two seeds, and the words after which a chain is cut.
    gap_cost: float = 0.05
    max_gap: int = 100
    #: Words looked ahead, in both texts together, for a place where they agree again, and how many must agree there.
    look_ahead: int = 24
    agree: int = 3

    @property
    def widest(self) -> int:
        """Words from seed to seed of a pair in the smaller document: as in the other one, or as many more as are looked ahead."""
        return self.min_words + self.look_ahead


def minimizers(words: np.ndarray, first: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seeds of all texts: owner, position (in words of its text), hash. Texts of fewer than k words have none."""
    values, offsets = shingles(words, first, k)
    counts = np.where(np.diff(first) >= k, np.diff(offsets), 0)
    picked = []
    long = counts >= window
    if long.any() and len(values) >= window:
        # windows that lie within one text
        least = np.lib.stride_tricks.sliding_window_view(values, window).argmin(axis=1) + np.arange(len(values) - window + 1)
        start = np.zeros(len(values) + 1, np.int64)
        np.add.at(start, offsets[:-1][long], 1)
        np.add.at(start, (offsets[:-1] + counts - window + 1)[long], -1)
        inside = np.cumsum(start)[: len(least)] > 0
        picked.append(least[inside])
    for i in np.flatnonzero((counts > 0) & ~long).tolist():
        picked.append(np.array([offsets[i] + int(values[offsets[i] : offsets[i + 1]].argmin())]))
    at = np.unique(np.concatenate(picked)) if picked else np.zeros(0, np.int64)
    owner = np.searchsorted(offsets, at, "right") - 1
    return owner, at - offsets[owner], values[at]


class Fenwick:
    """Prefix maxima of (value, number) over places 1..n."""

    def __init__(self, n: int) -> None:
        self.best: list[tuple[float, int]] = [(-np.inf, -1)] * (n + 1)

    def put(self, place: int, value: float, number: int) -> None:
        item = (value, number)
        while place < len(self.best):
            if item > self.best[place]:
                self.best[place] = item
            place += place & -place

    def upto(self, place: int) -> tuple[float, int]:
        out = (-np.inf, -1)
        while place:
            if self.best[place] > out:
                out = self.best[place]
            place -= place & -place
        return out


def chains(xs: list[int], ys: list[int], s: Settings) -> list[list[int]]:
    """Chains of matches (sorted by x, then y), as lists of their numbers; each match is in one chain at most."""
    n = len(xs)
    places = {y: i + 1 for i, y in enumerate(sorted(set(ys)))}
    tree = Fenwick(len(places))
    score, back = [0.0] * n, [-1] * n
    i = 0
    while i < n:
        j = i
        while j < n and xs[j] == xs[i]:  # matches of one x see only those before it
            value, number = tree.upto(places[ys[j]] - 1)
            # words passed over: what lies between the end of the one seed and the start of the next, in both texts
            linked = value - s.gap_cost * (xs[j] + ys[j])
            score[j], back[j] = (s.k + linked, number) if number >= 0 and linked > 0 else (float(s.k), -1)
            j += 1
        for m in range(i, j):
            tree.put(places[ys[m]], score[m] + s.gap_cost * (xs[m] + ys[m]), m)
        i = j
    out, used = [], [False] * n
    for end in sorted(range(n), key=lambda m: (-score[m], m)):
        if used[end]:
            continue
        chain, m = [], end
        while m >= 0 and not used[m]:
            if chain and max(xs[chain[-1]] - xs[m], ys[chain[-1]] - ys[m]) > s.max_gap:
                break
            used[m] = True
            chain.append(m)
            m = back[m]
        out.append(chain[::-1])
    return out


def runs(xs: list[int], s: Settings) -> list[tuple[int, int]]:
    """Where runs of min_words words may start, as ranges (first, last), by the ascending positions of shared seeds.

    A run that two texts share has a shared seed in each of its windows: one in its first window, one in its last, and
    never more than a window from one to the next.
    """
    out, n, start = [], s.min_words - s.k, 0
    for i in range(1, len(xs) + 1):
        if i == len(xs) or xs[i] - xs[i - 1] > s.window:
            a, b = max(0, xs[start] - s.window + 1), xs[i - 1] - n + s.window - 1
            if a <= b:
                out.append((a, b))
            start = i
    return out


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words, from one running sum."""
    up, down = POWERS.get(len(words) + 1)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], out=sums[1:])
    return mix((sums[n:] - sums[:-n]) * down[: len(words) - n + 1]) if len(words) >= n else np.zeros(0, np.uint64)


Run = tuple[int, int, int]  # start in a, start in b, words equal from there


def _reach(a: np.ndarray, b: np.ndarray, x: int, y: int, s: Settings) -> list[Run]:
    """Compare a from x with b from y onwards: the equal runs, up to where the texts differ for longer than is looked ahead."""
    out: list[Run] = []
    while True:
        n = min(len(a) - x, len(b) - y)
        differ = a[x : x + n] != b[y : y + n]
        run = int(differ.argmax()) if differ.any() else n
        if run:
            out.append((x, y, run))
        x, y = x + run, y + run
        if run == n:
            return out
        hit = _next_agreement(a[x : x + s.look_ahead + s.agree], b[y : y + s.look_ahead + s.agree], s.look_ahead, s.agree)
        if hit is None:
            return out
        x, y = x + hit[0], y + hit[1]


@cache
def _nearness(most: int) -> np.ndarray:
    """Rank of each pair of steps, nearest first; an equal step in both first: a word changed for another is commonest."""
    steps = sorted(((dx, dy) for dx in range(most + 1) for dy in range(most + 1)), key=lambda d: (d[0] + d[1], abs(d[0] - d[1]), d[0]))
    out = np.full((most + 1, most + 1), len(steps))
    for rank, (dx, dy) in enumerate(steps):
        if 0 < dx + dy <= most:
            out[dx, dy] = rank
    return out


def _next_agreement(a: np.ndarray, b: np.ndarray, most: int, agree: int) -> tuple[int, int] | None:
    """The nearest pair of steps, ``most`` words together, after which ``agree`` words are equal."""
    n, m = len(a) - agree + 1, len(b) - agree + 1
    if n < 1 or m < 1:
        return None
    equal = a[:, None] == b[None, :]
    if not equal.any():
        return None
    whole = equal[:n, :m].copy()
    for i in range(1, agree):
        whole &= equal[i : n + i, i : m + i]
    near = np.where(whole[: most + 1, : most + 1], _nearness(most)[:n, :m], (most + 1) ** 2)
    dx, dy = divmod(int(near.argmin()), near.shape[1])
    return (dx, dy) if near[dx, dy] < (most + 1) ** 2 else None


def best_spans(path: list[Run], s: Settings) -> list[tuple[int, int, int, int, int]]:
    """Passages of a path, from equal run to equal run: the longest that is alike enough, then those beside it."""
    out, todo = [], [(0, len(path))]
    start, length = np.array([r[0] for r in path], np.int64), np.array([r[2] for r in path], np.int64)
    alike = np.concatenate([[0], np.cumsum(length)])
    # a passage of runs i to j is alike enough if right[j] >= left[i]
    left, right = alike[:-1] - s.min_alike * start, alike[1:] - s.min_alike * (start + length) + 1e-9
    while todo:
        lo, hi = todo.pop()
        if hi <= lo or path[hi - 1][0] + path[hi - 1][2] - path[lo][0] < s.min_words:
            continue
        # the best right end from j on falls with j, so the last j that reaches left[i] is found by bisection
        reach = np.maximum.accumulate(right[lo:hi][::-1])
        i = np.arange(lo, hi)
        j = hi - 1 - np.searchsorted(reach, left[lo:hi], "left")
        span = np.where(j >= i, start[np.maximum(j, lo)] + length[np.maximum(j, lo)] - start[lo:hi], 0)
        best = int(span.argmax())
        if span[best] < s.min_words:
            continue
        f, t = int(i[best]), int(j[best])
        out.append((path[f][0], path[t][0] + path[t][2], path[f][1], path[t][1] + path[t][2], int(alike[t + 1] - alike[f])))
        todo += [(lo, f), (t + 1, hi)]
    return sorted(out)


def align(a: np.ndarray, b: np.ndarray, xs: list[int], ys: list[int], s: Settings) -> list[tuple[int, int, int, int, int]]:
    """Passages (start and end in a, start and end in b, words alike) around the seeds of a pair, chain after chain."""
    out: list[tuple[int, int, int, int, int]] = []
    walked: dict[int, list[tuple[int, int]]] = {}  # equal runs of all paths, by y - x
    for x, y in zip(xs, ys, strict=True):
        inside = any(p[0] <= x and x + s.k <= p[1] and p[2] <= y and y + s.k <= p[3] for p in out)
        if inside or any(f <= x < t for f, t in walked.get(y - x, ())) or not np.array_equal(a[x : x + s.k], b[y : y + s.k]):
            continue
        back = [(x - dx - n, y - dy - n, n) for dx, dy, n in reversed(_reach(a[:x][::-1], b[:y][::-1], 0, 0, s))] if x and y else []
        path = _reach(a, b, x, y, s)
        if back and back[-1][0] + back[-1][2] == x and back[-1][1] + back[-1][2] == y:
            path[0] = (*back[-1][:2], back[-1][2] + path[0][2])
            back.pop()
        path = back + path
        for f, g, n in path:
            walked.setdefault(g - f, []).append((f, f + n))
        out += best_spans(path, s)
    return out


SEEDS = "doc_id long, digest binary, n_words int, hashes array<long>, positions array<int>"
NO_SEEDS = np.zeros(0, np.int32), np.zeros(0, np.int64)
PASSAGES = "node long, start_word int, end_word int, hub long, other_start int, other_end int, words_alike int"


def repeated_passages(docs: DataFrame, settings: Settings | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start_word, end_word, other_doc_id, other_start, other_end, words_alike, text_sha256), a row per passage.

    The words [start_word, end_word) of doc_id are, but for small differences, those of a document with a smaller id. A
    text that equals another whole is one passage, against the copy with the least id. Words are lower-cased runs between
    white space. Null and empty texts, and texts shorter than a passage, have none. A null id comes after all others. Rows
    that share an id but not the text are documents of their own, told apart by ``text_sha256``; rows that repeat both are
    one document. Passages that occur twice within one document only are not reported. Other columns are not read.
    """
    text_batches(docs.sparkSession)
    s = settings or Settings()
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))

    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch):
                words, first = word_hashes(texts)
                owner, position, value = minimizers(words, first, s.k, s.window)
                counts = np.diff(first)
                keep = counts[owner] >= s.min_words
                owner, position, value = owner[keep], position[keep], value[keep]
                offsets = pa.array(np.searchsorted(owner, np.arange(len(texts) + 1)).astype(np.int32))
                columns = [part.column("doc_id"), part.column("digest"), pa.array(counts.astype(np.int32)), pa.ListArray.from_arrays(offsets, pa.array(value.view(np.int64))), pa.ListArray.from_arrays(offsets, pa.array(position.astype(np.int32)))]
                yield pa.record_batch(columns, ["doc_id", "digest", "n_words", "hashes", "positions"])
        give_back()

    # Equal texts first: one of them is seeded further. The order of the nodes is that of their least ids.
    seeded = stage(base.mapInArrow(seed, SEEDS).where(F.col("n_words") >= s.min_words), "seeded")
    one = seeded.groupBy("digest").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id")).alias("least"), F.first("n_words").alias("n_words"))
    firsts = one.select("digest", F.col("least.doc_id").alias("first_id"), "n_words").orderBy(F.asc_nulls_last("first_id"), "digest")
    firsts = stage(firsts.withColumn("node", F.monotonically_increasing_id()), "firsts")
    joined = seeded.join(firsts.select("digest", "first_id", "node").hint("merge"), "digest")
    own = F.col("doc_id").eqNullSafe(F.col("first_id"))
    slim = stage(joined.select("doc_id", "digest", "first_id", "node", "n_words", own.alias("own"), F.when(own, F.arrays_zip("hashes", "positions")).alias("seeds")), "slim")
    unstage(seeded)
    n = F.col("n_words")
    copies = slim.where("not own").select("doc_id", F.lit(0).alias("start_word"), n.alias("end_word"), F.col("first_id").alias("other_doc_id"), F.lit(0).alias("other_start"), n.alias("other_end"), n.alias("words_alike"), "digest").distinct()

    seeds = slim.where("own").select("node", F.explode("seeds").alias("s")).select(F.col("s.hashes").alias("hash"), "node", F.col("s.positions").alias("x"))
    pairs = "node long, hub long, xs array<int>, ys array<int>"
    #: ``at`` is twice the place of a shared seed, and 1 more if a smaller node has it too
    chained_pairs = f"{pairs}, at array<int>, seeds array<long>"

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from list_rows(chain_rows(batches), ["node", "hub", "xs", "ys", "at", "seeds"])
        give_back()

    def chain_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        doc, shared = None, []
        for pair, xs, ys, hashes in _groups(batches):
            if pair[0] != doc:
                yield from places(doc, shared)
                doc, shared = pair[0], []
            smaller = int(pair[0] != pair[1])
            shared.append((2 * np.array(xs, np.int32) + np.int32(smaller), np.concatenate(hashes)))
            if smaller and max(xs) + s.k - min(xs) >= s.min_span:
                found = [i for c in chains(xs, ys, s) if xs[c[-1]] + s.k - xs[c[0]] >= s.min_span for i in c]
                if found:
                    yield *pair, np.array(xs, np.int32)[found], np.array(ys, np.int32)[found], *NO_SEEDS
        yield from places(doc, shared)

    def places(doc: int | None, shared: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple]:
        if doc is not None:
            at, hashes = (np.concatenate(c) for c in zip(*shared, strict=True))
            order = np.argsort(at)
            at, hashes = at[order], hashes[order]
            found = runs((at >> 1).tolist(), s)
            close = np.diff(at >> 1) <= s.widest  # seeds without another one near are in no pair
            near = np.append(close, False) | np.append(False, close)
            if found or near.any():
                yield doc, None, *np.array(found, np.int32).reshape(-1, 2).T, at[near], hashes[near]

    # Matches with hubs, and the places of runs of min_words words (without a hub) as far as shared seeds allow them.
    matches, hubs = _to_hubs(seeds, True)
    chained = stage(matches.mapInArrow(chain, chained_pairs), "chains")
    unstage(hubs)
    where = chained.where("hub is null and size(xs) > 0").select("node", "xs", "ys")

    def run_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch):
                words, first = word_hashes(texts)
                ids, firsts, lasts = part.column("node").to_pylist(), part.column("xs").to_pylist(), part.column("ys").to_pylist()
                for i, doc in enumerate(ids):
                    values = run_hashes(words[first[i] : first[i + 1]], s.min_words)
                    at = np.concatenate([np.arange(a, min(b + 1, len(values))) for a, b in zip(firsts[i], lasts[i], strict=True)]).astype(np.int32)
                    yield pa.record_batch([pa.array(values[at].view(np.int64)), pa.array(np.full(len(at), doc)), pa.array(at)], ["hash", "node", "x"])
        give_back()

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from list_rows(map(heads, _groups(batches)), ["node", "hub", "xs", "ys"])
        give_back()

    def heads(group: tuple) -> tuple:
        (node, hub), x, y = group[0], np.array(group[1], np.int32), np.array(group[2], np.int32)
        head = np.concatenate([[True], (np.diff(x) > 1) | (np.diff(y) != np.diff(x))])
        return node, hub, x[head], y[head]

    # A hub may hold no more than a part of a passage. Runs of min_words words as keys have no such hubs.
    run_texts = _texts(base, firsts, where).join(where.hint("merge"), "node")
    keys = stage(run_texts.mapInArrow(run_keys, "hash long, node long, x int"), "runs")
    matches, hubs = _to_hubs(keys, False)
    whole = matches.mapInArrow(collapse, pairs)
    merged = chained.where("hub is not null").select("node", "hub", "xs", "ys").unionByName(whole).groupBy("node", "hub").agg(F.collect_list(F.struct("xs", "ys")).alias("c"))
    candidates = stage(merged.select("node", "hub", F.flatten("c.xs").alias("xs"), F.flatten("c.ys").alias("ys")), "candidates")
    unstage(keys, hubs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, hub_words = None, None
        for batch in batches:
            out = []
            for at in range(batch.num_rows):
                doc, hub, xs, ys, text, other = (batch.column(i)[at].as_py() for i in range(6))
                if other != last:
                    last, hub_words = other, word_hashes([other])[0]
                words = word_hashes([text])[0]
                out += [(doc, a, b, hub, c, d, n) for a, b, c, d, n in align(words, hub_words, xs, ys, s)]
            columns = list(zip(*out, strict=True)) if out else [[]] * 7
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [c.split()[0] for c in PASSAGES.split(", ")])
        give_back()

    def aligned(candidates: DataFrame) -> DataFrame:
        """The passages of staged candidates (node, hub, xs, ys), staged; two chains of a pair can meet in one passage."""
        texts = stage(_texts(base, firsts, candidates.select("node").union(candidates.select(F.col("hub").alias("node"))).distinct()), "texts")
        left = texts.select("node", F.col("text").alias("text_a"))
        right = texts.select(F.col("node").alias("hub"), F.col("text").alias("text_b"))
        both = candidates.join(left.hint("merge"), "node").join(right.hint("merge"), "hub").select("node", "hub", "xs", "ys", "text_a", "text_b")
        out = stage(both.mapInArrow(run, PASSAGES).distinct(), "passages")
        unstage(candidates, texts)
        return out

    found = aligned(candidates)
    shared = chained.where("hub is null and size(seeds) > 1").select("node", "at", "seeds")
    wanted = stage(_open_keys(shared, found, s), "open")
    n = wanted.count()
    if n:
        holders = _key_holders(shared, bitmap(wanted.select(F.col("key").alias("h")), n), s)
        least = holders.groupBy("key").agg(F.min(F.struct("node", "y", "y2")).alias("least")).select("key", F.col("least.node").alias("hub"), "least.y", "least.y2")
        found = found.unionByName(aligned(stage(_by_key(wanted, least), "candidates"))).distinct()
    unstage(chained, wanted)
    found = found.join(firsts.select("node", F.col("first_id").alias("doc_id"), "digest").hint("merge"), "node")
    found = found.join(firsts.select(F.col("node").alias("hub"), F.col("first_id").alias("other_doc_id")).hint("merge"), "hub")
    every = found.select(copies.columns).unionByName(copies)
    return every.withColumn("text_sha256", F.lower(F.hex("digest"))).drop("digest")


def _texts(base: DataFrame, firsts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text) of some nodes: each text from the row with its least id."""
    wanted = stage(firsts.select("digest", "first_id", "node").join(nodes.select("node").hint("merge"), "node"), "wanted")
    keys = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS // 4 else wanted.hint("merge")  # a row has less than 64 bytes
    rows = base.join(keys, (base.digest == wanted.digest) & base.doc_id.eqNullSafe(wanted.first_id))
    return rows.groupBy("node").agg(F.first("text").alias("text"))  # rows may repeat


def list_rows(rows: Iterator[tuple], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows of two numbers and arrays as Arrow batches: one for each row would cost more than the row."""
    held, size = [], 0

    def batch() -> pa.RecordBatch:
        first, second, *lists = zip(*held, strict=True)
        columns = [pa.array(first, pa.int64()), pa.array(second, pa.int64())]
        for arrays in lists:
            columns.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32()), pa.array(np.concatenate(arrays))))
        held.clear()
        return pa.record_batch(columns, names)

    for row in rows:
        held.append(row)
        size += sum(map(len, row[2:]))
        if len(held) >= ROWS or size >= ELEMENTS:
            yield batch()
            size = 0
    if held:
        yield batch()


def _to_hubs(keys: DataFrame, own: bool) -> tuple[DataFrame, DataFrame]:
    """Places (hash, node, x) whose hash two nodes have, as (node, hub, x, y), dealt and sorted by pair; and the hubs, staged.

    The hub of a hash is its first place in the least node; with ``own`` the hub's places come as well, and all with their hash.
    """
    hubs = keys.groupBy("hash").agg(F.min(F.struct("node", "x")).alias("hub"), F.max("node").alias("last")).where("hub.node <> last")
    hubs = stage(hubs.select("hash", F.col("hub.node").alias("hub"), F.col("hub.x").alias("y")), "hubs")
    matches = keys.join(hubs.hint("merge"), "hash").select("node", "hub", "x", "y", *(["hash"] if own else []))
    return (matches if own else matches.where("node <> hub")).repartition("node").sortWithinPartitions("node", "hub", "x", "y"), hubs


def run_ends(keys: np.ndarray, x: np.ndarray, x2: np.ndarray, apart: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the places of one key that overlap from one to the next (as in text that repeats a few words), the first and the last."""
    order = np.lexsort((x2, x, keys))
    keys, x, x2 = keys[order], x[order], x2[order]
    new = (np.diff(keys) != 0) | (np.diff(x) >= apart)
    ends = np.append(True, new) | np.append(new, True)
    return keys[ends], x[ends], x2[ends]


def seed_pairs(x: np.ndarray, hashes: np.ndarray, least: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of seeds, sorted by place, whose places differ by ``least`` to ``most``: numbers of both, and the keys of the pairs."""
    for lag in range(1, len(x)):
        apart = x[lag:] - x[:-lag]
        if apart.min() > most:
            return
        i = np.flatnonzero((apart >= least) & (apart <= most))
        if len(i):
            yield i, i + lag, mix(mix(hashes[i].view(np.uint64)) + hashes[i + lag].view(np.uint64)).view(np.int64)


def _key_rows(batches: Iterator[pa.RecordBatch], least: int, most: int, keep: Callable, names: list[str], s: Settings) -> Iterator[pa.RecordBatch]:
    """(key, node, places of both seeds) of the pairs that ``keep`` marks, from rows of nodes with their shared seeds.

    The nodes of a slice are paired together: each has its places in a range of its own, too far from the next for a pair."""
    for batch in batches:
        sizes = pc.fill_null(pc.list_value_length(batch.column("at")), 0).to_numpy(zero_copy_only=False)
        for a, b in slices(sizes, PAIRED):
            part = batch.slice(a, b - a)
            nodes, owner = part.column("node").to_numpy(), np.repeat(np.arange(b - a, dtype=np.int64), sizes[a:b])
            at, hashes = (part.column(c).flatten().to_numpy() for c in ("at", "seeds"))
            x = (owner << 32) + (at >> 1)
            parts = []
            for i, j, keys in seed_pairs(x, hashes, least, most):
                some = keep(part, at, x, i, j, keys)
                if len(some):
                    parts.append(run_ends(keys[some], x[i[some]], x[j[some]], s.min_span))
            if parts:
                keys, first, second = run_ends(*(np.concatenate(c) for c in zip(*parts, strict=True)), s.min_span)
                yield pa.record_batch([pa.array(keys), pa.array(nodes[first >> 32]), *(pa.array((v & 0xFFFFFFFF).astype(np.int32)) for v in (first, second))], names)
    give_back()


def covered(x: np.ndarray, starts: np.ndarray, ends: np.ndarray, k: int) -> np.ndarray:
    """Which seeds of k words, at places x, lie whole in one of the spans."""
    order = np.argsort(starts)
    reach = np.maximum.accumulate(np.concatenate([[-1], ends[order]]))
    return reach[np.searchsorted(starts[order], x, "right")] >= x + k


def _open_keys(shared: DataFrame, found: DataFrame, s: Settings) -> DataFrame:
    """(key, node, x, x2): pairs of seeds that smaller nodes have and that no passage of the node covers both."""
    spans = found.groupBy("node").agg(F.collect_set(F.struct("start_word", "end_word")).alias("spans"))
    rows = shared.join(spans.hint("merge"), "node", "left").select("node", "at", "seeds", F.col("spans.start_word").alias("starts"), F.col("spans.end_word").alias("ends"))

    def keep(part: pa.RecordBatch, at: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray, keys: np.ndarray) -> np.ndarray:
        home = np.repeat(np.arange(part.num_rows) << 32, pc.fill_null(pc.list_value_length(part.column("starts")), 0).to_numpy(zero_copy_only=False))
        inside = covered(x, *(home + part.column(c).flatten().to_numpy() for c in ("starts", "ends")), s.k)
        lower = at & 1 == 1
        return np.flatnonzero(lower[i] & lower[j] & ~(inside[i] & inside[j]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _key_rows(batches, s.min_span - s.k, s.min_words, keep, ["key", "node", "x", "x2"], s)

    return rows.mapInArrow(run, "key long, node long, x int, x2 int")


def _key_holders(shared: DataFrame, wanted: Bitmap, s: Settings) -> DataFrame:
    """(key, node, y, y2): pairs of seeds of all nodes whose key may be wanted, by a bitmap."""
    sent = shared.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = sent.value
        yield from _key_rows(batches, 1, s.widest, lambda part, at, x, i, j, keys: np.flatnonzero(marked(marks, keys)), ["key", "node", "y", "y2"], s)

    return shared.mapInArrow(run, "key long, node long, y int, y2 int")


def _by_key(wanted: DataFrame, holders: DataFrame) -> DataFrame:
    """(node, hub, xs, ys): the places of the pairs of seeds that a node and a smaller one share."""
    both = wanted.join(holders.hint("merge"), "key").where("hub < node").select("node", "hub", F.explode(F.array(F.struct("x", "y"), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))).alias("p"))
    places = both.groupBy("node", "hub").agg(F.array_sort(F.collect_set("p")).alias("p"))
    return places.select("node", "hub", F.col("p.x").alias("xs"), F.col("p.y").alias("ys"))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], list[int], list[int], list[np.ndarray]]]:
    """The matches of each pair of documents, from rows sorted by pair; a pair may run over several Arrow batches."""
    pair, xs, ys, hashes = None, [], [], []
    for batch in batches:
        docs, hubs = batch.column("node").to_numpy(), batch.column("hub").to_numpy()
        if not len(docs):
            continue
        x, y = batch.column("x").to_pylist(), batch.column("y").to_pylist()
        h = batch.column("hash").to_numpy() if "hash" in batch.schema.names else None
        cuts = np.flatnonzero((np.diff(docs) != 0) | (np.diff(hubs) != 0)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(docs)], strict=True):
            now = (int(docs[a]), int(hubs[a]))
            if now != pair:
                if pair:
                    yield pair, xs, ys, hashes
                pair, xs, ys, hashes = now, [], [], []
            xs += x[a:b]
            ys += y[a:b]
            if h is not None:
                hashes.append(h[a:b])
    if pair:
        yield pair, xs, ys, hashes


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and the white space after them."""
    data, starts, _, _ = word_spans([text], lower=False)
    raw = data[:-1].tobytes()
    gone = np.zeros(len(starts), bool)
    for a, b in spans:
        gone[a:b] = True
    edges = np.append(starts, len(raw))
    keep = np.ones(len(raw), bool)
    for i in np.flatnonzero(gone).tolist():
        keep[edges[i] : edges[i + 1]] = False
    return np.frombuffer(raw, np.uint8)[keep].tobytes().decode("utf-8", "surrogatepass").strip()


def without_repeats(docs: DataFrame, settings: Settings | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the same columns, less the passages that a document with a smaller id has too.

    Documents are told apart by id and text. One with no passage stays as it is, null texts included; one that has no word
    left is dropped. Rows that repeat an id and a text are treated alike.
    """
    found = repeated_passages(docs, settings, id_col, text_col)
    spans = found.groupBy("doc_id", "text_sha256").agg(F.collect_set(F.struct("start_word", "end_word")).alias("spans"))
    mark, of, digest = (fresh(docs, name) for name in ("spans", "of", "digest"))
    spans = stage(spans.select(F.col("doc_id").alias(of), F.unhex("text_sha256").alias(digest), F.col("spans").alias(mark)), "spans")
    n = spans.count()
    hint = F.broadcast(spans) if n <= BROADCAST_ROWS // 20 else spans.hint("merge")  # a row of spans has a hundred bytes or so
    same = docs[id_col].cast("long").eqNullSafe(spans[of]) & (F.unhex(F.sha2(F.coalesce(docs[text_col], F.lit("")), 256)) == spans[digest])
    joined = docs.join(hint, same, "left")
    names = list(docs.columns)
    whole = joined.where(F.col(mark).isNull()).select(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(text_col).to_pylist()
                spans = part.column(mark).to_pylist()
                new = [cut_words(t or "", [(x["start_word"], x["end_word"]) for x in some]) for t, some in zip(texts, spans, strict=True)]
                columns = [pa.array(new, pa.string()) if c == text_col else part.column(c) for c in names]
                yield pa.RecordBatch.from_arrays(columns, names)
        give_back()

    cut = joined.where(F.col(mark).isNotNull()).select(*names, mark).mapInArrow(run, docs.schema).where(F.trim(F.col(text_col)) != "")
    return whole.unionByName(cut)
