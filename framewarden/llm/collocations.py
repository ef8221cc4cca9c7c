"""Frequent phrases of a language and how firmly their words belong together, mined level by level over occurrence relations.

The relation of length k holds (piece, place, phrase) of every occurrence of a frequent phrase of k words, sorted, in blocks that are
rows of a written table; for single words the texts are read twice, to count and to write. A level merge-joins the relation below with itself where two phrases of one piece begin at adjacent places, counts
the longer phrases in each block, adds the counts of all blocks up in a shuffle, and keeps those that are frequent; the relation
is then semi-joined with them before it is extended again.

- A piece never leaves its block, so the merge-join needs no shuffle: places are numbered with a gap between pieces, and the
  sorted relation is held against itself one row on.
- Before the longer phrases are counted by their words, they are counted by 32 bits of hash: only phrases whose hash is frequent
  are shuffled with their words, and these counts are the ones that decide.
- Words are 64-bit hashes with a seed. The first count also holds the least and the greatest word of each hash; if two words
  share one, all starts again with another seed. So the counts are exact.
- A block is written in the bytes it needs: words and phrases by their numbers in the block, the commonest words first, the bytes of
  the numbers apart by their weight, so that the table's compression finds them alike.
- The semi-join goes by a bitmap of the frequent phrases' hashes, of 32 MB at most whatever their number. What it lets through
  wrongly doesn't count: a longer phrase is only kept by its own exact count, and it can't be more frequent than its parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import shuffles_dropped, stage, text_batches, unstage
from .words import POWERS, give_back, mix, text_slices

#: Words of a block; a block ends at the end of a slice of texts.
BLOCK = 1 << 19
#: Phrases' hashes that a task adds up at a time, and the bits of a hash of 32 bits within a part of their range.
HELD, LOW_BITS = 1 << 20, 20
#: Bits of the bitmap: eight for each frequent phrase, within these bounds, and how many of them a phrase sets at most.
FEWEST_BITS, MOST_BITS, MOST_PROBES = 1 << 20, 1 << 28, 4
#: Rows of (language, hash, count) that may be broadcast; their number is counted before.
BROADCAST_ROWS = 200_000
#: Parts of a language that are ranked apart before the best of each are ranked together.
PARTS = 64

PIECE_END = np.zeros(256, bool)
PIECE_END[[*range(10, 14), *b".,;:!?"]] = True
APART = PIECE_END.copy()
APART[[9, 32]] = True
LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))


def occurrences(texts: list[str], seed: int, spell: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Hashes of all words in order, whether a new piece begins at each, and the distinct hashes with their words if they are to be spelt."""
    raw = "\n".join([*texts, ""]).encode("utf-8", "surrogatepass").translate(LOWER)
    data = np.frombuffer(raw, np.uint8)
    inside = np.concatenate([[False], ~APART[data], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    values = mix(np.arange(256, dtype=np.uint64) + np.uint64(seed << 8))
    up, down = POWERS.get(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * up[:-1], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts]).view(np.int64)
    breaks = np.concatenate([[0], np.cumsum(PIECE_END[data])])
    new = np.ones(len(starts), bool)
    new[1:] = breaks[starts[1:]] != breaks[ends[:-1]]
    if not spell:
        return hashes, new, hashes[:0], []
    distinct, first = np.unique(hashes, return_index=True)
    return hashes, new, distinct, [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]


def planes(values: np.ndarray) -> bytes:
    """Numbers of 32 bits: how many bytes each needs, then the lowest bytes of all, the next ones, and so on."""
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + values.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width].T.tobytes()


def unplaned(data: pa.Buffer | bytes) -> np.ndarray:
    data = np.frombuffer(data, np.uint8)
    width, rows = int(data[0]), data[1:].reshape(data[0], -1)
    out = rows[0].astype(np.int32)
    for i in range(1, width):
        out |= rows[i].astype(np.int32) << (8 * i)
    return out


class Block:
    """Occurrences of one language: places (one more than the last within a piece), phrase of each, and the words of the phrases."""

    def __init__(self, at: np.ndarray, phrase: np.ndarray, words: np.ndarray) -> None:
        self.at, self.phrase, self.words = at, phrase, words  # words: a row of hashes for each phrase

    def row(self, lang: str) -> list[pa.Array]:
        """Single words as they are; of longer phrases each word once, and the numbers of their words."""
        words, parts = self.words.ravel(), b""
        if self.words.shape[1] > 1:
            words, own = np.unique(words, return_inverse=True)
            parts = planes(own.reshape(self.words.shape).T.ravel())
        steps = np.diff(self.at, prepend=np.int64(0))
        return [pa.array([lang]), *(pa.array([v], pa.binary()) for v in (planes(steps), planes(self.phrase), parts)), pa.array([words])]

    @classmethod
    def of(cls, batch: pa.RecordBatch, i: int, k: int) -> Block:
        steps, phrase = (unplaned(batch.column(c)[i].as_buffer()) for c in ("steps", "phrase"))
        words = batch.column("words")[i].values.to_numpy()
        if k > 1:
            words = words[unplaned(batch.column("parts")[i].as_buffer())]
        return cls(np.cumsum(steps, dtype=np.int64), phrase, np.ascontiguousarray(words.reshape(k, -1).T))

    def semi_join(self, keep: np.ndarray) -> Block:
        """The occurrences whose phrase is to be kept."""
        stay, number = keep[self.phrase], np.cumsum(keep) - 1
        return Block(self.at[stay], number[self.phrase[stay]], self.words[keep])

    def _pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """The occurrences that another one follows at the next place, and both phrases as one number."""
        i = np.flatnonzero(self.at[1:] == self.at[:-1] + 1)
        return i, self.phrase[i].astype(np.int64) << 32 | self.phrase[i + 1]

    def _joined(self, pairs: np.ndarray) -> np.ndarray:
        return np.concatenate([self.words[pairs >> 32], self.words[pairs & 0xFFFFFFFF][:, -1:]], axis=1)

    def merge_join(self) -> Block:
        """Occurrences one word longer: where two of this relation begin at adjacent places."""
        i, pairs = self._pairs()
        distinct, phrase = np.unique(pairs, return_inverse=True)
        return Block(self.at[i], phrase, self._joined(distinct))

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """The phrases of the merge-join and how often each occurs."""
        distinct, counts = np.unique(self._pairs()[1], return_counts=True)
        return self._joined(distinct), counts


def phrase_hashes(words: np.ndarray) -> np.ndarray:
    """32 bits of hash of each phrase."""
    out = np.zeros(len(words), np.uint64)
    for column in words.T:
        out = mix(out * np.uint64(31) + column.astype(np.uint64))
    return (out & np.uint64(0xFFFFFFFF)).astype(np.int64)


def hashes_of(frequent: DataFrame, k: int) -> DataFrame:
    """(h): the hashes of the phrases in a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.record_batch([pa.array(phrase_hashes(np.stack([c.to_numpy() for c in batch.columns], axis=1)))], ["h"])

    return frequent.select(*names(k)).mapInArrow(run, "h long")


class Bitmap(NamedTuple):
    """A set of hashes: each has ``probes`` bits set. It may hold others too, as likely for many hashes as for few."""

    bits: np.ndarray
    probes: int


def probe(hashes: np.ndarray, i: int, bits: int) -> np.ndarray:
    """The place of the i-th bit of each hash."""
    return (mix(hashes.view(np.uint64) + np.uint64(i)).view(np.int64) if i else hashes) & (bits - 1)


def bitmap(hashes: DataFrame, n: int) -> Bitmap:
    """The set of n hashes: at most MOST_BITS bits, put together by Spark."""
    bits = min(MOST_BITS, max(FEWEST_BITS, 1 << (8 * n).bit_length()))
    probes = max(1, min(MOST_PROBES, 2 * bits // (3 * max(n, 1))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column("h").to_numpy()
            for i in range(probes):
                at = probe(h, i, bits)
                yield pa.record_batch([pa.array(at >> 6), pa.array(np.int64(1) << (at & 63))], ["at", "bit"])

    marked = hashes.select("h").mapInArrow(run, "at long, bit long").groupBy("at").agg(F.bit_or("bit").alias("bit")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[marked.column("at").to_numpy()] = marked.column("bit").to_numpy()
    return Bitmap(np.unpackbits(out.view(np.uint8), bitorder="little").view(bool) if bits <= 1 << 24 else out, probes)


def has_bits(bits: np.ndarray, hashes: np.ndarray, i: int = 0) -> np.ndarray:
    """Which hashes have their i-th bit set."""
    if bits.dtype == bool:
        return bits[probe(hashes, i, len(bits))]
    at = probe(hashes, i, 64 * len(bits))
    return (bits[at >> 6] >> (at & 63)) & 1 == 1


def marked(bitmap: Bitmap | np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes may be among those of the bitmap; an array alone has one bit a hash."""
    bits, probes = bitmap if isinstance(bitmap, Bitmap) else (bitmap, 1)
    out = has_bits(bits, hashes)
    for i in range(1, probes):
        left = np.flatnonzero(out)
        out[left] = has_bits(bits, hashes[left], i)
    return out


def in_bitmap(bitmap: Bitmap | np.ndarray, words: np.ndarray) -> np.ndarray:
    return marked(bitmap, phrase_hashes(words))


def names(k: int) -> list[str]:
    return [f"w{i}" for i in range(1, k + 1)]


RELATION = "lang string, steps binary, phrase binary, parts binary, words array<long>"
COLUMNS = ["lang", "steps", "phrase", "parts", "words"]


def first_words(batches: Iterator[pa.RecordBatch], seed: int, spell: bool) -> Iterator[tuple[str, list]]:
    """What `occurrences` gives of the texts of a block, in parts, with their language."""
    held: dict[str, list] = {}
    size = 0
    for batch in batches:
        for part, texts in text_slices(batch):
            by_lang: dict[str, list[str]] = {}
            for name, text in zip(part.column("lang").to_pylist(), texts, strict=True):
                by_lang.setdefault(name, []).append(text)
            for name, own in by_lang.items():
                hashes, new, distinct, spelt = occurrences(own, seed, spell)
                held.setdefault(name, []).append((hashes, new, distinct, pa.array(spelt, pa.binary()).cast(pa.string())))
                size += len(hashes)
            if size > BLOCK:
                yield from held.items()
                held, size = {}, 0
    yield from held.items()


def first_relation(docs: DataFrame, lang: Column, text_col: str, seed: int) -> DataFrame:
    """(lang, words, counts, spelt): the hashes of the single words of each block, their counts, and the words as text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, parts in first_words(batches, seed, True):
            distinct, counts = np.unique(np.concatenate([p[0] for p in parts]), return_counts=True)
            if len(distinct):
                at = np.unique(np.concatenate([p[2] for p in parts]), return_index=True)[1]
                spelt = pa.concat_arrays([p[3] for p in parts]).take(pa.array(at))
                listed = pa.ListArray.from_arrays(pa.array([0, len(spelt)], pa.int32()), spelt)
                yield pa.record_batch([pa.array([name]), pa.array([distinct]), pa.array([counts]), listed], ["lang", "words", "counts", "spelt"])
        give_back()

    base = docs.select(lang.alias("lang"), F.col(text_col).alias("text"))
    return base.mapInArrow(run, "lang string, words array<long>, counts array<long>, spelt array<string>")


def frequent_relation(docs: DataFrame, lang: Column, text_col: str, seed: int, keep: Broadcast) -> DataFrame:
    """The relation of single words semi-joined with the bitmap of the frequent ones; ``total``: all words of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, parts in first_words(batches, seed, False):
            hashes, new = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            if len(hashes):
                distinct, phrase, counts = np.unique(hashes, return_inverse=True, return_counts=True)
                order = np.argsort(-counts, kind="stable")
                block = Block(np.arange(len(hashes)) + np.cumsum(new), np.argsort(order)[phrase], distinct[order][:, None])
                block = block.semi_join(in_bitmap(keep.value, block.words))
                yield pa.record_batch([*block.row(name), pa.array([len(hashes)], pa.int64())], [*COLUMNS, "total"])
        give_back()

    base = docs.select(lang.alias("lang"), F.col(text_col).alias("text"))
    return base.mapInArrow(run, f"{RELATION}, total long")


def packed(h: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Ascending hashes of 32 bits and their counts, a row for each part of the hashes' range: the steps from hash to hash and the counts,
    each in as few bytes as the largest needs."""
    part = h >> LOW_BITS
    starts = np.flatnonzero(np.diff(part, prepend=np.int64(-1)))
    ends = np.append(starts, len(h))[1:]
    steps = np.diff(h, prepend=np.int64(0))
    steps[starts] = h[starts] & ((1 << LOW_BITS) - 1)
    columns = []
    for values in (steps, n):
        kinds = map(np.min_scalar_type, np.maximum.reduceat(values, starts).tolist() if len(h) else [])
        columns.append(pa.array([values[a:b].astype(kind).tobytes() for a, b, kind in zip(starts.tolist(), ends.tolist(), kinds, strict=True)], pa.binary()))
    return pa.record_batch([pa.array(part[starts].astype(np.int32)), pa.array((ends - starts).astype(np.int32)), *columns], ["part", "size", "steps", "counts"])


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The hashes and counts of each part, from rows sorted by part: those of one row ascend, the rows of a part follow each other."""
    part, hashes, counts = None, [], []
    for batch in batches:
        for now, size, steps, n in zip(*(batch.column(c).to_pylist() for c in ("part", "size", "steps", "counts")), strict=True):
            if now != part and hashes:
                yield np.concatenate(hashes), np.concatenate(counts)
                hashes, counts = [], []
            part = now
            hashes.append((now << LOW_BITS) + np.cumsum(np.frombuffer(steps, f"u{len(steps) // size}"), dtype=np.int64))
            counts.append(np.frombuffer(n, f"u{len(n) // size}").astype(np.int64))
    if hashes:
        yield np.concatenate(hashes), np.concatenate(counts)


def busy_buckets(relation: DataFrame, k: int, keep: Broadcast, often: int) -> DataFrame:
    """(h): the hashes under which phrases of k + 1 words occur ``often`` times together, from the relation of length k semi-joined with
    the bitmap of its frequent phrases. Every frequent phrase has one of them, few others do. What a task has added up is shuffled
    by parts of the hashes' range, some three bytes a hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            h, at = np.unique(np.concatenate([h for h, _ in held]), return_inverse=True)
            n = np.bincount(at, np.concatenate([n for _, n in held]), len(h)).astype(np.int64)
            held.clear()
            yield packed(h, n)

        for batch in batches:
            for i in range(batch.num_rows):
                below = Block.of(batch, i, k)
                phrases, counts = below.semi_join(in_bitmap(keep.value, below.words)).counts()
                held.append((phrase_hashes(phrases), counts))
                if sum(len(h) for h, _ in held) > HELD:
                    yield from flush()
        if held:
            yield from flush()
        give_back()

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, n in unpacked(batches):
            distinct, at = np.unique(h, return_inverse=True)
            yield pa.record_batch([pa.array(distinct[np.bincount(at, n, len(distinct)) >= often])], ["h"])
        give_back()

    counts = relation.select(COLUMNS).mapInArrow(run, "part int, size int, steps binary, counts binary")
    return counts.repartition("part").sortWithinPartitions("part").mapInArrow(add_up, "h long")


def counts_of_longer(relation: DataFrame, k: int, keep: Broadcast, busy: Broadcast) -> DataFrame:
    """(lang, w1.., n): how often each phrase of k + 1 words occurs, if its hash is in the bitmap ``busy``; all counts are whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, lang in enumerate(batch.column("lang").to_pylist()):
                below = Block.of(batch, i, k)
                phrases, counts = below.semi_join(in_bitmap(keep.value, below.words)).counts()
                some = in_bitmap(busy.value, phrases)
                phrases, counts = phrases[some], counts[some]
                for a in range(0, len(counts), 1 << 16):
                    n = counts[a : a + (1 << 16)]
                    words = np.ascontiguousarray(phrases[a : a + len(n)].T)
                    yield pa.record_batch([pa.repeat(pa.scalar(lang), len(n)), *map(pa.array, words), pa.array(n)], ["lang", *names(k + 1), "n"])
        give_back()

    counts = relation.select(COLUMNS).mapInArrow(run, f"lang string, {', '.join(f'{w} long' for w in names(k + 1))}, n long")
    return counts.groupBy("lang", *names(k + 1)).agg(F.sum("n").alias("n"))


def longer_relation(relation: DataFrame, k: int, keep: Broadcast, keep_longer: Broadcast) -> DataFrame:
    """The relation of length k + 1 semi-joined with the bitmap of its frequent phrases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, lang in enumerate(batch.column("lang").to_pylist()):
                below = Block.of(batch, i, k)
                block = below.semi_join(in_bitmap(keep.value, below.words)).merge_join()
                block = block.semi_join(in_bitmap(keep_longer.value, block.words))
                if len(block.at):
                    yield pa.record_batch(block.row(lang), COLUMNS)
        give_back()

    return relation.select(COLUMNS).mapInArrow(run, RELATION)


class Levels(NamedTuple):
    """Written tables: totals (lang, total), words (lang, w1, n, word), phrases of each length (lang, w1.., n); rows of each."""

    totals: DataFrame
    words: DataFrame
    phrases: dict[int, DataFrame]
    sizes: dict[int, int]

    def table(self, k: int) -> DataFrame:
        return self.words.select("lang", "w1", "n") if k == 1 else self.phrases[k]


def mine(docs: DataFrame, longest: int, often: int, lang: Column, text_col: str) -> Levels:
    """All phrases of up to ``longest`` words that occur ``often`` times in their language, with exact counts."""
    for seed in range(1, 9):
        listed = first_relation(docs, lang, text_col, seed).select("lang", F.inline(F.arrays_zip(F.col("words").alias("w1"), F.col("counts").alias("n"), F.col("spelt").alias("word"))))
        summed = listed.groupBy("lang", "w1").agg(F.sum("n").alias("n"), F.min("word").alias("word"), F.max("word").alias("other"))
        words = stage(summed.where((F.col("n") >= often) | (F.col("word") != F.col("other"))), "words")
        if not words.where("word != other").limit(1).count():
            break
        unstage(words)
    else:
        raise ValueError("no seed gives all words hashes of their own")
    n_words = words.count()
    send = docs.sparkSession.sparkContext.broadcast
    keep = send(bitmap(hashes_of(words, 1), n_words))
    relation = stage(frequent_relation(docs, lang, text_col, seed, keep), "occurrences-1", compression="zstd")
    totals = stage(relation.groupBy("lang").agg(F.sum("total").alias("total")), "totals")
    found = Levels(totals, words, {}, {0: totals.count(), 1: n_words})
    for k in range(1, longest):
        buckets = stage(busy_buckets(relation, k, keep, often), "buckets")
        busy = send(bitmap(buckets, buckets.count()))
        unstage(buckets)
        longer = found.phrases[k + 1] = stage(counts_of_longer(relation, k, keep, busy).where(F.col("n") >= often), f"phrases-{k + 1}")
        found.sizes[k + 1] = longer.count()
        busy.destroy()
        if k + 1 < longest:
            keep_longer = send(bitmap(hashes_of(longer, k + 1), found.sizes[k + 1]))
            below, relation = relation, stage(longer_relation(relation, k, keep, keep_longer), f"occurrences-{k + 1}", compression="zstd")
            unstage(below)
            keep.destroy()
            keep = keep_longer
    keep.destroy()
    unstage(relation)
    return found


def look_up(df: DataFrame, table: DataFrame, rows: int, keys: list[str], of: list[str], **values: str) -> DataFrame:
    """``df`` with ``values`` (new name: column of ``table``) of the row of ``table`` whose ``of`` equals ``keys``, language aside."""
    side = table.select(F.col("lang").alias("_lang"), *(F.col(c).alias(f"_{c}") for c in of), *(F.col(c).alias(name) for name, c in values.items()))
    side = F.broadcast(side) if rows <= BROADCAST_ROWS else side.hint("merge")
    same = F.col("lang") == F.col("_lang")
    for key, c in zip(keys, of, strict=True):
        same &= F.col(key) == F.col(f"_{c}")
    return df.join(side, same, "left").drop("_lang", *(f"_{c}" for c in of))


def scored(found: Levels, j: int) -> DataFrame:
    """(lang, w1.., phrase, a, l, r, n, score) of the phrases of j words; the cut with the lowest score counts.

    Products are decimals of 38 digits: exact for counts below 10^15, beyond them Spark reports an overflow.
    """
    df = found.phrases[j].withColumnRenamed("n", "a")
    for i, w in enumerate(names(j)):
        wanted = {f"word{i}": "word"} | ({"l1": "n"} if i == 0 else {}) | ({f"r{j - 1}": "n"} if i == j - 1 else {})
        df = look_up(df, found.words, found.sizes[1], [w], ["w1"], **wanted)
    for k in range(2, j):
        df = look_up(df, found.table(k), found.sizes[k], names(j)[:k], names(k), **{f"l{k}": "n"})
        df = look_up(df, found.table(k), found.sizes[k], names(j)[-k:], names(k), **{f"r{j - k}": "n"})
    df = look_up(df, found.totals, found.sizes[0], [], [], n="total")
    wide = "decimal(19,0)"
    cuts = [F.struct(F.expr(f"1000000 * (cast(a as {wide}) * cast(a as {wide})) div (cast(l{k} as {wide}) * cast(r{k} as {wide}))").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in range(1, j)]
    phrase = F.concat_ws(" ", *(f"word{i}" for i in range(j))).alias("phrase")
    return df.withColumn("cut", F.array_min(F.array(*cuts))).select("lang", *names(j), phrase, "a", "cut.l", "cut.r", "n", "cut.score")


def uncovered(found: Levels, longest: int, covered: int) -> DataFrame:
    """The scored phrases that no longer phrase holds with at least ``covered`` per cent of their occurrences."""
    out = None
    for i in range(2, longest + 1):
        own = scored(found, i)
        parts = [found.phrases[j].select("lang", *(F.col(f"w{at + m}").alias(f"w{m}") for m in range(1, i + 1)), "n") for j in range(i + 1, longest + 1) for at in range(j - i + 1)]
        if parts:
            holders = reduce(DataFrame.unionByName, parts).groupBy("lang", *names(i)).agg(F.max("n").alias("n"))
            rows = sum(found.sizes[j] * (j - i + 1) for j in range(i + 1, longest + 1))
            own = look_up(own, holders, rows, names(i), names(i), most="n").where(F.col("most").isNull() | (100 * F.col("most") < covered * F.col("a"))).drop("most")
        own = own.drop(*names(i))
        out = own if out is None else out.unionByName(own)
    return out


def collocations(docs: DataFrame, longest: int = 3, often: int = 10, covered: int = 50, best: int = 2000, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The ``best`` phrases of each language: lang, rank, phrase, a, l, r, n, score (all counts exact).

    A phrase has 2 to ``longest`` words of one piece of text and occurs ``often`` times (a). A cut after its first words gives l
    and r, the counts of both parts, and floor(1000000 a a / (l r)); the lowest of all cuts is its score. n is the number of words
    of the language. Phrases that lie in a longer one with ``covered`` per cent of their occurrences are left out. Ranks go by
    score and a, highest first, then phrase.

    Null texts and texts without words count nothing; a null language is ``und``; rows that repeat count each; other columns
    are not read. A language none of whose phrases is frequent has no rows.
    """
    text_batches(docs.sparkSession)
    with shuffles_dropped(docs.sparkSession):
        found = mine(docs, longest, often, F.coalesce(F.col(lang_col).cast("string"), F.lit("und")), text_col)
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    parts = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).orderBy(*order)
    first = uncovered(found, longest, covered).withColumn("rank", F.row_number().over(parts)).where(F.col("rank") <= best)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= best)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


#: The same in SQL, for phrases of two and three words.
ORACLE_SQL = r"""
WITH pieces AS (SELECT row_number() OVER () AS piece, lang, piece AS body FROM (SELECT coalesce(lang, 'und') AS lang,
  unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')) AS piece FROM documents) t),
w AS (SELECT piece, lang, list_filter(regexp_split_to_array(body, '[ 	]+'), lambda x: x <> '') AS ws FROM pieces),
f1 AS (SELECT lang, w1, count(*) AS n FROM (SELECT lang, unnest(ws) AS w1 FROM w) t GROUP BY ALL),
total AS (SELECT lang, sum(n) AS n FROM f1 GROUP BY lang),
o AS (SELECT lang, ws, unnest(range(1, len(ws))) AS i FROM w),
f2 AS (SELECT lang, ws[i] AS w1, ws[i + 1] AS w2, count(*) AS n FROM o GROUP BY ALL),
f3 AS (SELECT lang, ws[i] AS w1, ws[i + 1] AS w2, ws[i + 2] AS w3, count(*) AS n FROM o WHERE i + 2 <= len(ws) GROUP BY ALL HAVING count(*) >= 10),
held AS (SELECT lang, w1, w2, max(n) AS most FROM (SELECT lang, w1, w2, n FROM f3 UNION ALL SELECT lang, w2, w3, n FROM f3) t GROUP BY ALL),
cuts AS (
  SELECT p.lang, concat(p.w1, ' ', p.w2) AS phrase, p.n AS a, 1 AS k, x.n AS l, y.n AS r
  FROM f2 p JOIN f1 x ON x.lang = p.lang AND x.w1 = p.w1 JOIN f1 y ON y.lang = p.lang AND y.w1 = p.w2
  LEFT JOIN held h ON h.lang = p.lang AND h.w1 = p.w1 AND h.w2 = p.w2 WHERE p.n >= 10 AND (h.most IS NULL OR 100 * h.most < 50 * p.n)
  UNION ALL
  SELECT p.lang, concat(p.w1, ' ', p.w2, ' ', p.w3), p.n, 1, x.n, y.n
  FROM f3 p JOIN f1 x ON x.lang = p.lang AND x.w1 = p.w1 JOIN f2 y ON y.lang = p.lang AND y.w1 = p.w2 AND y.w2 = p.w3
  UNION ALL
  SELECT p.lang, concat(p.w1, ' ', p.w2, ' ', p.w3), p.n, 2, x.n, y.n
  FROM f3 p JOIN f2 x ON x.lang = p.lang AND x.w1 = p.w1 AND x.w2 = p.w2 JOIN f1 y ON y.lang = p.lang AND y.w1 = p.w3),
s AS (SELECT *, CAST(CAST(1000000 AS HUGEINT) * a * a // (CAST(l AS HUGEINT) * r) AS BIGINT) AS score FROM cuts),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS c FROM s) t WHERE c = 1),
z AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b)
SELECT z.lang, CAST(z.rank AS BIGINT) AS rank, z.phrase, CAST(z.a AS BIGINT) AS a, CAST(z.l AS BIGINT) AS l, CAST(z.r AS BIGINT) AS r, CAST(t.n AS BIGINT) AS n, z.score
FROM z JOIN total t ON t.lang = z.lang WHERE z.rank <= 2000"""
