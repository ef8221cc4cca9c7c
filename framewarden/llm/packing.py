"""Best-fit packing of tokenised documents into sequences of bounded length, by rounds of a tree.

Each task packs the pieces that it has best-fit, longest first: a piece goes into the open bin with the least room that
holds it. A bin whose room is less than the shortest bin anywhere, or no more than one token in 512, is nearly full and leaves.
The bins that are left are the items of the next round, in fewer tasks, until one task has packed them all (no two bins of a
best-fit packing fit together) or a round in as few tasks as their number allows brings no more. A task never packs more than
``MOST`` items at a time.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import SLICE, Encoder, WordTokenizer
from .staging import stage, text_batches
from .words import give_back, text_slices

#: Items in a task of a merging round, and how many tasks of one round meet in one of the next.
MOST, FAN_IN = 200_000, 8
#: A bin with room for no more than this part of a sequence is nearly full.
NEARLY = 1 / 512

PIECE = "struct<doc_id: bigint, piece: int, start: bigint, length: bigint, ids_crc32: bigint>"


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: bins as lists of item numbers. Room is looked up in a bit mask of the rooms there are."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    for i in sorted(range(len(sizes)), key=sizes.__getitem__, reverse=True):
        size = sizes[i]
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[at].append(i)
            room -= size
        else:
            at, room = len(bins), capacity - size
            bins.append([i])
        if room:
            by_room[room].append(at)
            rooms |= 1 << room
    return bins


def _packed(fill: list[int], offsets: list[int], members: pa.StructArray, capacity: int) -> pa.RecordBatch:
    """Bins (fill, members) of items; item i has the members from offsets[i] to offsets[i + 1]."""
    take, ends, fills = [], [0], []
    for one in best_fit(fill, capacity):
        for i in one:
            take.extend(range(offsets[i], offsets[i + 1]))
        ends.append(len(take))
        fills.append(sum(fill[i] for i in one))
    out = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), members.take(pa.array(take, pa.int64())))
    return pa.record_batch([pa.array(fills, pa.int64()), out], ["fill", "members"])


def _pack_documents(docs: DataFrame, path: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Bins of the pieces of the documents, each task for itself and at most ``MOST`` pieces at a time.

    The pieces of a document are its ids and then ``end_id``, cut only where they are longer than a sequence."""
    sent = docs.sparkSession.sparkContext.broadcast(WordTokenizer(path))
    end = end_id.to_bytes(4, "little")
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(sent.value)
        columns: list[list] = [[], [], [], [], []]

        def bins() -> Iterator[pa.RecordBatch]:
            if columns[0]:
                members = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)
                yield _packed(columns[3], list(range(len(members) + 1)), members, capacity)
                for c in columns:
                    c.clear()

        for batch in batches:
            for part, texts in text_slices(batch, most=SLICE):
                for doc_id, (ids, _) in zip(part.column("doc_id").to_pylist(), encoder(texts), strict=True):
                    ids += end
                    for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                        some = ids[at : at + 4 * capacity]
                        for column, value in zip(columns, (doc_id, n, at // 4, len(some) // 4, zlib.crc32(some)), strict=True):
                            column.append(value)
                    if len(columns[0]) >= MOST:
                        yield from bins()
        del encoder
        yield from bins()
        give_back()

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return base.mapInArrow(run, f"fill long, members array<{PIECE}>")


def _pack(items: DataFrame, capacity: int) -> DataFrame:
    """items (fill, members) -> bins (fill, members), each task for itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if parts:
            table = pa.Table.from_batches(parts)
            members = table.column("members").combine_chunks()
            members = members.chunk(0) if isinstance(members, pa.ChunkedArray) else members
            yield _packed(table.column("fill").to_pylist(), members.offsets.to_pylist(), members.values, capacity)
        give_back()

    return items.mapInArrow(run, f"fill long, members array<{PIECE}>")


def pack_documents(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    ``path`` is a tokenizer file. A null or empty text is the end id alone. Rows that repeat are packed each; a null
    doc_id is carried through; other columns are not read. An empty table gives no rows.
    """
    text_batches(docs.sparkSession)
    spark = docs.sparkSession
    bins = stage(_pack_documents(docs, path, capacity, end_id, id_col, text_col), "bins")
    tasks = max(1, bins.rdd.getNumPartitions())
    done = None
    while True:
        shortest, n = bins.agg(F.min("fill"), F.count("*")).first()
        full = F.col("fill") > capacity - max(shortest or 0, int(capacity * NEARLY) + 1)
        closed, open_bins = bins.where(full), bins.where(~full)
        done = closed if done is None else done.unionByName(closed)
        n_open = open_bins.count()
        if n_open <= 1:
            done = done.unionByName(open_bins)
            break
        least = -(-n_open // MOST)
        last = tasks <= least
        tasks = max(least, tasks // FAN_IN, 1)
        merged = stage(_pack(open_bins.repartition(tasks), capacity), "bins")
        if tasks == 1 or last and merged.count() >= n_open:
            done = done.unionByName(merged)
            break
        bins = merged
    numbered = done.select("members", F.monotonically_increasing_id().alias("sequence_id"))
    # the place of a member is what the members before it hold
    ends = F.aggregate(
        "members",
        F.array(F.lit(0).cast("long")),
        lambda s, p: F.concat(s, F.array(F.element_at(s, -1) + p["length"])),
    )
    rows = numbered.select("sequence_id", F.explode(F.arrays_zip(F.col("members").alias("m"), ends.alias("offset"))).alias("x")).where("x.m is not null")
    return rows.select("x.m.doc_id", "x.m.piece", "x.m.start", "x.m.length", "x.m.ids_crc32", "sequence_id", F.col("x.offset").alias("offset"))
