"""Near-duplicates: BagMinHash signatures of shingle multisets, banding, exact multiset overlap of the candidates.

Signature. The count w of a shingle is a weight discretised to the levels 0, 1, 2, ... Each shingle carries a Poisson
process over (time, level) whose level axis is cut hierarchically, first into [0,1), [1,2), [2,4), [4,8), ..., then each
of these by halves. Every such interval has a generator of its own, seeded by shingle and interval; a point belongs to a
component of the signature chosen by it. An interval that the weight covers whole gives all its points; one that it
covers in part is split: each point falls into either half by a fair bit, the half is kept or dropped. A component is the
least time over all points under the weights, so two texts agree in a component with probability equal to their weighted
Jaccard similarity, without bias. Times beyond a limit (by the text's total weight) are not made; in the rare text that
leaves a component without a point the limit is doubled.

Candidates. Equal texts are one node first. Bands of the signature give buckets; in a bucket each node is held against
one hub, the least, so pairs stay in proportion to the rows whatever the size of a bucket. What is then in its hub's class is
settled. The nodes of a hub's buckets are its group; they can be near each other though far from the hub. As sets of
(shingle, level), let M be what more than half of a group has, and E(a) where node a departs from M. Nodes a and b of n and m
shingles are alike to t if and only if E(a) and E(b) share at least (f(a) + f(b)) / 2 elements, f(a) = |E(a)| - n (1 - t) / (1 + t).
So the node of least f links all that needs no shared element, and any other link needs elements of E that both have: those
that one node alone has count for nothing, and the nodes that can still reach each other are joined on the rarest of them
(a prefix filter). This is exact: no link between two nodes of a bucket is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import semi_join, stage, text_batches, unstage
from .words import give_back, mix, shingle_multiset, shingles, slices, text_slices, word_hashes

COMPONENTS_SEED = np.uint64(0xD6E8FEB86659FD93)


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * (1.0 / (1 << 53))


def signatures(values: np.ndarray, counts: np.ndarray, owner: np.ndarray, n: int, m: int) -> np.ndarray:
    """BagMinHash signatures (n x m times) of n multisets given as (value, count, owner) rows; inf where there is no value."""
    out = np.full((n, m), np.inf)
    total = np.bincount(owner, counts, minlength=n)
    todo = total > 0
    # A component of a text of weight W gets its first point at rate W: the expected latest of m is about (ln m + 0.6) / W.
    limit = np.divide(np.log(m) + 5.0, total, out=np.zeros(n), where=todo)
    while todo.any():
        mine = todo[owner]
        _fill(out, values[mine], counts[mine], owner[mine], limit, m)
        todo &= np.isinf(out).any(axis=1)
        limit[todo] *= 2
    return out


def _fill(out: np.ndarray, values: np.ndarray, counts: np.ndarray, owner: np.ndarray, limit: np.ndarray, m: int) -> None:
    """Lower ``out`` by every point before the owner's limit."""
    top = int(counts.max())
    low, width = 0, 1
    while low < top:  # the intervals [0,1), [1,2), [2,4), ...
        reach = counts > low
        v, c, o = values[reach], counts[reach], owner[reach]
        _points(out, mix(v ^ mix(np.full(len(v), low + 1, np.uint64))), c, o, limit, m, low, width)
        low, width = low + width, max(1, low + width)


def _points(out: np.ndarray, seed: np.ndarray, counts: np.ndarray, owner: np.ndarray, limit: np.ndarray, m: int, low: int, width: int) -> None:
    time = np.zeros(len(seed))
    state = seed
    whole_row = out.reshape(-1)
    while len(seed):
        state = mix(state + COMPONENTS_SEED)
        time = time - np.log(_uniform(state)) / (width * m)
        live = time < limit[owner]
        seed, counts, owner, time, state = seed[live], counts[live], owner[live], time[live], state[live]
        bits = mix(state ^ COMPONENTS_SEED)
        component = (bits % np.uint64(m)).astype(np.int64)
        # Where the weight covers the interval in part, the point goes down by halves until it is under the weight or above.
        under = counts >= low + width
        if not under.all():
            part = np.flatnonzero(~under)
            lo, size, draw = np.full(len(part), low), width, mix(bits[part])
            c = counts[part]
            while size > 1:
                size //= 2
                lo = lo + size * (draw & np.uint64(1)).astype(np.int64)
                draw = draw >> np.uint64(1)
            under[part] = lo < c
        np.minimum.at(whole_row, owner[under] * m + component[under], time[under])


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    """A 64-bit key for each band of each signature; it also depends on the band's number."""
    n, m = signature.shape
    bits = signature.view(np.uint64).reshape(n, bands, m // bands)
    key = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64)), (n, bands)).copy()
    for i in range(m // bands):
        key = mix(key * COMPONENTS_SEED + bits[:, :, i])
    return key.view(np.int64)


def sign_texts(texts: list[str], ngram: int, m: int) -> np.ndarray:
    words, first = word_hashes(texts)
    values, offsets = shingles(words, first, ngram)
    owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    counts = np.diff(np.append(at, len(values)))
    return signatures(values[at], counts, owner[at], len(texts), m)


def level_set(text: str, ngram: int) -> np.ndarray:
    """The multiset of shingles as a sorted set of hashes of (shingle, level), level 1 up to its count."""
    values, counts = shingle_multiset(text, ngram)
    first = np.cumsum(counts) - counts
    level = np.arange(int(counts.sum())) - np.repeat(first, counts) + 1
    return np.sort(mix(np.repeat(values, counts) ^ mix(level.astype(np.uint64))))


def multiset_overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets given as (sorted values, counts); 1 of two empty ones."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    either = int(a[1].sum() + b[1].sum()) - both
    return both / either if either else 1.0


SCORED = "node long, hub long, similarity double, size long, hub_size long, apart array<long>"


def _verify(pairs: DataFrame, texts: DataFrame, ngram: int, apart: bool = False) -> DataFrame:
    """pairs (node, hub) with their exact similarity and sizes; with ``apart`` what one of both has and the other hasn't."""
    left = texts.select(F.col("node"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("hub"), F.col("text").alias("text_b"))
    both = pairs.join(left.hint("merge"), "node").join(right.hint("merge"), "hub").select("node", "hub", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_set = None, None
        for batch in batches:
            for part, some in text_slices(batch, "text_a"):
                scores, sizes, hub_sizes, differ = [], [], [], []
                for a, b in zip(some, part.column("text_b"), strict=True):
                    b = b.as_py()
                    if b != last:
                        last, last_set = b, level_set(b, ngram)
                    own = level_set(a, ngram)
                    d = np.setxor1d(own, last_set, assume_unique=True)
                    both = (len(own) + len(last_set) - len(d)) // 2
                    scores.append(both / (both + len(d)) if both + len(d) else 1.0)
                    sizes.append(len(own))
                    hub_sizes.append(len(last_set))
                    differ.append(d if apart else d[:0])
                offsets = np.concatenate([[0], np.cumsum([len(d) for d in differ])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(offsets, np.concatenate([*differ, np.zeros(0, np.uint64)]).view(np.int64))
                yield pa.record_batch([part.column("node"), part.column("hub"), pa.array(scores, pa.float64()), pa.array(sizes, pa.int64()), pa.array(hub_sizes, pa.int64()), lists], [c.split()[0] for c in SCORED.split(", ")])
        give_back()

    return both.mapInArrow(run, SCORED)


def components(edges: DataFrame) -> DataFrame:
    """(node, class_id) for every node of the edges (a, b): class_id is the least node of its connected component.

    Each round hooks every class to its least neighbour, follows the hooks, and writes the table; the number of rounds
    grows with the logarithm of the longest path. The tables of a round are deleted after the next.
    """
    both = stage(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a <> b").distinct(), "edges")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("class_id")), "labels")
    while True:
        # the hook of each class, then two jumps along the hooks
        a, b = labels.select(F.col("node").alias("a"), F.col("class_id").alias("ca")), labels.select(F.col("node").alias("b"), F.col("class_id").alias("cb"))
        cross = both.join(a.hint("merge"), "a").join(b.hint("merge"), "b").where("ca <> cb")
        hooks = stage(cross.groupBy("ca").agg(F.min("cb").alias("cb")).where("cb < ca"), "hooks")
        if hooks.isEmpty():
            unstage(both, hooks)
            return labels
        far = hooks
        for _ in range(2):
            jump = far.select(F.col("ca").alias("cb"), F.col("cb").alias("further"))
            far = far.join(jump.hint("merge"), "cb", "left").select("ca", F.coalesce("further", "cb").alias("cb"))
        new = stage(labels.join(far.hint("merge"), labels.class_id == far.ca, "left").select("node", F.coalesce("cb", "class_id").alias("class_id")), "labels")
        unstage(labels, hooks)
        labels = new


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, ngram: int = 5, bands: int = 32, rows: int = 5
) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id (least doc_id of its class), class_size, kept, text_sha256.

    Documents are linked when the weighted Jaccard similarity of their multisets of ``ngram``-word shingles is at least
    ``threshold``; a class is a connected component of links and of equal texts. A pair at 0.8 misses all 32 bands of 5
    with probability 3e-6. A null text counts as empty, all empty texts are equal, and a text without words has no
    near copies but equal ones. A text of fewer than ``ngram`` words is one shingle. Rows that share a doc_id but not the
    text are documents of their own. A null doc_id comes after all others: a class of such rows alone has a null class_id.
    ``kept`` is true for the row of the least doc_id (then digest) of the class; rows that repeat its id and text have it
    too. Other columns are not read.
    """
    text_batches(docs.sparkSession)
    m = bands * rows
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    digested = base.withColumn("digest", F.unhex(F.sha2("text", 256)))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch):
                signature = sign_texts(texts, ngram, m)
                keys = band_keys(signature, bands)
                offsets = np.concatenate([[0], np.cumsum(np.where(np.isinf(signature[:, 0]), 0, bands))]).astype(np.int32)
                flat = keys[~np.isinf(signature[:, 0])].reshape(-1)
                yield pa.record_batch([part.column("doc_id"), part.column("digest"), pa.ListArray.from_arrays(offsets, flat)], ["doc_id", "digest", "bands"])
        give_back()

    signed = stage(digested.mapInArrow(sign, "doc_id long, digest binary, bands array<long>"), "signed")
    # a node for each text; its number is only a name
    nodes = stage(signed.groupBy("digest").agg(F.first("bands").alias("bands")).withColumn("node", F.monotonically_increasing_id()), "nodes")
    held = _against_hubs(nodes.select(F.explode("bands").alias("bucket"), "node"))
    labels = None
    if not held.isEmpty():
        ids = held.select("node").union(held.select(F.col("hub").alias("node"))).distinct()
        wanted = stage(nodes.select("digest", "node").join(ids.hint("merge"), "node"), "wanted")
        found = semi_join(digested.select("digest", "text"), wanted.select("digest"), "digest", 2 * wanted.count())
        texts = stage(found.join(wanted.hint("merge"), "digest").dropDuplicates(["node"]).select("node", "text"), "texts")
        scored = stage(_verify(held, texts, ngram, True), "scored")
        labels = _linked(scored, threshold)
        labels = _inside_groups(scored, labels, texts, threshold, ngram)
        unstage(wanted, texts, scored)
    unstage(held)

    out = signed.select("doc_id", "digest").join(nodes.select("digest", "node").hint("merge"), "digest")
    if labels is not None:
        out = out.join(labels.hint("merge"), "node", "left").withColumn("class", F.coalesce("class_id", "node")).drop("class_id")
    else:
        out = out.withColumn("class", F.col("node"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "digest"))
    classes = out.groupBy("class").agg(F.count("*").alias("class_size"), first.alias("first"))
    kept = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("digest") == F.col("first.digest"))
    return out.join(classes.hint("merge"), "class").select("doc_id", F.col("first.doc_id").alias("class_id"), "class_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def _against_hubs(rows: DataFrame) -> DataFrame:
    """(node, hub): the nodes of each bucket against its least one."""
    least = rows.groupBy("bucket").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub <> last").drop("last")
    return stage(rows.select("bucket", "node").join(least.hint("merge"), "bucket").where("node > hub").select("node", "hub").distinct(), "held")


def _linked(scored: DataFrame, threshold: float) -> DataFrame:
    return components(scored.where(F.col("similarity") >= threshold).select(F.col("node").alias("a"), F.col("hub").alias("b")))


def _joined(labels: DataFrame, found: DataFrame, threshold: float) -> DataFrame:
    """The classes once the links of ``found`` are added: only the classes that these join are gone through again."""
    links = stage(_named(found.where(F.col("similarity") >= threshold), labels).where("class_a <> class_b").select(F.col("class_a").alias("a"), F.col("class_b").alias("b")).distinct(), "links")
    if links.isEmpty():
        return labels
    among = components(links)
    new = among.select(F.col("node").alias("class_id"), F.col("class_id").alias("new_id"))
    known = labels.unionByName(new.select(F.col("class_id").alias("node"), "class_id")).distinct()  # a single node is its own class
    out = stage(known.join(new.hint("merge"), "class_id", "left").select("node", F.coalesce("new_id", "class_id").alias("class_id")), "labels")
    unstage(links, among, labels)
    return out


def _named(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """pairs with the classes class_a and class_b of node and hub so far."""
    a = labels.select("node", F.col("class_id").alias("la")).hint("merge")
    b = labels.select(F.col("node").alias("hub"), F.col("class_id").alias("lb")).hint("merge")
    joined = pairs.join(a, "node", "left").join(b, "hub", "left")
    return joined.withColumns({"class_a": F.coalesce("la", "node"), "class_b": F.coalesce("lb", "hub")}).drop("la", "lb")


def _inside_groups(scored: DataFrame, labels: DataFrame, texts: DataFrame, threshold: float, ngram: int) -> DataFrame:
    """The classes with the links between the nodes of a group, where not all of it is in its hub's class yet."""
    open_hubs = stage(_named(scored.select("node", "hub"), labels).where("class_a <> class_b").select("hub").distinct(), "open")
    if open_hubs.isEmpty():
        return labels
    group = scored.join(open_hubs.hint("merge"), "hub", "left_semi")
    hubs = group.groupBy("hub").agg(F.first("hub_size").alias("size"), (F.count("*") + 1).alias("members"))
    none = F.array().cast("array<long>")
    rows = stage(group.select("hub", "node", "size", "apart").unionByName(hubs.select("hub", F.col("hub").alias("node"), "size", none.alias("apart"))), "group")
    # M departs from the hub by what more than half of the group does; it is at most as large as two of its documents
    often = _counts(rows).where("n > 1").join(hubs.select("hub", "members").hint("merge"), "hub").where("2 * n > members")
    common = often.groupBy("hub").agg(F.collect_list("token").alias("common"))
    departs = F.concat(F.array_except("apart", F.coalesce("common", none)), F.array_except(F.coalesce("common", none), "apart"))
    flipped = stage(rows.join(common.hint("merge"), "hub", "left").select("hub", "node", "size", departs.alias("apart")), "departs")
    unstage(rows)
    rows = flipped

    shared = _counts(rows).where("n > 1")
    places = rows.select("hub", "node", F.explode("apart").alias("token")).join(shared.hint("merge"), ["hub", "token"], "left")
    tokens = places.groupBy("hub", "node").agg(F.sort_array(F.collect_list(F.when(F.col("n").isNotNull(), F.struct("n", "token")))).alias("tokens"))
    f = F.size("apart") - F.col("size") * ((1 - threshold) / (1 + threshold)) - 1e-6
    mine = rows.select("hub", "node", f.alias("f")).join(tokens.hint("merge"), ["hub", "node"], "left")
    mine = stage(mine.withColumn("tokens", F.coalesce("tokens", F.array().cast("array<struct<n:bigint,token:bigint>>"))).withColumn("most", F.size("tokens")), "mine")
    unstage(rows)

    # 1. against the node of least f, with which any node is linked that shares no element with another
    least = mine.groupBy("hub").agg(F.min(F.struct("f", "node", "most")).alias("least"))
    near = _classed(mine.select("hub", "node", "f", "most").join(least.hint("merge"), "hub"), labels)
    near = near.where("node <> least.node and (f + least.f <= 2 * least(most, least.most))")
    pairs = _named(_pairs(near.select("node", F.col("least.node").alias("hub"))), labels).where("class_a <> class_b").select("node", "hub")
    labels, done = _more(pairs, scored.select("node", "hub"), labels, texts, threshold, ngram)

    # 2. nodes outside the class of that node, if anything in the group can reach them
    mine = _classed(mine, labels)
    ends = mine.groupBy("hub").agg(F.min(F.struct("f", "node", "class_id")).alias("least"), F.max(2 * F.col("most") - F.col("f")).alias("reach"))
    mine = mine.join(ends.hint("merge"), "hub")
    far = "class_id <> least.class_id and 2 * most - f >= least.f and f <= reach"
    mine = stage(mine.withColumn("far", F.expr(far)).select("hub", "node", "f", "most", "tokens", "class_id", "far", F.col("least.f").alias("least_f")), "reached")
    lowest = mine.where("far").groupBy("hub").agg(F.min("f").alias("far_f"))
    left = _prefix(mine.where("far"), F.col("least_f"))
    right = _prefix(mine.join(lowest.hint("merge"), "hub"), F.col("far_f"))
    left = left.select("hub", "token", F.col("node").alias("a"), F.col("f").alias("f_a"), F.col("most").alias("most_a"), F.col("class_id").alias("class_a"))
    right = right.select("hub", "token", F.col("node").alias("b"), F.col("f").alias("f_b"), F.col("most").alias("most_b"), F.col("class_id").alias("class_b"))
    both = left.join(right.hint("merge"), ["hub", "token"]).where("class_a <> class_b and f_a + f_b <= 2 * least(most_a, most_b)")
    labels, _ = _more(_pairs(both.select(F.col("a").alias("node"), F.col("b").alias("hub"))), done, labels, texts, threshold, ngram)
    return labels


def _counts(rows: DataFrame) -> DataFrame:
    """(hub, token, n): how many nodes of a group have a token in ``apart``; summed within each batch first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column("apart").offsets.to_numpy())
            for a, b in slices(sizes):
                hub = np.repeat(batch.column("hub").to_numpy()[a:b], sizes[a:b])
                token = batch.column("apart").slice(a, b - a).flatten().to_numpy()
                order = np.lexsort((token, hub))
                hub, token = hub[order], token[order]
                at = np.flatnonzero(np.concatenate([[True], (np.diff(hub) != 0) | (np.diff(token) != 0)])) if len(hub) else np.zeros(0, np.int64)
                yield pa.record_batch([pa.array(hub[at]), pa.array(token[at]), pa.array(np.diff(np.append(at, len(hub))))], ["hub", "token", "n"])
        give_back()

    return rows.select("hub", "apart").mapInArrow(run, "hub long, token long, n long").groupBy("hub", "token").agg(F.sum("n").alias("n"))


def _classed(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.join(labels.hint("merge"), "node", "left").withColumn("class_id", F.coalesce("class_id", "node"))


def _pairs(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.greatest("node", "hub").alias("node"), F.least("node", "hub").alias("hub")).distinct()


def _prefix(rows: DataFrame, other: Column) -> DataFrame:
    """Each row's rarest shared tokens: all but so many as it must share with any node of f ``other`` or more, less one."""
    needed = F.greatest(F.lit(1), F.ceil((F.col("f") + other) / 2)).cast("int")
    some = F.slice("tokens", 1, F.greatest(F.lit(0), F.col("most") - needed + 1))
    return rows.select("hub", "node", "f", "most", "class_id", F.explode(some).alias("t")).withColumn("token", F.col("t.token")).drop("t")


def _more(pairs: DataFrame, done: DataFrame, labels: DataFrame, texts: DataFrame, threshold: float, ngram: int) -> tuple[DataFrame, DataFrame]:
    """Verify the pairs that aren't ``done``; the classes with their links, and all pairs done."""
    pairs = stage(pairs.join(done.hint("merge"), ["node", "hub"], "left_anti"), "pairs")
    if pairs.isEmpty():
        return labels, done
    found = stage(_verify(pairs, texts, ngram), "scored")
    labels = _joined(labels, found, threshold)
    unstage(found)
    return labels, done.unionByName(pairs)
