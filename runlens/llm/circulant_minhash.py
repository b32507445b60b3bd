"""Near duplicates by circulant MinHash: two permutations give every signature coordinate.

The first permutation scatters the shingles over 32-bit numbers. The second is applied to them shifted
by k places round the circle of numbers; its minimum is coordinate k. Bands of coordinates propose candidates, full
shingle sets decide. Components come from verified links only.

At a similarity of 0.85, 32 bands of 6 coordinates miss a pair with a chance of 3e-7.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import buckets_for, discard, stored
from .components import least_reachable
from .hashing import STEP, U, mixed, word_chunks

SHINGLE = 5
BANDS, ROWS = 32, 6
SIMILARITY = 85  # percent
BLOCK = 1_000_000  # shingles of a group that are compared in one block

SKETCH = "doc_id long, n_shingles long, digest binary, bands array<long>"
SETS = "node long, shingles array<long>"


def _scattered(sets: np.ndarray) -> np.ndarray:
    """The first permutation, on 32-bit folds of the shingles."""
    x = ((sets >> U(32)) ^ sets).astype(np.uint32)
    x *= np.uint32(0x9E3779B1)
    x ^= x >> np.uint32(15)
    return x * np.uint32(0x85EBCA77)


def _shifted_minimum(x: np.ndarray, k: int, first: np.ndarray) -> np.ndarray:
    """Minimum per document of the second permutation, shifted by ``k``."""
    y = x - np.uint32(k * 0x01000193 & 0xFFFFFFFF)
    y ^= y >> np.uint32(16)
    y *= np.uint32(0x7FEB352D)
    y ^= y >> np.uint32(15)
    y *= np.uint32(0x846CA68B)
    y ^= y >> np.uint32(16)
    return np.minimum.reduceat(y, first)


def signatures(sets: np.ndarray, first: np.ndarray, coordinates: int) -> np.ndarray:
    """Coordinates by row, documents by column; ``first`` holds where each document's set begins."""
    x = _scattered(sets)
    return np.stack([_shifted_minimum(x, k, first) for k in range(coordinates)])


def shingle_sets(column: pa.Array, k: int = SHINGLE) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(row of the first text, sorted sets of shingle hashes of it and the next texts)."""
    for w in word_chunks(column, lower=True):
        grams, _ = w.grams(k)
        out = []
        for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
            if b - a >= k:
                out.append(np.unique(grams[a : b - k + 1]))
            elif b > a:  # the whole short sequence is its one shingle
                g = np.zeros(1, dtype=U)
                for h in w.hashes[a:b]:
                    g = g * STEP + h
                out.append(mixed(g + U(b - a)))
            else:
                out.append(np.zeros(0, dtype=U))
        yield w.row, out


def _sketcher(shingle: int, bands: int, rows: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salts = mixed(np.arange(bands, dtype=U) + U(1))
        for batch in batches:
            for row, sets in shingle_sets(batch.column("text"), shingle):
                sizes = np.array([len(s) for s in sets], dtype=np.int64)
                full = np.flatnonzero(sizes)
                keys = np.zeros((len(sets), bands), dtype=U)
                if len(full):
                    first = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
                    sig = signatures(np.concatenate([sets[i] for i in full]), first, bands * rows)
                    for band in range(bands):
                        key = np.full(len(full), salts[band], dtype=U)
                        for r in range(rows):
                            key = mixed(key * STEP + sig[band * rows + r])
                        keys[full, band] = key
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                lists = pa.ListArray.from_arrays(
                    np.arange(len(sets) + 1, dtype=np.int32) * bands, pa.array(keys.view(np.int64).ravel())
                )
                ids = batch.column("doc_id").slice(row, len(sets))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(sizes), pa.array(digests, pa.binary()), lists], ["doc_id", "n_shingles", "digest", "bands"]
                )

    return sketch


def _set_maker(shingle: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, sets in shingle_sets(batch.column("text"), shingle):
                ends = np.cumsum([0] + [len(s) for s in sets]).astype(np.int32)
                lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(row, len(sets)), lists], ["node", "shingles"])

    return make


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) whose full sets are similar enough. A node that serves many pairs is a hot key of a plain
    join, which Spark splits."""
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("a")), "u")
    both = both.join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("b")), "v")
    shared = F.size(F.array_intersect("a", "b"))
    return both.where(100 * shared >= percent * (F.size("a") + F.size("b") - shared)).select("u", "v")


def _prefix_pairs(sets: list[np.ndarray], sides: np.ndarray, percent: int) -> Iterator[np.ndarray]:
    """Pairs of rows that can be similar enough, smaller row first, in batches that may repeat pairs.

    Elements are ranked by rarity. Of two similar sets, the ones that are rarest, as many as may be missing plus one, have
    an element in common. ``sides`` tells chunks apart: if there are two, only pairs across are wanted.
    """
    sizes = np.array([len(x) for x in sets])
    flat = np.concatenate(sets)
    _, inverse, counts = np.unique(flat, return_inverse=True, return_counts=True)
    rarity = np.empty(len(counts), dtype=np.int64)
    rarity[np.argsort(counts, kind="stable")] = np.arange(len(counts))
    ranks, row = rarity[np.ravel(inverse)], np.repeat(np.arange(len(sets)), sizes)
    order = np.lexsort((ranks, row))
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    prefix = sizes - -(-sizes * percent // 100) + 1
    use = place < np.repeat(prefix, sizes)
    ranks, row = ranks[order][use], row[order][use]
    by = np.lexsort((sizes[row], ranks))
    ranks, row = ranks[by], row[by]
    ends = np.append(np.flatnonzero(np.diff(ranks)) + 1, len(ranks))
    end_of = np.repeat(ends, np.diff(np.append(0, ends)))
    across = len(np.unique(sides)) > 1
    for step in range(1, len(row)):  # each element of a list of postings against the one ``step`` further on
        at = np.flatnonzero(np.arange(len(row)) + step < end_of)
        if not len(at):
            return
        a, b = row[at], row[at + step]
        good = 100 * sizes[a] >= percent * sizes[b]
        if across:
            good &= sides[a] != sides[b]
        yield np.stack([a[good], b[good]])


def _shared_bits(sets: list[np.ndarray], width: int = 1 << 15) -> list[np.ndarray]:
    """For ``width`` elements at a time that more than one set holds: which sets (rows) hold them, as bits."""
    sizes = [len(x) for x in sets]
    _, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.where(counts > 1, np.cumsum(counts > 1) - 1, -1)[np.ravel(inverse)]
    row = np.repeat(np.arange(len(sets)), sizes)[number >= 0]
    number, out = number[number >= 0], []
    for low in range(0, int(number.max()) + 1 if len(number) else 0, width):
        use = (number >= low) & (number < low + width)
        held = np.zeros((len(sets), min(width, int(number.max()) + 1 - low)), dtype=bool)
        held[row[use], number[use] - low] = True
        out.append(np.packbits(held, axis=1))
    return out


def _shared_counts(masks: list[np.ndarray], pairs: np.ndarray, batch: int = 4096) -> np.ndarray:
    """Sizes of the intersections of pairs of sets."""
    out = np.zeros(pairs.shape[1], dtype=np.int64)
    for mask in masks:
        for at in range(0, len(out), batch):
            a, b = pairs[:, at : at + batch]
            out[at : at + batch] += np.bitwise_count(mask[a] & mask[b]).sum(axis=1, dtype=np.int64)
    return out


def _block_verifier(percent: int):
    """Links between different components in each block of a group: enough of them to join what belongs together."""

    def links_of(sets: list[np.ndarray], nodes: list[int], labels: list[int], sides: np.ndarray) -> Iterator[tuple[int, int]]:
        root = {x: x for x in labels}

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        sizes = np.array([len(x) for x in sets])
        place = {x: i for i, x in enumerate(root)}
        names = list(place)
        own = np.array([place[x] for x in labels])
        masks = _shared_bits(sets)
        for pairs in _prefix_pairs(sets, sides, percent):
            roots = np.array([place[find(x)] for x in names])[own]
            pairs = np.unique(pairs[:, roots[pairs[0]] != roots[pairs[1]]], axis=1)
            shared = _shared_counts(masks, pairs)
            similar = 100 * shared >= percent * (sizes[pairs[0]] + sizes[pairs[1]] - shared)
            for a, b in zip(*pairs[:, similar].tolist()):
                p, q = find(labels[a]), find(labels[b])
                if p != q:
                    root[p] = q
                    yield nodes[a], nodes[b]

    def verify(rows: pa.Table) -> pa.Table:
        columns = [rows.column(c).to_numpy() for c in ("leader", "low", "high")]
        order = np.lexsort(columns[::-1])
        change = np.any([np.diff(c[order]) != 0 for c in columns], axis=0)
        nodes, labels, chunks = (rows.column(c).to_numpy() for c in ("node", "label", "chunk"))
        lists, out = rows.column("shingles").combine_chunks(), []
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        for part in np.split(order, np.flatnonzero(change) + 1):
            if len(part) > 1:
                sets = [lists[int(i)].values.to_numpy() for i in part]
                out += links_of(sets, nodes[part].tolist(), labels[part].tolist(), chunks[part])
        u, v = zip(*out) if out else ((), ())
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return verify


def _size_fits(a: str, b: str, percent: int):
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _in_chunks(held: DataFrame) -> tuple[DataFrame, int]:
    """``leader, low, high, chunk, node, label``: the nodes of each open group, once for each block that they meet in; and the
    shingles of all these copies.

    A label with more than BLOCK shingles has chunks of its own, which need no block among themselves; the others share the first
    chunks. So a large component that meets few strangers costs a few copies of each, not a copy for each of its chunks.
    """
    by_label = held.groupBy("leader", "label").agg(F.sum("n").alias("weight"), F.count("*").alias("nodes"))
    by_label = by_label.withColumn("own", F.when(F.col("weight") > BLOCK, F.least(F.ceil(F.col("weight") / BLOCK), "nodes")).otherwise(0))
    by_label = stored(by_label, "minhash-group-labels")
    small = F.when(F.col("own") == 0, F.col("weight"))
    groups = by_label.groupBy("leader").agg(
        F.ceil(F.coalesce(F.sum(small), F.lit(0)) / BLOCK).alias("shared"), F.sum("own").alias("large"), F.count("*").alias("labels")
    ).where("labels > 1").select("leader", "shared", (F.col("shared") + F.col("large")).alias("blocks"))
    # Only labels of more than BLOCK shingles are numbered.
    before = Window.partitionBy("leader").orderBy("label").rowsBetween(Window.unboundedPreceding, -1)
    large = by_label.where("own > 0").select("leader", "label", "own", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("before"))
    plan = by_label.select("leader", "label", "weight").join(groups, "leader").join(large, ["leader", "label"], "left").select(
        "leader", "label", "weight", "blocks",
        F.when(F.col("own").isNull(), 0).otherwise(F.col("shared") + F.col("before")).alias("first"),
        F.coalesce("own", "shared").alias("many"),
        F.coalesce("own", F.lit(0)).alias("own"),
    )
    plan = stored(plan, "minhash-chunks")
    copied = plan.agg(F.coalesce(F.sum(F.col("weight") * (F.col("blocks") - F.col("own"))), F.lit(0))).first()[0]
    dealt = held.join(plan.drop("weight"), ["leader", "label"]).withColumn("chunk", F.col("first") + F.pmod(F.xxhash64("node"), F.col("many")))
    others = F.filter(
        F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1),
        lambda c: (c < F.col("first")) | (c >= F.col("first") + F.col("own")),
    )
    dealt = dealt.withColumn("other", F.explode(others)).select(
        "leader", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), "chunk", "node", "label"
    )
    return dealt, copied


def near_duplicates(
    docs: DataFrame, percent: int = SIMILARITY, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs`` (doc_id, text; other columns are not read).

    Documents are linked if the sets of their lower-cased word shingles have a Jaccard similarity of at least
    ``percent`` / 100. ``component_id`` is the smallest doc_id reachable over links. Null and empty texts
    have no shingles and are linked with nothing. Repeated rows fall in one component; rows that share a doc_id
    but not their text are judged each by its own text. A null doc_id is linked with nothing, its
    component_id is null and it is kept. An empty table gives no rows.
    """
    sketch = docs.select("doc_id", "text").mapInArrow(_sketcher(shingle, bands, rows), SKETCH)
    sketch = stored(sketch, "minhash")
    named = sketch.where("n_shingles > 0 AND doc_id IS NOT NULL")

    # Equal sets are one node, called by the smallest doc_id.
    nodes = stored(named.groupBy("digest").agg(F.min("doc_id").alias("node")), "minhash-digests")
    member = stored(
        sketch.join(nodes, (sketch.digest == nodes.digest) & (sketch.n_shingles > 0) & sketch.doc_id.isNotNull(), "left")
        .select("doc_id", "n_shingles", "node", F.when(F.col("doc_id") == F.col("node"), F.col("bands")).alias("bands")),
        "minhash-nodes",
    )
    spread = (
        member.where("doc_id = node").select("node", F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
    )
    shared = (
        spread.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("c"))
        .where("low < high").select("key", "c")
    )
    hits = stored(spread.join(shared, "key").select("key", "node", "n", "c"), "minhash-hits")

    # Texts of the candidates only are hashed again, to full sets.
    wanted = hits.select("node").distinct()
    texts = docs.select("doc_id", "text").join(wanted, F.col("doc_id") == F.col("node"), "left_semi")
    sets = stored(texts.mapInArrow(_set_maker(shingle), SETS), "minhash-sets")

    # First, each node against one leader: the node of its buckets that shares most buckets with others.
    degree = hits.groupBy("node").agg(F.sum("c").alias("degree"))
    ranked = hits.join(degree, "node")
    leaders = ranked.groupBy("key").agg(F.max(F.struct("degree", (-F.col("node")).alias("minus"), "n")).alias("top"))
    stars = (
        hits.join(leaders, "key")
        .where(_size_fits("n", "top.n", percent))
        .groupBy("node")
        .agg(F.max("top").alias("top"))
        .select(F.col("node").alias("u"), (-F.col("top.minus")).alias("v"))
        .where("u <> v")
    )
    stars = stored(_verified(stars, sets, percent), "minhash-stars")
    labels = stored(least_reachable(stars), "minhash-labels")

    # Then all that share a bucket but not yet a component. A leader's group holds every node of its buckets, so pairs of a
    # bucket meet there once, however many bands they share; groups come in blocks of bounded size.
    held = hits.join(leaders, "key").select((-F.col("top.minus")).alias("leader"), "node", "n").distinct()
    held = held.join(labels, "node", "left").select("leader", "node", "n", F.coalesce("label", "node").alias("label"))
    held = stored(held, "minhash-held")
    dealt, copied = _in_chunks(held)
    met = dealt.join(sets, "node").withColumn("task", F.pmod(F.xxhash64("leader", "low", "high"), F.lit(buckets_for(copied, BLOCK * 8))))
    found = met.groupBy("task").applyInArrow(_block_verifier(percent), "u long, v long")
    links = stored(found.unionByName(stars), "minhash-links")
    labels = stored(least_reachable(links), "minhash-components")
    discard(sketch, hits, sets, stars, links)

    named = labels.withColumnRenamed("node", "l")
    return member.join(named, F.col("node") == F.col("l"), "left").select(
        "doc_id",
        "n_shingles",
        F.coalesce("label", "node", "doc_id").alias("component_id"),
        F.coalesce(F.coalesce("label", "node") == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def without_near_duplicates(docs: DataFrame, percent: int = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that stay: one of each component, all columns.

    A document that comes in several kept rows stays once if its doc_id is not null.
    """
    marks = near_duplicates(docs, percent).where("NOT kept").select(F.col("doc_id").alias("__dropped")).distinct()
    stay = docs.join(marks, F.col("doc_id") == F.col("__dropped"), "left_anti")
    return stay.where("doc_id IS NULL").unionByName(stay.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]))
