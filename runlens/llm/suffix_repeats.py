"""Repeated passages by prefix-partitioned suffix trees over words.

Suffixes that may repeat are found first: windows share the 8-word anchors that winnowing picks from them, so a window
without a repeated anchor can't repeat. Each remaining suffix is a path of word blocks, ending at the window's depth. Suffixes are
split by a prefix of 8 words; a prefix with more suffixes than fit in a group is lengthened block by block. Each group's
sorted suffixes and their common prefix lengths are its subtree; internal nodes at window depth are the
repeats, and neighbouring ones in a text join to maximal repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import buckets_for, discard, small_or_plain, stored, text_or_empty
from .hashing import STEP, U, Words, mixed, word_chunks

WINDOW = 35
BLOCKS = (8, 9, 9, 9)  # words of a path's blocks; the first is the shortest prefix and the anchor
GROUP = 20_000  # suffixes of one prefix before it is lengthened
TASK = 100_000  # suffixes that share a task

PATH = ["p0", "p1", "p2", "p3"]
SPANS = "array<struct<start: long, end: long>>"
SPLIT = f"doc_id long, key long, chars long, text string, starts array<int>, n_words long, n_removed long, removed {SPANS}, kept_sha256 string"
DONE = f"doc_id long, n_words long, n_removed long, removed {SPANS}, kept_sha256 string"
SUFFIX = "p0 long, p1 long, p2 long, p3 long, key long, chars long, start int, again boolean"


def _slide(x: np.ndarray, k: int, best) -> np.ndarray:
    """``best`` over each ``k`` neighbours of ``x``."""
    width = 1
    while 2 * width <= k:
        x = best(x[:-width], x[width:])
        width *= 2
    return x if width == k else best(x[: len(x) - (k - width)], x[k - width :])


def anchors(w: Words, window: int = WINDOW, gram: int = BLOCKS[0]) -> tuple[np.ndarray, np.ndarray]:
    """Word positions, and their gram hashes, that are smallest in some window of their text."""
    grams, _ = w.grams(gram)
    n, inner = len(grams), window - gram + 1
    if n < window:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=U)
    least = _slide(grams, inner, np.minimum)[: n - window + 1].copy()
    least[np.arange(len(least)) + window > w.text_end()[: len(least)]] = 0  # windows over a text's end
    padded = np.concatenate([np.zeros(inner - 1, dtype=U), least, np.zeros(inner - 1, dtype=U)])
    most = _slide(padded, inner, np.maximum)
    at = np.flatnonzero((most == grams[: len(most)]) & (most != 0))
    return at, grams[at]


def _anchor_rows(window: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_numpy()
            for w in word_chunks(batch.column("text")):
                at, marks = anchors(w, window)
                if not len(at):
                    continue
                text = np.searchsorted(w.first, at, side="right") - 1
                order = np.lexsort((marks, text))
                text, marks = text[order], marks[order]
                new = np.ones(len(text), dtype=bool)
                new[1:] = (text[1:] != text[:-1]) | (marks[1:] != marks[:-1])
                first = np.flatnonzero(new)
                many = np.diff(np.append(first, len(new))) > 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(marks[first].view(np.int64)), pa.array(keys[w.row + text[first]]), pa.array(many)], ["mark", "key", "again"]
                )

    return rows


def _cover(n: int, starts: np.ndarray, window: int) -> tuple[np.ndarray, list[dict]]:
    """Mask of covered words and the maximal covered spans."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    mask = np.cumsum(edge)[:n] > 0
    change = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    return mask, [{"start": int(a), "end": int(b)} for a, b in zip(change[::2], change[1::2])]


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _splitter(window: int):
    """Settle texts that need no suffixes; keep text and candidate windows of the others."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, chars = batch.column("doc_id"), batch.column("key").to_numpy(), batch.column("chars").to_numpy()
            marks, copies, first = batch.column("marks"), batch.column("copies").to_numpy(), batch.column("is_first").to_pylist()
            for w in word_chunks(batch.column("text")):
                at, grams = anchors(w, window)
                bounds = np.searchsorted(at, w.first)
                out: list[dict] = []
                for i in range(len(w.first) - 1):
                    row = w.row + i
                    a, b = int(w.first[i]), int(w.first[i + 1])
                    raw = w.data[w.text_starts[i] : w.text_starts[i + 1]].tobytes()
                    r = {"doc_id": ids[row].as_py(), "key": keys[row], "chars": chars[row], "text": None, "starts": None,
                         "n_words": b - a, "n_removed": None, "removed": None, "kept_sha256": None}
                    starts = np.zeros(0, dtype=np.int64)
                    if marks[row].is_valid and b - a >= window and (copies[row] < 2 or first[row]):
                        wanted = marks.values[marks.offsets[row].as_py() : marks.offsets[row + 1].as_py()].to_numpy().view(U)
                        lo, hi = bounds[i], bounds[i + 1]
                        hit = at[lo:hi][np.isin(grams[lo:hi], wanted)] - a
                        near = np.zeros(b - a + 1, dtype=np.int64)
                        np.add.at(near, np.maximum(hit - (window - BLOCKS[0]), 0), 1)
                        np.add.at(near, hit + 1, -1)
                        starts = np.flatnonzero(np.cumsum(near)[: b - a - window + 1] > 0)
                    if len(starts):
                        r["text"], r["starts"] = raw.decode(), starts.astype(np.int32)
                    if copies[row] >= 2 and b - a >= window:
                        r |= {"n_removed": b - a, "removed": [{"start": 0, "end": b - a}], "kept_sha256": _digest([])}
                    elif not len(starts):
                        r |= {"n_removed": 0, "removed": [], "kept_sha256": _digest(raw.split())}
                    out.append(r)
                yield _batch(out, _SPLIT_TYPE)

    return split


_SPAN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_DONE_FIELDS = [("n_words", pa.int64()), ("n_removed", pa.int64()), ("removed", _SPAN_TYPE), ("kept_sha256", pa.string())]
_SPLIT_TYPE = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("chars", pa.int64()), ("text", pa.string()),
                         ("starts", pa.list_(pa.int32())), *_DONE_FIELDS])
_DONE_TYPE = pa.schema([("doc_id", pa.int64()), *_DONE_FIELDS])


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in schema], schema=schema)


def paths(w: Words, at: np.ndarray, blocks: tuple[int, ...] = BLOCKS) -> np.ndarray:
    """Block hashes of the suffixes that begin at words ``at``, one row per block."""
    out, skip = [], 0
    for size in blocks:
        g = np.zeros(len(at), dtype=U)
        for j in range(skip, skip + size):
            g = g * STEP + w.hashes[at + j]
        out.append(mixed(g))
        skip += size
    return np.stack(out)


def _suffix_rows(blocks: tuple[int, ...]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, chars, lists = batch.column("key").to_numpy(), batch.column("chars").to_numpy(), batch.column("starts")
            for w in word_chunks(batch.column("text")):
                counts, at = [], []
                for i in range(len(w.first) - 1):
                    starts = lists[w.row + i].values.to_numpy()
                    counts.append(len(starts))
                    at.append(starts.astype(np.int64) + w.first[i])
                at, text = np.concatenate(at), np.repeat(np.arange(len(counts)), counts)
                p = paths(w, at, blocks).view(np.int64)
                order = np.lexsort((at, *p, text))
                p, at, text = p[:, order], at[order], text[order]
                new = np.ones(len(at), dtype=bool)
                new[1:] = (text[1:] != text[:-1]) | (p[:, 1:] != p[:, :-1]).any(axis=0)
                first = np.flatnonzero(new)
                again = np.diff(np.append(first, len(at))) > 1
                row = w.row + text[first]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(x[first]) for x in p), pa.array(keys[row]), pa.array(chars[row]),
                     pa.array((at[first] - w.first[text[first]]).astype(np.int32)), pa.array(again)],
                    [*PATH, "key", "chars", "start", "again"],
                )

    return rows


def deep_nodes(path: list[np.ndarray], depths: list[int], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the sorted suffixes and, in that order, the subtree's node at ``depth`` of each.

    Two neighbours hang below one node at ``depth`` if their common prefix is that long.
    """
    order = np.lexsort(path[::-1])
    common = np.zeros(len(order), dtype=np.int64)
    same = np.ones(max(len(order) - 1, 0), dtype=bool)
    for block, reached in zip(path, depths):
        block = block[order]
        same &= block[1:] == block[:-1]
        common[1:][same] = reached
    return order, np.cumsum(common < depth) - 1


def _tree_maker(blocks: tuple[int, ...]):
    depths = list(accumulate(blocks))

    def trees(suffixes: pa.Table) -> pa.Table:
        path = [suffixes.column(c).to_numpy() for c in PATH]
        order, node = deep_nodes(path, depths, depths[-1])
        leaves, again = np.bincount(node), suffixes.column("again").to_numpy()[order]
        # A leaf counts for its text; equal texts give one leaf each and are repeats as well.
        repeated = leaves[node] > 1
        repeated |= again
        return suffixes.select(["key", "chars", "start"]).take(pa.array(np.sort(order[repeated])))

    return trees


def _partitioned(suffixes: DataFrame, group: int) -> DataFrame:
    """Add ``prefix``, a hash of the shortest prefix, in blocks, that at most ``group`` suffixes share, and ``settled``.

    Where more than ``group`` suffixes share the whole path, no prefix parts them. All of them are repeats, which their number
    tells without a tree: they are settled, and no task gathers them.
    """
    group = max(group, 1)
    out = suffixes.withColumn("prefix", F.col("p0")).withColumn("settled", F.lit(False))
    wide = suffixes.select(*PATH, F.col("p0").alias("prefix"))
    for block in [*PATH[1:], None]:
        large = stored(wide.groupBy("prefix").agg(F.count("*").alias("n")).where(F.col("n") > group).select(F.col("prefix").alias("large")), "prefixes")
        if large.isEmpty():
            return out
        large = small_or_plain(large, 100_000)
        out = out.join(large, out.prefix == large.large, "left")
        if block is None:
            return out.withColumn("settled", F.col("large").isNotNull()).drop("large")
        longer = F.when(F.col("large").isNull(), F.col("prefix")).otherwise(F.xxhash64("prefix", block))
        out = out.withColumn("prefix", longer).drop("large")
        wide = wide.join(large, wide.prefix == large.large).withColumn("prefix", longer).drop("large")
    return out


def _finisher(window: int, blocks: tuple[int, ...]):
    """Cover the words of each text by its repeated windows."""

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists, found = batch.column("doc_id"), batch.column("starts"), batch.column("found")
            for w in word_chunks(batch.column("text")):
                out = []
                for i in range(len(w.first) - 1):
                    row, a, b = w.row + i, int(w.first[i]), int(w.first[i + 1])
                    starts = lists[row].values.to_numpy().astype(np.int64)
                    p = paths(w, starts + a, blocks)
                    _, inverse, counts = np.unique(p, axis=1, return_inverse=True, return_counts=True)
                    repeated = starts[counts[np.ravel(inverse)] > 1]
                    if found[row].is_valid:
                        repeated = np.concatenate([repeated, found[row].values.to_numpy()])
                    mask, spans = _cover(b - a, repeated, window)
                    raw = w.data[w.text_starts[i] : w.text_starts[i + 1]].tobytes().split()
                    out.append({"doc_id": ids[row].as_py(), "n_words": b - a, "n_removed": int(mask.sum()), "removed": spans,
                                "kept_sha256": _digest([x for x, m in zip(raw, mask.tolist()) if not m])})
                yield _batch(out, _DONE_TYPE)

    return finish


def remove_repeats(docs: DataFrame, blocks: tuple[int, ...] = BLOCKS, group: int = GROUP, task: int = TASK) -> DataFrame:
    """``doc_id, n_words, n_removed, removed, kept_sha256`` for every row of ``docs`` (doc_id, text; others are not read).

    ``removed`` holds the maximal spans of words, as [start, end), that are covered by windows of as many words as
    ``blocks`` sum to whose sequence starts anywhere else too, in the same text or another. The digest is of the kept words, joined by
    one space. A null text has no words; repeated rows are copies of each other, so a long enough text among them goes whole;
    a null or repeated doc_id changes nothing, rows are told apart by their texts. An empty table gives no rows.
    """
    if len(blocks) != len(PATH):
        raise ValueError(f"a path has {len(PATH)} blocks")
    window = sum(blocks)
    text = text_or_empty()
    docs = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("key"), F.length(text).cast("long").alias("chars"))
    marks = docs.select("key", "text").mapInArrow(_anchor_rows(window), "mark long, key long, again boolean")
    marks = stored(marks, "anchors")
    repeated = marks.groupBy("mark").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.max("again").alias("again"))
    repeated = repeated.where("low < high OR again").select("mark")
    copies = docs.groupBy("key", "chars").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"))
    copied = copies.where("copies > 1")
    by_text = marks.join(repeated, "mark").groupBy("key").agg(F.collect_set("mark").alias("marks"))
    # A text with copies repeats whole; its anchors must be known to others even where no other text shares one.
    known = copied.alias("c").join(by_text.alias("b"), "key", "full").select(
        F.col("key").alias("k"), F.col("c.chars").alias("k_chars"), "copies", "first_id", "marks"
    )
    joined = docs.join(known, (docs.key == known.k) & ((docs.chars == known.k_chars) | known.k_chars.isNull()), "left")
    joined = joined.select(
        "doc_id", "key", "chars", "text", "marks",
        F.coalesce("copies", F.lit(1)).alias("copies"),
        F.col("doc_id").eqNullSafe(F.col("first_id")).alias("is_first"),
    )
    split = stored(joined.mapInArrow(_splitter(window), SPLIT), "suffix-texts")
    discard(marks)

    open_texts = split.where("text IS NOT NULL").select("key", "chars", "text", "starts")
    suffixes = stored(open_texts.mapInArrow(_suffix_rows(blocks), SUFFIX), "suffixes")
    total = suffixes.count()
    grouped = _partitioned(suffixes, group).withColumn("task", F.pmod(F.xxhash64("prefix"), F.lit(buckets_for(total, task))))
    leaves = grouped.where("NOT settled").select("task", *PATH, "key", "chars", "start", "again").groupBy("task")
    found = leaves.applyInArrow(_tree_maker(blocks), "key long, chars long, start int")
    found = found.unionByName(grouped.where("settled").select("key", "chars", "start"))
    found = found.groupBy(F.col("key").alias("f_key"), F.col("chars").alias("f_chars")).agg(F.collect_list("start").alias("found"))
    rest = split.where("kept_sha256 IS NULL").select("doc_id", "key", "chars", "text", "starts")
    rest = rest.join(found, (rest.key == found.f_key) & (rest.chars == found.f_chars), "left").select("doc_id", "text", "starts", "found")
    done = stored(rest.mapInArrow(_finisher(window, blocks), DONE), "suffix-done")
    discard(suffixes)
    columns = [c.split()[0] for c in ("doc_id", "n_words", "n_removed", "removed", "kept_sha256")]
    return split.where("kept_sha256 IS NOT NULL").select(*columns).unionByName(done.select(*columns))
