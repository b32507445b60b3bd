"""Packing token sequences: least squares over shallow combinations of lengths.

Documents longer than a window are cut to whole windows and a rest. The histogram of the rests, in bins of a few
tokens, is met by combinations of at most three bins that fill a window: a non-negative least-squares problem whose
size depends on the window alone. Its rounded counts seat most rests. What is left is packed greedily, end to
end, cut where a window ends; the last, partial window is cut to powers of two, which need no padding.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import discard, running_start, stored, text_or_empty

WINDOW = 2048
STEP = 8  # tokens of a bin
DEPTH = 3
END = 1
FILE = "byte_bpe_50k.json"

# The white space of the tokenizer's splitting pattern, and its special token.
BLANK = "\t-\r \x85\xa0" + chr(0x1680) + chr(0x2000) + "-" + chr(0x200A) + "".join(map(chr, (0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
SPECIAL = "<|endoftext|>"
# Parts that are encoded each by itself: no token crosses from one to the next.
PART = re.compile(f" ?[^{BLANK}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+")


def tokenizer_path(name: str = FILE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_ranks(path: str) -> dict[bytes, int] | None:
    """Byte strings of a byte-level BPE file by id, if ids follow the order of its merges; else None."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocabulary, merges = model.get("vocab", {}), model.get("merges", [])
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spelt = {chr(b): b for b in plain}
    spelt |= {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in merges]
    if model.get("type") != "BPE" or any(vocabulary.get(m) != 256 + i for i, m in enumerate(merged)):
        return None
    tokens = [t for t in vocabulary if t != SPECIAL]
    if not all(c in spelt for t in tokens for c in t):
        return None
    return {bytes(spelt[c] for c in t): vocabulary[t] for t in tokens}


class PartIds(dict):
    """Ids of a part as little-endian 16-bit numbers; parts seen lately are remembered.

    A part that is new goes to the faster of two libraries if it can take over the file's merges; the ids are the same.
    """

    def __init__(self, path: str, most: int = 500_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids need more than 16 bits")
        self.most, self.encode = most, self.slow
        if (ranks := byte_ranks(path)) is not None:
            import public_tokenizers
            import tiktoken

            self.encode = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def slow(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def __missing__(self, part: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        ids = self[part] = array("H", self.encode(part)).tobytes()
        return ids

    def of(self, text: str) -> bytes:
        if SPECIAL in text:
            return array("H", self.slow(text)).tobytes()
        return b"".join(map(self.__getitem__, PART.findall(text)))


TOKENS = "doc_id long, tie long, n_tokens long, ids binary"


def _encoder(path: str, end: int):
    tail = np.array([end], dtype="<u2").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = PartIds(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [known.of(t) + tail for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("tie"), pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                    ["doc_id", "tie", "n_tokens", "ids"],
                )

    return encode


def tokenized(docs: DataFrame, path: str | None = None, end: int = END) -> DataFrame:
    """Ids of every text (null: empty) and the end id, as 16-bit numbers."""
    text = text_or_empty()
    rows = docs.select("doc_id", F.xxhash64(text).alias("tie"), text.alias("text"))
    return rows.mapInArrow(_encoder(path or tokenizer_path(), end), TOKENS)


def combinations(bins: int, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """All ascending tuples of at most ``depth`` bin numbers that sum to ``bins``."""
    out: list[tuple[int, ...]] = []

    def extend(done: tuple[int, ...], low: int, left: int) -> None:
        if left >= low:
            out.append((*done, left))
        if len(done) + 1 < depth:
            for b in range(low, left // 2 + 1):
                extend((*done, b), b, left - b)

    extend((), 1, bins)
    return out


def non_negative(a: np.ndarray, b: np.ndarray, rounds: int) -> np.ndarray:
    """Least squares with x >= 0 by an active set: the columns in use grow by the steepest, and shrink
    where their solution turns negative."""
    x, used = np.zeros(a.shape[1]), np.zeros(a.shape[1], dtype=bool)
    for _ in range(rounds):
        gain = a.T @ (b - a @ x)
        gain[used] = -np.inf
        best = int(np.argmax(gain))
        if gain[best] <= 1e-9 * max(1.0, float(np.abs(b).max())):
            break
        used[best] = True
        while True:
            at = np.flatnonzero(used)
            sub = a[:, at]
            z = np.linalg.solve(sub.T @ sub + 1e-10 * np.eye(len(at)), sub.T @ b)
            if (z > 0).all():
                break
            low = z <= 0
            share = np.min(x[at[low]] / np.maximum(x[at[low]] - z[low], 1e-300))
            x[at] += share * (z - x[at])
            drop = at[low & (x[at] <= 1e-12)]
            drop = drop if len(drop) else at[low]
            used[drop], x[drop] = False, 0.0
            if not used.any():
                break
        x[:] = 0.0
        if not used.any():
            break
        x[at] = z
    return x


def plan(histogram: np.ndarray, depth: int = DEPTH) -> list[tuple[tuple[int, ...], int]]:
    """Combinations and how often each is filled. ``histogram[b]`` counts the rests of bin b; bin 0 is unused.

    Counts are rounded down and then never exceed the histogram, so all seats can be taken.
    """
    bins = len(histogram) - 1
    if histogram.sum() == 0:
        return []
    tuples = combinations(bins, depth)
    a = np.zeros((bins + 1, len(tuples)))
    for j, c in enumerate(tuples):
        np.add.at(a[:, j], list(c), 1.0)
    x = non_negative(a, histogram.astype(float), rounds=3 * bins)
    left, out = histogram.astype(np.int64).copy(), []
    for j in np.argsort(-x, kind="stable"):
        if x[j] <= 0.5:
            break
        need = np.bincount(tuples[j], minlength=bins + 1)
        times = min(int(np.floor(x[j] + 0.5)), int(np.min(left[need > 0] // need[need > 0])))
        if times > 0:
            left -= times * need
            out.append((tuples[j], times))
    return out


def _cut_to_powers(fill: int) -> list[tuple[int, int]]:
    """(start, length) of the powers of two that make up a partial window."""
    out, at = [], 0
    while fill > at:
        size = 1 << ((fill - at).bit_length() - 1)
        out.append((at, size))
        at += size
    return out


PIECE = "array<struct<start: long, length: long, sequence_id: long, offset: long>>"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def _cutter(with_ids: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
                           + [("ids", pa.binary())] * with_ids)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows: list[tuple] = []
                for doc_id, total, ids, pieces in zip(*(batch.column(c).slice(at, 256).to_pylist() for c in ("doc_id", "n_tokens", "ids", "pieces"))):
                    whole = np.frombuffer(ids, dtype="<u2").astype("<u4")
                    for p in pieces:
                        own = whole[p["start"] : p["start"] + p["length"]].tobytes()
                        rows.append((doc_id, p["start"], p["length"], zlib.crc32(own), total, p["sequence_id"], p["offset"]) + (own,) * with_ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)] if rows else
                                                 [pa.array([], f.type) for f in schema], schema=schema)

    return cut


def packed(docs: DataFrame, path: str | None = None, window: int = WINDOW, step: int = STEP, depth: int = DEPTH,
           end: int = END, with_ids: bool = True) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` and ``ids`` (32-bit, little-endian).

    ``docs`` gives doc_id and text, other columns are not read. A null text is empty, so its document is the end id alone. Rows that
    repeat, and rows with a null doc_id, are packed each for itself. An empty table gives no rows. Each id lies in one piece;
    pieces of a sequence follow each other without a gap, and no sequence is longer than ``window``.
    """
    spark = docs.sparkSession
    tokens = stored(tokenized(docs, path, end), "pack-tokens")
    rows = stored(tokens.select("doc_id", "tie", "n_tokens"), "pack-lengths")
    n = rows.count()
    rows = rows.withColumns({"full": F.expr(f"n_tokens div {window}"), "rest": F.col("n_tokens") % window})
    rows = rows.withColumn("bin", F.ceil(F.col("rest") / step).cast("int"))
    rows = stored(running_start(rows, [], ["doc_id", "tie"], "full", "first", n), "pack-rows")

    # Whole windows are sequences of their own.
    whole = rows.where("full > 0").withColumn("i", F.explode(F.expr("sequence(0L, full - 1)")))
    whole = whole.select("doc_id", "tie", (F.col("i") * window).alias("start"), F.lit(window).cast("long").alias("length"),
                         (F.col("first") + F.col("i")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    next_id = rows.agg(F.coalesce(F.sum("full"), F.lit(0))).first()[0]

    # The histogram has window / step bins however many documents there are.
    bins = window // step
    histogram = np.zeros(bins + 1, dtype=np.int64)
    for b, count in rows.where("bin > 0").groupBy("bin").count().collect():
        histogram[b] = count
    seats = []  # bin, first and last rank that the combination takes, seats of that bin in it, first sequence, seat number
    taken = np.zeros(bins + 1, dtype=np.int64)
    for combination, times in plan(histogram, depth):
        for b in sorted(set(combination)):
            uses = combination.count(b)
            seats.append((b, int(taken[b]), int(taken[b] + uses * times), uses, int(next_id), combination.index(b)))
            taken[b] += uses * times
        next_id += times

    rests = rows.where("bin > 0").select("doc_id", "tie", "bin", "rest", (F.col("full") * window).alias("start"), F.lit(1).alias("one"))
    rests = stored(rests, "pack-rests")
    rests = running_start(rests, ["bin"], ["doc_id", "tie"], "one", "rank", n)
    table = spark.createDataFrame(seats, "seat_bin int, low long, high long, uses long, base long, seat long")
    inside = (F.col("bin") == F.col("seat_bin")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    rests = stored(rests.join(F.broadcast(table), inside, "left"), "pack-seats")  # at most depth * bins rows
    seated = rests.where("seat_bin IS NOT NULL").withColumns({
        "sequence_id": F.col("base") + F.expr("(rank - low) div uses"),
        "seat": F.col("seat") + (F.col("rank") - F.col("low")) % F.col("uses"),
    })
    by_seat = F.sort_array(F.collect_list(F.struct("seat", "rest", "doc_id", "tie", "start")))
    seated = seated.groupBy("sequence_id").agg(by_seat.alias("s")).withColumn("i", F.explode(F.sequence(F.lit(1), F.size("s"))))
    before = F.aggregate(F.slice("s", F.lit(1), F.col("i") - 1), F.lit(0).cast("long"), lambda t, s: t + s["rest"])
    seated = seated.select(F.element_at("s", F.col("i")).alias("p"), "sequence_id", before.alias("offset")).select(
        "p.doc_id", "p.tie", "p.start", F.col("p.rest").alias("length"), "sequence_id", "offset")

    # The others, end to end.
    loose = stored(rests.where("seat_bin IS NULL").select("doc_id", "tie", "start", "rest"), "pack-loose")
    size = loose.agg(F.coalesce(F.sum("rest"), F.lit(0))).first()[0]
    loose = running_start(loose, [], ["doc_id", "tie"], "rest", "at", n)
    loose = loose.withColumn("w", F.explode(F.expr(f"sequence(at div {window}, (at + rest - 1) div {window})")))
    powers = _cut_to_powers(int(size % window))
    last = size // window
    cuts = F.when(F.col("w") < last, F.array(F.struct(F.lit(0).alias("from"), F.lit(window).alias("size"), F.lit(0).alias("k")))).otherwise(
        F.array(*[F.struct(F.lit(a).alias("from"), F.lit(s).alias("size"), F.lit(k).alias("k")) for k, (a, s) in enumerate(powers or [(0, window)])]))
    loose = loose.withColumn("cut", F.explode(cuts))
    left = F.col("w") * window + F.col("cut.from")
    low, high = F.greatest(left, F.col("at")), F.least(left + F.col("cut.size"), F.col("at") + F.col("rest"))
    loose = loose.where(low < high).select(
        "doc_id", "tie", (F.col("start") + low - F.col("at")).alias("start"), (high - low).alias("length"),
        (F.lit(next_id) + F.col("w") + F.col("cut.k")).cast("long").alias("sequence_id"), (low - left).alias("offset"))

    # Keys without nulls, so that the join finds both sides dealt as it needs them.
    key = {"k": F.coalesce("doc_id", F.lit(0)), "is_null": F.isnull("doc_id")}
    pieces = whole.unionByName(seated).unionByName(loose).withColumns(key).groupBy("k", "is_null", "tie").agg(
        F.sort_array(F.collect_list(F.struct("start", "length", "sequence_id", "offset"))).alias("pieces"))
    found = tokens.withColumns(key).dropDuplicates(["k", "is_null", "tie"]).join(pieces, ["k", "is_null", "tie"])
    kind = PACKED if with_ids else PACKED.rpartition(",")[0]
    return found.select("doc_id", "n_tokens", "ids", "pieces").mapInArrow(_cutter(with_ids), kind)
