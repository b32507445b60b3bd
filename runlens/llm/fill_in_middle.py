"""Fill-in-the-middle: documents cut in three by keyed draws and put together again in another order.

Every text becomes pieces of whole units, keyed by document and output position. One shuffle brings a document's pieces
to one task, sorted by position inside the partition (the DataFrame form of repartitionAndSortWithinPartitions), and
the task streams them: into digests of the output, and, sorted anew, into digests of the text that the output restores. No
task holds more than one input text or, later, one piece.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import text_or_empty

PIECE = 1 << 15  # bytes of a piece, at most
BLOCK = 1 << 20  # bytes whose units are looked at together
BATCH_ROWS, BATCH_BYTES = 4_000, 1 << 22
LAST = 1 << 62


@dataclass(frozen=True)
class Plan:
    """The marks, the key of the draws, and which share stays plain or puts the suffix first (of 100)."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    key: str = "1:"
    moved: int = 90
    suffix_first: int = 20

    def __post_init__(self):
        marks = (self.prefix, self.suffix, self.middle)
        if any(not m or m[i:] == o[: len(m) - i] for m in marks for o in marks for i in range(m is o, len(m))):
            raise ValueError("no end of a mark may be the start of a mark")


PLAN = Plan()


def unit_starts(data: np.ndarray) -> np.ndarray:
    """For each byte of a text, whether a unit (a run of ASCII letters, or one other code point) starts there."""
    low = data | 32
    letter = (low >= 97) & (low <= 122)
    starts = (data & 0xC0) != 0x80
    starts[1:] &= ~(letter[1:] & letter[:-1])
    return starts


def nth_start(starts: np.ndarray, k: int) -> int:
    """Where unit ``k`` (from 0) starts; the end of the text if there is none."""
    for at in range(0, len(starts), BLOCK):
        block = starts[at : at + BLOCK]
        here = int(np.count_nonzero(block))
        if k < here:
            return at + int(np.flatnonzero(block)[k])
        k -= here
    return len(starts)


def cuts(starts: np.ndarray, first: int, last: int, most: int = PIECE) -> Iterator[tuple[int, int]]:
    """Pieces of ``first:last``, of whole units; a letter run over ``most`` bytes is cut inside."""
    while last - first > most:
        inner = np.flatnonzero(starts[first + 1 : first + most + 1])
        end = first + 1 + int(inner[-1]) if len(inner) else first + most
        yield first, end
        first = end
    if first < last:
        yield first, last


def code_points(data: np.ndarray) -> int:
    return int(np.count_nonzero((data & 0xC0) != 0x80))


Head = tuple[int, str, int | None, int | None]


def cut_text(text: bytes, draws: tuple[int, int, int, int], plan: Plan = PLAN) -> tuple[Head, Iterator[bytes]]:
    """``(n, form, prefix_chars, middle_chars)`` of a text and the pieces of its output, in order."""
    data = np.frombuffer(text, dtype=np.uint8)
    starts = unit_starts(data.copy()) if len(data) else np.zeros(0, dtype=bool)
    n = int(np.count_nonzero(starts))
    marks = [m.encode() for m in (plan.prefix, plan.suffix, plan.middle)]
    if not text or any(m in text for m in marks) or draws[2] % 100 >= plan.moved:
        return (n, "plain", None, None), (text[a:b] for a, b in cuts(starts, 0, len(text)))
    a, b = (nth_start(starts, k) for k in sorted((draws[0] % (n + 1), draws[1] % (n + 1))))
    parts = [(marks[0], 0, a), (marks[1], b, len(text)), (marks[2], a, b)]
    form = "psm"
    if draws[3] % 100 < plan.suffix_first:
        form, parts = "spm", [parts[1], parts[0], parts[2]]

    def pieces() -> Iterator[bytes]:
        for mark, first, last in parts:
            for x, y in cuts(starts, first, last):
                yield mark + text[x:y]
                mark = b""
            if mark:
                yield mark

    return (n, form, code_points(data[:a]), code_points(data[a:b])), pieces()


def restored(form: str, pieces: Iterator[bytes], plan: Plan = PLAN) -> Iterator[tuple[int, bytes]]:
    """Pieces of the original text with the number of their part, found in an output by its marks alone.

    A mark may be cut anywhere between two pieces.
    """
    if form == "plain":
        yield from ((0, p) for p in pieces)
        return
    order = [(0, plan.prefix), (2, plan.suffix), (1, plan.middle)]
    marks = [(part, m.encode()) for part, m in (order if form == "psm" else [order[1], order[0], order[2]])]
    part, left = None, b""
    for piece in pieces:
        left += piece
        while marks and (at := left.find(marks[0][1])) >= 0:
            if at:
                yield part, left[:at]
            part, mark = marks.pop(0)
            left = left[at + len(mark) :]
        hold = max((k for k in range(1, len(marks[0][1])) if left.endswith(marks[0][1][:k])), default=0) if marks else 0
        if len(left) > hold:
            yield part, left[: len(left) - hold]
            left = left[len(left) - hold :]
    if left:
        yield part, left


def _draw(digest: Column, group: int) -> Column:
    return F.conv(F.substring(digest, 8 * group + 1, 8), 16, 10).cast("long")


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: Callable[[tuple], int]) -> Iterator[pa.RecordBatch]:
    held, held_bytes = [], 0
    for row in rows:
        held.append(row)
        held_bytes += size(row)
        if len(held) >= BATCH_ROWS or held_bytes >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, held_bytes = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


KEY = ["home", "doc_id", "body"]
HEAD = ["n", "form", "prefix_chars", "middle_chars"]
_HEAD_SQL = "n long, form string, prefix_chars long, middle_chars long"
_HEAD_ARROW = [("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64())]


def _schemas(docs: DataFrame) -> tuple[str, list[tuple[str, pa.DataType]]]:
    """The key columns: of which input partition, which document and which text a piece is."""
    kind = docs.schema["doc_id"].dataType
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}.get(kind.simpleString())
    if arrow is None:
        raise TypeError(f"doc_id must be an integer or a string, not {kind.simpleString()}")
    return f"home int, doc_id {kind.simpleString()}, body binary", [("home", pa.int32()), ("doc_id", arrow), ("body", pa.binary())]


def pieces(docs: DataFrame, plan: Plan = PLAN) -> DataFrame:
    """Output pieces ``home, doc_id, body, position, piece`` and, at position -1, one row of facts per document.

    Rows with one doc_id and one text are told apart by nothing but the input partition ``home``, which keeps copies of
    one row, however many, from meeting in one task; copies in one partition share their positions.
    """
    key_sql, key_arrow = _schemas(docs)
    digest = F.sha2(F.concat(F.lit(plan.key), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    rows = docs.select("doc_id", text_or_empty().alias("text")).select(
        F.spark_partition_id().alias("home"), "doc_id", F.unhex(F.md5("text")).alias("body"), F.col("text").cast("binary").alias("text"),
        digest.alias("draws"),
    ).select("home", "doc_id", "body", "text", *[_draw(F.col("draws"), i).alias(f"h{i + 1}") for i in range(4)])
    schema = pa.schema([*key_arrow, ("position", pa.int64()), ("piece", pa.binary()), *_HEAD_ARROW])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            for home, doc_id, body, text, *draws in _rows(batches):
                head, parts = cut_text(text, draws, plan)
                yield home, doc_id, body, -1, None, *head
                for i, part in enumerate(parts):
                    yield home, doc_id, body, i, part, None, None, None, None

        return _batches(each(), schema, lambda r: len(r[4] or b""))

    return rows.mapInArrow(cut, f"{key_sql}, position long, piece binary, {_HEAD_SQL}")


def _sorted(found: DataFrame) -> DataFrame:
    return found.repartition(*KEY).sortWithinPartitions(*KEY, "position")


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, int, Head, Iterator[bytes]]]:
    """For each key of a sorted partition: how often it occurs, its facts and its pieces as a stream, copies once."""
    for key, rows in groupby(_rows(batches), key=lambda r: r[:3]):
        head, copies, first = None, 0, None
        for row in rows:
            if row[3] >= 0:
                first = row
                break
            head, copies = row[5:], copies + 1

        def stream(row=first, rows=rows):
            at = -1
            while row is not None:
                if row[3] != at:
                    at = row[3]
                    yield row[4]
                row = next(rows, None)

        yield key, copies, head, stream()


def transformed(docs: DataFrame, plan: Plan = PLAN) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output``: the transformed text of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = pa.schema([_schemas(docs)[1][1], *_HEAD_ARROW, ("output", pa.large_string())])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            for key, copies, head, parts in _documents(batches):
                text = b"".join(parts).decode()
                for _ in range(copies):
                    yield key[1], *head, text

        return _batches(each(), schema, lambda r: len(r[-1]))

    return _sorted(pieces(docs, plan)).mapInArrow(join, f"doc_id {kind}, {_HEAD_SQL}, output string")


def digests(docs: DataFrame, plan: Plan = PLAN) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256`` for every row of ``docs``.

    ``docs`` has doc_id and text; other columns are not read. A null or empty text has no units, stays plain and has the
    digest of the empty string; a null doc_id draws as an empty one. Repeated rows give one row each, an empty table
    gives none. A text is cut whole; its output goes through a task piece by piece.
    """
    key_sql, key_arrow = _schemas(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    facts = [*_HEAD_ARROW, ("output_sha256", pa.string())]
    again = pa.schema([*key_arrow, ("position", pa.int64()), ("piece", pa.binary()), *facts, ("copies", pa.int64())])
    final = pa.schema([key_arrow[1], *facts, ("restored_sha256", pa.string())])

    def assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Digest of each output; its pieces again, keyed by where they were in the text."""

        def each():
            for key, copies, head, parts in _documents(batches):
                whole = hashlib.sha256()

                def seen():
                    for p in parts:
                        whole.update(p)
                        yield p

                for i, (part, piece) in enumerate(restored(head[1], seen(), plan)):
                    yield *key, (part << 48) + i, piece, None, None, None, None, None, None
                yield *key, LAST, None, *head, whole.hexdigest(), copies

        return _batches(each(), again, lambda r: len(r[4] or b""))

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            for key, rows in groupby(_rows(batches), key=lambda r: r[:3]):
                whole = hashlib.sha256()
                for row in rows:
                    if row[3] < LAST:
                        whole.update(row[4])
                    else:
                        for _ in range(row[-1]):
                            yield key[1], *row[5:10], whole.hexdigest()

        return _batches(each(), final, lambda r: 100)

    there = _sorted(pieces(docs, plan)).mapInArrow(assembled, f"{key_sql}, position long, piece binary, {_HEAD_SQL}, output_sha256 string, copies long")
    # Pieces of a document are still in one partition, so sorting them anew needs no shuffle.
    back = there.sortWithinPartitions(*KEY, "position")
    return back.mapInArrow(checked, f"doc_id {kind}, {_HEAD_SQL}, output_sha256 string, restored_sha256 string")


def digests_sql(plan: Plan = PLAN) -> str:
    """The same rows in DuckDB."""
    draw = "CAST('0x' || substr(sha256('{k}' || coalesce(CAST(doc_id AS VARCHAR), '')), {a}, 8) AS BIGINT) AS h{i}"
    draws = ", ".join(draw.format(k=plan.key, a=8 * i + 1, i=i + 1) for i in range(4))
    p, s, m = plan.prefix, plan.suffix, plan.middle
    marked = " OR ".join(f"contains(t, '{x}')" for x in (p, s, m))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, {draws} FROM documents),
f AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
  CASE WHEN t = '' OR {marked} OR h3 % 100 >= {plan.moved} THEN 'plain' WHEN h4 % 100 < {plan.suffix_first} THEN 'spm' ELSE 'psm' END AS form FROM d),
c AS (SELECT *, array_to_string(u[1 : a], '') AS p, array_to_string(u[a + 1 : b], '') AS m, array_to_string(u[b + 1 : n], '') AS s FROM f)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{p}' || p || '{s}' || s || '{m}' || m ELSE '{s}' || s || '{p}' || p || '{m}' || m END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM c"""
