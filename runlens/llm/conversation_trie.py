"""Prefix tree of conversations: what they share, by the Euler-tour technique.

Every distinct sequence of first turns is a node. Each node has an arc that enters it and one that leaves it; the arcs form one
list, which is ranked by splicing out arcs that have the least hash among their neighbours, round by round. Leaves and savings of a
subtree are differences of prefix sums at a node's two arcs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import discard, stored, text_or_empty

BASE = 20_000  # arcs that are left to one plain walk
STRETCH = 8_192  # turns of a conversation, or children of a node, that meet in one task
CHUNK = 1 << 15  # characters of member lists that travel as one row


def numbered(df: DataFrame, order: list[str], out: str, name: str) -> DataFrame:
    """``df`` stored in the order of ``order``, with consecutive numbers from 0.

    Rows are sorted in ranges; only one count per range is added up in one place and handed to all.
    """
    placed = stored(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()), name)
    part = F.shiftright("__at", 33)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    out_number = (F.col("__start") + F.col("__at").bitwiseAND((1 << 33) - 1)).alias(out)
    return placed.withColumn("__part", part).join(F.broadcast(starts), "__part").select(*df.columns, out_number)


def sequences(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns in order, ``c, place, body, chars``, and one row per conversation, ``c, conv_id, n``.

    ``c`` numbers conversations without nulls; ``place`` counts from 0; ``body`` stands for role and text.
    """
    rows = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), text_or_empty().alias("text"), F.spark_partition_id().alias("home")
    )
    body = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    placed = numbered(rows, ["conv_id", "turn", "role", "text", "home"], "at", "trie-turns").select(
        "conv_id", "at", body.alias("body"), F.length("text").cast("long").alias("chars")
    )
    convs = stored(placed.groupBy("conv_id").agg(F.min("at").alias("c"), F.count("*").alias("n")), "trie-conversations")
    joined = placed.alias("r").join(convs.alias("k"), F.col("r.conv_id").eqNullSafe(F.col("k.conv_id")))
    return joined.select("k.c", "k.conv_id", (F.col("at") - F.col("c")).alias("place"), "body", "chars"), convs


def shared_heads(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same for rebuilt conversations: the first h turns of conversation c - c % 100, then the own turns after h.

    h is crc32(c) % 6. A conversation that has no conv_id keeps its turns.
    """
    rows, convs = sequences(turns)
    rows = stored(rows, "trie-places")
    head = (F.crc32(F.col("conv_id").cast("string")) % 6).cast("long")
    plan = convs.withColumns({"h": F.coalesce(head, F.lit(0)), "base": F.col("conv_id") - F.col("conv_id") % 100})
    of = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"), F.col("c").alias("base_c"))
    plan = plan.join(of, "base", "left").withColumn("b", F.least("h", F.coalesce("base_n", F.lit(0))))
    plan = stored(plan.withColumn("length", F.col("b") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "trie-plan")
    own = rows.join(plan.select("c", "b", "h"), "c").where("place >= h").select(
        "c", (F.col("b") + F.col("place") - F.col("h")).alias("place"), "body", "chars"
    )
    heads = rows.where("place < 5 AND conv_id % 100 = 0").select(F.col("c").alias("base_c"), "place", "body", "chars")
    taken = plan.where("b > 0").select("c", "base_c", "b").join(heads, "base_c").where("place < b").select("c", "place", "body", "chars")
    return own.unionByName(taken), plan.select("c", "conv_id", F.col("length").alias("n"))


def _number(digest: Column, at: int) -> Column:
    return F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(20,0)")


def _key(depth: Column, x: Column, y: Column) -> Column:
    return F.unhex(F.md5(F.concat_ws(":", depth, x, y)))


def keyed(rows: DataFrame) -> DataFrame:
    """``c, depth, key, parent_key, chars`` for each turn: its node and the node before.

    A node is known by its depth and two sums, over its turns, of 60-bit hashes of turn and place, which name the sequence as a
    chain of digests would but can be summed in parallel: inside stretches of a conversation and over their totals.
    """
    mixed = F.sha2(F.concat_ws(":", "place", "body"), 256)
    rows = rows.withColumn("__mixed", mixed).select(
        "c", "place", "chars", _number(F.col("__mixed"), 1).alias("x"), _number(F.col("__mixed"), 16).alias("y"),
        F.floor(F.col("place") / STRETCH).alias("stretch"),
    )
    totals = rows.groupBy("c", "stretch").agg(F.sum("x").alias("tx"), F.sum("y").alias("ty"))
    before = Window.partitionBy("c").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("c", "stretch", F.sum("tx").over(before).alias("sx"), F.sum("ty").over(before).alias("sy")).where("stretch > 0")
    inside = Window.partitionBy("c", "stretch").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = rows.withColumns({"ix": F.sum("x").over(inside), "iy": F.sum("y").over(inside)}).join(starts, ["c", "stretch"], "left")
    zero = F.lit(0).cast("decimal(38,0)")
    ends = [(F.col(f"i{a}") + F.coalesce(f"s{a}", zero)).cast("decimal(38,0)") for a in "xy"]
    depth = F.col("place") + 1
    return summed.select(
        "c", depth.alias("depth"), _key(depth, *ends).alias("key"),
        _key(F.col("place"), *[(e - F.col(a)).cast("decimal(38,0)") for e, a in zip(ends, "xy")]).alias("parent_key"), "chars",
    )


def member_digests(ends: DataFrame) -> DataFrame:
    """``key, ends_sha256`` from ``key, conv_id``: digest of the sorted, comma-joined conv_ids of each key.

    A digest is a chain, so one task reads all members of a key; it reads them as few long strings, which the tasks of a sort make
    before, and holds one at a time. A null conv_id comes first, as ``null``.
    """
    parts = pa.schema([("key", pa.binary()), ("first", pa.int64()), ("members", pa.string())])

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        held: list[tuple] = []
        for key, group in groupby(rows, key=lambda r: r[0]):
            first, ids, size = None, [], 0
            for _, conv in group:
                if not ids:
                    first = conv
                ids.append("null" if conv is None else str(conv))
                size += len(ids[-1]) + 1
                if size >= CHUNK:
                    held.append((key, first, ",".join(ids)))
                    ids, size = [], 0
            if ids:
                held.append((key, first, ",".join(ids)))
            if len(held) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), parts)], schema=parts)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), parts)], schema=parts)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        out: list[tuple] = []
        for key, group in groupby(rows, key=lambda r: r[0]):
            whole = hashlib.sha256()
            for i, (_, _, members) in enumerate(group):
                whole.update(("," * (i > 0) + members).encode())
            out.append((key, whole.hexdigest()))
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["key", "ends_sha256"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["key", "ends_sha256"])

    listed = ends.orderBy("key", "conv_id").select("key", "conv_id").mapInArrow(chunks, "key binary, first long, members string")
    return listed.repartition("key").sortWithinPartitions("key", "first").mapInArrow(digest, "key binary, ends_sha256 string")


def prefix_sums(arcs: DataFrame, head: int = 0) -> DataFrame:
    """``arc, p, q``: sums of ``u`` and ``v`` over all arcs before, along the list ``arc, next, u, v`` that starts at ``head``.

    A round splices out each arc whose hash is below those of the arc before and the arc after: about a third, never two
    neighbours, so what is left shrinks like a geometric series. When at most ``BASE`` arcs are left, one walk settles them,
    and the rounds put the others back in reverse. Every round is a table in the shared folder. An empty list gives no rows.
    """
    active, gone, turn = stored(arcs.select("arc", "next", "u", "v"), "tour"), [], 0

    def lower(a: str, b: str) -> Column:
        return F.coalesce(F.xxhash64(F.lit(turn), F.col(a)) < F.xxhash64(F.lit(turn), F.col(b)), F.lit(False)) & F.col(a).isNotNull() & F.col(b).isNotNull()

    while active.count() > BASE:
        turn += 1
        before = active.where(lower("next", "arc")).select(
            F.col("next").alias("to"), F.col("arc").alias("before"), F.col("u").alias("bu"), F.col("v").alias("bv")
        )
        met = active.join(before, F.col("arc") == F.col("to"), "left").withColumns({
            "spliced": F.col("before").isNotNull() & lower("arc", "next"),
            "told": lower("next", "arc"),
        })

        def row(kind: int, arc: str, after: str, u: Column, v: Column) -> Column:
            return F.struct(F.lit(kind).alias("kind"), F.col(arc).alias("arc"), F.col(after).alias("next"), u.alias("u"), v.alias("v"))

        bu, bv, u, v = (F.col(c) for c in ("bu", "bv", "u", "v"))
        rows = F.array_compact(F.array(
            F.when(F.col("spliced"), row(0, "arc", "before", bu, bv)),
            F.when(F.col("spliced"), row(1, "before", "next", bu + u, bv + v)),
            F.when(F.col("before").isNotNull() & ~F.col("spliced"), row(1, "before", "arc", bu, bv)),
            F.when(~F.col("spliced") & ~F.col("told"), row(1, "arc", "next", u, v)),
        ))
        both = stored(met.select(F.inline(rows)), "tour", partition_by=["kind"])
        if turn == 1:
            discard(active)
        gone.append(both)
        active = both.where("kind = 1").drop("kind")

    after = {r["arc"]: (r["next"], r["u"], r["v"]) for r in active.collect()}  # at most BASE
    at, p, q, walked = head, 0, 0, []
    while at in after:
        walked.append((at, p, q))
        at, u, v = after[at]
        p, q = p + u, q + v
    known = stored(arcs.sparkSession.createDataFrame(walked, "arc long, p long, q long"), "tour-sums")
    for both in reversed(gone):
        back = both.where("kind = 0").select(F.col("arc").alias("own"), F.col("next").alias("before"), "u", "v")
        put = back.join(known, F.col("before") == F.col("arc")).select(F.col("own").alias("arc"), (F.col("p") + F.col("u")).alias("p"), (F.col("q") + F.col("v")).alias("q"))
        more = stored(known.unionByName(put), "tour-sums")
        discard(known, both)
        known = more
    return known


def trie(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per node of the conversations ``rows`` (c, place, body, chars) and ``convs`` (c, conv_id, n).

    Columns: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens``, ``ends_sha256``.
    """
    spark = rows.sparkSession
    convs = stored(convs, "trie-members")
    if convs.isEmpty():
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    turns = stored(keyed(rows).join(convs, "c"), "trie-keys")
    root = _key(F.lit(0), F.lit(0), F.lit(0))
    ends = turns.where("depth = n").select("key", "conv_id").unionByName(convs.where("n = 0").select(root.alias("key"), "conv_id"))

    facts = [F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")]
    top = convs.agg(*facts).select(root.alias("key"), F.lit(None).cast("binary").alias("parent_key"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("chars"), "n_convs", "conv_id")
    # Depth, parent and length go with the key; as grouping columns they leave the rest to a hash aggregate.
    nodes = turns.groupBy("key", "parent_key", "depth", "chars").agg(*facts).unionByName(top)
    # Children of a node have consecutive numbers, in the order of their keys.
    nodes = stored(numbered(nodes, ["depth", "parent_key", "key"], "id", "trie-sorted"), "trie-nodes")
    kids = nodes.where("depth > 0").groupBy(F.col("parent_key").alias("key")).agg(
        F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("n_children")
    )
    family = stored(nodes.join(kids, "key", "left").withColumn("saved", (F.col("n_convs") - 1) * F.col("chars")), "trie-family")

    # A node meets its children in stretches, so one with a third of all nodes below it is spread.
    stretch = F.floor(F.col("id") / STRETCH)
    spans = family.where("n_children > 0").select(
        F.col("key").alias("parent_key"), F.col("id").alias("parent"), F.col("last").alias("youngest"), F.col("conv_id").alias("parent_conv_id"),
        F.explode(F.sequence(F.floor(F.col("first") / STRETCH), F.floor(F.col("last") / STRETCH))).alias("stretch"),
    )
    placed = stored(family.withColumn("stretch", stretch).join(spans, ["parent_key", "stretch"], "left").drop("stretch", "parent_key"), "trie-placed")

    inner = F.col("n_children") > 0
    down = F.when(inner, 2 * F.col("first")).otherwise(2 * F.col("id") + 1)
    up = F.when(F.col("id") < F.col("youngest"), 2 * F.col("id") + 2).otherwise(2 * F.col("parent") + 1)
    leaf = F.when(inner, 0).otherwise(1).cast("long")
    zero = F.lit(0).cast("long")
    tour = placed.select(F.inline(F.array(
        F.struct((2 * F.col("id")).alias("arc"), down.alias("next"), leaf.alias("u"), F.col("saved").alias("v")),
        F.struct((2 * F.col("id") + 1).alias("arc"), up.alias("next"), zero.alias("u"), zero.alias("v")),
    )))
    sums = prefix_sums(tour)
    sign = F.when(F.col("arc") % 2 == 1, 1).otherwise(-1)
    below = sums.groupBy(F.floor(F.col("arc") / 2).alias("id")).agg(F.sum(sign * F.col("p")).alias("n_leaves"), F.sum(sign * F.col("q")).alias("saved_tokens"))
    out = placed.join(below, "id").join(member_digests(ends), "key", "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def shared_trie(turns: DataFrame) -> DataFrame:
    """The prefix tree of conversations rebuilt by :func:`shared_heads`.

    ``turns`` has conv_id, turn, role, text; other columns are not read. Turns are ordered by turn (null first), then role, then
    text; repeated rows are turns of their own. A null role or text is empty. Rows without conv_id are one conversation more, a
    member that has no smallest number and is written ``null`` in member lists. An empty table gives no rows.
    """
    return trie(*shared_heads(turns))


def conversation_trie(turns: DataFrame) -> DataFrame:
    """The prefix tree of the conversations as they are."""
    rows, convs = sequences(turns)
    return trie(rows.drop("conv_id"), convs)


# CRC-32 of a text in DuckDB, a byte and eight shifts at a time.
_CRC = """xor(list_reduce(flatten([[CAST(4294967295 AS BIGINT)], flatten(list_transform(string_split(s, ''),
  lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))]),
  lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295)"""

TRIE_SQL = f"""
WITH c AS (SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS t,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS q FROM conversations),
g AS (SELECT conv_id, n, {_CRC} % 6 AS h, conv_id - conv_id % 100 AS base FROM
    (SELECT conv_id, CAST(conv_id AS VARCHAR) AS s, count(*) AS n FROM c GROUP BY conv_id)),
k AS (SELECT g.*, least(g.h, coalesce(o.n, 0)) AS b FROM g LEFT JOIN g o ON o.conv_id = g.base),
s AS (SELECT k.conv_id, q + 1 AS d, r, t FROM k JOIN c ON c.conv_id = k.base AND q < b
  UNION ALL SELECT k.conv_id, b + q - h + 1, r, t FROM k JOIN c ON c.conv_id = k.conv_id WHERE q >= h),
p AS (SELECT conv_id, d, t, md5(string_agg(length(r) || ':' || r || length(t) || ':' || t, '') OVER (PARTITION BY conv_id ORDER BY d)) AS key FROM s
  UNION ALL SELECT conv_id, 0, '', '' FROM k),
l AS (SELECT conv_id, max(d) AS l FROM p GROUP BY conv_id),
n AS (SELECT d, key, min(conv_id) AS rep, count(*) AS n_convs, (count(*) - 1) * any_value(length(t)) AS s,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (d = l), '')) AS ends_sha256
  FROM p JOIN l USING (conv_id) GROUP BY d, key),
e AS (SELECT n.*, o.key AS up FROM n LEFT JOIN p o ON o.conv_id = n.rep AND o.d = n.d - 1),
f AS (SELECT up, count(*) AS m FROM e WHERE d > 0 GROUP BY up),
w AS (SELECT o.key, count(*) FILTER (f.m IS NULL) AS n_leaves, sum(e.s) AS saved FROM e LEFT JOIN f ON f.up = e.key
  JOIN p o ON o.conv_id = e.rep AND o.d <= e.d GROUP BY o.key)
SELECT e.rep AS conv_id, e.d AS depth, o.rep AS parent_conv_id, e.n_convs, coalesce(f.m, 0) AS n_children, n_leaves,
  CAST(saved AS BIGINT) AS saved_tokens, e.ends_sha256
FROM e LEFT JOIN n o ON o.key = e.up LEFT JOIN f ON f.up = e.key JOIN w ON w.key = e.key"""
