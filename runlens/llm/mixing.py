"""Mixing sources to target weights.

Each source's words are packed into blocks of one length. An urn holds as many tickets of a source as its target has
blocks; a pseudorandom permutation deals all tickets to the slots of output shards, so a shard's counts by source are
multinomial draws, given the totals. A source's tickets, pass by pass, go through a pseudorandom permutation of its
block numbers, and blocks join the slots by number.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import LongType

from .common import running_start, stored, text_or_empty, word_count, words
from .hashing import U, mixed

BLOCK = 64  # words
SHARD = 1024  # blocks
MOST_PASSES = 3
WEIGHTS = (1, 2, 3)
ROUNDS = 4
STRIDE = 10_000  # tickets that one row is expanded to
TASK = 20  # such rows that one task expands, about


def permuted(index: np.ndarray, size: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of 0..size-1 for each seed: Feistel rounds, walked until inside the range."""
    index, size, seed = (np.asarray(x).astype(np.int64).view(U).copy() for x in (index, size, seed))
    half = np.zeros(len(index), dtype=U)
    for bits in range(1, 32):
        half[(U(1) << (U(2) * U(bits))) < size] = bits  # ends one below what is needed
    half += U(1)
    mask = (U(1) << half) - U(1)
    todo = np.arange(len(index))
    while len(todo):
        x, h, m, s = index[todo], half[todo], mask[todo], seed[todo]
        left, right = x >> h, x & m
        for r in range(ROUNDS):
            left, right = right, left ^ (mixed(right + s * U(0x9E3779B97F4A7C15) + U((r + 1) * 0xD1B54A32D192ED03 % (1 << 64))) & m)
        index[todo] = (left << h) | right
        todo = todo[index[todo] >= size[todo]]
    return index.view(np.int64)


@F.pandas_udf(LongType())
def permute(index: pd.Series, size: pd.Series, seed: pd.Series) -> pd.Series:
    return pd.Series(permuted(index.to_numpy(), size.to_numpy(), seed.to_numpy()))


def sized(docs: DataFrame) -> DataFrame:
    """``doc_id, source, tie, size`` of every row; ``tie`` tells texts apart where doc_id does not."""
    text = text_or_empty()
    return docs.select("doc_id", "source", F.xxhash64(text).alias("tie"), word_count(text).alias("size"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_PASSES) -> DataFrame:
    """``source, number, source_size, target``: all words shared by weight, at most ``most`` times a source's own.

    Sources take the weights in turn, in code point order with null last. With sources in order of cap by weight,
    those before the first whose cap exceeds its share of what is left are capped. One row per source.
    """
    by_name = Window.orderBy(F.isnull("source"), "source")
    by_cap = Window.orderBy(F.col("source_size") / F.col("weight"), "number")
    before, rest = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    own = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    own = own.withColumn("number", F.row_number().over(by_name).cast("long") - 1)
    own = own.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("number") % len(weights) + 1).cast("int")))
    own = own.withColumns({
        "total": F.sum("source_size").over(everything),
        "capped": most * F.coalesce(F.sum("source_size").over(before), F.lit(0)),
        "shares": F.sum("weight").over(rest),
    })
    own = own.withColumn("level", (F.col("total") - F.col("capped")).cast("double") / F.col("shares"))
    free = F.when(most * F.col("source_size") > F.col("weight") * F.col("level"), F.col("level"))
    whole = by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own = own.withColumn("free_level", F.first(free, ignorenulls=True).over(whole))
    share = F.least((most * F.col("source_size")).cast("double"), F.col("weight") * F.coalesce("free_level", F.lit(0.0)))
    return own.select("source", "number", "source_size", share.alias("target"))


def _tickets(sources: DataFrame, block: int, shard: int, most: int, seed: int) -> DataFrame:
    """``number, block, pass, shard, slot``: what each ticket takes and where it goes."""
    # A source's blocks are its words over the block length; its last block may be short, so a ticket is
    # worth the mean block.
    rows = sources.where("source_size > 0").withColumn("n_blocks", F.ceil(F.col("source_size") / block))
    drawn = F.round(F.col("target") * F.col("n_blocks") / F.col("source_size"))
    rows = rows.withColumn("n_tickets", F.least(drawn.cast("long"), most * F.col("n_blocks")))
    before = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({
        "first": F.coalesce(F.sum("n_tickets").over(before), F.lit(0)),
        "all": F.sum("n_tickets").over(Window.partitionBy(F.lit(0))),
    }).where("n_tickets > 0")
    # With a count of its own the shuffle is left as it is; else its few rows would be merged into one task, tickets and all.
    strides = rows.agg(F.sum(F.ceil(F.col("n_tickets") / STRIDE))).first()[0] or 0
    rows = rows.withColumn("from", F.explode(F.expr(f"sequence(0L, n_tickets - 1, {STRIDE}L)"))).repartition(math.ceil(strides / TASK) or 1, "number", "from")
    rows = rows.withColumn("ticket", F.explode(F.expr(f"sequence(from, least(from + {STRIDE}L, n_tickets) - 1)")))
    turn = F.floor(F.col("ticket") / F.col("n_blocks"))
    return (
        rows.withColumns({
            "pass": turn,
            "block": permute(F.col("ticket") % F.col("n_blocks"), F.col("n_blocks"), F.col("number") * 16 + turn + seed),
            "place": permute(F.col("first") + F.col("ticket"), F.col("all"), F.lit(seed) - 1),
        })
        .select("number", "block", "pass", F.floor(F.col("place") / shard).alias("shard"), (F.col("place") % shard).alias("slot"))
    )


def mix(sizes: DataFrame, block: int = BLOCK, shard: int = SHARD, most: int = MOST_PASSES, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """Deal blocks to shards. ``sizes`` is a stored :func:`sized`.

    Gives the documents (doc_id, source, tie, size, number, source_size, target, start: words of the source before it)
    and the mix (shard, slot, number, start, pass, from, n_words: words [from, from + n_words) of the document that starts there).
    Rows without words have no place in the mix; null sources are one source; repeated rows lie one after the other. A
    block is drawn at most ``most`` times, so no document exceeds that many times its size. The same rows
    and seed give the same mix.
    """
    sources = stored(targets(sizes, most=most), "mix-sources")
    docs = sizes.alias("d").join(sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
    docs = stored(docs.select("d.*", "s.number", "s.source_size", "s.target"), "mix-documents")
    docs = stored(running_start(docs, ["number"], ["doc_id", "tie"], "size", "start", docs.count()), "mix-offsets")
    pieces = docs.where("size > 0").select("number", "start", "size", F.explode(
        F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")).alias("block"))
    low = F.greatest(F.col("block") * block, F.col("start"))
    high = F.least(F.col("block") * block + block, F.col("start") + F.col("size"))
    pieces = pieces.select("number", "block", "start", (low - F.col("start")).alias("from"), (high - low).alias("n_words"))
    # Spark takes the tickets for as small as the sources they are expanded from, and would broadcast them.
    tickets = _tickets(sources, block, shard, most, seed).hint("merge")
    return docs, pieces.join(tickets, ["number", "block"]).select(
        "shard", "slot", "number", "start", "pass", "from", "n_words"
    )


def taken(docs: DataFrame, mixed_pieces: DataFrame) -> DataFrame:
    """``docs`` with ``taken``, the words of each that the mix holds, repeats counted."""
    sums = mixed_pieces.groupBy(F.col("number").alias("n"), F.col("start").alias("s")).agg(F.sum("n_words").alias("taken"))
    on = (F.col("number") == F.col("n")) & (F.col("start") == F.col("s")) & (F.col("size") > 0)
    return docs.join(sums, on, "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long")).drop("n", "s")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: a row for each document and pass that the mix holds, with all columns of ``docs``.

    A pass that holds the whole document keeps its text; else the text is the words that were drawn, in
    order, joined by spaces. ``n_chars`` is set anew if there is such a column.
    """
    sizes = stored(sized(docs), "mix-sizes")
    placed, pieces = mix(sizes, **options)
    parts = pieces.groupBy("number", "start", "pass").agg(
        F.array_sort(F.collect_list(F.struct("from", "n_words"))).alias("__parts"), F.sum("n_words").alias("__sum")
    )
    parts = placed.where("size > 0").join(parts, ["number", "start"]).select(
        F.col("doc_id").alias("__id"), F.col("tie").alias("__tie"), "__parts", F.col("__sum").alias("__taken"), (F.col("__sum") == F.col("size")).alias("__whole")
    )
    rows = docs.withColumn("__t", F.xxhash64(text_or_empty())).dropDuplicates(["doc_id", "__t"])
    rows = rows.join(parts, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__t") == F.col("__tie")))
    said = words(F.col("text"))
    cut = F.flatten(F.transform("__parts", lambda p: F.slice(said, (p["from"] + 1).cast("int"), p["n_words"].cast("int"))))
    rows = rows.withColumn("text", F.when(F.col("__whole"), F.col("text")).otherwise(F.array_join(cut, " ")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)
