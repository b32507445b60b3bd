"""Approximate nearest neighbours over robust-pruned directed graphs, one for each shard.

Vectors are dealt to shards by hash. In a shard, points enter the graph in growing batches: a greedy beam search from the medoid
proposes neighbours, relaxed pruning keeps edges that are not shadowed by a nearer one, and reverse edges are
pruned alike. Queries go to every shard in blocks and walk its graph with a beam; exact distances
on the original vectors rank what the shards found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import stored

DEGREE = 32
BEAM = 64  # while the graph is built
SEARCH_BEAM = 160  # for queries
ALPHA = 1.2
SHARD = 4096  # vectors
BLOCK = 512  # queries

GRAPH = "d int, shard int, start int, edges binary, ids binary, vectors binary"


def _distances(points: np.ndarray, queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Squared distances of each query to its own row of candidates; candidate -1 is infinitely far."""
    found = points[np.maximum(candidates, 0)]
    found -= queries[:, None, :]
    out = np.einsum("qcd,qcd->qc", found, found)
    out[candidates < 0] = np.inf
    return out


def beam_search(points: np.ndarray, edges: np.ndarray, start: int, queries: np.ndarray, beam: int, keep_visited: bool = False):
    """Greedy searches of all queries side by side: each step expands the nearest unexpanded point of each beam.

    Gives the beams (ids, squared distances), nearest first, and, if asked, the expanded points of each query.
    """
    n, q = len(points), len(queries)
    ids = np.full((q, beam), -1, dtype=np.int64)
    dist = np.full((q, beam), np.inf, dtype=points.dtype)
    ids[:, 0] = start
    dist[:, 0] = _distances(points, queries, ids[:, :1])[:, 0]
    done = np.zeros((q, beam), dtype=bool)
    seen = np.zeros((q, n), dtype=bool)
    seen[:, start] = True
    visited: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    active = np.arange(q)
    while True:
        open_dist = np.where(done[active] | (ids[active] < 0), np.inf, dist[active])
        at = open_dist.argmin(axis=1)
        going = np.isfinite(open_dist[np.arange(len(active)), at])
        active, at = active[going], at[going]
        if not len(active):
            return ids, dist, visited
        done[active, at] = True
        here = ids[active, at]
        if keep_visited:
            visited.append((active, here, dist[active, at]))
        near = edges[here]
        fresh = (near >= 0) & ~seen[active[:, None], np.maximum(near, 0)]
        near = np.where(fresh, near, -1)
        rows, cols = np.nonzero(fresh)
        seen[active[rows], near[rows, cols]] = True
        new = _distances(points, queries[active], near)
        all_ids = np.concatenate([ids[active], near], axis=1)
        all_dist = np.concatenate([dist[active], new], axis=1)
        all_done = np.concatenate([done[active], np.zeros(near.shape, dtype=bool)], axis=1)
        best = np.argsort(all_dist, axis=1, kind="stable")[:, :beam]
        ids[active], dist[active], done[active] = (np.take_along_axis(x, best, axis=1) for x in (all_ids, all_dist, all_done))


def robust_prune(points: np.ndarray, owners: np.ndarray, candidates: np.ndarray, alpha: float, degree: int) -> np.ndarray:
    """Diverse neighbours of each owner from its row of candidates (-1: none; repeated ones count once).

    The nearest candidate stays, and those to which it is nearer, by the factor ``alpha``, than the owner is, go.
    """
    rows = len(owners)
    candidates = np.where(candidates == owners[:, None], -1, candidates)
    order = np.argsort(candidates, axis=1, kind="stable")
    candidates = np.take_along_axis(candidates, order, axis=1)
    candidates[:, 1:][candidates[:, 1:] == candidates[:, :-1]] = -1
    dist = _distances(points, points[owners], candidates)
    out = np.full((rows, degree), -1, dtype=np.int64)
    every, factor = np.arange(rows), points.dtype.type(alpha * alpha)
    for k in range(degree):
        best = dist.argmin(axis=1)
        live = np.isfinite(dist[every, best])
        if not live.any():
            break
        chosen = np.where(live, candidates[every, best], -1)
        out[:, k] = chosen
        between = _distances(points, points[np.maximum(chosen, 0)], candidates)
        dist[(factor * between <= dist) & live[:, None]] = np.inf
        dist[every, best] = np.inf
    return out


def build_graph(points: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, batch: int = 256) -> tuple[np.ndarray, int]:
    """Edges (rows of neighbours, -1: none) and the point where searches start."""
    n = len(points)
    edges = np.full((n, degree), -1, dtype=np.int64)
    middle = points.mean(axis=0, keepdims=True)
    start = int(_distances(points, middle, np.arange(n)[None, :])[0].argmin())
    order = np.random.default_rng(n).permutation(n)
    order = np.concatenate([[start], order[order != start]])
    at = 1
    while at < n:
        new = order[at : at + min(batch, max(at, 1))]
        at += len(new)
        ids, _, visited = beam_search(points, edges, start, points[new], beam, keep_visited=True)
        steps = np.full((len(new), len(visited)), -1, dtype=np.int64)
        for step, (who, where, _) in enumerate(visited):
            steps[who, step] = where
        edges[new] = robust_prune(points, new, np.concatenate([ids, steps], axis=1), alpha, degree)
        # Reverse edges: those that fit are appended, full rows are pruned again.
        source, target = np.repeat(new, degree), edges[new].ravel()
        source, target = source[target >= 0], target[target >= 0]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        owners, first, counts = np.unique(target, return_index=True, return_counts=True)
        incoming = np.full((len(owners), counts.max()), -1, dtype=np.int64)
        incoming[np.repeat(np.arange(len(owners)), counts), np.arange(len(target)) - np.repeat(first, counts)] = source
        for a in range(0, len(owners), 512):
            part = owners[a : a + 512]
            edges[part] = robust_prune(points, part, np.concatenate([edges[part], incoming[a : a + 512]], axis=1), alpha, degree)
    return edges, start


def _graph_maker(degree: int, beam: int, alpha: float):
    def make(rows: pa.Table) -> pa.Table:
        vectors = rows.column("vector").combine_chunks()
        points = vectors.flatten().to_numpy().reshape(len(rows), -1).astype(np.float32)
        edges, start = build_graph(points, degree, beam, alpha)
        ids = rows.column("node").to_numpy().astype(np.int64)
        return pa.table({
            "d": pa.array([rows.column("d")[0].as_py()], pa.int32()),
            "shard": pa.array([rows.column("shard")[0].as_py()], pa.int32()), "start": pa.array([start], pa.int32()),
            "edges": pa.array([edges.astype(np.int32).tobytes()]), "ids": pa.array([ids.tobytes()]), "vectors": pa.array([points.tobytes()]),
        })

    return make


def _searcher(beam: int, found: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids = np.frombuffer(r["ids"], dtype=np.int64)
                points = np.frombuffer(r["vectors"], dtype=np.float32).reshape(len(ids), -1)
                edges = np.frombuffer(r["edges"], dtype=np.int32).reshape(len(ids), -1).astype(np.int64)
                queries = np.array(r["vectors_q"], dtype=np.float32)
                if not len(queries) or queries.shape[1] != points.shape[1]:
                    continue
                for a in range(0, len(queries), 128):
                    near, _, _ = beam_search(points, edges, r["start"], queries[a : a + 128], max(beam, found))
                    near = near[:, :found]
                    who, col = np.nonzero(near >= 0)
                    q = np.array(r["query_ids"], dtype=np.int64)[a : a + 128]
                    yield pa.RecordBatch.from_arrays([pa.array(q[who]), pa.array(ids[near[who, col]])], ["query_id", "node"])

    return search


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, vector`` (doubles) of the rows that take part: not null, not zero, all components finite."""
    v = vectors.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.where(F.col("vec_id").isNotNull() & fine & F.exists("vector", lambda x: x != 0))


def distance(a: str, b: str):
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA,
            search_beam: int = SEARCH_BEAM, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest rows found for each query, itself left out.

    ``vectors`` and ``queries`` give vec_id and embedding; extra columns are not read. Null, zero and non-finite vectors and null ids take no part, on
    either side; vectors of another length than the query's are not its candidates. Equal vectors are one point of the index,
    which knows the ``k`` + 1 smallest ids of it, all that can be among the nearest. A repeated id counts once, with one of its vectors.
    An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = stored(usable(vectors).withColumn("hash", F.xxhash64("vector")), "ann-vectors")
    # Rank functions over equal vectors stop at k + 1 before they are shuffled.
    first = Window.partitionBy("hash", "vector").orderBy("vec_id")
    copies = rows.withColumn("copy", F.row_number().over(first)).where(F.col("copy") <= k + 1)
    copies = stored(copies.select("vec_id", "vector", "hash", "copy"), "ann-copies")
    nodes = copies.where("copy = 1").select(F.col("vec_id").alias("node"), "vector", "hash")
    total = nodes.count()
    n_shards = max(1, -(-total // shard))
    dealt = nodes.withColumns({"d": F.size("vector"), "shard": F.pmod(F.xxhash64(F.size("vector"), "hash"), F.lit(n_shards)).cast("int")})
    graphs = dealt.select("d", "shard", "node", "vector").groupBy("d", "shard").applyInArrow(_graph_maker(degree, beam, alpha), GRAPH)
    graphs = stored(graphs, "ann-graphs")

    asked = stored(usable(queries).select(F.col("vec_id").alias("query_id"), F.col("vector").alias("vector_q")).dropDuplicates(["query_id"]), "ann-queries")
    n_blocks = max(1, -(-asked.count() // block))
    blocks = asked.withColumn("block", F.struct(F.size("vector_q").alias("d"), F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)).alias("b")))
    blocks = blocks.groupBy("block").agg(F.collect_list(F.struct("query_id", F.transform("vector_q", lambda x: x.cast("float")).alias("v"))).alias("q"))
    blocks = blocks.select("block", F.col("q.query_id").alias("query_ids"), F.col("q.v").alias("vectors_q"))
    # Each block of the stated queries meets each shard: pairs of (shard, block) are listed, not rows.
    pairs = graphs.select("d", "shard").withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).withColumn(
        "block", F.struct("d", F.col("b").cast("long").alias("b")))
    work = pairs.hint("merge").join(blocks, "block").hint("merge").join(graphs, ["d", "shard"]).repartition(max(1, n_shards * n_blocks), "d", "shard", "block.b")
    found = work.mapInArrow(_searcher(search_beam, k + 1), "query_id long, node long")

    found = found.join(nodes.select("node", "hash", F.col("vector").alias("v")), "node").join(asked, "query_id")
    found = found.select("query_id", "node", "hash", "v", distance("v", "vector_q").alias("score"))
    by_score = Window.partitionBy("query_id").orderBy("score", "node")
    found = found.withColumn("place", F.row_number().over(by_score)).where(F.col("place") <= k + 1)
    c = copies.select("vec_id", F.col("hash").alias("h"), F.col("vector").alias("w"))
    found = found.join(c, (F.col("hash") == F.col("h")) & (F.col("v") == F.col("w"))).where("vec_id <> query_id")
    final = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
