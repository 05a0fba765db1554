"""Approximate nearest neighbours by robust-pruned directed graphs, one for each shard.

Vectors with equal components are one *class* (its six smallest identifiers stand for it, which is enough for five
neighbours beside the query itself), so copies never crowd a graph. Classes are dealt to shards of bounded size by
hash; a shard is as large as a task's memory allows, since every query searches every shard, and small tables have some
shards too, for the cores. In a shard the graph grows by batches: a greedy search from the medoid proposes neighbours, relaxed
distance pruning keeps at most ``degree`` diverse edges, and each edge is offered in the other direction. Vectors of one direction and
different length are different classes without a distance; of those a point keeps some, beside its diverse edges, and what is still out of
reach of the start gets an edge of its own. The graphs are written to the shared folder; queries, in blocks as large as a shard, then run a beam search in every shard, and the
best of all shards are kept. So a task holds one shard and as many queries, and what is sent between tasks is what such tiles need.
Scores are exact: the cosine in double precision on the original vectors.

Defined cases: vectors that are null, empty or zero, or hold a null or a non-finite component, take no part; vectors of
another dimension are never compared; repeated rows count once; a null vec_id takes no part; equal scores go to the smaller
vec_id; other columns, whatever their names, are not looked at; a table without vectors gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .common import Scratch

#: Edges of a node, width of the beam, relaxation of the pruning.
DEGREE, BEAM, ALPHA = 24, 64, 1.2
#: Classes from which a shard of its own pays, and shards up to which that decides; bytes of components in a shard at most; points of one step of a build.
LEAST_ROWS, FEW_SHARDS, SHARD_BYTES, STEP = 2048, 64, 512 << 20, 256
#: Squared distance of unit vectors (32 bits) of one direction, and edges that a point keeps to such vectors.
SAME, SAME_EDGES = 1e-6, 8


def _distances(x: np.ndarray, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Squared distances of unit vectors: of each row of q to the rows of x that its row of ids names."""
    return 2.0 - 2.0 * np.einsum("brd,bd->br", x[ids], q, optimize=True)


def beam_search(x: np.ndarray, edges: np.ndarray, start: int, q: np.ndarray, beam: int, at_once: int = 4):
    """For each row of q the ids and distances of the ``beam`` nearest found, nearest first (id -1: none)."""
    b, n = len(q), len(x)
    rows = np.arange(b)[:, None]
    ids = np.full((b, beam), -1)
    dist = np.full((b, beam), np.inf, np.float32)
    opened = np.ones((b, beam), bool)
    seen = np.zeros((b, n + 1), bool)  # the last column stands for no node
    seen[:, n] = seen[:, start] = True
    ids[:, 0], opened[:, 0] = start, False
    dist[:, 0] = _distances(x, q, np.full((b, 1), start))[:, 0]
    while True:
        pick = np.argsort(np.where(opened, np.inf, dist), axis=1, kind="stable")[:, :at_once]
        fresh = ~np.take_along_axis(opened, pick, 1)
        if not fresh.any():
            return ids, dist
        np.put_along_axis(opened, pick, True, 1)
        new = np.where(fresh[:, :, None], edges[np.take_along_axis(ids, pick, 1)], -1).reshape(b, -1)
        new = np.where(new < 0, n, new)
        new.sort(axis=1)
        skip = seen[rows, new]
        skip[:, 1:] |= new[:, 1:] == new[:, :-1]
        seen[rows, new] = True
        d = np.where(skip, np.inf, _distances(x, q, np.where(skip, 0, new))).astype(np.float32)
        ids, dist, opened = np.c_[ids, np.where(skip, -1, new)], np.c_[dist, d], np.c_[opened, skip]
        best = np.argsort(dist, axis=1, kind="stable")[:, :beam]
        ids, dist, opened = (np.take_along_axis(a, best, 1) for a in (ids, dist, opened))


def robust_prune(x: np.ndarray, points: np.ndarray, cand: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Diverse edges of each point among its row of candidates (-1: none); rows of ``degree`` ids.

    A candidate in the point's own direction is as far from all others as the point, so it prunes none of them: a point keeps
    ``SAME_EDGES`` such edges and then looks further."""
    cand = np.sort(np.where(cand == points[:, None], -1, cand), axis=1)
    cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
    here = np.maximum(cand, 0)
    d = np.where(cand < 0, np.inf, _distances(x, x[points], here))
    between = 2.0 - 2.0 * np.einsum("bcd,bed->bce", x[here], x[here], optimize=True)
    alive, out, rows = cand >= 0, np.full((len(points), degree), -1), np.arange(len(points))
    same = d <= SAME
    found_same = np.zeros(len(points), int)
    for k in range(degree):
        left = np.where(alive, d, np.inf)
        best = left.argmin(1)
        some = np.isfinite(left[rows, best])
        if not some.any():
            break
        out[some, k] = cand[rows, best][some]
        # squared distances: the relaxation enters squared
        own = same[rows, best] & some
        alive &= ~((alpha * alpha * between[rows, best] <= d) & (some & ~own)[:, None])
        alive[rows, best] = False
        found_same += own
        alive &= ~(same & (found_same >= SAME_EDGES)[:, None])
    return out


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, seed: int = 7) -> tuple[np.ndarray, int]:
    """Edges (rows of ids, -1: none) and the start node of a graph over unit vectors."""
    n, rng = len(x), np.random.default_rng(seed)
    start = int((x @ x.mean(0)).argmax())
    edges = np.full((n, degree), -1)
    if n > 1:
        some = rng.integers(0, n, (n, min(degree // 2, n)))
        edges[:, : some.shape[1]] = np.where(some == np.arange(n)[:, None], -1, some)
    for relax in (1.0, alpha):
        order = rng.permutation(n)
        for a in range(0, n, STEP):
            p = order[a : a + STEP]
            found, _ = beam_search(x, edges, start, x[p], min(beam, n))
            edges[p] = robust_prune(x, p, np.c_[found, edges[p]], degree, relax)
            # the other direction
            to, source = edges[p].ravel(), np.repeat(p, degree)
            source, to = source[to >= 0], to[to >= 0]
            o = np.argsort(to, kind="stable")
            source, to = source[o], to[o]
            who, first, count = np.unique(to, return_index=True, return_counts=True)
            # nodes with few offers together, those with many in small parts; a step makes at most STEP offers to a node
            for low, high in ((0, 8), (8, 32), (32, STEP)):
                chosen = np.flatnonzero((count > low) & (count <= high))
                for part in np.array_split(chosen, 1 + len(chosen) * (degree + high) ** 2 // 4_000_000):
                    if len(part):
                        place = np.arange(high)
                        offered = np.where(place < count[part, None], source[np.minimum(first[part, None] + place, len(source) - 1)], -1)
                        edges[who[part]] = robust_prune(x, who[part], np.c_[edges[who[part]], offered], degree, relax)
    return connected(x, edges, start, beam), start


def connected(x: np.ndarray, edges: np.ndarray, start: int, beam: int) -> np.ndarray:
    """Edges with which every node is reached from the start: the first node of each part that isn't becomes a neighbour of the nearest node found."""
    reached = np.zeros(len(x), bool)

    def reach(node):
        reached[node] = True
        front = np.array([node])
        while len(front):
            front = np.unique(edges[front])
            front = front[(front >= 0) & ~reached[np.maximum(front, 0)]]
            reached[front] = True

    reach(start)
    while not reached.all():
        node = int(np.argmin(reached))
        found = beam_search(x, edges, start, x[node : node + 1], min(beam, len(x)))[0][0]
        found = found[found >= 0]
        free = (edges[found] < 0).any(1)
        if not free.any():
            edges = np.c_[edges, np.full(len(edges), -1)]
            free[0] = True
        by = int(found[free.argmax()])
        edges[by, int(np.argmin(edges[by]))] = node
        reach(node)
    return edges


def _unit(raw: np.ndarray) -> np.ndarray:
    big = np.abs(raw).max(1, keepdims=True)
    scaled = raw / big
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _vectors(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("rep").reset_index(drop=True)
    edges, start = build_graph(_unit(_vectors(pdf["embedding"])).astype(np.float32))
    return pdf.assign(pos=np.arange(len(pdf), dtype=np.int32), start=start, edges=[e.astype(np.int32) for e in edges])


def _search(k: int):
    def run(graph: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(graph) or not len(queries):
            return pd.DataFrame({"query": [], "rep": [], "members": [], "score": []})
        graph = graph.sort_values("pos")
        raw, asked = _vectors(graph["embedding"]), _vectors(queries["embedding"])
        x, q = _unit(raw).astype(np.float32), _unit(asked).astype(np.float32)
        edges, reps, members = np.stack(graph["edges"].to_numpy()), graph["rep"].to_numpy(), graph["members"].to_numpy()
        norms, qn, ids, rows = np.linalg.norm(raw, axis=1), np.linalg.norm(asked, axis=1), queries["rep"].to_numpy(), []
        for a in range(0, len(q), 256):
            found, _ = beam_search(x, edges, int(graph["start"].iloc[0]), q[a : a + 256], min(BEAM, len(x)))
            for i, f in enumerate(found, a):
                f = f[f >= 0]
                score = raw[f] @ asked[i] / (norms[f] * qn[i])
                for j in np.lexsort((reps[f], -score))[:k]:
                    rows.append((ids[i], reps[f[j]], members[f[j]], score[j]))
        return pd.DataFrame(rows, columns=["query", "rep", "members", "score"])

    return run


def shards_for(classes: int, dim: int) -> int:
    """As few shards as fit into memory, but one for each ``LEAST_ROWS`` classes up to ``FEW_SHARDS``: the data decide alone, so every cluster finds the same."""
    return max(1, -(-classes * 8 * max(1, dim) // SHARD_BYTES), min(FEW_SHARDS, classes // LEAST_ROWS))


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", n_shards: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row whose id ``every`` divides. n_shards: see ``shards_for``."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "neighbours")
    e = F.col("embedding")
    fine = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    src = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"))
    src = src.filter(F.col("vec_id").isNotNull() & e.isNotNull() & fine & F.exists(e, lambda v: v != 0)).distinct()
    low = src.withColumn("n", F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))).filter(F.col("n") <= k + 1)
    classes = scratch.write(low.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.array_sort(F.collect_list("vec_id")).alias("members")).withColumn("dim", F.size("embedding")), "classes")
    n_classes, dim = classes.agg(F.count("*"), F.coalesce(F.max("dim"), F.lit(1))).first()
    n_shards = n_shards or shards_for(n_classes, dim)
    sharded = classes.withColumn("shard", F.pmod(F.xxhash64("rep"), F.lit(n_shards)).cast("int"))
    graph = scratch.write(sharded.groupBy("dim", "shard").applyInPandas(_build, "embedding array<double>, rep long, members array<long>, dim int, shard int, pos int, start int, edges array<int>"), "graph")

    asked = scratch.write(src.filter(F.col("vec_id") % every == 0).join(classes.select("embedding", "rep"), "embedding").select(F.col("vec_id").alias("query_id"), "rep"), "asked")
    distinct = classes.join(asked.select("rep").distinct(), "rep", "left_semi").select("rep", "embedding", "dim")
    n_blocks = max(1, asked.count() * n_shards // max(1, n_classes))
    blocks = distinct.withColumn("part", F.pmod(F.xxhash64("rep"), F.lit(n_blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))))
    pieces = graph.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    keys = ["dim", "shard", "part"]
    found = pieces.groupBy(*keys).cogroup(blocks.groupBy(*keys)).applyInPandas(_search(k + 1), "query long, rep long, members array<long>, score double")
    best = found.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "rep"))).filter(F.col("n") <= k + 1)
    near = best.select("query", "score", F.explode("members").alias("vec_id"))
    each = asked.withColumnRenamed("rep", "query").join(near, "query").filter("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
