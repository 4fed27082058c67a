"""Operator 5: approximate nearest neighbours by robust-pruned directed graphs, one for each shard.

Distinct vectors are dealt into shards by a hash: of about SHARD_SIZE vectors,
or more where that would make more than SHARDS_EACH shards for each shuffle
partition, but no more than SHARD_MOST. Within a shard
a directed graph is grown from random edges: a greedy beam search for
each point proposes neighbours, and pruning keeps a proposal only if no kept
one is closer to it by the factor ALPHA, so that long and diverse edges stay;
reverse edges are added and pruned the same way. Beam searches of all points
of a batch run in step. Every query then searches every shard, and the best of
all shards are ranked by the exact cosine in double precision.

Equal vectors are one node that carries its smallest ids (more than a result
can use) and is searched once, so a very common vector costs nothing. Vectors
meet only vectors of their own dimension, and are scaled by a power of two, so
that components of any finite size have a cosine. Defined results: vectors
null, zero or with null or non-finite components take no part, neither as
queries nor as candidates; ties go to the smaller vec_id; a vec_id repeated
with the same vector counts once; an empty table has no rows; other columns,
whatever their names, are not looked at.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.llm.common import cut, partitions, table

SHARD_SIZE, SHARD_MOST, SHARDS_EACH = 4096, 1 << 16, 4
#: Shards that are dealt to partitions one by one; more of them are spread by a hash.
PLACED = 1024
DEGREE, BEAM, ALPHA = 24, 64, 1.2
SEARCH_BEAM, WIDTH, STARTS, BATCH = 128, 4, 24, 512
NEIGHBOURS, EVERY = 5, 50


def beam_search(x: np.ndarray, graph: np.ndarray, starts: np.ndarray, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, similarities), best first, of a beam search for each row of q; -1 where fewer are reached."""
    b = len(q)
    seen = np.zeros((b, len(x) + 1), bool)
    ids = np.full((b, max(beam, len(starts))), -1, np.int32)
    sims = np.full(ids.shape, -np.inf, np.float32)
    ids[:, : len(starts)], sims[:, : len(starts)] = starts, q @ x[starts].T
    seen[:, starts] = True
    done = ids < 0
    row = np.arange(b)[:, None]
    while True:
        open_ = np.where(done, -np.inf, sims)
        pick = np.argpartition(-open_, WIDTH - 1, axis=1)[:, :WIDTH]
        live = np.take_along_axis(open_, pick, 1) > -np.inf
        if not live.any():
            break
        np.put_along_axis(done, pick, True, 1)
        near = graph[np.where(live, np.take_along_axis(ids, pick, 1), len(x))].reshape(b, -1)
        near.sort(axis=1)
        new = (near >= 0) & ~seen[row, near]
        new[:, 1:] &= near[:, 1:] != near[:, :-1]
        near = np.where(new, near, -1)
        seen[row, near] = True
        most = int(new.sum(1).max())
        if not most:
            continue
        near = -np.sort(-near, axis=1)[:, :most]
        sim = np.where(near >= 0, np.einsum("bkd,bd->bk", x[near], q), -np.inf).astype(np.float32)
        ids, sims, done = np.concatenate([ids, near], 1), np.concatenate([sims, sim], 1), np.concatenate([done, near < 0], 1)
        keep = np.argpartition(-sims, beam - 1, axis=1)[:, :beam]
        ids, sims, done = (np.take_along_axis(z, keep, 1) for z in (ids, sims, done))
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


def robust_prune(x: np.ndarray, points: np.ndarray, ids: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """(point, degree) neighbours kept of candidate ids (point, c), -1 where none: nearest first, dropping those that a kept one covers."""
    ids = np.where(ids == points[:, None], -1, ids)
    far = 2 - 2 * np.einsum("bkd,bd->bk", x[ids], x[points])
    far = np.where(ids < 0, np.inf, far)
    order = np.argsort(far, axis=1, kind="stable")
    ids, far = np.take_along_axis(ids, order, 1), np.take_along_axis(far, order, 1)
    out = np.full((len(points), degree), -1, np.int32)
    vectors = x[ids]
    row = np.arange(len(points))
    for k in range(degree):
        best = far.argmin(1)
        ok = np.isfinite(far[row, best])
        if not ok.any():
            break
        out[ok, k] = ids[row, best][ok]
        between = 2 - 2 * np.einsum("bkd,bd->bk", vectors, vectors[row, best])
        far = np.where((alpha * alpha * between <= far) & ok[:, None], np.inf, far)
        far[row, best] = np.inf
    return out


def build(x: np.ndarray, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(graph, starting points) of unit vectors x; the graph's last row, of no point, is empty."""
    n = len(x)
    rng = np.random.Generator(np.random.PCG64(seed))
    graph = np.full((n + 1, DEGREE), -1, np.int32)
    graph[:n] = rng.integers(0, n, (n, DEGREE))
    middle = int((x @ x.mean(0)).argmax())
    starts = np.unique(np.concatenate([[middle], rng.integers(0, n, min(n, STARTS))])).astype(np.int32)
    for alpha in (1.0, ALPHA):
        order = rng.permutation(n).astype(np.int32)
        for k in range(0, n, BATCH):
            points = order[k : k + BATCH]
            found, _ = beam_search(x, graph, starts, x[points], BEAM)
            graph[points] = robust_prune(x, points, np.concatenate([found, graph[points]], 1), DEGREE, alpha)
            _add_reverse(x, graph, points, alpha)
    return graph, starts


def _add_reverse(x, graph, points, alpha):
    tail, head = np.repeat(points, graph.shape[1]), graph[points].ravel()
    tail, head = tail[head >= 0], head[head >= 0]
    order = np.argsort(head, kind="stable")
    tail, head = tail[order], head[order]
    new = np.ones(len(head), bool)
    new[1:] = head[1:] != head[:-1]
    group = np.cumsum(new) - 1
    place = np.arange(len(head)) - np.flatnonzero(new)[group]
    for low in range(0, int(place.max()) + 1 if len(place) else 0, 2 * graph.shape[1]):  # a popular point takes its edges in rounds
        part = (place >= low) & (place < low + 2 * graph.shape[1])
        targets, back = np.unique(head[part], return_inverse=True)
        more = np.full((len(targets), 2 * graph.shape[1]), -1, np.int32)
        more[back, place[part] - low] = tail[part]
        for k in range(0, len(targets), BATCH):
            t = targets[k : k + BATCH]
            ids = np.concatenate([graph[t], more[k : k + BATCH]], 1)
            ids.sort(axis=1)
            ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
            graph[t] = robust_prune(x, t, ids, graph.shape[1], alpha)


def scaled(vectors: list) -> np.ndarray:
    """Rows of doubles, each times a power of two that brings its largest component near one."""
    x = np.array([np.asarray(v, np.float64) for v in vectors])
    return np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])


class Shard:
    """The vectors of one shard and their graph; few vectors are searched one and all."""

    def __init__(self, ids: list, vectors: list):
        self.ids = ids
        self.exact = scaled(vectors)
        self.norm = np.sqrt((self.exact * self.exact).sum(1))
        self.x = np.concatenate([(self.exact / self.norm[:, None]), np.zeros((1, self.exact.shape[1]))]).astype(np.float32)
        self.graph = build(self.x[:-1]) if len(ids) > 2 * SEARCH_BEAM else None

    def search(self, queries: np.ndarray, k: int):
        """(query, point, exact cosine) of the k best found for each query."""
        unit = (queries / np.sqrt((queries * queries).sum(1))[:, None]).astype(np.float32)
        if self.graph is None:
            found = np.broadcast_to(np.arange(len(self.ids), dtype=np.int32), (len(queries), len(self.ids)))
        else:
            found = np.concatenate([beam_search(self.x[:-1], *self.graph, unit[i : i + BATCH], SEARCH_BEAM)[0][:, : 2 * k] for i in range(0, len(unit), BATCH)])
        dots = np.einsum("bkd,bd->bk", self.exact[found], queries)
        score = dots / (self.norm[found] * np.sqrt((queries * queries).sum(1))[:, None])
        score = np.where(found < 0, -np.inf, score)
        best = np.argsort(-score, axis=1, kind="stable")[:, :k]
        for i in range(len(queries)):
            for j in best[i]:
                if found[i, j] >= 0:
                    yield i, int(found[i, j]), float(score[i, j])


def neighbours(vectors: DataFrame, queries: DataFrame, k: int = NEIGHBOURS, shard_size: int | None = None) -> DataFrame:
    """Rows (query_id, rank, vec_id, score) of the k nearest rows of vectors (vec_id, embedding) found for each of queries (likewise), itself left out."""
    spark = vectors.sparkSession
    valid = lambda df: (
        df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        .where("vec_id IS NOT NULL AND embedding IS NOT NULL AND NOT exists(embedding, x -> x IS NULL OR isnan(x) OR abs(x) = double('inf'))")
        .where("exists(embedding, x -> x <> 0)")
    )
    key = F.xxhash64("embedding").alias("node")
    ranked = valid(vectors).distinct().withColumn("nth", F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))).where(F.col("nth") <= k + 1)
    nodes = cut(ranked.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select(F.size("embedding").alias("dim"), key, "ids", "embedding"))
    counts = {r["dim"]: r["n"] for r in nodes.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    most = shard_size or min(SHARD_MOST, max(SHARD_SIZE, sum(counts.values()) // (SHARDS_EACH * partitions(spark))))
    sizes = {dim: max(1, -(-n // most)) for dim, n in counts.items()}
    shards = F.element_at(F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair]), F.col("dim"))
    asked = valid(queries).select(F.size("embedding").alias("dim"), key, "embedding", "vec_id")
    wanted = asked.dropDuplicates(["node"]).where(F.col("dim").isin(list(sizes)))
    rows = nodes.select("dim", F.pmod("node", shards).cast("int").alias("shard"), F.lit(0).alias("kind"), "node", "ids", "embedding").union(
        wanted.select("dim", F.explode(F.sequence(F.lit(0), shards - 1)).alias("shard"), F.lit(1), "node", F.expr("CAST(NULL AS array<bigint>)"), "embedding")
    )
    first, n = {}, 0
    for dim, number in sizes.items():
        first[dim], n = n, n + number
    of_dim = F.element_at(F.create_map(*[F.lit(x) for pair in first.items() for x in pair]), F.col("dim"))
    if n <= PLACED:
        rows = rows.repartition(n, F.element_at(F.array(*[F.lit(x) for x in one_each(spark, n)]), of_dim + F.col("shard") + 1))
    else:
        rows = rows.repartition(2 * n, "dim", "shard")
    rows = rows.sortWithinPartitions("dim", "shard", "kind", "node")
    names = ["node", "ids", "score"]

    def run(frames):
        at, held, shard = None, ([], []), None
        for pdf in frames:
            for (dim, number, kind), part in pdf.groupby(["dim", "shard", "kind"], sort=False):
                if at != (dim, number):
                    at, held, shard = (dim, number), ([], []), None
                if kind == 0:
                    held[0].extend(part["ids"])
                    held[1].extend(part["embedding"])
                    continue
                if not held[0]:
                    continue
                shard = shard or Shard(*held)
                asked_now = scaled(part["embedding"])
                node = part["node"].to_numpy()
                found = [(node[i], shard.ids[j], s) for i, j, s in shard.search(asked_now, 3 * k)]
                yield pd.DataFrame(found, columns=names)

    found = rows.mapInPandas(run, "node long, ids array<long>, score double")
    found = found.withColumn("nth", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("score"), F.get("ids", F.lit(0))))).where(F.col("nth") <= 3 * k)
    # Each node's list once; its queries take theirs from it.
    best = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id")))
    near = cut(found.select("node", "score", F.explode("ids").alias("vec_id")).groupBy("node").agg(F.slice(best, 1, k + 1).alias("best")))
    pairs = asked.select("node", F.col("vec_id").alias("query_id")).distinct().join(near, "node")
    own = F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    out = pairs.select("query_id", F.posexplode(own).alias("rank", "near"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "near.vec_id", (-F.col("near.far")).alias("score"))


def one_each(spark: SparkSession, n: int) -> list[int]:
    """n numbers that a repartition by them deals out to n partitions, one each."""
    place = F.pmod(F.hash(F.col("id").cast("int")), F.lit(n))
    found = {r["at"]: r["id"] for r in spark.range(40 * n + 1000).groupBy(place.alias("at")).agg(F.min("id").alias("id")).collect()}
    spare = iter(range(40 * n + 1000, 41 * n + 1000))
    return [int(found[k]) if k in found else next(spare) for k in range(n)]


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours(vectors, vectors.where(F.col("vec_id") % EVERY == 0))
