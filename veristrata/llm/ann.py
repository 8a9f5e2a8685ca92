"""Approximate nearest neighbours by balanced posting lists.

Unit vectors are clustered by k-means on a bounded sample; every vector is then filed under
its nearest centroids: the first, and others nearly as near, so that vectors at a boundary
lie in several lists. Centroids are found by best-first search in a neighbour graph that fits
in memory. A query opens the lists whose centroid is at most ``open_ratio`` times as far as
the nearest one, and further ones until they must hold k vectors besides itself. The ratio is
the smallest by which a bounded set of queries, answered exactly by a scan of all rows, would
find the wanted share of their neighbours: where vectors cluster it is small and few lists are
read; where they fill the space evenly, no list can be left out, and nearly all are read.
Lists are split into blocks, and the queries of a list into parts, of like size; every opened
list is read in all its blocks, so no task holds a large list, and no vector is left out.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, read, ship

#: Rows of the sample that centroids are fitted on, and the most centroids.
SAMPLE, MOST_LISTS = 20_000, 4096
#: Vectors a list should hold, at most so many lists; a block of a list holds so many.
LIST_SIZE, BLOCK = 256, 2048
#: A vector is filed in lists up to this many times as far as its nearest, in at most so many.
FILE_RATIO, COPIES = 1.08, 4
#: Queries of one list that meet one of its blocks at a time.
QUERIES = 2048
#: Queries that are answered exactly to find the ratio by which lists are opened, and the share of neighbours it should find.
CALIBRATION, RECALL = 200, 0.96
NEIGHBOURS = 24


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows by a power of two, so that the largest component is near 1: exact, and no square is too large or too small."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0.0))[1][:, None])


def _unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Centroids of unit vectors; centroids of overfull clusters are moved to split them (balance)."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)]
    for step in range(rounds):
        best = np.concatenate([(x[i : i + 4096] @ c.T).argmax(axis=1) for i in range(0, len(x), 4096)])
        size = np.bincount(best, minlength=k)
        new = np.zeros_like(c)
        np.add.at(new, best, x)
        full = size > 0
        new[full] /= np.maximum(np.linalg.norm(new[full], axis=1, keepdims=True), 1e-12)
        if step < rounds - 3:
            big, small = np.argsort(-size, kind="stable"), np.argsort(size, kind="stable")
            for b, s in zip(big[: k // 8], small[: k // 8], strict=True):
                if size[b] > 3 * max(size[s], 1) and (members := np.flatnonzero(best == b)).size:
                    new[s] = x[rng.choice(members)]
                    full[s] = True
        c = np.where(full[:, None], new, c)
    return c


class Lists:
    """Centroids and the graph over them."""

    def __init__(self, centroids: np.ndarray) -> None:
        self.centroids = centroids
        k = min(NEIGHBOURS, len(centroids) - 1)
        near = centroids @ centroids.T
        np.fill_diagonal(near, -np.inf)
        self.graph = np.argsort(-near, axis=1, kind="stable")[:, :k] if k else np.zeros((len(centroids), 0), np.int64)
        rng = np.random.default_rng(5)
        self.starts = rng.choice(len(centroids), min(16, len(centroids)), replace=False)

    def search(self, v: np.ndarray, ratio: float, most: int | None = None, beam: int = 64) -> np.ndarray:
        """Lists by distance, nearest first, up to ``ratio`` times the nearest one's; found by walking the graph."""
        seen = set(self.starts.tolist())
        first = self.centroids[self.starts] @ v
        frontier = [(-s, int(i)) for s, i in zip(first, self.starts, strict=True)]
        heapq.heapify(frontier)
        found = sorted(frontier)
        while frontier:
            score, at = heapq.heappop(frontier)
            top = 2 + 2 * found[0][0]
            if len(found) >= beam and score > found[beam - 1][0] and 2 + 2 * score > ratio**2 * top:
                break
            new = [int(i) for i in self.graph[at] if int(i) not in seen]
            if new:
                seen.update(new)
                for s, i in zip((self.centroids[new] @ v).tolist(), new, strict=True):
                    heapq.heappush(frontier, (-s, i))
                    found.append((-s, i))
                found.sort()
        squares = np.array([max(2 + 2 * s, 0.0) for s, _ in found])
        keep = squares <= ratio**2 * max(squares[0], 1e-12)
        return np.array([i for _, i in found])[keep][:most]


def _enough(index: Lists, v: np.ndarray, lists: np.ndarray, held: np.ndarray, rows: int) -> np.ndarray:
    """``lists`` and, while these hold fewer than ``rows`` rows, the next nearest ones; a vector lies in ``COPIES`` lists at most."""
    if held[lists].sum() >= rows:
        return lists
    order = np.argsort(-(index.centroids @ v), kind="stable")
    order = order[~np.isin(order, lists)]
    more = int(np.searchsorted(np.cumsum(held[order]), rows - held[lists].sum())) + 1
    return np.concatenate([lists, order[:more]])


def clean(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(id, v)`` as doubles; null, empty and zero vectors and those with null or non-finite components are left out."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(F.col(id_col).cast("bigint").alias("id"), v.alias("v")).where(F.col("v").isNotNull() & F.col("id").isNotNull() & ~bad & F.exists("v", lambda x: x != 0))


def exact_cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision; equal rows always give equal numbers. Powers of two do not change the cosine."""
    a, b = _scaled(a), _scaled(b)
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", open_ratio: float | None = None, recall: float = RECALL) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: of each query the k nearest found by cosine, itself excluded.

    Ties go to the smaller id. Vectors that cannot be measured, and null ids, take no part, as rows or as
    queries. Vectors of each length are searched by themselves. Fewer than k rows
    remain only if there are fewer candidates: a query that found fewer is asked again in all lists.
    Rows of one id are one candidate, which counts by its best score, and one query, which gets the
    best for any of them; none of them is its own neighbour. Few vectors make one list, which is
    exact search. ``open_ratio`` None: it is chosen so that about ``recall`` of the neighbours of
    ``CALIBRATION`` queries are found. Other columns are not read; empty tables give an empty result.
    """
    spark = vectors.sparkSession
    ship(spark)
    sizes = clean(vectors, id_col, vector_col).groupBy(F.size("v").alias("dim")).count().orderBy("dim").collect()  # one row a length
    out = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    for i, size in enumerate(sizes):
        rows, asked = (clean(x, id_col, vector_col).where(F.size("v") == size["dim"]) for x in (vectors, queries))
        found = _search(rows, asked, size["dim"], size["count"], k, open_ratio, recall)
        out = out.unionByName(found) if i else found
    return out


def nearest_lists(index: Lists, unit: np.ndarray) -> list[np.ndarray]:
    """The lists that each vector is filed in, nearest first."""
    out = []
    for i in range(0, len(unit), 1024):
        square = np.clip(2 - 2 * (unit[i : i + 1024] @ index.centroids.T), 0, None)
        order = np.argsort(square, axis=1, kind="stable")[:, :COPIES]
        d = np.take_along_axis(square, order, axis=1)
        out += [o[x <= FILE_RATIO**2 * max(x[0], 1e-12)] for o, x in zip(order, d, strict=True)]
    return out


def ratio_for(rows: DataFrame, index: Lists, sent, dim: int, k: int, recall: float) -> float:
    """The smallest ratio by which a bounded set of rows, as queries, would find the share ``recall`` of their true neighbours.

    Each partition keeps the k nearest of each query; the driver gets the k best of each, as numbers only.
    """
    spark = rows.sparkSession
    chosen = rows.orderBy(F.xxhash64("id"), "id").limit(CALIBRATION).toPandas()
    own, q = chosen["id"].to_numpy(), _unit(np.stack(chosen["v"].to_numpy()))
    asked = spark.sparkContext.broadcast((own, q))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, q = asked.value
        index = sent.value
        best, ids, near = np.full((len(q), k), -np.inf), np.zeros((len(q), k), np.int64), np.zeros((len(q), k, dim))
        for b in batches:
            all_ids, all_units = b.column(0).to_numpy(), _unit(_matrix(b.column(1), dim))
            for at in range(0, len(all_ids), 1024):
                i, unit = all_ids[at : at + 1024], all_units[at : at + 1024]
                score = q @ unit.T
                score[i[None] == own[:, None]] = -np.inf
                both, both_ids = np.hstack([best, score]), np.hstack([ids, np.broadcast_to(i, score.shape)])
                top = np.argpartition(-both, k - 1, axis=1)[:, :k]
                vecs = np.where((top < k)[..., None], np.take_along_axis(near, np.minimum(top, k - 1)[..., None], axis=1), unit[np.maximum(top - k, 0)])
                best, ids, near = np.take_along_axis(both, top, axis=1), np.take_along_axis(both_ids, top, axis=1), vecs
        who, which = np.nonzero(np.isfinite(best))
        square = np.clip(2 - 2 * (q @ index.centroids.T), 0, None)
        first = np.sqrt(np.maximum(square.min(axis=1), 1e-12))
        need = [math.sqrt(square[w, lists].min()) / first[w] for w, lists in zip(who, nearest_lists(index, near[who, which]), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(ids[who, which]), pa.array(best[who, which]), pa.array(need, pa.float64())], names=["query", "id", "score", "need"])

    hits = rows.select("id", "v").mapInArrow(scan, "query bigint, id bigint, score double, need double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    need = np.sort([r["need"] for r in hits.withColumn("rank", rank).where(F.col("rank") <= k).select("need").collect()])
    return max(1.0, float(need[min(len(need) - 1, math.ceil(recall * len(need)))])) * 1.000001 if len(need) else 1.0


def _search(rows: DataFrame, queries: DataFrame, dim: int, n: int, k: int, open_ratio: float | None, recall: float) -> DataFrame:
    """``search`` among ``n`` vectors ``(id, v)`` of one length."""
    spark = rows.sparkSession
    lists_wanted = int(min(MOST_LISTS, max(1, n // LIST_SIZE)))
    share = max(1, n // SAMPLE)
    sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(share)) == 0).limit(2 * SAMPLE).toPandas() if lists_wanted > 1 else rows.limit(1).toPandas()
    sample = sample if len(sample) else rows.limit(1).toPandas()
    x = _unit(np.unique(np.stack(sample["v"].to_numpy()), axis=0))
    index = Lists(kmeans(x, min(lists_wanted, max(1, len(x) // 4))))
    sent = spark.sparkContext.broadcast(index)
    ratio = 1.0 if len(index.centroids) == 1 else ratio_for(rows, index, sent, dim, k, recall) if open_ratio is None else open_ratio

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for b in batches:
            at = nearest_lists(index, _unit(_matrix(b.column(1), dim)))
            take = pa.array(np.repeat(np.arange(len(at)), [len(a) for a in at]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(at).astype(np.int32)), b.column(0).take(take), b.column(1).take(take)], names=["list", "id", "v"])

    filed = cut(rows.mapInArrow(file, "list int, id bigint, v array<double>"))
    counts = filed.groupBy("list").count().collect()  # one row a list: at most MOST_LISTS
    held = np.zeros(len(index.centroids), np.int64)
    for r in counts:
        held[r["list"]] = r["count"]

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for b in batches:
            unit = _unit(_matrix(b.column(1), dim))
            at = [_enough(index, v, index.search(v, ratio), held, COPIES * (k + 1)) for v in unit]
            ends = np.cumsum([0, *map(len, at)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*at, np.zeros(0)]).astype(np.int32)))], names=["id", "v", "lists"])

    asked = cut(queries.mapInArrow(choose, "id bigint, v array<double>, lists array<int>"))
    found = cut(_probe(filed, asked, held, dim, k))
    short = asked.join(found.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k), F.col("id") == F.col("query_id"), "left_anti")
    if not short.head(1):
        return found
    every = F.array(*[F.lit(int(i)) for i in np.flatnonzero(held)])
    again = cut(_probe(filed, cut(short.select("id", "v", every.alias("lists"))), held, dim, k))
    return found.join(again.select(F.col("query_id").alias("again")).distinct(), F.col("query_id") == F.col("again"), "left_anti").unionByName(again)


def _probe(filed: DataFrame, asked: DataFrame, held: np.ndarray, dim: int, k: int) -> DataFrame:
    """The k nearest for each of ``asked(id, v, lists)`` among ``filed(list, id, v)``; each list is cut into blocks, and its queries into parts."""
    spark = filed.sparkSession
    wanted = asked.select(F.explode("lists").alias("list")).groupBy("list").count().collect()  # one row a list
    plan = [(r["list"], -(-int(held[r["list"]]) // BLOCK), -(-r["count"] // QUERIES)) for r in wanted if held[r["list"]]]
    plan = F.broadcast(spark.createDataFrame(plan, "list int, blocks int, parts int"))
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    deal = lambda c: F.pmod(F.xxhash64("id"), F.col(c)).cast("int")
    left = asked.select("id", "v", F.explode("lists").alias("list")).join(plan, "list").select("list", upto("blocks").alias("block"), deal("parts").alias("part"), "id", "v")
    right = filed.join(plan, "list").select("list", deal("blocks").alias("block"), upto("parts").alias("part"), "id", "v")
    hit = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return hit.empty_table()
        ids, vecs = right["id"].to_numpy(), _matrix(right["v"].combine_chunks(), dim)
        qids, q = left["id"].to_numpy(), _matrix(left["v"].combine_chunks(), dim)
        unit, asking, out = _unit(vecs), _unit(q), []
        for a in range(0, len(q), 256):
            scores = asking[a : a + 256] @ unit.T
            scores[ids[None] == qids[a : a + 256, None]] = -np.inf
            last = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k] if scores.shape[1] > k else np.full(len(scores), -np.inf)
            for i, (score, least) in enumerate(zip(scores, last, strict=True), a):
                near = np.flatnonzero((score >= least - 1e-9) & np.isfinite(score))
                exact = exact_cosine(np.broadcast_to(q[i], (len(near), dim)), vecs[near])
                order = np.lexsort((ids[near], -exact))[:k]
                out.append((np.full(len(order), qids[i]), ids[near][order], exact[order]))
        return pa.table([np.concatenate([o[j] for o in out]) for j in range(3)], schema=hit)

    keys = ("list", "block", "part")
    hits = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(nearest, "query_id bigint, vec_id bigint, score double")
    best = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_ann(spark, sf_dir):
    """The five nearest other vectors of every vector whose id is divisible by 50."""
    vectors = read(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where("vec_id % 50 = 0"))
