"""Approximate nearest neighbours by adaptive dimension scan over probed lists.

Vectors are dealt to the nearest of a number of centroids that follows the table's size (all of them are indexed). A query
probes the lists whose centroids are closest. Inside a list, vectors are rotated at random and stored in column blocks; after
each block the distance so far estimates the whole one, and candidates for which the hypothesis "may still be among the k
nearest" is rejected are abandoned. Survivors get their exact distance on the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Shipped, named, written

SAMPLE = 65_536
PER_LIST = 16
PROBES_FOR = 0.97
STRICTNESS = 2.1
COLUMNS = 16
LIST_BLOCK = 16_384
QUERY_BLOCK = 2_048
CALIBRATION = 200
ROUNDS = 6
TOGETHER = 4_096


def number_of_lists(rows: int) -> int:
    """The square root of the table's rows, so that a query meets few centroids and short lists; 4,096 at most.

    The bound is what the sample can tell apart (16 of its vectors to a list); it is reached at 17 million rows.
    """
    return int(np.clip(np.sqrt(rows), 1, max(1, min(rows, SAMPLE) // PER_LIST)))


class ListIndex:
    """Centroids, number of lists to probe and rotation, fitted on a bounded sample."""

    def __init__(self, sample: np.ndarray, rows: int, k: int, seed: int = 8):
        rng = np.random.default_rng(seed)
        n, d = sample.shape
        lists = min(number_of_lists(rows), n)
        self.centroids = sample[np.sort(rng.choice(n, lists, replace=False))]
        for _ in range(ROUNDS):
            home = self.home(sample)
            order, sizes = np.argsort(home, kind="stable"), np.bincount(home, minlength=lists)
            some = sizes > 0
            sums = np.add.reduceat(sample[order], (np.cumsum(sizes) - sizes)[some], axis=0)
            self.centroids = self.centroids.copy()
            self.centroids[some] = sums / sizes[some, None]
        self.rotation = np.linalg.qr(rng.normal(size=(d, d)))[0]
        home = self.home(sample)
        needed = []
        for q in rng.choice(n, min(CALIBRATION, n), replace=False).tolist():
            far = ((sample - sample[q]) ** 2).sum(1)
            far[q] = np.inf  # a vector is not its own neighbour
            near = np.argsort(far, kind="stable")[: min(k, n - 1)]
            needed.extend(np.argsort(self.order(sample[q : q + 1])[0])[home[near]].tolist())
        self.probes = int(np.quantile(needed, PROBES_FOR)) + 1 if needed else 1

    def far(self, vectors: np.ndarray) -> np.ndarray:
        return (self.centroids**2).sum(1) - 2 * vectors @ self.centroids.T

    def home(self, vectors: np.ndarray) -> np.ndarray:
        """The list of each vector."""
        parts = [self.far(vectors[i : i + TOGETHER]).argmin(1) for i in range(0, len(vectors), TOGETHER)]
        return np.concatenate(parts) if parts else np.empty(0, np.int64)

    def order(self, vectors: np.ndarray) -> np.ndarray:
        """List numbers of each vector, nearest centroid first."""
        return np.argsort(self.far(vectors), axis=1, kind="stable")


def usable(vectors: DataFrame, vec_id: str, embedding: str, size: int | None = None) -> DataFrame:
    """``id, v`` (doubles): neither null nor zero, without null, NaN or infinite components, with an id."""
    rows = named(vectors, id=vec_id, v=embedding).select(F.col("id").cast("bigint").alias("id"), F.col("v").cast("array<double>").alias("v"))
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = rows.where("id is not null and v is not null and size(v) > 0").where(F.forall("v", lambda x: F.coalesce(good(x), F.lit(False))) & F.exists("v", lambda x: x != 0))
    return rows.where(F.size("v") == size) if size else rows


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(((a - b) ** 2).sum(1))


def scan(query: np.ndarray, query_id: int, rotated_query: np.ndarray, ids: np.ndarray, vectors: np.ndarray, blocks: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest of one list block (ids, exact distances), nearest first, ties to the smaller id."""
    d = vectors.shape[1]
    live = np.flatnonzero(ids != query_id)
    if len(live) > k:
        first = live[:: max(1, len(live) // (4 * k))]
        sampled = exact(vectors[first], query)
        limit = np.sort(sampled)[k - 1] ** 2
        safe = first[np.argsort(sampled, kind="stable")[:k]]  # so that k rows come back, however many the estimate rejects
        part, seen = np.zeros(len(ids)), 0
        for block in blocks:
            width = block.shape[0]
            part[live] += ((block[:, live] - rotated_query[seen : seen + width, None]) ** 2).sum(0)
            seen += width
            slack = (1 + STRICTNESS / np.sqrt(seen)) ** 2 if seen < d else 1 + 1e-9
            live = live[part[live] <= limit * slack * seen / d + 1e-12]
            if seen < d and len(live) > 4 * k:  # the k best so far tighten the limit by their exact distances
                best = live[np.argpartition(part[live], k)[:k]]
                limit = min(limit, exact(vectors[best], query).max() ** 2)
        live = np.union1d(live, safe)
    far = exact(vectors[live], query)
    order = np.lexsort((ids[live], far))[:k]
    return ids[live][order], far[order]


def nearest_ids(query: np.ndarray, query_id: int, turned: np.ndarray, ids: np.ndarray, vectors: np.ndarray, blocks: list[np.ndarray], k: int, unique: bool):
    """``scan`` for k different ids: where ids repeat, an id counts with its smallest distance, and more rows are asked for."""
    others, rows = (len(ids), k) if unique else (len(np.unique(ids[ids != query_id])), k)
    while True:
        near, far = scan(query, query_id, turned, ids, vectors, blocks, rows)
        if unique:
            return near, far
        first = np.sort(np.unique(near, return_index=True)[1])
        if len(first) >= min(k, others) or rows >= len(ids):
            return near[first][:k], far[first][:k]
        rows *= 4


def vectors_of(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), size)


def as_lists(vectors: np.ndarray) -> pa.Array:
    n, d = vectors.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * d), pa.array(np.ascontiguousarray(vectors).reshape(-1)))


def in_order(table: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
    """Ids and vectors of one block by id (equal ids by a hash of their vectors), so results do not hang on the order of rows."""
    ids = table["id"].to_numpy()
    vectors = vectors_of(table["v"].combine_chunks(), len(table["v"][0]))
    unique = len(np.unique(ids)) == len(ids)
    keys = (ids,) if unique else ((vectors.view(np.uint64) * np.arange(1, 2 * vectors.shape[1], 2, dtype=np.uint64)).sum(1), ids)
    order = np.lexsort(keys)
    return ids[order], np.ascontiguousarray(vectors[order]), unique


def nearest(vectors: DataFrame, k: int = 10, every: int = 100, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k nearest other vectors by Euclidean distance (double precision).

    Queries are the rows whose id is a multiple of ``every``. Null and zero vectors, those with a null, NaN or infinite
    component and rows without an id take no part. Distances are between vectors of one length: those of another length than
    most are compared with all of their own. Ties go to the smaller id; a repeated id counts once, with its smallest distance,
    and asks with one vector. If there are at most k candidates, all of them come back; if there are more, k do: where the
    lists to probe hold too few ids, a query takes further ones, nearest centroid first. The order of rows does not matter.

    Every usable row is indexed. A list is cut into blocks of about 16,384 rows by id hash, its queries into blocks of about
    2,048, and a task meets one block of each at a time; so neither a list nor its queries ever are in one task as a whole.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, vec_id, embedding)
    shape = "query_id bigint, rank int, vec_id bigint, score double"
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], shape)
    usual = int(sizes.d)
    sampled = rows.where(F.size("v") == usual).orderBy(F.xxhash64("id"), "id", "v").limit(SAMPLE).select("v").toArrow()
    sample = np.concatenate([vectors_of(c, usual) for c in sampled["v"].chunks if len(c)])
    index = Shipped(spark, ListIndex(sample, int(sizes.n), k))

    def place(batches: Iterator[pa.RecordBatch], held: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        """Each vector with its list, or (with ``held``, how many ids a list has) with all lists it probes; -length for another length."""
        for b in batches:
            for i in range(0, b.num_rows, TOGETHER):
                part = b.slice(i, TOGETHER)
                ids, v, lengths = part.column(0).to_numpy(), part.column(1), np.diff(part.column(1).offsets.to_numpy())
                at = np.flatnonzero(lengths == usual)
                if len(at):
                    some = vectors_of(v.take(pa.array(at)), usual)
                    if held is None:
                        n, lists = np.ones(len(at), np.int64), index.value.home(some)
                    else:
                        order = index.value.order(some)
                        enough = (np.cumsum(held[order], axis=1) <= k).sum(1) + 1
                        n = np.minimum(np.maximum(enough, index.value.probes), order.shape[1])
                        lists = order[np.arange(order.shape[1]) < n[:, None]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[at], n)), as_lists(np.repeat(some, n, axis=0)), pa.array(lists.astype(np.int32))], ["id", "v", "list"])
                other = np.flatnonzero(lengths != usual)
                if len(other):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[other]), v.take(pa.array(other)), pa.array(-lengths[other].astype(np.int32))], ["id", "v", "list"])

    parts = "id bigint, v array<double>, list int"
    stored = rows.mapInArrow(lambda b: place(b, None), parts)
    dealt = written(stored.select("id", "list"))
    # an id that stands in several lists counts in one of them, so any lists together hold at least the sum of distinct ids
    held = np.zeros(len(index.value.centroids), np.int64)
    for r in dealt.where("list >= 0").groupBy("id").agg(F.min("list").alias("list")).groupBy("list").count().collect():
        held[r["list"]] = r["count"]
    # a repeated id asks with one vector, of the usual length if it has one
    first = F.min(F.struct(F.size("v") != usual, "v")).alias("first")
    asked = written(rows.where(F.col("id") % every == 0).groupBy("id").agg(first).select("id", "first.v").mapInArrow(lambda b: place(b, held), parts))
    # how many blocks a list and its queries have follows from their numbers; there are at most 4,096 lists, and one for each other length
    blocks = dealt.groupBy("list").agg(F.ceil(F.count("*") / LIST_BLOCK).cast("int").alias("cuts"))
    turns = asked.groupBy("list").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("turns"))
    sized = F.broadcast(written(blocks.join(turns, "list")))  # lists that no query probes drop out

    def cut(of: str, number: str):
        return F.pmod(F.xxhash64(F.lit(of), "id"), number).cast("int")

    def each(number: str):
        return F.explode(F.sequence(F.lit(0), F.col(number) - 1))

    stored = stored.join(sized, "list").withColumn("cut", cut("row", "cuts")).withColumn("turn", each("turns")).drop("cuts", "turns")
    asked = asked.join(sized, "list").withColumn("turn", cut("query", "turns")).withColumn("cut", each("cuts")).drop("cuts", "turns")

    def search(key, candidates, queries):
        found = [[], [], []]
        if candidates.num_rows and queries.num_rows:
            ids, stack, unique = in_order(candidates)
            rotation = index.value.rotation if stack.shape[1] == usual else np.empty((stack.shape[1], 0))  # no columns: all by exact distance
            turned = (stack @ rotation).T
            columns = [np.ascontiguousarray(turned[i : i + COLUMNS]) for i in range(0, turned.shape[0], COLUMNS)]
            asking, points, _ = in_order(queries)
            for q, v, w in zip(asking.tolist(), points, points @ rotation):
                near, far = nearest_ids(v, q, w, ids, stack, columns, k, unique)
                for x, part in zip(found, (np.full(len(near), q), near, far)):
                    x.append(part)
        made = [np.concatenate(x) if x else np.empty(0, t) for x, t in zip(found, (np.int64, np.int64, np.float64))]
        return pa.table({"query_id": made[0], "vec_id": made[1], "score": made[2]})

    keys = ("list", "cut", "turn")
    met = stored.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(search, "query_id bigint, vec_id bigint, score double")
    best = met.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
