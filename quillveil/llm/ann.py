"""Approximate nearest neighbours by an adaptive scan of dimensions within the probed lists of an inverted file.

The index is fitted on a bounded sample: centroids by k-means, and a random rotation, after which each block of dimensions
holds a like part of any distance. All vectors are then assigned to lists. A query probes the lists nearest to it, as many
as the sample's own neighbours call for. In a list
the rotated vectors are scanned in column blocks; after each block a hypothesis test drops a candidate whose partial distance
is, with the chosen confidence, too large for it to be among the nearest so far. What survives all blocks is measured on the
original vectors in double precision.

Lists are cut into blocks of rows, and a list's queries into blocks of queries, so a list of any size is many small tasks.

Edge cases: vectors that are null, empty, zero, of another dimension than most, with null or non-finite components or without an
id take no part, as query or candidate; equal distances go to the smaller id; repeated rows are candidates of their own, but
one query, of which none of them is a candidate; an empty table, or one without queries, gives no rows.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillveil.llm.workers import lean

#: Lists are about the square root of the number of vectors, `LISTS` at most; the index is fitted on about `SAMPLE` vectors, or
#: `PER_LIST` for each list if that is more (131,072 at most).
LISTS, SAMPLE, PER_LIST = 4096, 20_000, 32
#: Share of the sample's true neighbours that the probed lists must hold; it sets how many lists a query probes.
HELD = 0.97
#: Sampled vectors whose neighbours in the sample are found exactly for that.
TRIED = 200
#: A list's rows and queries meet in blocks of so many; a row is copied once for each block of its list's queries.
BLOCK_ROWS = 4096
BLOCK_QUERIES = 4096
COLUMNS = 16
#: Larger: fewer wrong drops, later ones.
CONFIDENCE = 2.6


class Index(NamedTuple):
    rotation: np.ndarray
    centroids: np.ndarray
    probes: int


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null or empty, all components finite, not all zero."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0)


def fit(vectors: DataFrame, lists: int = LISTS, sample: int = SAMPLE, seed: int = 11, rounds: int = 12) -> Index:
    """Rotation and centroids from a sample of (id, vector), chosen by hash."""
    n = vectors.count()
    k = int(min(lists, max(1, round(n**0.5))))
    sample = max(sample, PER_LIST * k)
    chosen = vectors.where(F.xxhash64("id").cast("double") / 2.0**64 + 0.5 < min(1.0, sample / max(1, n))).select("id", "vector").collect()
    chosen.sort(key=lambda r: (r[0], list(r[1])))
    rng = np.random.default_rng(seed)
    x = np.array([r[1] for r in chosen], np.float64)
    if not len(x):
        row = vectors.select("vector").first()
        x = np.array([row[0]], np.float64) if row else np.zeros((1, 1))
    rotation = np.linalg.qr(rng.standard_normal((x.shape[1], x.shape[1])))[0]
    k = min(k, len(x))
    centroids = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        nearest = assign(centroids, x)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, x)
        counts = np.bincount(nearest, minlength=k)
        centroids = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], x[rng.choice(len(x), k)])
    return Index(rotation, centroids, _probes(centroids, x, rng))


def _probes(centroids: np.ndarray, x: np.ndarray, rng: np.random.Generator, k: int = 10) -> int:
    """Nearest lists to probe so that they hold the share HELD of the neighbours that sampled vectors have in the sample.

    A sample's neighbours lie farther off than those among all vectors, so the number errs on the large side.
    """
    lists = assign(centroids, x)
    ranks = [np.zeros(1, np.int64)]
    for i in rng.choice(len(x), min(TRIED, len(x)), replace=False):
        far = ((x - x[i]) ** 2).sum(1)
        far[i] = np.inf
        place = np.argsort(np.argsort((centroids**2).sum(1) - 2 * centroids @ x[i], kind="stable"))
        ranks.append(place[lists[np.argsort(far, kind="stable")[: min(k, len(x) - 1)]]])
    return int(np.quantile(np.concatenate(ranks), HELD, method="higher")) + 1


def assign(centroids: np.ndarray, x: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    for a in range(0, len(x), 4096):
        part = x[a : a + 4096]
        out[a : a + 4096] = np.argmin((centroids**2).sum(1) - 2 * part @ centroids.T, axis=1)
    return out


def scan(rotated: np.ndarray, query: np.ndarray, k: int, rows: np.ndarray | None = None, confidence: float = CONFIDENCE) -> np.ndarray:
    """Those of the rows given, or of all, that may be among their k nearest, by adaptive scan of column blocks."""
    rows = np.arange(len(rotated)) if rows is None else rows
    n, dim = len(rows), rotated.shape[1]
    kept: list[np.ndarray] = []
    best = np.full(k, np.inf)
    for a in range(0, n, 512):
        live = rows[a : a + 512]
        partial = np.zeros(len(live))
        for d in range(0, dim, COLUMNS):
            e = min(dim, d + COLUMNS)
            partial = partial + ((rotated[live, d:e] - query[d:e]) ** 2).sum(1)
            if best[-1] < np.inf:
                reach = 1.0 + 1e-9 if e == dim else (1 + confidence / np.sqrt(e)) ** 2
                keep = partial * (dim / e) <= best[-1] * reach
                live, partial = live[keep], partial[keep]
                if not len(live):
                    break
        if len(live):
            kept.append(live)
            best = np.sort(np.concatenate((best, partial)))[:k]
    return np.concatenate(kept) if kept else np.zeros(0, np.int64)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, lists: int = LISTS) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k nearest found of each query, among all rows of another id.

    vectors and queries: (id, vector). Queries and candidates meet list by list; the best k of each meeting are merged. Rows of
    queries that share an id are one query, that of their least vector.
    """
    vectors = vectors.where(F.col("id").isNotNull() & usable(F.col("vector")))
    sizes = vectors.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    dim = sizes[0][0] if sizes else 1
    vectors = vectors.where(F.size("vector") == dim)
    queries = queries.where(F.col("id").isNotNull() & usable(F.col("vector")) & (F.size("vector") == dim))
    queries = queries.groupBy("id").agg(F.min("vector").alias("vector"))
    index = fit(vectors, lists)
    shared = vectors.sparkSession.sparkContext.broadcast(index)  # at most LISTS centroids

    def put(batches):
        for batch in batches:
            if len(batch):
                nearest = assign(shared.value.centroids, _matrix(batch.column(1)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest.astype(np.int32))], names=["id", "vector", "list"])

    schema = "id long, vector array<double>, list int"
    rows = vectors.select(F.col("id").cast("long"), F.col("vector").cast("array<double>")).mapInArrow(lean(put), schema)
    held = {r[0]: r[1] for r in rows.groupBy("list").count().collect()}  # at most LISTS rows
    filled = np.array([held.get(i, 0) for i in range(len(index.centroids))])
    least = max(8, index.probes)

    def probe(batches):
        centroids = shared.value.centroids
        for batch in batches:
            if not len(batch):
                continue
            x = _matrix(batch.column(1))
            order = np.argsort((centroids**2).sum(1) - 2 * x @ centroids.T, axis=1, kind="stable")
            met = np.cumsum(filled[order], axis=1)
            take = np.maximum(least, (met < enough).sum(1) + 1)
            row = np.repeat(np.arange(len(x)), np.minimum(take, order.shape[1]))
            chosen = np.concatenate([o[:t] for o, t in zip(order, take, strict=True)])
            live = filled[chosen] > 0
            at = pa.array(row[live])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(chosen[live].astype(np.int32))], names=["id", "vector", "list"])

    own = vectors.join(queries.select("id"), "id", "left_semi").groupBy("id").count().agg(F.max("count")).first()[0] or 0
    enough = k + own  # rows that hold k candidates, whatever rows the query's id has

    asked = queries.select(F.col("id").cast("long"), F.col("vector").cast("array<double>")).mapInArrow(lean(probe), schema)
    asking = {r[0]: r[1] for r in asked.groupBy("list").count().collect()}
    table = lambda counts, size: F.coalesce(F.get(F.array(*(F.lit(int(max(1, -(-counts.get(i, 0) // size)))) for i in range(len(filled)))), F.col("list")), F.lit(1))
    row_blocks, query_blocks = table(held, BLOCK_ROWS), table(asking, BLOCK_QUERIES)
    spread = lambda n: F.sequence(F.lit(0), n - 1)
    left = rows.withColumn("r", F.pmod(F.xxhash64("id"), row_blocks).cast("int")).withColumn("q", F.explode(spread(query_blocks)))
    right = asked.withColumn("q", F.pmod(F.xxhash64("id"), query_blocks).cast("int")).withColumn("r", F.explode(spread(row_blocks)))

    def meet(candidates: pa.Table, wanted: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if len(candidates) and len(wanted):
            ids, x = candidates["id"].to_numpy(), _matrix(candidates["vector"])
            rotated = x @ shared.value.rotation
            query_ids, q = wanted["id"].to_numpy(), _matrix(wanted["vector"])
            for qid, own, turned in zip(query_ids, q, q @ shared.value.rotation, strict=True):
                at = scan(rotated, turned, k, np.flatnonzero(ids != qid))
                score = np.sqrt(((x[at] - own) ** 2).sum(1))
                first = np.lexsort((ids[at], score))[:k]
                out[0].append(np.full(len(first), qid))
                out[1].append(ids[at[first]])
                out[2].append(score[first])
        flat = [np.concatenate(o) if o else np.zeros(0) for o in out]
        return pa.table({"query_id": pa.array(flat[0].astype(np.int64)), "vec_id": pa.array(flat[1].astype(np.int64)), "score": pa.array(flat[2].astype(np.float64))})

    keys = ["list", "r", "q"]
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, "query_id long, vec_id long, score double")
    order = W.partitionBy("query_id").orderBy("score", "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
