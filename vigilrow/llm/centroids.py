"""Centroid clustering by partial-distance search, in exact integers.

Vectors of WIDTH components become integers, floor(scale * x). Squared differences are summed over a few dimensions at a time, those of
high variance first; a centroid whose sum is strictly above the best whole distance so far is abandoned for that vector, and what is
left finishes all dimensions. Centroids are tried in their order, so that the smaller number wins a tie.

The vectors are written once as integers. Each round is one scan of them: a task sums its own vectors per cluster and gives at most
`k` x WIDTH sums, which Spark adds up as decimals; so a cluster with most of the vectors is no large group. Only the sums of the
clusters, k x WIDTH numbers, come to the driver, and the centroids go out with the next scan.

Edge cases: vectors that are null, of another width, or with a null or non-finite component are left out, and so are those with an
integer beyond 2**27, as squared distances would not fit a long; a null vec_id is hashed as an empty text; rows that repeat a vec_id are vectors
of their own, of which more than one can be a first centroid; fewer vectors than centroids give fewer centroids; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilrow.llm.common import materialize

WIDTH = 64
#: Dimensions whose differences are summed before centroids are compared with the best again.
STEP = 8
#: Beyond this a component's integer is too large for distances in a long.
LARGEST = 1 << 27


@dataclass(frozen=True)
class Clustering:
    """assigned: vec_id, cluster, distance of every vector that was kept; centroids: their integer components."""

    assigned: DataFrame
    centroids: np.ndarray


def integers(embeddings: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id and vector (array<int>) of the vectors that are kept."""
    x = embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    good = (F.size("x") == WIDTH) & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v * scale) <= LARGEST))
    return x.filter(F.coalesce(good, F.lit(False))).select("vec_id", F.transform("x", lambda v: F.floor(v * scale).cast("int")).alias("vector"))


def nearest(x: np.ndarray, centroids: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of the nearest centroid of each row of x and the squared distance to it."""
    cluster, best = np.zeros(len(x), np.int32), np.full(len(x), np.iinfo(np.int64).max)
    x = x[:, order]
    for number, centroid in enumerate(centroids[:, order]):
        alive, far = np.arange(len(x)), np.zeros(len(x), np.int64)
        for at in range(0, x.shape[1], STEP):
            # abandoned rows leave the arrays; what stays has every dimension before `at` summed
            apart = x[alive, at : at + STEP] - centroid[at : at + STEP]
            far += (apart * apart).sum(axis=1)
            going = far <= best[alive]
            if not going.all():
                alive, far = alive[going], far[going]
        closer = far < best[alive]
        best[alive[closer]], cluster[alive[closer]] = far[closer], number
    return cluster, best


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, WIDTH).astype(np.int64)


def _first(vectors: DataFrame, k: int) -> np.ndarray:
    """The k vectors with the smallest sha256 of `1:<vec_id>`."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = vectors.select(digest.alias("digest"), "vector").orderBy("digest", "vector").limit(k).collect()
    return np.array([r.vector for r in rows], np.int64).reshape(-1, WIDTH)


def _order(vectors: DataFrame) -> np.ndarray:
    """Dimensions by falling variance over all vectors."""
    each = vectors.select(F.posexplode("vector").alias("at", "v")).groupBy("at").agg(F.var_pop("v").alias("spread"))
    spread = {r["at"]: r.spread for r in each.collect()}
    return np.array(sorted(range(WIDTH), key=lambda d: (-(spread.get(d) or 0.0), d)))


def _sums(vectors: DataFrame, centroids: np.ndarray, order: np.ndarray) -> DataFrame:
    """cluster, at, total and n: a task gives the sums of its vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, n = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
        for b in batches:
            x = _matrix(b.column("vector"))
            cluster, _ = nearest(x, centroids, order)
            for c in np.unique(cluster):
                own = cluster == c
                totals[c] += x[own].sum(axis=0)
                n[c] += own.sum()
        c, at = np.divmod(np.flatnonzero(np.repeat(n > 0, WIDTH)), WIDTH)
        yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(at), pa.array(totals[c, at]), pa.array(n[c])], ["cluster", "at", "total", "n"])

    found = vectors.select("vector").mapInArrow(run, "cluster long, at long, total long, n long")
    return found.groupBy("cluster", "at").agg(*(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("total", "n")))


def cluster(embeddings: DataFrame, k: int = 16, rounds: int = 3, scale: int = 64) -> Clustering:
    """Assigns, moves each centroid that has vectors to the floor of their mean, `rounds` times, and assigns once more."""
    vectors = materialize(integers(embeddings, scale), "vectors")
    centroids, order = _first(vectors, k), _order(vectors)
    for _ in range(rounds if len(centroids) else 0):
        for r in _sums(vectors, centroids, order).collect():
            centroids[r.cluster, r["at"]] = int(r.total) // int(r.n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            number, far = nearest(_matrix(b.column("vector")), centroids, order)
            yield pa.RecordBatch.from_arrays([b.column("vec_id").cast(pa.int64()), pa.array(number), pa.array(far)], ["vec_id", "cluster", "distance"])

    return Clustering(materialize(vectors.mapInArrow(run, "vec_id long, cluster int, distance long"), "assigned"), centroids)


def report(found: Clustering) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector that was kept."""
    spark = found.assigned.sparkSession
    sums = {r.cluster: int(r.s) for r in found.assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    total = sum(sums.values())
    own = [(c, sums.get(c, 0), total, hashlib.sha256(",".join(map(str, v.tolist())).encode()).hexdigest()) for c, v in enumerate(found.centroids)]
    clusters = spark.createDataFrame(own, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # as many rows as there are centroids
    return found.assigned.join(F.broadcast(clusters), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
