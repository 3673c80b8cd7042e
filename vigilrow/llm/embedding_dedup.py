"""Embedding near-dedup: random-hyperplane sign hashing in several tables, exact cosine verification and
distributed connected components.

Two vectors link when their labels are equal and not null and their cosine, in double precision, is at
least `least`. A vector lives in the bucket of its signs against `bits` random hyperplanes that are
orthogonal to each other, and visits its own bucket and all others in which a vector that it links with can
live. Two unit vectors that link are at most sqrt(2 - 2 * least) apart; where their signs differ, their
distances from those hyperplanes add up, so that for one of both the squares of these distances sum to at
most 1 - least. A vector visits every bucket for which its own do: so no link is left out, by any chance.
A pair that meets both ways counts once. `bits` follows from the number of vectors of the largest label, so
that buckets stay small as the table grows; the number of visits grows with the bits. The hyperplanes are
fixed by `seed`.

Equal vectors of a label are compared once and weighted by their number. The vectors that live in a bucket
are cut into blocks, and each block is met by the bucket's visitors in a task of its own, through which these
stream, so that no task holds a whole bucket. No pair leaves a task: per vector it returns how many it links
with, and the one vector that stands there for all that links join, directly or through others.

Edge cases: a vector that is null, empty, zero or has a null or non-finite component, or whose label is
null, links with nothing; vectors of different lengths link with nothing; rows that repeat a vec_id are
vectors of their own, that share the id; a null vec_id names no component unless alone; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilrow.llm.common import materialize, partitions
from vigilrow.llm.components import connected_components


#: Squared distances from hyperplanes are whole numbers of this part, so that their sums are the same in each task.
UNIT = 2.0**-40


def bits_for(n: int) -> int:
    """Hyperplanes for labels of up to n different vectors: with each doubling of n one more, so that buckets don't grow with the table."""
    return min(max(0, ceil(log2(max(n, 1) / 1024))), 12)


def _planes(width: int, bits: int, seed: int) -> np.ndarray:
    """Normals of hyperplanes, orthogonal to each other, and so no more than there are components."""
    return np.linalg.qr(np.random.default_rng([seed, width]).standard_normal((width, min(bits, width))))[0]


def _squares(x: np.ndarray, planes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bucket in which each vector lives, and its squared distances from the hyperplanes in UNITs.

    Sums are taken row by row: they don't depend on the batch, as those of a product of matrices may.
    """
    p = np.stack([(x * v).sum(axis=1) for v in planes.T], axis=1) if planes.shape[1] else np.zeros((len(x), 0))
    return (p > 0) @ (1 << np.arange(p.shape[1], dtype=np.int64)), np.floor(p * p / UNIT).astype(np.int64)


def _reach(least: float) -> int:
    return ceil((1 - least + 1e-9) / UNIT)


def _unit(rows: np.ndarray) -> np.ndarray:
    x = np.asarray(rows, np.float64)
    # by a power of two, which is exact, so that no square is beyond what a double holds
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _joined(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """For each of n places the one that stands for all that the edges u - v join with it."""
    root = np.arange(n)
    while len(u):
        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
        while (root != root[root]).any():
            root = root[root]
        u, v = root[u], root[v]
        apart = u != v
        u, v = u[apart], v[apart]
    return root


def links(embeddings: DataFrame, least: float, bits: int, block: int, seed: int) -> DataFrame:
    """(a, n, b): for vector a, in one comparison, how many it links with and the vector that stands for all it is joined to.

    embeddings: id, label, vector (usable), width and weight.
    """
    kind, reach = embeddings.schema["vector"].dataType.simpleString(), _reach(least)
    parts = partitions(embeddings.sparkSession)

    def hash_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for width, g in b.groupby("width"):
                planes = _planes(width, bits, seed)
                home, squares = _squares(_unit(np.stack(g.vector.to_numpy())), planes)
                rows = {"label": g.label, "width": g.width, "id": g.id, "weight": g.weight, "vector": g.vector}
                yield pd.DataFrame({**rows, "code": home, "visits": False})
                for mask in range(1 << planes.shape[1]):
                    flipped = mask >> np.arange(planes.shape[1]) & 1
                    near = (squares * flipped).sum(axis=1) <= reach
                    if near.any():
                        yield pd.DataFrame({**{k: v[near] for k, v in rows.items()}, "code": home[near] ^ mask, "visits": True})

    keys = ["label", "width", "code"]
    hashed = embeddings.mapInPandas(hash_rows, f"label long, width int, id long, weight long, vector {kind}, code long, visits boolean")
    sizes = embeddings.mapInPandas(lambda it: (x[~x.visits][keys] for x in hash_rows(it)), "label long, width int, code long")
    sizes = sizes.groupBy(*keys).agg(F.count("*").alias("size"))
    # who lives in a bucket goes to one of its blocks, who visits to all
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    dealt = hashed.join(sizes, keys).withColumn("blocks", F.ceil(F.col("size") / block).cast("int"))
    dealt = dealt.withColumn("i", F.explode(F.when(F.col("visits"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(own))))
    group = [*keys, "i"]
    dealt = dealt.select(*group, "visits", "id", "weight", "vector")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, None
        for b in batches:
            key = b[group].to_numpy(np.int64)
            starts = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(axis=1)))
            out = [np.empty((0, 3), np.int64)]
            for lo, hi in zip(starts, np.append(starts[1:], len(b))):
                g, planes = b.iloc[lo:hi], _planes(int(key[lo, 1]), bits, seed)
                x = _unit(np.stack(g.vector.to_numpy()))
                rows = (g.id.to_numpy(np.int64), g.weight.to_numpy(np.int64), x, *_squares(x, planes))
                if at is None or (key[lo] != at).any():
                    at, held = key[lo], None
                visits = g.visits.to_numpy(bool)
                if not visits.all():
                    live = [r[~visits] for r in rows]
                    held = live if held is None else [np.concatenate(r) for r in zip(held, live)]
                if held is not None:
                    guests = np.flatnonzero(visits)
                    for k in range(0, len(guests), 1024):
                        out += met([r[guests[k : k + 1024]] for r in rows], held)
            yield pd.DataFrame(np.concatenate(out), columns=["a", "n", "b"])

    def met(guests: list, live: list) -> list:
        (a, wa, x, home, _), (b, wb, y, other, squares) = guests, live
        link = x @ y.T >= least
        i, j = np.nonzero(link)
        flipped = (home[i] ^ other[j])[:, None] >> np.arange(squares.shape[1]) & 1
        # where each visits the other, the smaller id counts
        link[i, j] = (a[i] < b[j]) | ((squares[j] * flipped).sum(axis=1) > reach) & (a[i] != b[j])
        some = link[i, j]
        ids, n = np.concatenate([a, b]), np.concatenate([link @ wb, wa @ link])
        root = _joined(i[some], j[some] + len(a), len(ids))
        some = np.flatnonzero(n)
        return [np.stack([ids[some], n[some], ids[root[some]]], axis=1)]

    return dealt.repartition(parts, *group).sortWithinPartitions(*group, "visits").mapInPandas(compare, "a long, n long, b long")


def dedup(embeddings: DataFrame, least: float = 0.98, bits: int | None = None, block: int = 1024, seed: int = 17) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    kind = "float" if embeddings.schema["embedding"].dataType.simpleString() == "array<float>" else "double"
    rows = embeddings.select("vec_id", F.col("label").cast("long").alias("label"), F.col("embedding").cast(f"array<{kind}>").alias("vector"))
    usable = F.col("label").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0)
    usable &= F.coalesce(F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False)) & F.exists("vector", lambda v: v != 0)
    fit = rows.filter(usable).groupBy("label", "vector").agg(F.count("*").alias("weight"), F.min("vec_id").alias("vec_id"))
    # classes of equal vectors, known by a number of their own
    fit = materialize(fit.withColumn("id", F.xxhash64("label", "vector", F.lit(1))).withColumn("width", F.size("vector")), "vectors")
    if bits is None:
        bits = bits_for(fit.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0)
    found = materialize(links(fit.select("id", "label", "vector", "width", "weight"), least, bits, block, seed), "links")
    counts = found.groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "id")
    label = connected_components(found.select("a", "b"))
    classes = fit.select("id", "label", "vector", "weight", "vec_id").join(counts, "id", "left").join(label, "id", "left").withColumn("component", F.coalesce("component", "id"))
    smallest = classes.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    classes = classes.join(smallest, "component").select("id", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id")
    own = rows.select("vec_id", F.when(usable, F.xxhash64("label", "vector", F.lit(1))).alias("id")).join(classes, "id", "left")
    component = F.coalesce("component_id", "vec_id")
    return own.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
