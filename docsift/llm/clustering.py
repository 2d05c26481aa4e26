"""Plain Lloyd over integer vectors: exact, and the same however the rows are partitioned.

Centroids are few and are sent to every task. There NumPy takes the squared differences to
one centroid after another, the least wins (ties: the lower number), and each partition
sums its vectors as integers. The sums of all partitions meet in a groupBy, a row for each
cluster and component. Only those sums (clusters times components) come to the driver.

Vectors with another number of components, null components or such as are not finite are
left out, as are those with a scaled component of 2^62 or more, whose distances no long
can hold. A distance or sum that does not fit a long is null; the assignment is exact all
the same. Repeated rows count as often as they stand there. Of the candidates for a first
centroid, those with equal hashes (repeated or null ids) are ordered by their components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsift.scratch import written

#: Components of a vector, what they are scaled by, clusters, rounds, and the salt of the first centroids' hashes.
COMPONENTS, SCALE, CLUSTERS, ROUNDS, SALT = 64, 256, 40, 5, "2:"
#: Components and distances below these are exact in 64 bits, for up to 2^9 components.
_NARROW, _WIDE, _LONG = 1 << 26, 1 << 62, 1 << 63


def scaled(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): the vectors (vec_id, embedding) that take part, as floor(scale * x) in longs."""
    x = F.col("embedding")
    value = lambda y: y.cast("double") * scale
    usable = (F.size(x) == components) & F.forall(x, lambda y: F.coalesce(~F.isnan(y) & (F.abs(value(y)) < float(_WIDE)), F.lit(False)))
    whole = F.transform(x, lambda y: F.floor(value(y)))
    return vectors.filter(F.coalesce(usable, F.lit(False))).select("vec_id", whole.alias("v"))


def _first(vectors: DataFrame, clusters: int, salt: str) -> np.ndarray:
    name = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(name.alias("name"), "v").orderBy("name", "v").limit(clusters).collect()
    return np.array([r["v"] for r in rows], dtype=np.int64)


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, list | np.ndarray]:
    """Number of the nearest centroid and its squared distance, for each row; exact for any integers."""
    most = max(int(np.abs(vectors).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if most >= _NARROW:
        vectors, centroids = vectors.astype(object), centroids.astype(object)
    best, least = np.zeros(len(vectors), dtype=np.int64), None
    for number, centroid in enumerate(centroids):
        apart = vectors - centroid
        distance = (apart * apart).sum(axis=1)
        if least is None:
            least = distance
            continue
        closer = (distance < least).astype(bool)
        best[closer], least[closer] = number, distance[closer]
    return best, least


def _sums(vectors: DataFrame, centroids: np.ndarray) -> list:
    """(cluster, component, n, high, low) over all vectors: sums as high * 2^32 + low."""
    k, size = centroids.shape

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(k, dtype=np.int64)
        high, low = np.zeros((k, size), dtype=np.int64), np.zeros((k, size), dtype=np.int64)
        for batch in batches:
            if len(batch):
                v = np.stack(batch["v"].to_numpy())
                number, _ = nearest(v, centroids)
                n += np.bincount(number, minlength=k)
                np.add.at(high, number, v >> 32)
                np.add.at(low, number, v & 0xFFFFFFFF)
        used = np.flatnonzero(n)
        place = np.tile(np.arange(size), len(used))
        yield pd.DataFrame({"cluster": np.repeat(used, size), "component": place, "n": np.repeat(n[used], size), "high": high[used].ravel(), "low": low[used].ravel()})

    rows = vectors.select("v").mapInPandas(run, "cluster int, component int, n long, high long, low long")
    total = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    return rows.groupBy("cluster", "component").agg(F.sum("n").alias("n"), total("high"), total("low")).collect()  # k * size rows at most


def lloyd(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, salt: str = SALT) -> np.ndarray:
    """Centroids of vectors (vec_id, v) after the rounds; empty clusters keep theirs."""
    centroids = _first(vectors, clusters, salt)
    for _ in range(rounds if len(centroids) else 0):
        for cluster, component, n, high, low in _sums(vectors, centroids):
            centroids[cluster, component] = ((int(high) << 32) + int(low)) // n
    return centroids


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of each of the vectors (vec_id, v); the distance is null beyond a long."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            number, distance = nearest(np.stack(batch["v"].to_numpy()), centroids)
            fits = pd.array([int(d) if d < _LONG else None for d in distance], dtype="Int64")
            yield pd.DataFrame({"vec_id": batch["vec_id"], "cluster": number.astype(np.int32), "distance": fits})

    return vectors.mapInPandas(run, f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, cluster int, distance long")


def _inertia(distance: Column) -> Column:
    """Sum as a long; null where one of the distances or the sum is beyond it."""
    total = F.sum(distance.cast("decimal(38,0)"))
    return F.when(F.count(distance) == F.count(F.lit(1)), total)


def cluster(vectors: DataFrame, components: int = COMPONENTS, clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, salt: str = SALT) -> DataFrame:
    """One row per vector (vec_id, embedding) that takes part.

    vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256: squared distance to
    the centroid, its sum over the cluster and over all, and a digest of the centroid's
    components as decimal numbers joined by commas.
    """
    spark = vectors.sparkSession
    usable = written(scaled(vectors, components, scale), "cluster-vectors")
    centroids = lloyd(usable, clusters, rounds, salt)
    rows = written(assigned(usable, centroids.reshape(-1, components)), "cluster-rows")
    inertia = rows.groupBy("cluster").agg(_inertia(F.col("distance")).alias("sum")).collect()  # a row for each cluster
    sums = {r["cluster"]: r["sum"] for r in inertia}
    fit = lambda x: int(x) if x is not None and x < _LONG else None
    total = fit(sum(sums.values())) if None not in sums.values() else None
    facts = [(c, fit(s), total, hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in sums.items()]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    joined = rows.join(F.broadcast(facts), "cluster")  # as many rows as clusters
    return joined.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
