"""Centroid clustering in exact integers, with lower bounds that a geometric look at each cluster keeps tight.

A vector keeps its cluster without a scan as long as its distance to the own centroid is below a
lower bound of its distance to every other one. When centroids move, that bound must be loosened. The plain way takes off
the full drift of the farthest mover. Here each cluster is a sphere around its old centroid, and a
centroid that moves from A to B can come nearer to a point x of it by |x-A| - |x-B| only, which is at most |AB| times the
cosine of the angle between AB and the line from the middle of AB to x. In the plane through A, B and the sphere's
centre that angle is at least the centre's angle less the half-angle under which the sphere is seen; a centroid that moves away or
across takes nothing or little off. Vectors whose bound no longer decides are scanned exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splicelake.llm.common import bounded_batches, discard, stage

#: Integers up to here are exact in doubles.
EXACT = 1 << 53
#: Components are held within +-2^62 and results within a long.
LIMIT, LONGEST = float(1 << 62), (1 << 63) - 1
STATE = "cluster int, distance long, lower double, scanned boolean"


def usable(vector: Column, dims: int) -> Column:
    """Exactly ``dims`` components, none null or non-finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) == dims) & finite, F.lit(False))


def integer_vector(vector: Column, scale: int) -> Column:
    """floor(``scale`` * x) of each component, x as a double."""
    scaled = F.transform(vector, lambda x: F.greatest(F.least(x.cast("double") * scale, F.lit(LIMIT)), F.lit(-LIMIT)))
    return F.transform(scaled, lambda x: F.floor(x).cast("long"))


def _largest(a: np.ndarray) -> int:
    return max(abs(int(a.max())), abs(int(a.min()))) if a.size else 0


def squared_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``x`` to those of ``c``: doubles while these are exact, else Python integers."""
    if 4 * x.shape[1] * max(_largest(x), _largest(c)) ** 2 < EXACT:
        xf, cf = x.astype(np.float64), c.astype(np.float64)
        return (xf * xf).sum(1)[:, None] - 2.0 * (xf @ cf.T) + (cf * cf).sum(1)[None, :]
    xo, co = x.astype(object), c.astype(object)
    return np.stack([((xo - row) ** 2).sum(1) for row in co], axis=1)


def own_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distance of each row of ``x`` to the same row of ``c``."""
    if 4 * x.shape[1] * max(_largest(x), _largest(c)) ** 2 < EXACT:
        return ((x - c) ** 2).sum(1)
    return ((x.astype(object) - c.astype(object)) ** 2).sum(1)


def loosening(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """By how much a lower bound in each cluster must fall: the most that another centroid's move brings it nearer to any point of the cluster's sphere."""
    old, new = old.astype(np.float64), new.astype(np.float64)
    move = new - old
    drift = np.sqrt((move**2).sum(1))
    away = old[:, None, :] - ((old + new) / 2)[None, :, :]
    far = np.sqrt((away**2).sum(2))
    with np.errstate(divide="ignore", invalid="ignore"):
        angle = np.arccos(np.clip((away * move[None, :, :]).sum(2) / (far * drift[None, :]), -1.0, 1.0))
        seen = np.arcsin(np.clip(radius[:, None] / far, 0.0, 1.0))
        least = np.maximum(0.0, angle - seen - 1e-7)
        nearer = drift[None, :] * np.maximum(0.0, np.cos(np.minimum(least, np.pi / 2)))
    inside = ~(radius[:, None] * (1 + 1e-9) < far)
    nearer = np.where(inside, drift[None, :], nearer)
    nearer[:, drift == 0] = 0.0
    np.fill_diagonal(nearer, 0.0)
    return nearer.max(1) if len(old) > 1 else np.zeros(len(old))


def half_gaps(c: np.ndarray) -> np.ndarray:
    """Half of each centroid's distance to the nearest other one."""
    if len(c) < 2:
        return np.full(len(c), np.inf)
    between = np.sqrt(squared_distances(c, c).astype(np.float64))
    np.fill_diagonal(between, np.inf)
    return between.min(1) / 2


def assign(
    x: np.ndarray, centroids: np.ndarray, cluster: np.ndarray | None, lower: np.ndarray | None, loosen: np.ndarray, gaps: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cluster, squared distance, lower bound of the distance to any other centroid, and whether the vector was scanned."""
    n = len(x)
    if cluster is None:
        cluster, lower, distance, open_ = np.zeros(n, np.int64), np.zeros(n), np.zeros(n, object), np.ones(n, bool)
    else:
        lower = lower - loosen[cluster]
        lower -= 1e-9 * (1.0 + np.abs(lower))
        distance = own_distances(x, centroids[cluster])
        own = np.sqrt(distance.astype(np.float64)) * (1 + 1e-9) + 1e-9
        open_ = ~(own < np.maximum(lower, gaps[cluster] * (1 - 1e-9)))
    at = np.flatnonzero(open_)
    if len(at):
        found = squared_distances(x[at], centroids)
        best = found.argmin(1)  # the first of equal ones: the smaller number
        rows = np.arange(len(at))
        cluster, distance = cluster.copy(), distance.astype(object)
        cluster[at], distance[at] = best, [int(d) for d in found[rows, best]]
        found = found.astype(np.float64)
        found[rows, best] = np.inf
        lower[at] = np.sqrt(found.min(1)) * (1 - 1e-9) if len(centroids) > 1 else np.inf
    return cluster, distance, lower, open_


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _assigned(vectors: DataFrame, centroids: np.ndarray, loosen: np.ndarray, gaps: np.ndarray) -> DataFrame:
    """``vectors`` (``vec_id, vector`` and, but for the first time, the state) with their next state."""
    dims, known = centroids.shape[1], "cluster" in vectors.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("vector"), dims)
            state = [b.column(c).to_numpy(zero_copy_only=False) for c in ("cluster", "lower")] if known else [None, None]
            cluster, distance, lower, scanned = assign(x, centroids, *state, loosen, gaps)
            held = pa.array([min(int(d), LONGEST) for d in distance], pa.int64())
            columns = [b.column("vec_id"), b.column("vector"), pa.array(cluster.astype(np.int32)), held, pa.array(lower), pa.array(scanned)]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "vector", "cluster", "distance", "lower", "scanned"])

    return vectors.mapInArrow(run, f"vec_id {dict(vectors.dtypes)['vec_id']}, vector array<bigint>, {STATE}")


def _sums(state: DataFrame, dims: int) -> dict[int, tuple[int, float, list[int]]]:
    """Members, radius and component sums per cluster; every task sends one row per cluster and component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        members: dict[int, int] = {}
        for b in batches:
            x, cluster = _matrix(b.column("vector"), dims), b.column("cluster").to_numpy(zero_copy_only=False)
            if _largest(x) * len(x) >= LONGEST:
                x = x.astype(object)
            for c in np.unique(cluster).tolist():
                mine = x[cluster == c]
                totals[c] = totals.get(c, np.zeros(dims, object)) + mine.sum(0).astype(object)
                members[c] = members.get(c, 0) + len(mine)
        rows = [(c, d, members[c], Decimal(int(v))) for c, sums in totals.items() for d, v in enumerate(sums)]
        types = [pa.int32(), pa.int32(), pa.int64(), pa.decimal128(38, 0)]
        columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
        yield pa.RecordBatch.from_arrays(columns, names=["cluster", "dim", "n", "total"])

    parts = state.select("cluster", "vector").mapInArrow(run, "cluster int, dim int, n long, total decimal(38,0)")
    found = parts.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()
    reach = {r["cluster"]: r["far"] for r in state.groupBy("cluster").agg(F.max("distance").alias("far")).collect()}
    sums: dict[int, list[int]] = {}
    members: dict[int, int] = {}
    for r in found:
        sums.setdefault(r["cluster"], [0] * dims)[r["dim"]] = int(r["total"])
        members[r["cluster"]] = r["n"]
    # A distance held at the largest long says nothing about the radius.
    return {c: (members[c], float("inf") if reach[c] == LONGEST else reach[c] ** 0.5 * (1 + 1e-9), s) for c, s in sums.items()}


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors with the smallest SHA-256 of ``seed:vec_id``, in that order; a null id hashes as an empty one, equal ids go by their components."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(key.alias("_h"), "vector").orderBy("_h", "vector").limit(k).collect()
    return np.array([r["vector"] for r in rows], np.int64)


def cluster_vectors(
    vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: int = 2, id_col: str = "vec_id", vector: str = "embedding"
) -> tuple[DataFrame, np.ndarray, list[int]]:
    """The final state of every usable vector (``vec_id, vector, cluster, distance, lower, scanned``), the final centroids, and how many vectors each round scanned.

    Each round's state is a table in the shared folder; the one before goes as soon as it is written. The driver sees
    ``k`` times ``dims`` sums a round, whatever the number of vectors.
    """
    start = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector).alias("_v")).filter(usable(F.col("_v"), dims))
    state, path = stage(start.select("vec_id", integer_vector(F.col("_v"), scale).alias("vector")))
    centroids = first_centroids(state, k, seed)
    if not len(centroids):
        return state.selectExpr("*", *[f"CAST(NULL AS {t.split()[1]}) AS {t.split()[0]}" for t in STATE.split(", ")]), centroids, []
    loosen, scans = np.zeros(len(centroids)), []
    with bounded_batches(vectors.sparkSession, rows=20_000):
        for turn in range(rounds + 1):
            old_path = path
            state, path = stage(_assigned(state, centroids, loosen, half_gaps(centroids)))
            discard(vectors.sparkSession, old_path)
            scans.append(state.filter("scanned").count())
            if turn == rounds:
                break
            moved, radius = centroids.copy(), np.zeros(len(centroids))
            for c, (n, far, sums) in _sums(state, dims).items():
                moved[c], radius[c] = [s // n for s in sums], far
            loosen, centroids = loosening(centroids, moved, radius), moved
    return state, centroids, scans


def centroid_clusters(vectors: DataFrame, k: int = 40, rounds: int = 5, **rest) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every usable vector.

    Vectors without exactly ``dims`` finite components (a null vector among them) are left out; equal
    distances go to the smaller cluster; a cluster without vectors keeps its centroid; with fewer than ``k`` usable
    vectors there are as many clusters. A null id is an empty one when the first centroids are drawn;
    repeated rows stay repeated. Integers are exact whatever their size; components are held within +-2^62
    and distances and sums at the largest long. No other column is read; an empty table gives no rows.
    """
    state, centroids, _ = cluster_vectors(vectors, k, rounds, **rest)
    spark = vectors.sparkSession
    per = state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()
    whole = min(sum(int(r["total"]) for r in per), LONGEST)
    facts = [
        (r["cluster"], min(int(r["total"]), LONGEST), whole, hashlib.sha256(",".join(map(str, centroids[r["cluster"]].tolist())).encode()).hexdigest())
        for r in per
    ]
    # One row per cluster.
    known = F.broadcast(spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"))
    return state.select("vec_id", "cluster", "distance").join(known, "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
