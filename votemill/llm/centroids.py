"""Centroid clustering of integer vectors with Elkan's bounds.

A vector's components become the integers floor(SCALE * x). Beside its vector every row carries an upper bound of the distance
to its own centroid and a lower bound of the distance to each centroid. A round moves the centroids; the bounds move by as
much as their centroids did, and only those distances are computed that neither the bounds nor half the distance between
two centroids rule out. Bounds are doubles that are always rounded away from the truth, and a distance is ruled out only if its bound is
strictly beyond, so ties are seen: the nearest centroid, and the smaller number among equals, come from exact integers.

Scale: rows stay where they were read. A round is one pass of Arrow batches over the table that the round before wrote (its
predecessor goes then), and one aggregate with a row a centroid; only centroids (k rows of `dims` integers)
reach the driver. Nothing is shuffled by vector or by id, so no key can be hot. A lost task starts again from the written table.

Edge cases: vectors that are null, of another length, or with a null or non-finite component take no part and give no row; of
vectors with a component of 2**27 or more after scaling, whose squared distances leave 64 bits, cluster, distance and all figures are null; rows of
one id are vectors of their own, and equal vectors get equal rows; rows with a null id take part but start no centroid; with fewer than k
vectors there are as many centroids as vectors; sums beyond 64 bits are null; an empty table gives no row; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from votemill.llm.common import discard, in_batches, materialize

K, ROUNDS, DIMS, SCALE, SEED = 40, 5, 64, 256, "2"
#: Components stay below this, so that a squared distance of 64 of them fits 64 bits.
REACH = 1 << 27
#: Relative room for the roundings of a square root, a sum and a product of doubles.
ROOM = 2.0**-48
BATCH = 2000


def up(x):
    return x * (1 + ROOM) + ROOM


def down(x):
    return np.maximum(x * (1 - ROOM) - ROOM, 0)


def squares(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of v to c (a centroid, or one for each row)."""
    d = v - c
    return np.einsum("ij,ij->i", d, d)


class Centroids:
    """Centroids of a round, how far each has moved, and half the distances between them, rounded down."""

    def __init__(self, at: np.ndarray, before: np.ndarray | None = None):
        self.at = at
        self.moved = up(np.sqrt(squares(at, before).astype(float))) if before is not None else np.zeros(len(at))
        apart = np.array([squares(at, c) for c in at]).reshape(len(at), len(at)).astype(float)
        self.half = down(np.sqrt(apart) / 2)
        others = self.half + np.diag(np.full(len(at), np.inf))
        self.nearest = others.min(1) if len(at) else np.zeros(0)

    def assign(self, v: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Moves own, upper and lower (bounds of distances to the centroids before they moved) on; number of distances computed, by row."""
        np.copyto(lower, down(lower - self.moved))
        np.copyto(upper, up(upper + self.moved[own]))
        computed = np.zeros(len(v), np.int64)
        rows = np.flatnonzero(upper >= self.nearest[own])
        best = np.full(len(v), -1, np.int64)  # the exact square to the own centroid, where it was computed
        best[rows] = squares(v[rows], self.at[own[rows]])
        computed[rows] += 1
        root = np.sqrt(best[rows].astype(float))
        upper[rows], lower[rows, own[rows]] = up(root), down(root)
        for j in range(len(self.at)):
            a = own[rows]
            some = rows[(a != j) & (upper[rows] >= lower[rows, j]) & (upper[rows] >= self.half[a, j])]
            if not len(some):
                continue
            d = squares(v[some], self.at[j])
            computed[some] += 1
            root = np.sqrt(d.astype(float))
            lower[some, j] = down(root)
            won = (d < best[some]) | ((d == best[some]) & (j < own[some]))
            new = some[won]
            own[new], best[new], upper[new] = j, d[won], up(root[won])
        return computed


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.reshape(-1)))


def one_round(rows: DataFrame, centroids: Centroids, tag: str) -> DataFrame:
    """The written table of rows (id, v, and after the first round own, upper, lower, n_distances) with their state after a round."""
    shared, k = rows.sparkSession.sparkContext.broadcast(centroids), len(centroids.at)
    dims, first = centroids.at.shape[1], "own" not in rows.columns

    def run(batches):
        c = shared.value
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            v = matrix(batch.column("v"), dims).astype(np.int64)
            if first:
                own, upper, lower, done = np.zeros(n, np.int32), np.full(n, np.inf), np.zeros((n, k)), np.zeros(n, np.int64)
            else:
                own, upper, done = (batch.column(x).to_numpy(zero_copy_only=False).copy() for x in ("own", "upper", "n_distances"))
                lower = matrix(batch.column("lower"), k).copy()
            done = done + c.assign(v, own, upper, lower)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(own), pa.array(upper), lists(lower), pa.array(done)], names=["id", "v", "own", "upper", "lower", "n_distances"])

    kind = T.StructType([rows.schema["id"], rows.schema["v"]]).add("own", T.IntegerType()).add("upper", T.DoubleType()).add("lower", T.ArrayType(T.DoubleType())).add("n_distances", T.LongType())
    return materialize(in_batches(rows, run, kind, BATCH), tag)


def means(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The componentwise floor of the mean of each centroid's vectors; centroids without any stay."""
    sums = rows.groupBy("own").agg(F.count("*").alias("n"), *[F.sum(F.col("v")[i].cast("long")).alias(f"s{i}") for i in range(centroids.shape[1])])
    out = centroids.copy()
    for r in sums.collect():  # k rows
        out[r["own"]] = [r[f"s{i}"] // r["n"] for i in range(centroids.shape[1])]
    return out


def integers(vectors: DataFrame, id_col: str, vec_col: str, dims: int, scale: int) -> DataFrame:
    """id, v (array of int; null if a component is out of reach) of the vectors that take part."""
    x = F.col(vec_col)
    whole = (F.size(x) == dims) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < float("inf")))
    scaled = F.transform(x, lambda e: F.floor(F.least(F.greatest(scale * e.cast("double"), F.lit(-2.0 * REACH)), F.lit(2.0 * REACH))).cast("int"))
    rows = vectors.filter(x.isNotNull() & whole).select(F.col(id_col).alias("id"), scaled.alias("v"))
    return rows.withColumn("v", F.when(F.forall("v", lambda e: F.abs(e) < REACH), F.col("v")))


def first_centroids(rows: DataFrame, k: int, seed: str) -> np.ndarray:
    """The vectors of the k smallest hashes of `seed:<id>`, ties by their components."""
    place = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    found = rows.select(place.alias("place"), "v").filter("place IS NOT NULL").orderBy("place", "v").limit(k).collect()
    return np.array([r["v"] for r in found], np.int64)


def clusters(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: str = SEED) -> tuple[DataFrame, np.ndarray]:
    """id, v, cluster, distance (squared) and n_distances (computed over all rounds) of every vector that takes part, and the centroids."""
    rows = integers(vectors, id_col, vec_col, dims, scale)
    state = rows.filter("v IS NOT NULL")
    at, before = first_centroids(state, k, seed), None
    if not len(at):
        null = [F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("n_distances", "long"))]
        return rows.select("id", "v", *null), at
    for r in range(rounds + 1):
        last, state = state, one_round(state, Centroids(at, before), f"round{r}")
        if r:
            discard(last)
        if r < rounds:
            before, at = at, means(state, at)
    near = F.element_at(F.array(*[F.array(*[F.lit(int(x)) for x in c]) for c in at]), F.col("own") + 1)
    distance = F.aggregate(F.zip_with("v", near, lambda a, b: (a - b).cast("long") * (a - b).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    found = state.select("id", "v", F.col("own").alias("cluster"), distance.alias("distance"), "n_distances")
    odd = rows.filter("v IS NULL").select("id", "v", *[F.lit(None).cast(found.schema[c].dataType).alias(c) for c in found.columns[2:]])
    return found.unionByName(odd), at


def clustered(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", **settings) -> DataFrame:
    """id_col, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that takes part."""
    found, at = clusters(vectors, id_col, vec_col, **settings)
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in at]
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).filter("cluster IS NOT NULL").collect()  # k rows
    total = sum(int(r["s"]) for r in sums)
    fit = lambda s: int(s) if s < 1 << 63 else None
    own = {r["cluster"]: fit(r["s"]) for r in sums}
    table = found.sparkSession.createDataFrame([(j, own.get(j), fit(total), digest[j]) for j in range(len(at))], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(table), "cluster", "left").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows


def sql(k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: str = SEED) -> str:
    """The same over `embeddings`, with every distance computed, for finite components within reach."""
    distance = "list_sum(list_transform(list_zip(x.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
    parts = [
        f"""x AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: floor({scale} * e::DOUBLE)::BIGINT) AS v FROM embeddings
 WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {dims})""",
        f"c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h, v) - 1)::INT AS j, v FROM (SELECT sha256('{seed}:' || vec_id) AS h, v FROM x WHERE vec_id IS NOT NULL ORDER BY h, v LIMIT {k}))",
    ]
    for r in range(rounds + 1):
        parts.append(f"a{r} AS MATERIALIZED (SELECT r, arg_min(j, (d, j)) AS j, min(d) AS d FROM (SELECT x.r, c.j, {distance} AS d FROM x, c{r} c) GROUP BY r)")
        if r < rounds:
            parts.append(f"""m{r} AS (SELECT j, i, sum(e) AS s, count(*) AS n FROM (SELECT a.j, unnest(x.v) AS e, unnest(range({dims})) AS i FROM x JOIN a{r} a USING (r)) GROUP BY j, i),
n{r} AS (SELECT j, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS v FROM m{r} GROUP BY j),
c{r + 1} AS MATERIALIZED (SELECT j, coalesce(n.v, c.v) AS v FROM c{r} c LEFT JOIN n{r} n USING (j))""")
    return f"""WITH {', '.join(parts)}
SELECT x.vec_id, a.j AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.j))::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM x JOIN a{rounds} a USING (r) JOIN c{rounds} c USING (j)"""
