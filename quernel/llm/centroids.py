"""Centroid clustering of integer vectors, exact in every step.

Distances are expanded: |x|^2 - 2 x.c + |c|^2, where x.c is one matrix product of a block of vectors with all centroids. It runs
in float64 BLAS, which is exact as long as every partial sum is below 2^53; with |x_i| <= a and |c_i| <= b none exceeds
dim * (a + b)^2. Vectors beyond that bound are compared in 64-bit integers, and those for which these don't suffice in Python
integers. Centroids are exact floors of exact sums.

Vectors are written once as blocks of a few thousand. In each round every task adds up its blocks, and a tree of partial sums
(RDD.treeAggregate) combines them: what moves is a row of sums for each centroid and task, whatever the size of a cluster. The
driver holds the centroids alone.

Defined results: vectors that are null, have another number of components or one that is null, infinite or no number (or is infinite
times the scale) are left out; repeated rows and ids are vectors of their own; the first centroids go by a hash of the id, then by
the components, and a null id starts no centroid unless ids run out (it is hashed as an empty string, and comes last); with fewer vectors than
centroids there are as many centroids as vectors; ties go to the smaller number; a sum of distances or a distance that a long can't
hold is null; very long vectors are as any other (all have ``dim`` components); extra columns are left alone; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.session import materialize

BLOCK = 2048  # vectors
EXACT = 1 << 53  # float64 holds all integers up to here
LONG = 1 << 63


def usable(column: str, dim: int):
    """Whether a vector has ``dim`` finite components."""
    x = F.col(f"`{column}`")
    return F.coalesce((F.size(x) == dim) & F.forall(x, lambda v: v.isNotNull() & (F.abs(v) < float("inf"))), F.lit(False))


def blocks_of(vectors: DataFrame, dim: int, scale: int) -> DataFrame:
    """(ids, points) of up to BLOCK vectors (id, x) each: points holds floor(scale * x) as float64, which is exact."""

    def run(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, BLOCK):
                part = batch.slice(first, BLOCK)
                values = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
                with np.errstate(over="ignore"):
                    points = np.floor(values * scale)
                kept = np.isfinite(points).all(axis=1)
                ids = part.column(0).filter(pa.array(kept))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids.to_pylist()], pa.list_(pa.int64())), pa.array([points[kept].astype("<f8").tobytes()], pa.binary())], ["ids", "points"]
                )

    return vectors.mapInArrow(run, "ids array<bigint>, points binary")


def integers(values: np.ndarray) -> np.ndarray:
    """Whole float64 numbers as Python integers."""
    out = np.empty(values.shape, dtype=object)
    out.flat = [int(v) for v in values.flat]
    return out


class Centroids:
    """The centroids of a round: a list of rows of integers."""

    def __init__(self, rows: list[list[int]]):
        self.rows = rows
        self.most = max((abs(v) for row in rows for v in row), default=0)
        self.floats = np.array(rows, dtype=np.float64) if self.most < EXACT else None

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the nearest centroid, squared distance): distances are int64, or Python integers where some need them."""
        dim = points.shape[1]
        largest = np.abs(points).max(axis=1, initial=0.0)
        product = dim * (largest + float(self.most)) ** 2  # far below the bound it is exact enough, and near it rounding is taken off
        fast = product < EXACT / 2
        if fast.all():
            return self._by_product(points)
        number = np.zeros(len(points), dtype=np.int64)
        distance = np.zeros(len(points), dtype=object)
        number[fast], distance[fast] = self._by_product(points[fast])
        whole = ~fast & (product < LONG / 2)
        number[whole], distance[whole] = self._by_difference(points[whole].astype(np.int64), np.array(self.rows, dtype=np.int64) if whole.any() else None)
        rest = ~fast & ~whole
        number[rest], distance[rest] = self._by_difference(integers(points[rest]), np.array(self.rows, dtype=object))
        return number, distance

    def _by_product(self, points: np.ndarray):
        if not len(points):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        squares = (points * points).sum(axis=1)[:, None] - 2.0 * (points @ self.floats.T) + (self.floats * self.floats).sum(axis=1)
        number = squares.argmin(axis=1)
        return number, squares[np.arange(len(points)), number].astype(np.int64)

    def _by_difference(self, points: np.ndarray, rows):
        number, distance = np.zeros(len(points), np.int64), np.zeros(len(points), dtype=object)
        for i in range(len(points)):
            squares = [((points[i] - row) ** 2).sum() for row in rows]
            number[i] = min(range(len(squares)), key=squares.__getitem__)
            distance[i] = int(squares[number[i]])
        return number, distance


def column_sums(points: np.ndarray) -> np.ndarray:
    """Exact sums of whole numbers by column, as Python integers."""
    if len(points) * np.abs(points).max(initial=0.0) < EXACT / 2:
        return integers(points.sum(axis=0))
    return integers(points).sum(axis=0)


def points_of(block, dim: int) -> np.ndarray:
    return np.frombuffer(bytes(block["points"]), "<f8").reshape(-1, dim)


def totals(blocks: DataFrame, rows: list[list[int]], dim: int) -> list[tuple[int, int, list[int]]]:
    """(vectors, sum of distances, sums of components) of each centroid's cluster, as exact integers."""
    centroids = Centroids(rows)
    context = blocks.sparkSession.sparkContext
    shared = context.broadcast(centroids)  # k * dim integers

    def add(total, block):
        points = points_of(block, dim)
        number, distance = shared.value.nearest(points)
        for c in np.unique(number).tolist():
            mine = number == c
            total[c, 0] += int(mine.sum())
            total[c, 1] += sum(distance[mine].tolist())
            total[c, 2:] += column_sums(points[mine])
        return total

    zero = np.zeros((len(rows), dim + 2), dtype=object)
    total = blocks.select("points").rdd.treeAggregate(zero, add, np.add)
    return [(int(t[0]), int(t[1]), [int(v) for v in t[2:]]) for t in total]


def first_centroids(vectors: DataFrame, k: int, seed: str, scale: int) -> list[list[int]]:
    """The ``k`` vectors whose ids have the smallest hashes."""
    order = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    rows = vectors.orderBy(F.col("id").isNull(), order, "x").limit(k).collect()  # k vectors
    return [[int(np.floor(np.float64(v) * scale)) for v in row["x"]] for row in rows]


def cluster(table: DataFrame, id_col: str, vector_col: str, dim: int, k: int, rounds: int, seed: str = "", scale: int = 1) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every usable vector after ``rounds`` rounds and a last assignment.

    Components count as floor(scale * x).
    """
    vectors = table.where(usable(vector_col, dim)).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("x"))
    finite = vectors.where(F.forall("x", lambda v: F.abs(v * scale) < float("inf")))
    blocks = materialize(blocks_of(finite, dim, scale), "blocks")
    rows = first_centroids(finite, k, seed, scale)
    for _ in range(rounds if rows else 0):
        found = totals(blocks, rows, dim)
        rows = [[s // n for s in sums] if n else row for row, (n, _, sums) in zip(rows, found)]
    inertias = [inertia for _, inertia, _ in totals(blocks, rows, dim)] if rows else []
    inertia = sum(inertias)
    digests = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in rows]

    def longs(values) -> pa.Array:
        return pa.array([v if v < LONG else None for v in map(int, values)], pa.int64())

    def label(batches):
        centroids = Centroids(rows)
        for batch in batches:
            for ids, points in zip(batch.column(0), batch.column(1)):
                number, distance = centroids.nearest(np.frombuffer(points.as_buffer(), "<f8").reshape(-1, dim))
                numbers = number.tolist()
                yield pa.RecordBatch.from_arrays(
                    [ids.values, pa.array(number, pa.int32()), longs(distance), longs(inertias[c] for c in numbers), longs(inertia for _ in numbers), pa.array([digests[c] for c in numbers], pa.string())],
                    ["id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
                )

    found = blocks.mapInArrow(label, "id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.withColumnRenamed("id", id_col)


def op13_centroids(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return cluster(vectors, "vec_id", "embedding", dim=64, k=8, rounds=10, seed="3:", scale=1024)


def _oracle(k: int = 8, rounds: int = 10) -> str:
    """One assignment and one update after the other, written out."""

    def assigned(r: int) -> str:
        return f"""a{r} AS MATERIALIZED (
    SELECT id, arg_min(c, (d, c)) AS c, min(d) AS d
    FROM (SELECT k.id, c.c, k.square - 2 * list_inner_product(k.v, c.v) + list_inner_product(c.v, c.v) AS d FROM kept k CROSS JOIN c{r} c) GROUP BY id
)"""

    steps = [assigned(0)]
    for r in range(1, rounds + 1):
        steps.append(f"""c{r} AS MATERIALIZED (
    SELECT c.c, coalesce(n.v, c.v) AS v FROM c{r - 1} c LEFT JOIN (
        SELECT c, list(floor(s / n) ORDER BY i) AS v
        FROM (SELECT a.c, i, sum(k.v[i]) AS s, count(*) AS n FROM a{r - 1} a JOIN kept k USING (id) CROSS JOIN range(1, 65) t(i) GROUP BY a.c, i) GROUP BY c
    ) n USING (c)
)""")
        steps.append(assigned(r))
    return f"""
WITH scaled AS (
    SELECT vec_id, row_number() OVER () AS id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v, sha256('3:' || vec_id) AS h
    FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64
), kept AS MATERIALIZED (SELECT *, list_inner_product(v, v) AS square FROM scaled),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT h, v FROM kept ORDER BY h, v LIMIT {k})),
{", ".join(steps)}
SELECT k.vec_id, a.c::INTEGER AS cluster, a.d::BIGINT AS distance, (sum(a.d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia,
    (sum(a.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(list_transform(c.v, lambda x: x::BIGINT), ',')) AS centroid_sha256
FROM a{rounds} a JOIN kept k USING (id) JOIN c{rounds} c ON c.c = a.c
"""


ORACLE = _oracle()
