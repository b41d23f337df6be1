"""Centroid clustering in integers, by a tournament of bisectors.

Vectors become integers floor(SCALE * c). For each pair of centroids i < j the bisecting plane is worked
out once: x is nearer to j if 2 (c_j - c_i) . x > |c_j|^2 - |c_i|^2; at zero the smaller number wins. A
vector's nearest centroid is the winner of a knockout: neighbours meet first, then the winners, so a left
side always has the smaller number, and k - 1 such tests leave one of k centroids. Only its distance is
then worked out. All is exact: products stay below 2 ** 53 as doubles, else they are made of longs.

A round is one pass over the vectors: a task adds its vectors up by cluster, and the sums of all tasks,
k times the vector's length, meet in a grouped sum. So a vector that most rows have is no more work than
others, and only the k centroids pass through the driver.

Rows whose vector is null, of another length, or holds null or non-finite entries are left out. Rows
without an id are clustered; as starting centroids they come last. Repeated rows count each; ties of the
starting hash (repeated ids) go by the vector. With fewer vectors than k there are as many centroids as vectors. An
empty table gives an empty one. Other columns are ignored. Entries beyond 2 ** 26 after scaling fail, as
distances would not fit a long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwork.llm.rows import id_type, lists, saved, vectors

SCALE = 64
MOST = 1 << 26
#: Rows whose matches are played at once.
ROWS = 8192


def integers(df: DataFrame, width: int, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """id, x (its scaled integers), for each whole vector of this length."""

    def run(batches):
        for batch in batches:
            rows, values = vectors(batch.column(1), width)
            x = np.floor(values * scale)
            if np.abs(x).max(initial=0) > MOST:
                raise OverflowError(f"a vector's entry is beyond {MOST} after scaling")
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), lists(x.astype(np.int32))], [id_col, "x"])

    return df.select(id_col, vector_col).mapInArrow(run, f"`{id_col}` {id_type(df, id_col)}, x array<int>")


def first_centroids(kept: DataFrame, k: int, id_col: str, seed: int) -> np.ndarray:
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")), 256)
    rows = kept.orderBy(order.asc_nulls_last(), "x").limit(k).collect()
    return np.array([r["x"] for r in rows], np.int64)


class Bisectors:
    """Normals and thresholds of all pairs of centroids."""

    def __init__(self, centroids: np.ndarray):
        c = self.centroids = np.asarray(centroids, np.int64)
        square = (c * c).sum(axis=1)
        self.normal = 2 * (c[None, :, :] - c[:, None, :])
        self.threshold = square[None, :] - square[:, None]
        self.steepest = int(np.abs(self.normal).max(initial=0))

    def nearest(self, x: np.ndarray) -> np.ndarray:
        """The number of the nearest centroid of each row, by k - 1 sign tests."""
        small = self.steepest * int(np.abs(x).max(initial=0)) * x.shape[1] < 1 << 53
        kind = np.float64 if small else np.int64
        x, normal = x.astype(kind), self.normal.astype(kind)
        left = [np.full(len(x), i) for i in range(len(self.centroids))]
        while len(left) > 1:
            winners = []
            for a, b in zip(left[::2], left[1::2]):
                beyond = np.einsum("nd,nd->n", x, normal[a, b]) > self.threshold[a, b]
                winners.append(np.where(beyond, b, a))
            left = winners + left[len(winners) * 2 :]
        return left[0]

    def distance(self, x: np.ndarray, cluster: np.ndarray) -> np.ndarray:
        d = x - self.centroids[cluster]
        return (d * d).sum(axis=1)


def matrices(column: pa.Array, width: int):
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)
    for begin in range(0, len(flat), ROWS):
        yield begin, flat[begin : begin + ROWS]


def moved(kept: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: floor of the mean of their vectors; empty ones stay."""
    k, width = centroids.shape
    planes = Bisectors(centroids)

    def run(batches):
        sums = np.zeros((k, width + 1), np.int64)
        for batch in batches:
            for _, x in matrices(batch.column(0), width):
                cluster = planes.nearest(x)
                order = np.argsort(cluster, kind="stable")
                there, first = np.unique(cluster[order], return_index=True)
                sums[there, :width] += np.add.reduceat(x[order], first, axis=0)
                sums[:, width] += np.bincount(cluster, minlength=k)
        cluster = np.repeat(np.flatnonzero(sums[:, width]), width + 1)
        yield pa.RecordBatch.from_arrays([pa.array(cluster.astype(np.int32)), pa.array(np.tile(np.arange(width + 1, dtype=np.int32), len(cluster) // (width + 1))), pa.array(sums[sums[:, width] > 0].ravel())], ["cluster", "dim", "part"])

    out = centroids.astype(object)
    total = {(r["cluster"], r["dim"]): r["total"] for r in kept.select("x").mapInArrow(run, "cluster int, dim int, part long").groupBy("cluster", "dim").agg(F.sum("part").alias("total")).collect()}
    for (cluster, dim), s in total.items():
        if dim < width:
            out[cluster, dim] = s // total[cluster, width]
    return out.astype(np.int64)


def cluster(df: DataFrame, k: int = 16, rounds: int = 3, width: int = 64, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 1) -> DataFrame:
    """id, x, cluster, distance (squared), cluster_inertia, inertia, centroid (its integers)."""
    kept = saved(integers(df, width, id_col, vector_col), "vectors")
    centroids = first_centroids(kept, k, id_col, seed)
    kind = f"`{id_col}` {id_type(df, id_col)}, x array<int>, cluster int, distance long"
    if not len(centroids):
        return df.sparkSession.createDataFrame([], f"{kind}, cluster_inertia long, inertia long, centroid array<long>")
    for _ in range(rounds):
        centroids = moved(kept, centroids)
    planes = Bisectors(centroids)

    def run(batches):
        for batch in batches:
            for begin, x in matrices(batch.column(1), width):
                number = planes.nearest(x)
                part = batch.slice(begin, len(x))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(number.astype(np.int32)), pa.array(planes.distance(x, number))], [id_col, "x", "cluster", "distance"])

    assigned = saved(kept.mapInArrow(run, kind), "assigned")
    own = {r["cluster"]: r["s"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    of = df.sparkSession.createDataFrame([(n, s, sum(own.values()), centroids[n].tolist()) for n, s in own.items()], "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return assigned.join(F.broadcast(of), "cluster").select(id_col, "x", "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def digest(clustered: DataFrame, id_col: str = "vec_id") -> DataFrame:
    text = F.array_join(F.transform("centroid", lambda c: c.cast("string")), ",")
    return clustered.select(id_col, "cluster", "distance", "cluster_inertia", "inertia", F.sha2(text, 256).alias("centroid_sha256"))


def oracle(k: int = 16, rounds: int = 3, width: int = 64) -> str:
    """The digest by plain distances to all centroids."""
    steps = []
    for n in range(rounds + 1):
        steps.append(f"""assigned{n} AS MATERIALIZED (
  SELECT vec_id, k, dist FROM (SELECT e.vec_id, c.k, sum((e.v - c.v) * (e.v - c.v)) AS dist FROM entries e JOIN centroids{n} c USING (d) GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY dist, k) = 1)""")
        if n < rounds:
            steps.append(f"""sums{n} AS (SELECT a.k, e.d, sum(e.v) AS s, count(*) AS n FROM assigned{n} a JOIN entries e USING (vec_id) GROUP BY ALL
), centroids{n + 1} AS MATERIALIZED (SELECT c.k, c.d, CASE WHEN n IS NULL THEN c.v ELSE CAST((s - (s % n + n) % n) // n AS BIGINT) END AS v FROM centroids{n} c LEFT JOIN sums{n} USING (k, d))""")
    return f"""WITH kept AS (SELECT vec_id, embedding FROM embeddings WHERE len(embedding) = {width} AND list_bool_and(list_transform(embedding, lambda c: c IS NOT NULL AND isfinite(c)))
), entries AS MATERIALIZED (SELECT vec_id, unnest(range({width})) AS d, CAST(floor({SCALE} * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS v FROM kept
), seeds AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR))) - 1 AS k FROM kept QUALIFY k < {k}
), centroids0 AS MATERIALIZED (SELECT s.k, e.d, e.v FROM seeds s JOIN entries e USING (vec_id)
), {', '.join(steps)},
inertias AS (SELECT k, CAST(sum(dist) AS BIGINT) AS own FROM assigned{rounds} GROUP BY ALL),
digests AS (SELECT k, sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY d)) AS sha FROM centroids{rounds} GROUP BY ALL)
SELECT vec_id, CAST(k AS INTEGER) AS cluster, CAST(dist AS BIGINT) AS distance, own AS cluster_inertia, CAST((SELECT sum(own) FROM inertias) AS BIGINT) AS inertia, sha AS centroid_sha256
FROM assigned{rounds} JOIN inertias USING (k) JOIN digests USING (k)"""
