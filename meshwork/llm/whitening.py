"""Embedding whitening by a covariance over distinct vectors with weights.

Vectors become integers x = floor(SCALE * c) + SHIFT and equal ones are grouped, with their number. Each
distinct vector is fitted with weight one, or with its number (weights="counts"). Sums are exact; the
covariance is a product of the centred, weighted matrix with itself in each task, and the tasks' products,
half of the square of the vector's length, meet in a grouped sum. The driver gets that one matrix, whose
eigenvectors are the components. Each distinct vector is whitened once and joined back to its rows; a vector
that over 1 / HOT of all rows have, of which there are fewer than HOT, is joined by broadcast, so that its
rows stay where they are.

Rows whose vector is null, empty or holds null or non-finite entries are left out, and so are those of
another length than most have (of equally frequent lengths the longest). Components whose eigenvalue is
zero but for rounding are left out, so vectors that are all equal give no rows, like an empty table. Rows
without an id and repeated rows are whitened like others; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwork.llm.rows import id_type, lists, saved, vectors

SCALE, SHIFT = 64, 1_000_000
HOT = 256
ROWS = 8192
#: Entries stay below this after scaling, so that they are exact as doubles.
MOST = 1 << 52


def integers(df: DataFrame, width: int, id_col: str, vector_col: str) -> DataFrame:
    """id, x."""

    def run(batches):
        for batch in batches:
            rows, values = vectors(batch.column(1), width)
            x = np.floor(values * SCALE)
            if np.abs(x).max(initial=0) >= MOST:
                raise OverflowError(f"a vector's entry is beyond {MOST} after scaling")
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), lists(x.astype(np.int64) + SHIFT)], [id_col, "x"])

    return df.select(id_col, vector_col).mapInArrow(run, f"`{id_col}` {id_type(df, id_col)}, x array<long>")


def usual_length(df: DataFrame, vector_col: str) -> int:
    lengths = df.groupBy(F.size(vector_col).alias("n")).agg(F.count("*").alias("rows")).where("n > 0")
    best = lengths.agg(F.max_by("n", F.struct("rows", "n"))).first()[0]
    return best or 0


def matrices(batch: pa.RecordBatch, width: int):
    """(x as a matrix, the numbers of rows that have it) of some rows of a batch at a time."""
    x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    counts = batch.column(1).to_numpy(zero_copy_only=False)
    for begin in range(0, len(x), ROWS):
        yield begin, x[begin : begin + ROWS], counts[begin : begin + ROWS]


class Moments:
    """n (sum of weights), S (sums by dimension), both exact, and what centres a vector."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, np.array(sums, object)
        self.top = max(map(abs, sums))

    def apart(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: as longs, or as numbers of Python where these would not do."""
        if self.n * int(np.abs(x).max(initial=0)) + self.top < 1 << 62:
            return x * self.n - self.sums.astype(np.int64)
        return x.astype(object) * self.n - self.sums

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.apart(x) / self.n).astype(np.float64)

    def deviation(self, x: np.ndarray) -> list[int]:
        """The sum over dimensions of the square of apart, exact."""
        d = self.apart(x)
        if d.dtype != object and int(np.abs(d).max(initial=0)) ** 2 * d.shape[1] >= 1 << 63:
            d = d.astype(object)
        return (d * d).sum(axis=1).tolist()


def grouped_sums(rows: DataFrame, run, columns: str = "cell int, part double") -> dict[int, float]:
    """Tasks' partial results added up by cell."""
    return {r["cell"]: r["total"] for r in rows.mapInArrow(run, columns).groupBy("cell").agg(F.sum("part").alias("total")).collect()}


def covariance_of(rows: DataFrame, width: int, size: int, weighted: bool, n: int, values) -> np.ndarray:
    """The covariance (divisor n) of values(x), which are centred and of this size, over rows x (of this width), count."""
    upper = np.triu_indices(size)

    def run(batches):
        product = np.zeros((size, size))
        for batch in batches:
            for _, x, counts in matrices(batch, width):
                v = values(x)
                product += (v * counts[:, None] if weighted else v).T @ v
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(upper[0]), dtype=np.int32)), pa.array(product[upper] / n)], ["cell", "part"])

    got = grouped_sums(rows, run)
    out = np.zeros((size, size))
    out[upper] = [got[k] for k in range(len(upper[0]))]
    return out + np.triu(out, 1).T


class Fit:
    """Components of the covariance, by falling eigenvalue: rows of vectors."""

    def __init__(self, moments: Moments, covariance: np.ndarray, most: int):
        values, vectors = np.linalg.eigh(covariance)
        values, vectors = values[::-1], vectors.T[::-1]
        there = values > values[0] * len(values) * 1e-14 if values[0] > 0 else np.zeros(len(values), bool)
        self.values, self.vectors = values[there][:most], vectors[there][:most]
        self.moments, self.explained = moments, self.values / np.trace(covariance) if len(self.values) else self.values

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.moments.centred(x) @ self.vectors.T / np.sqrt(self.values)


def whiten(df: DataFrame, components: int = 16, weights: str = "one", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, x, deviation (decimal), whitened (list, by component), n, explained (list), identity_error."""
    if weights not in ("one", "counts"):
        raise ValueError("weights: one or counts")
    weighted = weights == "counts"
    width = usual_length(df, vector_col)
    columns = "x array<long>, deviation decimal(38,0), whitened array<double>, n long, explained array<double>, identity_error double"
    nothing = df.sparkSession.createDataFrame([], f"`{id_col}` {id_type(df, id_col)}, {columns}")
    if not width:
        return nothing
    rows = saved(integers(df, width, id_col, vector_col), "vectors")
    distinct = saved(rows.groupBy("x").agg(F.count("*").alias("count")), "distinct")

    def sums(batches):
        total = np.zeros(width, object)
        n = held = 0
        for batch in batches:
            for _, x, counts in matrices(batch, width):
                total += (x.astype(object) * counts[:, None].astype(object)).sum(axis=0) if weighted else x.sum(axis=0).astype(object)
                n += int(counts.sum()) if weighted else len(x)
                held += int(counts.sum())
        cells = [*total.tolist(), n, held]
        yield pa.RecordBatch.from_arrays([pa.array(range(width + 2), pa.int32()), pa.array(cells, pa.decimal128(38, 0))], ["cell", "part"])

    got = grouped_sums(distinct, sums, "cell int, part decimal(38,0)")
    if not got or not got[width]:
        return nothing
    n, held = int(got[width]), int(got[width + 1])
    moments = Moments(n, [int(got[k]) for k in range(width)])
    fit = Fit(moments, covariance_of(distinct, width, width, weighted, n, moments.centred), components)
    if not len(fit.values):
        return nothing
    error = np.abs(covariance_of(distinct, width, len(fit.values), weighted, n, fit.whitened) - np.eye(len(fit.values))).max()

    def once(batches):
        for batch in batches:
            for begin, x, counts in matrices(batch, width):
                part = batch.slice(begin, len(x))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(fit.moments.deviation(x), pa.decimal128(38, 0)), lists(fit.whitened(x))], ["x", "count", "deviation", "whitened"])

    whitened = saved(distinct.mapInArrow(once, "x array<long>, count long, deviation decimal(38,0), whitened array<double>"), "whitened")
    hot = F.broadcast(whitened.where(F.col("count") * HOT > held).select(F.col("x").alias("hot"), F.col("deviation").alias("d"), F.col("whitened").alias("w")))
    met = rows.join(hot, F.col("x") == F.col("hot"), "left")
    near = met.where("hot is not null").select(id_col, "x", F.col("d").alias("deviation"), F.col("w").alias("whitened"))
    far = met.where("hot is null").select(id_col, "x").join(whitened.where(F.col("count") * HOT <= held).drop("count"), "x").select(id_col, "x", "deviation", "whitened")
    explained = F.array(*(F.lit(float(e)) for e in fit.explained))
    return near.unionAll(far).select("*", F.lit(n).cast("long").alias("n"), explained.alias("explained"), F.lit(float(error)).alias("identity_error"))


def digest(found: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """A row for each row and component."""
    each = found.select(id_col, "n", "deviation", F.posexplode("whitened").alias("at", "whitened"), "explained", "identity_error")
    return each.select(id_col, (F.col("at") + 1).cast("int").alias("component"), "n", F.col("deviation").cast("long").alias("deviation"), "whitened", F.get("explained", F.col("at")).alias("explained"), "identity_error")
