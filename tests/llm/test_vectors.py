"""Centroid clustering and whitening, against plain numpy."""

import hashlib
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, LongType, StringType, StructField, StructType

from meshwork.llm import bisectors, whitening
from tests.llm.cases import SMALL

SCHEMA = StructType([StructField("vec_id", LongType()), StructField("embedding", ArrayType(FloatType()))] + [StructField(c, StringType()) for c in ("x", "cluster", "count", "n", "hot", "whitened", "distance")])


def frame(spark, rows):
    return spark.createDataFrame([(*r, *["z"] * 7) for r in rows], SCHEMA)


def vectors(n, width=64, seed=1, spread=1.0):
    rng = np.random.default_rng(seed)
    return [(k, [float(x) for x in np.float32(v)]) for k, v in enumerate(rng.normal(0, spread, (n, width)))]


def odd(width=64):
    return [(700, None), (701, []), (702, [0.5] * (width - 1)), (703, [0.5] * (width - 1) + [None]), (704, [0.5] * (width - 1) + [float("nan")]), (705, [float("inf")] + [0.5] * (width - 1)), (706, [0.25] * (width + 1))]


def plain_clusters(rows, k=16, rounds=3, width=64):
    kept = [(i, [math.floor(64 * float(c)) for c in v]) for i, v in rows if v is not None and len(v) == width and all(c is not None and math.isfinite(c) for c in v)]
    seeds = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))[:k]
    centroids = [v for _, v in seeds]

    def assigned():
        out = []
        for _, v in kept:
            far = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centroids]
            out.append((far.index(min(far)), min(far)))
        return out

    for _ in range(rounds):
        of = assigned()
        for c in range(len(centroids)):
            mine = [v for (_, v), (n, _) in zip(kept, of) if n == c]
            if mine:
                centroids[c] = [sum(x) // len(mine) for x in zip(*mine)]
    of, own = assigned(), {}
    for c, d in of:
        own[c] = own.get(c, 0) + d
    sha = lambda c: hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()
    return sorted(((i, c, d, own[c], sum(own.values()), sha(c)) for (i, _), (c, d) in zip(kept, of)), key=str)


def clusters(df, **options):
    return sorted((tuple(r) for r in bisectors.digest(bisectors.cluster(df, **options)).collect()), key=str)


@pytest.mark.parametrize("spread", [0.02, 0.5])
def test_clusters_equal_plain_ones(spark, spread):
    """With a small spread many distances tie and many vectors are equal."""
    rows = vectors(150, spread=spread) + odd() + [(3, [0.5] * 64), (3, [0.25] * 64), (None, [0.5] * 64), (None, None)]
    rows += [(1000 + k, [0.5] * 64) for k in range(60)]
    assert clusters(frame(spark, rows)) == plain_clusters(rows)


def test_fewer_vectors_than_clusters(spark):
    rows = vectors(5) + odd()
    assert clusters(frame(spark, rows)) == plain_clusters(rows)
    assert clusters(frame(spark, odd())) == [] == clusters(frame(spark, rows).where("false"))
    assert clusters(frame(spark, [(None, [1.0, 2.0])]), width=2) == plain_clusters([(None, [1.0, 2.0])], width=2)


def test_tournament_is_the_argmin():
    rng = np.random.default_rng(2)
    for k in (1, 2, 3, 7, 16):
        for top in (2, 50, 1 << 25):
            c, x = rng.integers(-top, top, (k, 6)), rng.integers(-top, top, (400, 6))
            far = ((x[:, None, :].astype(object) - c[None]) ** 2).sum(axis=2)
            planes = bisectors.Bisectors(c)
            got = planes.nearest(x)
            assert (got == far.astype(np.float64).argmin(axis=1)).all() or [min(range(k), key=lambda j: (f[j], j)) for f in far] == got.tolist()
            assert [f[g] for f, g in zip(far, got)] == planes.distance(x, got).tolist()


def test_entries_beyond_longs_fail(spark):
    with pytest.raises(Exception, match="beyond"):
        clusters(frame(spark, [(1, [1e30] * 64)]))


def test_clusters_equal_their_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SMALL}/embeddings.parquet'")
    want = con.execute(bisectors.oracle()).fetchall()
    assert clusters(spark.read.parquet(f"{SMALL}/embeddings.parquet")) == sorted(want, key=str)


def plain_whitening(rows, most, counts):
    kept = [(i, tuple(math.floor(64 * float(c)) + 1_000_000 for c in v)) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    held = [v for _, v in kept]
    fit = np.array(held if counts else sorted(set(held)), np.int64)
    n, s = len(fit), fit.sum(axis=0)
    values, vecs = np.linalg.eigh(np.cov(fit.T.astype(float), bias=True))
    values, vecs = values[::-1][:most], vecs[:, ::-1][:, :most]
    x = np.array(held)
    return kept, n, ((n * x - s) ** 2).sum(axis=1), (x - s / n) @ vecs / np.sqrt(values), values / np.cov(fit.T.astype(float), bias=True).trace()


@pytest.mark.parametrize("weights", ["one", "counts"])
def test_whitening_equals_plain_one(spark, weights):
    rows = vectors(120, 24, 3) + [(500 + k, vectors(1, 24, 3)[0][1]) for k in range(90)] + [(None, vectors(2, 24, 3)[1][1]), (7, vectors(9, 24, 3)[8][1])]
    df = frame(spark, rows + [(700, None), (701, []), (702, [0.5] * 23 + [None]), (703, [float("nan")] * 24), (704, [0.5] * 23)])
    found = whitening.whiten(df, weights=weights)
    kept, n, deviation, white, explained = plain_whitening(rows, 16, weights == "counts")
    got = sorted(found.collect(), key=lambda r: (str(r.vec_id), r.x))
    order = sorted(range(len(kept)), key=lambda k: (str(kept[k][0]), list(kept[k][1])))
    assert [(r.vec_id, tuple(r.x), int(r.deviation), r.n) for r in got] == [(*kept[k], int(deviation[k]), n) for k in order]
    assert np.allclose(np.abs(np.array([r.whitened for r in got])), np.abs(white[order]), atol=1e-9)
    assert np.allclose(got[0].explained, explained, rtol=1e-9) and max(r.identity_error for r in got) < 1e-9
    w = np.array([r.whitened for r in got])
    sign = np.sign((w * white[order]).sum(axis=0))
    assert np.allclose(w, white[order] * sign, atol=1e-9)  # one sign a component, the same for all rows
    rows = whitening.digest(found)
    assert rows.count() == 16 * len(kept) and dict(rows.dtypes)["deviation"] == "bigint" and dict(rows.dtypes)["component"] == "int"


def test_whitening_edges(spark):
    flat = [(k, [0.5] * 8) for k in range(9)]
    assert whitening.whiten(frame(spark, flat)).count() == 0
    assert whitening.digest(whitening.whiten(frame(spark, flat).where("false"))).count() == 0
    assert whitening.whiten(frame(spark, [(1, None), (2, [None] * 4)])).count() == 0
    # Two of three entries are the same, so there are two components; lengths that tie go to the longer.
    rng = np.random.default_rng(4)
    rows = [(k, [float(a), float(a), float(b)]) for k, (a, b) in enumerate(rng.integers(-9, 9, (40, 2)))] + [(100 + k, [1.0, 2.0]) for k in range(40)]
    got = whitening.whiten(frame(spark, rows))
    assert {len(r.whitened) for r in got.collect()} == {2} and got.count() == 40
    assert got.agg(F.max("identity_error")).first()[0] < 1e-9


def test_moments_beyond_longs_are_exact():
    x = np.array([[1 << 40, 5], [-(1 << 40), 9]])
    m = whitening.Moments(1 << 30, [1 << 60, 3])
    want = [sum(((1 << 30) * int(v) - s) ** 2 for v, s in zip(row, (1 << 60, 3))) for row in x]
    assert m.deviation(x) == want
