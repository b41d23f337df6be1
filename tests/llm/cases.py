"""Documents that each operator has to bear: nulls, empty and long texts, ties, repeated rows, and
columns whose names are those of an operator's own."""

import random

from pyspark.sql.types import LongType, StringType, StructField, StructType

SMALL = "/root/testdata/sf0.001"
WORDS = "the of and river stone Light walks über été 12 grün a.b x-ray Ωmega naïve, (so) it's !! 日本 \U0001f600".split()
SCHEMA = StructType([StructField("doc_id", LongType()), StructField("text", StringType())] + [StructField(c, StringType()) for c in ("ids", "spans", "fp", "h", "node", "tags", "score", "cut_h", "later_copy")])


def texts(n: int = 40, seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    base = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 120))) for _ in range(n)]
    rows = [(k, t) for k, t in enumerate(base)]
    rows += [(n + k, base[k]) for k in range(5)]
    rows += [(n + 10 + k, base[7].replace("the", "a", 1) + " end" * k) for k in range(4)]
    rows += [(n + 20, ""), (n + 21, None), (n + 22, " \n\t "), (n + 23, "x"), (n + 24, "one two"), (None, base[3]), (None, None)]
    rows += [(n + 30, " ".join(rng.choice(WORDS) for _ in range(20_000))), (n + 31, "a" * 60_000), (n + 32, "\n".join(base[:6] * 3))]
    return rows + [(2, base[2]), (2, base[2])]


def frame(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * 9) for r in rows], SCHEMA)


def by_id(rows, name="doc_id"):
    return {r[name]: r for r in rows if r[name] is not None}
