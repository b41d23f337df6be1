"""Cached results as lines of JSON: read whole, what can't be used put aside with its reason, totals checked twice.

A line is a chunk of a case's clusters with the chunk's totals, or (chunk -1) the case's sample row with its
totals. Counts have to be whole numbers; a line that is no JSON, or holds other kinds of values, is corrupt and
kept as its text. Chunks keep a case of any size in lines of bounded length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "cycle46-v1"
TOTALS = ("clusters", "molecules", "largest", "h2", "bonds")
TOTAL_TYPE = "struct<" + ", ".join(f"{t}: long" for t in TOTALS) + ">"
SCHEMA = f"version string, case_id long, chunk long, totals {TOTAL_TYPE}, items array<struct<cluster_id: long, size: long, h2: long, bonds: long>>, corrupt string"
CHUNK = 200


def lines(clusters: DataFrame, chunk: int = CHUNK, version: str = VERSION) -> DataFrame:
    """case_id, chunk, version, totals, items: what `text` writes. clusters: case_id, cluster_id, size, h2, bonds."""
    sums = [F.count("*").cast("long").alias("clusters"), F.sum("size").alias("molecules"), F.max("size").alias("largest"), F.sum("h2").alias("h2"), F.sum("bonds").alias("bonds")]
    part = F.expr(f"cluster_id div {chunk}").alias("chunk")
    items = F.array_sort(F.collect_list(F.struct("cluster_id", "size", "h2", "bonds"))).alias("items")
    chunks = clusters.groupBy("case_id", part).agg(*sums, items)
    whole = clusters.groupBy("case_id", F.lit(-1).cast("long").alias("chunk")).agg(*sums).withColumn("items", F.lit(None).cast(dict(chunks.dtypes)["items"]))
    return chunks.unionByName(whole).select("case_id", "chunk", F.lit(version).alias("version"), F.struct(*TOTALS).alias("totals"), "items")


def text() -> Column:
    return F.to_json(F.struct("version", "case_id", "chunk", "totals", "items"))


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "corrupt").json(path)


def reasons(version: str) -> Column:
    """Why a line can't be used: an array, empty for a good one."""
    c, x = F.col, lambda f: F.coalesce(F.exists("items", f), F.lit(True))
    wrong = lambda i: i["cluster_id"].isNull() | i["size"].isNull() | i["h2"].isNull() | i["bonds"].isNull() | (i["cluster_id"] < 0) | (i["size"] < 1) | (i["h2"] < 0) | (2 * i["h2"] > i["bonds"]) | (i["bonds"] > 2 * i["size"])
    total = lambda f: F.aggregate("items", F.lit(0).cast("long"), lambda a, i: a + i[f])
    same = (c("totals.clusters") == F.size("items")) & (c("totals.molecules") == total("size")) & (c("totals.largest") == F.array_max(F.transform("items", lambda i: i["size"]))) & (c("totals.h2") == total("h2")) & (c("totals.bonds") == total("bonds"))
    chunk = F.coalesce(c("chunk") >= 0, F.lit(False))
    rules = (
        ("version", c("version") != version),
        ("key", c("case_id").isNull() | c("chunk").isNull() | (c("chunk") < -1)),
        ("empty", chunk & (F.coalesce(F.size("items"), F.lit(0)) < 1)),
        ("counts", chunk & x(wrong)),
        ("repeated", chunk & (F.size(F.array_distinct(F.transform("items", lambda i: i["cluster_id"]))) < F.size("items"))),
        ("totals", F.when(chunk, ~same).otherwise(c("totals").isNull())),
    )
    found = F.array(*(F.when(F.coalesce(bad, F.lit(True)), name) for name, bad in rules))
    return F.when(c("corrupt").isNotNull(), F.array(F.lit("corrupt"))).otherwise(F.filter(found, lambda r: r.isNotNull()))


def scan(rows: DataFrame, version: str = VERSION) -> tuple[DataFrame, DataFrame]:
    """(good lines, quarantine: case_id and chunk as far as they can be told, reason, corrupt)."""
    told = lambda name: F.coalesce(F.col(name), F.try_to_number(F.nullif(F.regexp_extract("corrupt", f'"{name}":(-?[0-9]+)', 1), F.lit("")), F.lit("S999999999999999999")).cast("long"))
    judged = rows.withColumn("reasons", reasons(version))
    bad = judged.where(F.size("reasons") > 0).select(told("case_id").alias("case_id"), told("chunk").alias("chunk"), F.explode("reasons").alias("reason"), "corrupt")
    return judged.where(F.size("reasons") == 0).drop("reasons", "corrupt"), bad


def reconciled(good: DataFrame) -> DataFrame:
    """case_id, the sums over its good chunks, differs: the totals of its sample row that these are not, 'sample' if it
    has not exactly one, 'repeated' if a cluster stands in two chunks; null if the case can be used."""
    chunks = good.where("chunk >= 0")
    sums = chunks.groupBy("case_id").agg(*(F.max("totals.largest").alias(t) if t == "largest" else F.sum(f"totals.{t}").alias(t) for t in TOTALS))
    heads = good.where("chunk = -1").groupBy("case_id").agg(F.count("*").alias("heads"), F.min("totals").alias("told"))
    ids = chunks.select("case_id", F.explode("items.cluster_id").alias("cluster_id")).groupBy("case_id", "cluster_id").agg(F.count("*").alias("n"))
    twice = ids.where("n > 1").groupBy("case_id").agg(F.count("*").alias("twice"))
    met = heads.join(sums, "case_id", "full_outer").join(twice, "case_id", "left")
    differs = [F.when(~F.col(t).eqNullSafe(F.col(f"told.{t}")), t) for t in TOTALS]
    one = F.coalesce(F.col("heads") == 1, F.lit(False))
    names = F.concat_ws(",", F.when(~one, F.lit("sample")), *(F.when(one, d) for d in differs), F.when(F.col("twice") > 0, F.lit("repeated")))
    return met.select("case_id", *TOTALS, F.nullif(names, F.lit("")).alias("differs"))
