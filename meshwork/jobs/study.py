"""A study: a grid of seeded cases, of which only the missing ones are generated, and each is kept by
the partition it is written to. Groups of results are combined through a gate; results on disk count only as
long as their files' digests are those that were noted when they were written."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from meshwork.functions.scalars import derived_seed
from meshwork.operators import kernels
from meshwork.sources.storage import dropped, hadoop


def plan(spark: SparkSession, namespace: str, sizes: list[int], phis: list[str], replicates: int, arm_length: int = 5, p_a: float = 0.5) -> DataFrame:
    """case_id, size, seed, phi (as written: the seed depends on the text), arm_length, p_a."""
    one = lambda values, kind: spark.createDataFrame([(v,) for v in values], kind)
    grid = one(sizes, "size int").crossJoin(one(phis, "phi string")).withColumn("index", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    seeded = grid.withColumn("seed", derived_seed(namespace, F.col("size"), F.col("phi"), F.col("index")))
    return seeded.select(F.xxhash64("size", "phi", "index").alias("case_id"), "size", "seed", "phi", F.lit(arm_length).alias("arm_length"), F.lit(p_a).alias("p_a"), "index")


def missing(planned: DataFrame, done: DataFrame) -> DataFrame:
    return planned.join(done.select("case_id").distinct(), "case_id", "left_anti")


def generate(planned: DataFrame, folder: str, tasks: int) -> None:
    """Places the cases and appends them below folder, by size; one case is the unit of work."""
    kernels.place(planned.repartition(tasks, "case_id")).write.mode("append").partitionBy("size").parquet(folder)


def united(groups: dict[str, DataFrame], name: str = "run") -> DataFrame:
    """The groups' rows with their group, and column name under the group's as a prefix."""
    if not groups:
        raise ValueError("no groups")
    return reduce(DataFrame.unionByName, (rows.withColumn(name, F.concat(F.lit(f"{g}/"), F.col(name).cast("string"))).withColumn("group", F.lit(g)) for g, rows in groups.items()))


def clashes(rows: DataFrame, planned: DataFrame, keys: list[str]) -> DataFrame:
    """keys, problem, runs, groups: what keeps united rows from being one study. repeated: a condition with several
    runs, of one group or of several; unexpected: one that no group planned; absent: planned (group, keys) without
    a run of this group."""
    of = rows.groupBy(*keys).agg(F.count("*").cast("long").alias("runs"), F.array_join(F.array_sort(F.collect_set("group")), ",").alias("groups"))
    several = of.where("runs > 1").withColumn("problem", F.lit("repeated"))
    known = planned.select(*keys).distinct()
    unexpected = of.join(known, keys, "left_anti").withColumn("problem", F.lit("unexpected"))
    gone = planned.select("group", *keys).distinct().join(rows.select("group", *keys).distinct(), ["group", *keys], "left_anti")
    absent = gone.groupBy(*keys).agg(F.lit(0).cast("long").alias("runs"), F.array_join(F.array_sort(F.collect_set("group")), ",").alias("groups")).withColumn("problem", F.lit("absent"))
    return reduce(DataFrame.unionByName, (x.select(*keys, "problem", "runs", "groups") for x in (several, unexpected, absent)))


def gate(rows: DataFrame, planned: DataFrame, keys: list[str], source: str | None = None) -> DataFrame:
    """rows, unless any condition clashes or (source: a column, the digest of what made a row) they come from several
    sources: then whatever reads or writes them fails as a whole, with the first clash in its message."""
    found = clashes(rows, planned, keys)
    first = found.agg(F.count("*").alias("clashes"), F.min(F.to_json(F.struct(*keys, "problem"))).alias("clash"))
    if source:
        first = first.crossJoin(rows.agg(F.min(source).alias("least"), F.max(source).alias("most")))
    wrong: Column = F.when(F.col("clashes") > 0, F.format_string("%d conditions clash: %s", "clashes", "clash"))
    if source:
        wrong = wrong.when(~F.col("least").eqNullSafe(F.col("most")), F.format_string("several sources: %s, %s", "least", "most"))
    # One row, which every row meets; a null passes.
    verdict = first.select(wrong.alias("wrong"))
    checked = rows.crossJoin(F.broadcast(verdict))
    return checked.where(F.when(F.col("wrong").isNull(), True).otherwise(F.raise_error(F.col("wrong")).cast("boolean"))).drop("wrong")


def combine(groups: dict[str, DataFrame], planned: DataFrame, keys: list[str], folder: str, name: str = "run", source: str | None = None) -> None:
    """Writes the united groups, all or nothing: a failed job is never committed. Nothing to write is an error."""
    spark = planned.sparkSession
    at, path = hadoop(spark, folder)
    if at.exists(path):
        raise FileExistsError(folder)
    rows = gate(united(groups, name), planned, keys, source)
    seen = Observation()
    try:
        rows.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(folder)
        if not seen.get["rows"]:
            raise ValueError("no rows to export")
    except Exception:
        dropped(spark, folder)  # the folder that the failed job began
        raise


def files(spark: SparkSession, folder: str, key: str) -> DataFrame:
    """key (of the partition folder), file, bytes, sha256 of every result file below folder, read whole."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(folder)
    part = F.regexp_extract("path", f"/{key}=([^/]*)/", 1)
    return rows.select(part.alias(key), F.regexp_extract("path", "([^/]*)$", 1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def note(spark: SparkSession, folder: str, key: str, manifest: str, identity: str) -> None:
    """Notes the digests of the results below folder, under the identity of what made them."""
    files(spark, folder, key).withColumn("identity", F.lit(identity)).write.mode("errorifexists").parquet(manifest)


def states(spark: SparkSession, folder: str, key: str, manifest: str, identity: str) -> DataFrame:
    """key, state of every partition that is noted or there, its files read and digested again: kept; foreign (made
    by another identity), changed, lost (a noted file is gone), added (a file that is not noted)."""
    noted, there = spark.read.parquet(manifest), files(spark, folder, key)
    met = noted.select(key, "file", F.col("sha256").alias("noted"), "identity").join(there.select(key, "file", "sha256"), [key, "file"], "full_outer")
    c = F.col
    bad = (F.when(c("noted").isNotNull() & (c("identity") != identity), 4).when(c("sha256").isNull(), 3).when(c("noted").isNull(), 1).when(c("noted") != c("sha256"), 2).otherwise(0))
    worst = met.groupBy(key).agg(F.max(bad).alias("w"))
    return worst.select(key, F.element_at(F.array(*map(F.lit, ("kept", "added", "changed", "lost", "foreign"))), F.col("w") + 1).alias("state"))


def to_do(planned: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """planned rows whose partition is not kept as it was noted. found: as states has them."""
    good = found.where("state = 'kept'").select(F.col(key).alias("kept_key"))
    return planned.join(good, F.col(key).cast("string") == F.col("kept_key").cast("string"), "left_anti")
