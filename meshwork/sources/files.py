"""Saved samples as files: explicit schemas, strict readers, partitioned writers, network settings.

Readers never infer: a cell that doesn't fit its type fails the read. Plain and gzip files are read
alike; a table that a sample folder holds twice, plain and packed, or not at all, is an error row
(`copies`) rather than a silent choice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "trajectories": "molecule long, type string, arm int, step int, site long, x int, y int, z int, direction int",
    "candidates": "endpoint_a long, molecule_a long, arm_a int, type_a string, site_a long, x_a int, y_a int, z_a int, endpoint_b long, molecule_b long, arm_b int, type_b string, site_b long, x_b int, y_b int, z_b int, manhattan_distance int",
    "bonds": "bond_id long, endpoint_a long, molecule_a long, arm_a int, type_a string, site_a long, x_a int, y_a int, z_a int, endpoint_b long, molecule_b long, arm_b int, type_b string, site_b long, x_b int, y_b int, z_b int, manhattan_distance int",
    "cluster-members": "molecule long, cluster_id long, cluster_size long, bond_degree long",
    "cluster-summary": "cluster_id long, molecule_count long, bond_count long",
    "network-summary": "molecules long, bonds long, clusters long, largest long, second_largest long, isolated_molecules long, largest_fraction double",
}
SETTINGS = ("dim", "L", "seed", "arm_length", "a_probability")
TARGETS = ("target_molecules", "target_phi")


def samples(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Table `name` of every sample folder below: its columns and case_id, the folder's name."""
    rows = spark.read.schema(SCHEMAS[name]).option("header", True).option("mode", "FAILFAST").option("recursiveFileLookup", True).option("pathGlobFilter", f"{name}.csv*").csv(folder)
    return rows.withColumn("case_id", F.element_at(F.split(F.input_file_name(), "/"), -2))


def copies(spark: SparkSession, folder: str, name: str, cases: DataFrame) -> DataFrame:
    """case_id, files: the cases (a frame with case_id) for which there isn't exactly one file of the table."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"{name}.csv*").load(folder)
    counts = listed.select(F.element_at(F.split("path", "/"), -2).alias("case_id")).groupBy("case_id").agg(F.count("*").cast("long").alias("files"))
    return cases.select("case_id").join(counts, "case_id", "left").fillna(0, ["files"]).where("files <> 1")


def save(rows: DataFrame, folder: str, *keys: str) -> None:
    """Never over what is there; the committer puts all files in place at the end or none."""
    rows.write.mode("errorifexists").partitionBy(*keys).parquet(folder)


def export_csv(rows: DataFrame, folder: str, *order: str) -> None:
    """One file per case_id, with a header, in this order, for tools that read such files."""
    rows.repartition("case_id").sortWithinPartitions("case_id", *order).write.mode("errorifexists").partitionBy("case_id").option("header", True).csv(folder)


def settings(spark: SparkSession, path: str) -> DataFrame:
    """file, key, value, line: `key = value` lines of setting files; what follows # is a comment."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\n")).alias("line", "raw"))
    bare = text.withColumn("raw", F.trim(F.regexp_replace("raw", "#.*", ""))).where("raw <> ''")
    return bare.select("file", (F.col("line") + 1).alias("line"), F.trim(F.regexp_extract("raw", "^([^=]*)=", 1)).alias("key"), F.trim(F.regexp_extract("raw", "^[^=]*=(.*)$", 1)).alias("value"))


def setting_faults(rows: DataFrame) -> DataFrame:
    """file, fault: unknown, repeated and missing keys, bad numbers, and not exactly one target."""
    known = [*SETTINGS, *TARGETS]
    number = r"^[+]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
    each = rows.select("file", F.when(~F.col("key").isin(*known), F.concat(F.lit("unknown "), "key")).when(~F.col("value").rlike(number), F.concat(F.lit("bad "), "key")).alias("fault"))
    per = rows.groupBy("file").agg(F.collect_list("key").alias("keys"))
    has = lambda k: F.size(F.filter("keys", lambda x: x == k))
    whole = F.array(
        *(F.when(has(k) > 1, F.lit(f"repeated {k}")) for k in known),
        *(F.when(has(k) == 0, F.lit(f"missing {k}")) for k in SETTINGS),
        F.when(has(TARGETS[0]) + has(TARGETS[1]) != 1, F.lit("one target")),
    )
    return each.unionByName(per.select("file", F.explode(whole).alias("fault"))).where("fault is not null")


def networks(rows: DataFrame) -> DataFrame:
    """One row per faultless file: its settings and the number of molecules that its target comes to, with the
    fraction in exact decimals: whole sites first, then whole molecules."""
    wide = rows.groupBy("file").pivot("key", [*SETTINGS, *TARGETS]).agg(F.first("value"))
    good = wide.join(setting_faults(rows).select("file").distinct(), "file", "left_anti")
    sites = F.pow(F.col("L").cast("int"), F.col("dim").cast("int")).cast("decimal(18,0)")
    whole = F.floor(F.col("target_phi").cast("decimal(20,18)") * sites).cast("long")
    count = F.expr("whole div (1 + 4 * arms)")
    out = good.withColumn("whole", whole).withColumn("arms", F.col("arm_length").cast("long")).withColumn("molecules", F.coalesce(F.col("target_molecules").cast("long"), count))
    return out.select("file", F.col("dim").cast("int"), F.col("L").cast("int"), F.col("seed").cast("decimal(20,0)"), F.col("arms").alias("arm_length"), F.col("a_probability").cast("double"), "target_phi", "molecules")


def viewer_model(trajectories: DataFrame) -> DataFrame:
    """case_id, molecules: JSON of [id, type, centre, arms], arms as flat lists of coordinates by step."""
    arm = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("step", "x", "y", "z"))), lambda p: F.array(p["x"], p["y"], p["z"])))
    arms = trajectories.where("arm >= 0").groupBy("case_id", "molecule", "arm").agg(arm.alias("path")).groupBy("case_id", "molecule").agg(F.transform(F.array_sort(F.collect_list(F.struct("arm", "path"))), lambda a: a["path"]).alias("arms"))
    centre = trajectories.where("arm = -1").select("case_id", "molecule", "type", F.array("x", "y", "z").alias("centre"))
    # One row per molecule: a case may have any number of them.
    return centre.join(arms, ["case_id", "molecule"]).select("case_id", "molecule", F.to_json(F.struct(F.col("molecule").alias("id"), "type", "centre", "arms")).alias("json"))


#: Columns that a file may have; more are a fault of the rows' keys.
MOST_COLUMNS = 10_000


def columns_of(rows: DataFrame, cells: str, order: list[str]) -> list[str]:
    """The keys of the maps in column cells, by first appearance: the first row (by order) that has the key, then its
    place in the map. One row a key reaches the driver."""
    each = rows.select(F.struct(*order).alias("row"), F.posexplode(F.map_keys(cells)).alias("at", "key"))
    first = each.groupBy("key").agg(F.min(F.struct("row", "at")).alias("first"))
    keys = first.orderBy("first", "key").limit(MOST_COLUMNS + 1).select("key").collect()
    if len(keys) > MOST_COLUMNS:
        raise ValueError(f"over {MOST_COLUMNS} columns")
    return [k[0] for k in keys]


def export_union(rows: DataFrame, cells: str, order: list[str], folder: str) -> list[str]:
    """Writes rows of maps (text to text) as CSV with a header, one column for each key that any row has; a row without
    a key has an empty cell. No rows, or only empty maps, are an error and leave nothing. Returns the columns."""
    names = columns_of(rows, cells, order)
    if not names:
        raise ValueError("no rows to export")
    by = [F.col(c).asc_nulls_first() for c in order]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Ranges, so that the files one after the other have the rows in order.
    dealt = rows.repartitionByRange(n, *by).sortWithinPartitions(*by)
    dealt.select(*(F.try_element_at(cells, F.lit(k)).alias(k) for k in names)).write.mode("errorifexists").option("header", True).csv(folder)
    return names


def columns_in(rows: DataFrame, *fields: str) -> DataFrame:
    """rows with these columns only; the missing ones are named in the error."""
    absent = [f for f in fields if f not in rows.columns]
    if absent:
        raise ValueError(f"missing columns: {', '.join(absent)}")
    return rows.select(*fields)
