"""Bonds that arrive as files: running multiplicities per pair, as a structured stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BONDS = "case_id long, bond_id long, endpoint_a long, endpoint_b long, molecule_a long, molecule_b long"


def bond_stream(spark: SparkSession, folder: str, files_at_once: int = 64) -> DataFrame:
    return spark.readStream.schema(BONDS).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def running_pairs(bonds: DataFrame) -> DataFrame:
    """case_id, molecule_a < molecule_b, multiplicity so far. The state has a row per pair; a bond that
    arrives again is counted again, so files are to be written once."""
    low, high = F.least("molecule_a", "molecule_b"), F.greatest("molecule_a", "molecule_b")
    return bonds.groupBy("case_id", low.alias("molecule_a"), high.alias("molecule_b")).agg(F.count("*").cast("long").alias("multiplicity"))
