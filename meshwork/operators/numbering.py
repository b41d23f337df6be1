"""Places within groups of any size, and joins with one row a group, without a window over a group.

A window sorts a group in one task. Here rows are dealt out by ranges of (group, order), so that a large
group lies in many partitions; each partition numbers its own rows, and the numbers of rows that earlier
partitions hold of its first group are added: at most one number a partition."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from meshwork.sources.storage import saved

#: A group with over one HOT-th of all rows is joined by broadcast; there are fewer than HOT of these.
HOT = 256


def begins(batch: pa.RecordBatch, at: list[int]) -> np.ndarray:
    """Whether a row, from the second on, has another key than the one before. Nulls are equal."""
    new = np.zeros(max(batch.num_rows - 1, 0), bool)
    for k in at:
        a, b = batch.column(k).slice(1), batch.column(k).slice(0, max(batch.num_rows - 1, 0))
        other = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
        new |= other.to_numpy(zero_copy_only=False)
    return new


def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str = "place") -> DataFrame:
    """rows with `name`: a row's place in its group by order, from 0. Rows that tie in all of order come in any order,
    and are one task's work if they are many. Null keys are a group; nulls in order come first. The result lies in
    the shared folder."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(c).asc_nulls_first() for c in (*keys, *order)]
    at = [rows.columns.index(c) for c in keys]

    def run(batches):
        from pyspark import TaskContext

        part, last, held = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            place = np.arange(batch.num_rows)
            first = [batch.column(k)[0].as_py() for k in at]
            start = np.concatenate([[False], begins(batch, at)])
            place -= np.maximum.accumulate(np.where(start, place, 0))
            if first == last:
                place[: int(start.argmax()) if start.any() else len(start)] += held
            last, held = [batch.column(k)[-1].as_py() for k in at], int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(place), part, np.int32)), pa.array(place)], [*batch.schema.names, "part", name])

    schema = StructType([*rows.schema.fields, StructField("part", IntegerType()), StructField(name, LongType())])
    made = saved(rows.repartitionByRange(n, *by).sortWithinPartitions(*by).mapInArrow(run, schema), "numbered")
    held = made.groupBy("part", *keys).agg(F.count("*").alias("rows"))
    before = F.sum("rows").over(Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # Only a partition's first group can have rows in earlier ones.
    base = held.withColumn("before", before).where("before > 0").select(F.col("part").alias("base_part"), *(F.col(c).alias(f"base_{c}") for c in keys), "before")
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"base_{c}")) for c in keys), F.col("part") == F.col("base_part"))
    met = made.join(F.broadcast(base), same, "left")
    return met.select(*rows.columns, (F.col(name) + F.coalesce("before", F.lit(0))).cast("long").alias(name))


def with_group(rows: DataFrame, groups: DataFrame, keys: list[str], count: str, small: bool = False) -> DataFrame:
    """rows joined with groups, which has one row for each of their keys; its column count, the group's number of
    rows, tells the groups that are too large for one task. rows and groups are read twice. small: no group is too large."""
    if small:
        return rows.join(groups.drop(count), keys)
    total = groups.agg(F.sum(count)).first()[0] or 0
    hot: Column = F.col(count) * HOT > total
    large, small = groups.where(hot), groups.where(~hot).drop(count)
    apart = F.broadcast(large.select(*keys))
    near = rows.join(F.broadcast(large.drop(count)), keys)
    return near.unionByName(rows.join(apart, keys, "left_anti").join(small, keys))
