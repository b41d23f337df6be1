"""Column functions that the statistics share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Decimals that results keep, so that the order of summation doesn't show.
DIGITS = 9


def ratio(a: Column, b: Column) -> Column:
    """a / b; null, not zero, where b is zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def rounded(x: Column) -> Column:
    return F.round(x.cast("double"), DIGITS)


def size_high(size: Column) -> Column:
    """Upper end of the bins 1, 2, 3-4, 5-8, ..., from the integer's bits."""
    return F.when(size == 1, F.lit(1).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(size - 1))))


def size_low(high: Column) -> Column:
    return F.when(high == 1, F.lit(1).cast("long")).otherwise((F.floor(high / 2) + 1).cast("long"))


def count_of(x: Column) -> Column:
    return F.count(x).cast("long")


def spread(x: Column, name: str) -> list[Column]:
    """n (defined values), mean, sd and se; the last two are null for fewer than two values."""
    return [
        count_of(x).alias(f"{name}_n"),
        rounded(F.avg(x)).alias(f"{name}_mean"),
        rounded(F.stddev_samp(x)).alias(f"{name}_sd"),
        rounded(F.stddev_samp(x) / F.sqrt(F.count(x))).alias(f"{name}_se"),
    ]


def near(a: Column, b: Column, relative: float = 1e-10, absolute: float = 1e-12) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(relative) * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute))


def derived_seed(namespace: str, size: Column, phi_text: Column, index: Column) -> Column:
    """The first eight bytes of a SHA-256 as an unsigned number; the fraction enters as it is written."""
    text = F.concat_ws(":", F.lit(namespace), size.cast("string"), phi_text, index.cast("string"))
    return F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)")
