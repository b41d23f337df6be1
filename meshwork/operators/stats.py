"""Two-level statistics: within a sample, then with equal weight across the samples of a condition."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshwork.functions.scalars import ratio, rounded, size_high, size_low, spread
from meshwork.operators.numbering import numbered, with_group


def moments(summary: DataFrame, rounded: Callable[[Column], Column] = rounded) -> DataFrame:
    """Per case: mean cluster size, size-weighted means over all clusters, without one largest and without
    all largest ones, the number of ties and the id of the cluster left out. Undefined ones are null."""
    s, tied, one = F.col("molecule_count"), F.col("tied"), F.col("is_largest")
    part = lambda keep, x: F.sum(F.when(keep, x))
    everything = F.lit(True)
    return summary.groupBy("case_id").agg(
        rounded(F.avg(s)).alias("size_mean"),
        rounded(ratio(part(everything, s * s), part(everything, s))).alias("weighted_all"),
        rounded(ratio(part(~one, s * s), part(~one, s))).alias("weighted_excl_one"),
        rounded(ratio(part(~tied, s * s), part(~tied, s))).alias("weighted_excl_all_tied"),
        F.count_if(tied).cast("long").alias("largest_tie_count"),
        F.min(F.when(one, F.col("cluster_id"))).alias("selected_largest_id"),
    )


def size_histogram(summary: DataFrame) -> DataFrame:
    return summary.groupBy("case_id", F.col("molecule_count").alias("size")).agg(F.count("*").cast("long").alias("count"))


def scoped(rows: DataFrame) -> DataFrame:
    """Each cluster under scope 'all' and, unless it is the one largest, under 'exclude_one_largest'."""
    scopes = F.when(F.col("is_largest"), F.array(F.lit("all"))).otherwise(F.array(F.lit("all"), F.lit("exclude_one_largest")))
    return rows.withColumn("scope", F.explode(scopes)).withColumn("size_high", size_high(F.col("size"))).withColumn("size_low", size_low(F.col("size_high")))


def size_bins(doubles: DataFrame) -> DataFrame:
    """Per case, scope and size bin: clusters, molecules, h2, and the share of bonded molecules per cluster
    (mean over clusters) and pooled."""
    return scoped(doubles).groupBy("case_id", "scope", "size_low", "size_high").agg(
        F.count("*").cast("long").alias("cluster_count"),
        F.sum("size").cast("long").alias("molecule_count"),
        F.sum("h2").cast("long").alias("h2"),
        rounded(F.avg(ratio(F.col("h2"), F.col("size")))).alias("fraction_mean"),
        rounded(ratio(F.sum("h2"), F.sum("size"))).alias("fraction_pooled"),
    )


def size_relation(bins: DataFrame, conditions: DataFrame) -> DataFrame:
    """Across the samples of a condition. A sample without a bin is left out of the fraction's mean, and
    total_samples tells how many there are. conditions: case_id, condition."""
    total = conditions.groupBy("condition").agg(F.count("*").cast("long").alias("total_samples"))
    per = bins.join(conditions, "case_id").groupBy("condition", "scope", "size_low", "size_high").agg(
        F.count("*").cast("long").alias("samples_with_bin"), F.sum("cluster_count").cast("long").alias("clusters"), *spread(F.col("fraction_mean"), "fraction")
    )
    return per.join(F.broadcast(total), "condition")


def presence(doubles: DataFrame) -> DataFrame:
    """Per case and scope, in total and per bin: clusters without and with h2; bins that a case lacks count 0."""
    rows = scoped(doubles)
    seen = rows.groupBy("case_id", "scope", "size_low", "size_high").agg(F.count_if(F.col("h2") == 0).alias("without_h2"), F.count_if(F.col("h2") > 0).alias("with_h2"))
    bins = seen.select("size_low", "size_high").distinct()
    cases = doubles.select("case_id").distinct().select("case_id", F.explode(F.array(F.lit("all"), F.lit("exclude_one_largest"))).alias("scope"))
    # A dense grid of cases by the few bins there are; bins grow with the logarithm of the largest size.
    grid = cases.join(F.broadcast(bins.agg(F.collect_list(F.struct("size_low", "size_high")).alias("bins")))).select("case_id", "scope", F.explode("bins").alias("b")).select("case_id", "scope", "b.*")
    filled = grid.join(seen, ["case_id", "scope", "size_low", "size_high"], "left").fillna(0, ["without_h2", "with_h2"])
    total = filled.groupBy("case_id", "scope").agg(F.sum("without_h2").alias("without_h2"), F.sum("with_h2").alias("with_h2"))
    total = total.select("case_id", "scope", F.lit("TOTAL").alias("kind"), F.lit(0).cast("long").alias("size_low"), F.lit(0).cast("long").alias("size_high"), "without_h2", "with_h2")
    every = filled.select("case_id", "scope", F.lit("BIN").alias("kind"), "size_low", "size_high", "without_h2", "with_h2").unionByName(total)
    both = F.col("without_h2") + F.col("with_h2")
    return every.select("case_id", "scope", "kind", "size_low", "size_high", F.col("without_h2").cast("long"), F.col("with_h2").cast("long"), both.cast("long").alias("cluster_count"), rounded(ratio(F.col("with_h2"), both)).alias("fraction_with_h2"))


def condition_summary(samples: DataFrame) -> DataFrame:
    """Per condition n, mean, sd, se of the share of finished orders and of the number of orders, and their extremes."""
    share = ratio(F.col("h"), F.col("n"))
    return samples.groupBy("segment", "region").agg(F.count("*").cast("long").alias("samples"), *spread(share, "share"), *spread(F.col("n").cast("double"), "n"), F.min("n").alias("n_min"), F.max("n").alias("n_max"))


def mean_and_pooled(samples: DataFrame) -> DataFrame:
    return samples.groupBy("segment", "region").agg(rounded(F.avg(ratio(F.col("h"), F.col("n")))).alias("mean_of_ratios"), rounded(ratio(F.sum("h"), F.sum("n"))).alias("pooled_ratio"))


CHECKPOINTS = (5, 10, 20, 50, 100, 200, 500, 1000)


def convergence(samples: DataFrame, value, order: list, checkpoints: tuple[int, ...] = CHECKPOINTS) -> DataFrame:
    """Statistics of the first n samples of a condition, for each checkpoint it reaches, and of all of them
    (first_n 'all'). The first n are taken before undefined values are dropped. Only the samples up to the last
    checkpoint are sorted: a limit within groups, which Spark applies before it shuffles; a running frame is
    read at the checkpoints, so a sample is used once, not once a checkpoint."""
    by = Window.partitionBy("segment", "region").orderBy(*order)
    run = by.rowsBetween(Window.unboundedPreceding, 0)
    v = samples.withColumn("v", value)
    first = v.withColumn("k", F.row_number().over(by)).where(F.col("k") <= max(checkpoints))
    stats = first.select("segment", "region", F.col("k").cast("string").alias("first_n"), F.count("v").over(run).cast("long").alias("n"), F.avg("v").over(run).alias("m"), F.stddev_samp("v").over(run).alias("s"))
    every = v.groupBy("segment", "region").agg(F.lit("all").alias("first_n"), F.count("v").cast("long").alias("n"), F.avg("v").alias("m"), F.stddev_samp("v").alias("s"))
    rows = stats.where(F.col("first_n").isin(*map(str, checkpoints))).unionByName(every)
    return rows.select("segment", "region", "first_n", "n", rounded(F.col("m")).alias("mean"), rounded(F.col("s")).alias("sd"), rounded(F.col("s") / F.sqrt("n")).alias("se"))


def peaks(summary: DataFrame) -> DataFrame:
    """Per segment the region with the highest mean share; ties go to the smallest region."""
    best = F.max_by(F.struct("region", "share_mean"), F.struct(F.col("share_mean"), -F.col("region")))
    return summary.where("share_mean is not null").groupBy("segment").agg(best.alias("b")).select("segment", F.col("b.region").alias("peak_region"), F.col("b.share_mean").alias("peak_mean"))


def thresholds(summary: DataFrame, low: float, high: float) -> DataFrame:
    """Per segment the largest region below the peak whose mean is at most low, and the smallest above it
    whose mean is at least high; null where there is none."""
    rows = summary.join(F.broadcast(peaks(summary)), "segment")
    below = F.when((F.col("region") < F.col("peak_region")) & (F.col("share_mean") <= low), F.col("region"))
    above = F.when((F.col("region") > F.col("peak_region")) & (F.col("share_mean") >= high), F.col("region"))
    return rows.groupBy("segment").agg(F.max(below).alias("low_region"), F.first("peak_region").alias("peak_region"), F.min(above).alias("high_region"))


def nearest(summary: DataFrame, target: float) -> DataFrame:
    gap = F.struct(rounded(F.abs(F.col("share_mean") - target)), F.col("region"))
    return summary.where("share_mean is not null").groupBy("segment").agg(F.min_by("region", gap).alias("nearest_region"))


def medians(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, median (exact; of an even number of values the mean of the two in the middle) of groups of any size:
    values are numbered across partitions, so no task holds a group's. Nulls do not count."""
    placed = numbered(rows.where(F.col(value).isNotNull()).select(*keys, value), keys, [value])
    sizes = placed.groupBy(*keys).agg(F.count("*").alias("size"))
    middle = with_group(placed, sizes.withColumn("rows", F.col("size")), keys, "rows")
    return middle.where("place = (size - 1) div 2 or place = size div 2").groupBy(*keys).agg(F.avg(value).alias("median"))


def resources(stages: DataFrame) -> DataFrame:
    """Per group: attempted and by status; median, least and most of the completed ones only."""
    done = F.when(F.col("status") == "F", F.col("value"))
    middle = medians(stages.select("grp", done.alias("done")), ["grp"], "done")
    per = stages.groupBy("grp").agg(
        F.count("*").cast("long").alias("attempted"),
        F.count_if(F.col("status") == "F").cast("long").alias("completed"),
        F.count_if(F.col("status") == "P").cast("long").alias("incomplete"),
        F.count_if(F.col("status") == "O").cast("long").alias("open_ones"),
        F.min(done).alias("least_value"),
        F.max(done).alias("most_value"),
    )
    return per.join(middle, "grp", "left").withColumn("median_value", rounded(F.col("median"))).drop("median")


#: Numbers of a sample row that studies summarise.
SAMPLE_METRICS = ("largest_fraction", "p", "clusters_per_volume", "h2", "h2_per_volume", "h2_per_bond", "h2_endpoint_fraction_bonded", "h2_endpoint_fraction_all", "size_mean", "weighted_all", "weighted_excl_one", "weighted_excl_all_tied")
CYCLE_METRICS = ("q_h2", "q4", "q6", "c4_per_molecule", "c6_per_molecule")


def sample_rows(network: DataFrame, histogram: DataFrame, moment: DataFrame, volume: int) -> DataFrame:
    """One row a case: counts, shares and moments, not rounded, so that means of them are no ties when they are.
    p is the share of arms that are bonded. moment: with exact values."""
    rows = network.join(histogram.drop("bonds"), "case_id", "left").fillna(0, ["h1", "h2", "h3", "h4"]).join(moment.drop("largest_tie_count", "selected_largest_id"), "case_id")
    share = ratio
    return rows.select(
        *(c for c in network.columns if c != "largest_fraction"), share(F.col("largest"), F.col("molecules")).alias("largest_fraction"), "h1", "h2", "h3", "h4",
        share(F.col("bonds"), 2 * F.col("molecules")).alias("p"),
        share(F.col("clusters"), F.lit(volume)).alias("clusters_per_volume"),
        share(F.col("h2"), F.lit(volume)).alias("h2_per_volume"),
        share(F.col("h2"), F.col("bonds")).alias("h2_per_bond"),
        share(2 * F.col("h2"), F.col("bonds")).alias("h2_endpoint_fraction_bonded"),
        share(F.col("h2"), F.col("molecules")).alias("h2_endpoint_fraction_all"),
        "size_mean", "weighted_all", "weighted_excl_one", "weighted_excl_all_tied",
    )


def metric_summary(rows: DataFrame, keys: list[str], metrics: tuple[str, ...]) -> DataFrame:
    """keys, metric, n (defined values), mean, sd, se, least, most: all metrics in one pass, as rows."""
    long = rows.select(*keys, F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics))).alias("m")).select(*keys, "m.*")
    v = F.col("v")
    return long.groupBy(*keys, "metric").agg(F.count(v).cast("long").alias("n"), rounded(F.avg(v)).alias("mean"), rounded(F.stddev_samp(v)).alias("sd"), rounded(F.stddev_samp(v) / F.sqrt(F.count(v))).alias("se"), F.min(v).alias("least"), F.max(v).alias("most"))


def largest_doubles(doubles: DataFrame) -> DataFrame:
    """Per case the double bonds of the one largest cluster, and their shares."""
    one = F.col("is_largest")
    rows = doubles.groupBy("case_id").agg(F.sum("h2").cast("long").alias("h2"), F.sum(F.when(one, F.col("h2"))).cast("long").alias("h2_largest"), F.max(F.when(one, F.col("size"))).alias("largest"), F.sum("size").alias("molecules"))
    share = lambda a, b: rounded(ratio(F.col(a), F.col(b)))
    return rows.select("case_id", "h2", "h2_largest", "largest", share("h2_largest", "h2").alias("h2_share"), share("largest", "molecules").alias("largest_fraction"), share("h2_largest", "largest").alias("h2_per_molecule"))


def compare_bins(relation: DataFrame, small: int, large: int) -> DataFrame:
    """Per condition and scope that have both bins: their means, and whether the smaller sizes' is higher."""
    of = lambda high, name: relation.where(F.col("size_high") == high).select("condition", "scope", F.col("fraction_mean").alias(name))
    return of(small, "small_mean").join(of(large, "large_mean"), ["condition", "scope"]).withColumn("smaller_is_more", F.col("small_mean") > F.col("large_mean"))


def diagnose(compared: DataFrame) -> DataFrame:
    opposite = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("smaller_is_more"), F.col("condition")))), lambda c: c.cast("string")), ",")
    return compared.groupBy("scope").agg(F.count("*").cast("long").alias("eligible"), F.count_if("smaller_is_more").cast("long").alias("satisfied"), opposite.alias("opposite"))


def cycle_bins(rows: DataFrame) -> DataFrame:
    """Per case, scope and size bin: clusters, and means over them."""
    return scoped(rows).groupBy("case_id", "scope", "size_low", "size_high").agg(F.count("*").cast("long").alias("cluster_count"), *(rounded(F.avg(m)).alias(m) for m in CYCLE_METRICS))


def cycle_bin_summary(bins: DataFrame, conditions: DataFrame) -> DataFrame:
    """Across the cases of a condition: means and errors over those that have the bin; the clusters' mean is over all."""
    total = conditions.groupBy("condition").agg(F.count("*").cast("long").alias("n_total"))
    per = [x for m in CYCLE_METRICS for x in (rounded(F.avg(m)).alias(f"{m}_mean"), rounded(F.stddev_samp(m) / F.sqrt(F.count(m))).alias(f"{m}_se"))]
    rows = bins.groupBy("condition", "scope", "size_low", "size_high").agg(F.count("*").cast("long").alias("n_contributing"), F.sum("cluster_count").alias("clusters"), *per)
    return rows.join(F.broadcast(total), "condition").withColumn("cluster_count_mean", rounded(ratio(F.col("clusters"), F.col("n_total")))).drop("clusters")


def keyed(relation: DataFrame, phi: str = "target_phi") -> DataFrame:
    """relation with percent: the fraction, a decimal number as text, in whole percent; null where it is none."""
    exact = F.expr(f"try_cast({phi} AS decimal(20,10))") * 100
    return relation.withColumn("percent", F.when(exact == F.floor(exact), exact.cast("int")))


def on_grid(relation: DataFrame, rows: list[str], columns: list[str], values: dict[str, object]) -> DataFrame:
    """A row for every pair of a row key and a column key that relation has, with values (column -> what stands where
    there is no row; None for undefined). The column keys, bins or conditions, go along as an array; a repeated pair fails."""
    across = relation.select(F.struct(*columns).alias("c")).distinct().agg(F.array_sort(F.collect_list("c")).alias("across"))
    grid = relation.select(*rows).distinct().crossJoin(F.broadcast(across)).select(*rows, F.explode("across").alias("c")).select(*rows, "c.*")
    once = relation.groupBy(*rows, *columns).agg(F.count("*").alias("copies"), *(F.min(v).alias(v) for v in values))
    single = F.when(F.col("copies") > 1, F.raise_error(F.concat(F.lit("a repeated row: "), F.to_json(F.struct(*rows, *columns)))).cast("boolean")).otherwise(True)
    filled = grid.join(once.where(single).drop("copies"), [*rows, *columns], "left")
    return filled.select(*rows, *columns, *(F.col(v) if absent is None else F.coalesce(v, F.lit(absent)).alias(v) for v, absent in values.items()))
