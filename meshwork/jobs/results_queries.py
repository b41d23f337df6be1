"""Queries over results as they are kept: caches, compact documents, groups of a study, resumed runs, relations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwork.jobs import study
from meshwork.jobs.integrity_queries import UNBOUNDED
from meshwork.jobs.queries import INPUTS, Network, query
from meshwork.jobs.results_oracles import ORACLES  # noqa: F401
from meshwork.jobs.study_queries import relation, samples, with_condition
from meshwork.operators import constraints, spatial, stats, trajectories
from meshwork.sources import caches, compact, files, views
from meshwork.sources.storage import kept, saved, shared_folder, table

FORMAT = "molecules-1"


def cache(spark, folder) -> DataFrame:
    """The clusters of each case as a cache of lines with faults that follow from case and chunk, written and read."""

    def make() -> DataFrame:
        rows = caches.lines(Network(spark, folder).doubles())
        k = F.expr(f"case_id div {views.CASES}") % 7
        here = lambda rest, chunk: (k == rest) & (F.col("chunk") == chunk)
        more = lambda at, name: F.when(at, F.col("totals").withField(name, F.col(f"totals.{name}") + 1)).otherwise(F.col("totals"))
        rows = rows.withColumn("version", F.when(here(2, 1), "cycle46-v0").otherwise(F.col("version"))).withColumn("items", F.when(here(4, 1), F.concat("items", F.slice("items", 1, 1))).otherwise(F.col("items")))
        rows = rows.withColumn("totals", more(here(3, 0), "molecules")).withColumn("totals", more(here(6, -1), "bonds"))
        line = caches.text()
        line = F.when(here(1, 0), F.expr("substring(line, 1, length(line) - 5)")).when(here(5, 0), F.regexp_replace("line", '"h2":', '"h2":true,"was":')).otherwise(F.col("line"))
        return rows.withColumn("line", caches.text()).select(line.alias("value"))

    path = shared_folder(spark, "cache")
    kept(spark, folder, INPUTS, "cache", make).write.option("compression", "gzip").text(path)
    return caches.read(spark, path)


@query
def cache_quarantine(spark, folder):
    """Lines of the cache that can't be used, and why."""
    return caches.scan(cache(spark, folder))[1].select("case_id", "chunk", "reason")


@query
def cache_totals(spark, folder):
    """Cases of the cache: sums over the chunks that can be used, and what of the sample row they are not."""
    return caches.reconciled(caches.scan(cache(spark, folder))[0])


def documents(spark, folder) -> compact.Documents:
    """A compact document for each group of orders, with faults that follow from its number."""
    number = F.col("molecule") % views.GROUP

    def make() -> DataFrame:
        steps = views.trajectories(spark, folder).withColumn("molecule", number)
        points = trajectories.ends(steps).repartition("case_id")
        found = spatial.candidates(points, UNBOUNDED, ("case_id",)).select("case_id", F.expr("endpoint_a div 4").alias("molecule_a"), F.expr("endpoint_b div 4").alias("molecule_b"), (F.col("endpoint_a") % 4).alias("arm_a"), (F.col("endpoint_b") % 4).alias("arm_b"))
        docs = compact.written(steps, found, FORMAT)
        k, v = F.col("case_id") % 11, F.col("value")
        other = {3: (r"\]\}$", ""), 4: (r'"molecules":\[', '"molecules":[[7,"X",1],'), 5: (r'"bonds":\[\[(\d+),\d+,', '"bonds":[[$1,9999999,'), 6: (r'"bonds":\[(\[[^\]]*\])', '"bonds":[$1,$1'), 7: ('"molecules-1"', '"molecules-0"')}
        faulty = v
        for rest, (pattern, text) in other.items():
            faulty = F.when(k == rest, F.regexp_replace(v, pattern, text)).otherwise(faulty)
        return docs.select("case_id", faulty.alias("value"))

    return compact.Documents(kept(spark, folder, ("orders",), "documents", make), FORMAT)


@query
def compact_faults(spark, folder):
    return documents(spark, folder).faults


@query
def compact_summary(spark, folder):
    """Documents without faults: counts, and components worked out anew from their bonds."""
    return documents(spark, folder).summary()


def grouped(spark, folder) -> tuple[dict[str, DataFrame], DataFrame]:
    """Orders as runs of three groups by status; a condition is a customer and a priority. Planned: each customer of
    a segment other than BUILDING in the group of its nation's rest by three."""
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("run"), F.col("o_custkey").alias("customer"), F.col("o_orderpriority").alias("priority"), "o_orderstatus")
    groups = {g: orders.where(F.col("o_orderstatus") == g).drop("o_orderstatus") for g in "FOP"}
    priorities = orders.select("priority").distinct().agg(F.array_sort(F.collect_list("priority")).alias("p"))
    customers = table(spark, folder, "customer").where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("customer"), F.element_at(F.array(*map(F.lit, "FOP")), (F.col("c_nationkey") % 3 + 1).cast("int")).alias("group"))
    return groups, customers.crossJoin(F.broadcast(priorities)).select("group", "customer", F.explode("p").alias("priority"))


@query
def group_clashes(spark, folder):
    """Conditions that keep three groups of runs from being one study."""
    groups, planned = grouped(spark, folder)
    return study.clashes(study.united(groups), planned, ["customer", "priority"])


@query
def group_results(spark, folder):
    """Groups without a clash, written through the gate and read again."""
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("run"), F.col("o_orderkey").alias("condition"), "o_orderstatus", "o_totalprice")
    groups = {g: orders.where(F.col("o_orderstatus") == g) for g in "FOP"}
    path = shared_folder(spark, "combined")
    study.combine(groups, orders.select(F.col("o_orderstatus").alias("group"), "condition"), ["condition"], path)
    return spark.read.parquet(path).select("group", "run", "condition", "o_totalprice")


@query
def key_union(spark, folder):
    """Events as rows of different columns, written with the union of these, and read again as text."""
    k = F.from_json("props", "k long")["k"].cast("string")
    text = lambda c: F.col(c).cast("string")
    cells = F.map_concat(
        F.create_map(F.lit("event"), text("event_id")),
        F.when(F.col("user_id") % 2 == 0, F.create_map(F.lit("user"), text("user_id"))).otherwise(F.create_map(F.lit("odd user"), text("user_id"))),
        F.when(k.isNull(), F.expr("cast(map() as map<string,string>)")).otherwise(F.create_map(F.concat(F.col("event_type"), F.lit("_k")), k)),
    )
    path = shared_folder(spark, "union")
    files.export_union(table(spark, folder, "events").select("event_id", cells.alias("cells")), "cells", ["event_id"], path)
    return spark.read.option("header", True).csv(path)


@query
def resume_verified(spark, folder):
    """Months of orders as results on disk: noted with their digests, then some written anew, removed or added to;
    read and digested again, each is kept or to do."""
    month = (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("long")
    rows = table(spark, folder, "orders").select(month.alias("month"), "o_orderkey", "o_totalprice")
    results, manifest = shared_folder(spark, "results"), shared_folder(spark, "manifest")
    write = lambda r, mode: r.repartition("month").write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(results)
    write(rows.where("month % 7 <> 2"), "errorifexists")
    study.note(spark, results, "month", manifest, "v1")
    write(rows.where("month % 5 = 3 and month % 7 <> 2").withColumn("o_totalprice", F.col("o_totalprice") + 1), "overwrite")
    write(rows.where("month % 11 = 4 and month % 7 <> 2"), "append")
    found = saved(study.states(spark, results, "month", manifest, "v1"), "states")
    planned = rows.select("month").distinct()
    left = study.to_do(planned, found, "month").withColumn("again", F.lit(True))
    state = found.select(F.col("month").cast("long").alias("month"), "state")
    return planned.join(state, "month", "left").join(left, "month", "left").select("month", F.coalesce("state", F.lit("absent")).alias("state"), F.coalesce("again", F.lit(False)).alias("again"))


@query
def relation_grid(spark, folder):
    """The size relation for every condition and bin, with no samples where a condition lacks a bin."""
    rows = relation(spark, folder).where("scope = 'exclude_one_largest'")
    return stats.on_grid(rows, ["condition"], ["size_low", "size_high"], {"fraction_n": 0, "fraction_mean": None})


@query
def relation_layout(spark, folder):
    """The size relation with fractions as text, against the layout that a figure expects; with planted faults."""
    k = F.col("condition")
    rows = relation(spark, folder).select(F.lit(24).alias("size"), F.when(k % 5 == 1, F.format_string("0.%02d5", k % 100)).otherwise(F.format_string("0.%02d", k % 100)).alias("target_phi"), "scope", "size_low", "size_high", F.when((k % 3 == 0) & (F.col("size_low") == 2), F.col("total_samples") + 1).otherwise(F.col("samples_with_bin")).alias("n"), F.col("total_samples").alias("total"), (k % 4 == 1).alias("twice"))
    rows = rows.unionByName(rows.where("twice")).drop("twice")
    return constraints.layout_faults(stats.keyed(rows), [24], list(range(93, 100)))


@query
def condition_alignment(spark, folder):
    """Conditions that either the relation or the summary of the same study lacks, where some are left out of each."""
    rows = with_condition(samples(Network(spark, folder))).select("condition").distinct()
    return constraints.coverage(rows.where("condition % 4 <> 1"), rows.where("condition % 3 <> 0"), ["condition"])


@query
def replicate_check(spark, folder):
    """Segments and nations with other than twelve customers."""
    rows = table(spark, folder, "customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").cast("long").alias("nation"))
    return constraints.replicates(rows, ["segment", "nation"], 12)


@query
def moment_violations(spark, folder):
    """Sample rows against moments worked out anew from the histogram of cluster sizes, with faulty ones among them."""
    net = Network(spark, folder)
    rows = samples(net)
    k = F.expr(f"case_id div {views.CASES}")
    faulty = rows.withColumns({
        "weighted_all": F.when(k % 5 == 1, F.col("weighted_all") * (1 + 1e-6)).otherwise(F.col("weighted_all")),
        "weighted_excl_all_tied": F.when(k % 7 == 2, F.lit(None)).otherwise(F.col("weighted_excl_all_tied")),
        "clusters": F.when(k % 11 == 3, F.col("clusters") + 1).otherwise(F.col("clusters")),
    })
    return constraints.moment_faults(faulty, stats.size_histogram(net.summary))
