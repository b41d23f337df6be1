"""Further registered queries: sample rows and their summaries, cycles by cluster, validators, file-like scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshwork.functions.scalars import ratio, rounded
from meshwork.jobs.queries import INPUTS, Network, halves, query, sparse
from meshwork.jobs.study_oracles import ORACLES  # noqa: F401
from meshwork.operators import constraints, graph, motifs, spatial, stats
from meshwork.sources import views
from meshwork.sources.storage import kept, table

#: Cases of a year are the samples of a condition.
YEAR = 100 * views.CASES


def with_condition(rows: DataFrame) -> DataFrame:
    return rows.withColumn("condition", F.expr(f"case_id div {YEAR}"))


def samples(net: Network) -> DataFrame:
    return stats.sample_rows(graph.network_summary(net.summary), graph.multiplicity_histogram(net.bonds), stats.moments(net.summary, lambda x: x), views.LATTICE**3)


@query
def sample_rows(spark, folder):
    rows = samples(Network(spark, folder))
    return rows.select(*(rounded(F.col(c)).alias(c) if t == "double" else c for c, t in rows.dtypes))


@query
def sample_violations(spark, folder):
    """Sample rows against what the bonds say, with faulty ones among them."""
    rows = samples(Network(spark, folder))
    k = F.expr(f"case_id div {views.CASES}")
    faulty = rows.withColumn("h1", F.when(k % 5 == 1, F.col("h1") + 1).otherwise(F.col("h1"))).withColumn("largest_fraction", F.when(k % 7 == 2, F.col("largest_fraction") + 1e-6).otherwise(F.col("largest_fraction")))
    return constraints.sample_violations(faulty)


@query
def study_summary(spark, folder):
    return stats.metric_summary(with_condition(samples(Network(spark, folder))), ["condition"], stats.SAMPLE_METRICS)


@query
def percent_summary(spark, folder):
    """Shares in percent: of arms that are bonded, of molecules in the largest cluster, of endpoints in double bonds."""
    rows = with_condition(samples(Network(spark, folder)))
    shares = rows.select("condition", (100 * ratio(2 * F.col("bonds"), 4 * F.col("molecules"))).alias("bonded"), (100 * F.col("largest_fraction")).alias("largest"), (100 * F.col("h2_endpoint_fraction_bonded")).alias("doubled"))
    return stats.metric_summary(shares, ["condition"], ("bonded", "largest", "doubled"))


@query
def largest_h2(spark, folder):
    return stats.largest_doubles(Network(spark, folder).doubles())


@query
def presence_summary(spark, folder):
    counts = with_condition(stats.presence(Network(spark, folder).doubles()))
    return stats.metric_summary(counts, ["condition", "scope", "kind", "size_low", "size_high"], ("without_h2", "with_h2", "cluster_count", "fraction_with_h2"))


def relation(spark, folder) -> DataFrame:
    """The size relation, a few rows, saved once a session."""

    def make() -> DataFrame:
        net = Network(spark, folder)
        return stats.size_relation(stats.size_bins(net.doubles()), with_condition(net.bonds.select("case_id").distinct()))

    return kept(spark, folder, INPUTS, "relation", make)


@query
def bin_comparison(spark, folder):
    return stats.compare_bins(relation(spark, folder), 2, 4)


@query
def bin_diagnostics(spark, folder):
    return stats.diagnose(stats.compare_bins(relation(spark, folder), 2, 4))


@query
def bin_plot_rows(spark, folder):
    """Bins by their geometric middle, fractions in percent."""
    return relation(spark, folder).select("condition", "scope", "size_low", "size_high", rounded(F.sqrt(F.col("size_low") * F.col("size_high"))).alias("middle"), rounded(100 * F.col("fraction_mean")).alias("percent"))


def cycle_rows(spark, folder) -> DataFrame:
    net = Network(spark, folder, views.DENSE)
    make = lambda: motifs.cluster_cycles(net.bonds, net.parts, net.doubles(), halves(spark, folder))
    return kept(spark, folder, INPUTS, "cycles", make)


@query
def cycle_clusters(spark, folder):
    return cycle_rows(spark, folder)


@query
def cycle_bins(spark, folder):
    return stats.cycle_bins(cycle_rows(spark, folder))


@query
def cycle_bin_summary(spark, folder):
    rows = cycle_rows(spark, folder)
    return stats.cycle_bin_summary(with_condition(stats.cycle_bins(rows)), with_condition(rows.select("case_id").distinct()))


@query
def cycle_totals(spark, folder):
    rows = motifs.cycle_totals(cycle_rows(spark, folder))
    return rows.withColumns({c: rounded(F.col(c)) for c in ("c4_per_100", "c6_per_100")})


@query
def cycle_summary(spark, folder):
    return stats.metric_summary(with_condition(motifs.cycle_totals(cycle_rows(spark, folder))), ["condition"], ("c4", "c6", "c4_per_100", "c6_per_100"))


@query
def cycle_violations(spark, folder):
    """Cycle rows that can't be, with faulty ones among them."""
    rows = cycle_rows(spark, folder)
    return constraints.cycle_violations(rows.withColumn("c4_mol", F.when(F.col("cluster_id") % 2 == 0, F.col("c4_edge") + 1).otherwise(F.col("c4_mol"))))


@query
def graph_violations(spark, folder):
    """Faulty bonds against the clusters of the bonds without faults."""
    return constraints.graph_violations(views.faulty(sparse(spark, folder)), Network(spark, folder).parts)


@query
def candidate_violations(spark, folder):
    """Candidates, with some repeated and some turned round."""
    rows = spatial.candidates(views.sites(spark, folder), views.LATTICE, ("case_id",))
    # Copies are told from the row: a union would work the candidates out again for each of its parts.
    copies = rows.withColumn("copy", F.explode(F.array(*map(F.lit, range(3))))).where("copy = 0 or copy = 1 and endpoint_a % 41 = 3 or copy = 2 and endpoint_a % 37 = 5")
    end = lambda x, y: F.when(F.col("copy") == 2, F.col(y)).otherwise(F.col(x))
    return constraints.candidate_violations(copies.select("case_id", end("endpoint_a", "endpoint_b").alias("endpoint_a"), end("endpoint_b", "endpoint_a").alias("endpoint_b")))


@query
def trajectory_violations(spark, folder):
    """Lines of an order as steps on the lattice: order of numbers, sites left and found again, jumps, kinds."""
    n = views.LATTICE
    steps = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("molecule"), F.col("l_linenumber").cast("long").alias("step"), *((F.col(c) % n).cast("long").alias(x) for c, x in (("l_partkey", "x"), ("l_suppkey", "y"), ("l_orderkey", "z"))), F.col("l_returnflag").alias("type"))
    return constraints.trajectory_violations(steps, ["molecule"])


@query
def candidate_rows(spark, folder):
    """Candidates with what is known of both ends."""
    sites = views.sites(spark, folder)
    return spatial.attached(spatial.candidates(sites, views.LATTICE, ("case_id",)), sites, ["case_id"])


@query
def occupied_sites(spark, folder):
    return spatial.occupation(views.sites(spark, folder))


@query
def component_order(spark, folder):
    """The five first components of a case, by size and then smallest molecule."""
    place = F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("molecule_count"), "root"))
    return Network(spark, folder).summary.withColumn("place", place.cast("long")).where("place <= 5").select("case_id", "place", "root", "molecule_count")


@query
def first_cases(spark, folder):
    """Of every year the first two cases, with their bonds."""
    per = with_condition(sparse(spark, folder)).groupBy("condition", "case_id").agg(F.count("*").cast("long").alias("bonds"))
    return per.withColumn("k", F.row_number().over(Window.partitionBy("condition").orderBy("case_id"))).where("k <= 2").drop("k")


@query
def over_the_cap(spark, folder):
    """Cases with more bonds than a viewer takes: rows, not a silent cut."""
    return sparse(spark, folder).groupBy("case_id").agg(F.count("*").cast("long").alias("bonds")).where("bonds > 60")


@query
def tolerant_selection(spark, folder):
    return views.samples(spark, folder).where(F.abs(ratio(F.col("h"), F.col("n")) - 0.5) < 1e-9).select("sample", "n", "h")


@query
def subset_check(spark, folder):
    """Regions in which a segment has no sample although another segment has one."""
    rows = views.samples(spark, folder).where("h >= 2 * (n - h)").select("segment", "region").distinct()
    every = rows.select("region").distinct().join(F.broadcast(rows.select("segment").distinct()), how="cross")
    return every.join(rows, ["segment", "region"], "left_anti").select("segment", "region")


@query
def safe_names(spark, folder):
    """Last parts of paths, and whether they are safe as file names."""
    name = F.regexp_extract(F.regexp_replace("url", "[?#].*$", ""), "([^/]*)$", 1)
    return table(spark, folder, "pages").select("page_id", name.alias("name"), name.rlike("^[A-Za-z0-9][A-Za-z0-9._-]*$").alias("safe"))


@query
def file_digests(spark, folder):
    return table(spark, folder, "pages").select("page_id", F.sha2(F.coalesce("html", F.lit("")), 256).alias("sha256"), F.octet_length(F.coalesce("html", F.lit(""))).cast("long").alias("bytes"))


@query
def stale_entries(spark, folder):
    """Results kept under the digests of code and input: what holds, and what has to be made again."""
    now = file_digests(spark, folder).select("page_id", F.sha2(F.concat_ws(":", F.lit("v2"), "sha256"), 256).alias("key"))
    kept = file_digests(spark, folder).where("page_id % 3 <> 0").select("page_id", F.sha2(F.concat_ws(":", F.when(F.col("page_id") % 5 == 0, "v1").otherwise("v2"), "sha256"), 256).alias("held"))
    return now.join(kept, "page_id", "left").select("page_id", F.when(F.col("held").isNull(), "missing").when(F.col("held") != F.col("key"), "stale").otherwise("kept").alias("state"))


@query
def folder_bytes(spark, folder):
    """Per host the pages and their bytes: total, mean, most."""
    rows = table(spark, folder, "pages").select(F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"), F.octet_length(F.coalesce("html", F.lit(""))).cast("long").alias("bytes"))
    return rows.groupBy("host").agg(F.count("*").cast("long").alias("files"), F.sum("bytes").cast("long").alias("total"), rounded(F.avg("bytes")).alias("mean"), F.max("bytes").alias("most"))


@query
def token_lines(spark, folder):
    """key=value tokens of log lines, parsed again."""
    line = F.concat_ws(" ", F.concat(F.lit("event="), "event_id"), F.concat(F.lit("kind="), "event_type"), F.concat(F.lit("user="), "user_id"))
    parsed = table(spark, folder, "events").select(F.str_to_map(line, F.lit(" "), F.lit("=")).alias("m"))
    return parsed.select(F.col("m")["event"].cast("long").alias("event_id"), F.col("m")["kind"].alias("kind"), F.col("m")["user"].cast("long").alias("user_id"))


@query
def manifest_status(spark, folder):
    """Documents in a column, by a value in them and the kind of row."""
    rows = table(spark, folder, "events").select("event_type", F.from_json("props", "k long")["k"].alias("k"))
    return rows.groupBy("event_type", F.expr("k div 10").alias("level")).agg(F.count("*").cast("long").alias("rows"), F.count("k").cast("long").alias("known"))


@query
def best_export(spark, folder):
    """Per customer the finished order with the most lines, the latest of these."""
    lines = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.count("*").cast("long").alias("lines"))
    done = table(spark, folder, "orders").where("o_orderstatus = 'F'").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return done.groupBy(F.col("o_custkey").alias("customer")).agg(F.max_by(F.struct("o_orderkey", "lines"), F.struct("lines", "o_orderkey")).alias("b")).select("customer", F.col("b.o_orderkey").alias("run"), F.col("b.lines").alias("lines"))


@query
def single_rows(spark, folder):
    """Orders that do not have exactly one line, by the number they have."""
    lines = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").cast("long").alias("lines"))
    rows = table(spark, folder, "orders").join(lines, "o_orderkey", "left").select(F.coalesce("lines", F.lit(0)).cast("long").alias("lines"))
    return rows.where("lines <> 1").groupBy("lines").agg(F.count("*").cast("long").alias("orders"))


@query
def complete_folders(spark, folder):
    """Suppliers that all parts sizes of theirs come with: runs that hold every case they should."""
    have = table(spark, folder, "lineitem").join(table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("l_suppkey").agg(F.count_distinct("p_size").cast("long").alias("sizes"))
    want = table(spark, folder, "part").agg(F.count_distinct("p_size").cast("long").alias("all_sizes"))
    return have.join(F.broadcast(want), F.col("sizes") == F.col("all_sizes")).select(F.col("l_suppkey").alias("supplier"), "sizes")


@query
def cluster_json(spark, folder):
    """Clusters with bonds of each case written as JSON, read again and counted."""
    rows = Network(spark, folder).doubles().where("bonds > 0").groupBy("case_id").agg(F.to_json(F.collect_list(F.struct("cluster_id", "size", "h2"))).alias("doc"))
    read = rows.select("case_id", F.explode(F.from_json("doc", "array<struct<cluster_id:long,size:long,h2:long>>")).alias("c"))
    return read.groupBy("case_id").agg(F.count("*").cast("long").alias("clusters"), F.sum("c.size").cast("long").alias("molecules"), F.sum("c.h2").cast("long").alias("h2"))


@query
def memory_estimate(spark, folder):
    """Per part a lattice of its size: the molecules it takes, bytes, and placement attempts allowed."""
    volume = F.pow((8 * F.col("p_size")).cast("double"), 3).cast("long")
    rows = table(spark, folder, "part").select("p_partkey", volume.alias("volume"))
    rows = rows.withColumn("molecules", F.expr("volume div 10 div 21"))
    return rows.select(F.col("p_partkey").alias("part"), "molecules", (12 * F.col("volume") + F.col("molecules") * (16 + 36 * 5)).alias("bytes"), F.greatest(F.lit(1000).cast("long"), 100 * F.col("molecules")).alias("attempts"))
