"""The registered queries: each operator over a view of the driver's tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork.functions.scalars import derived_seed, near, ratio, rounded
from meshwork.jobs.oracles import ORACLES
from meshwork.operators import constraints, cores, graph, kernels, motifs, spatial, stats
from meshwork.operators.numbering import numbered, with_group
from meshwork.sources import views
from meshwork.sources.storage import buckets, joins_by_hints, kept, saved, table

#: Tables that networks are made of.
INPUTS = ("lineitem", "orders")
REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]):
    @wraps(f)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        joins_by_hints(spark)
        return f(spark, folder)

    REGISTRY[f.__name__] = run
    return run


def bonds(spark: SparkSession, folder: str, keys: int | None) -> DataFrame:
    """A view's bonds, saved once a session."""
    make = (lambda: views.bonds(spark, folder, keys, buckets(spark, folder, INPUTS))) if keys else (lambda: views.giant(spark, folder))
    return kept(spark, folder, INPUTS, f"bonds-{keys}", make, "case_id" if keys else None)


def dense(spark: SparkSession, folder: str) -> DataFrame:
    return bonds(spark, folder, views.DENSE)


def sparse(spark: SparkSession, folder: str) -> DataFrame:
    return bonds(spark, folder, views.SPARSE)


def halves(spark: SparkSession, folder: str) -> DataFrame:
    """Three-bond paths of the dense view, of which cycles are made."""
    return kept(spark, folder, INPUTS, "halves", lambda: motifs.halves(dense(spark, folder)), "case_id")


class Network:
    """The bonds of all cases and what is derived from them."""

    def __init__(self, spark: SparkSession, folder: str, keys: int | None = views.SPARSE):
        """keys: of a side of a case; None for the view with one giant case. What is worked out here serves all
        queries of a session, as long as the tables stay as they are."""
        self.bonds = bonds(spark, folder, keys)
        # Cases are small but for the giant one, so what is kept is dealt out by case and then joined where it is.
        self.small, self.dealt = bool(keys), ("case_id", buckets(spark, folder, INPUTS)) if keys else (None, None)
        once = lambda name, make: kept(spark, folder, INPUTS, f"{name}-{keys}", make, self.dealt[0])
        molecules = lambda: views.molecules(self.bonds, keys) if keys else views.bonded(self.bonds)
        self.parts = once("members", lambda: graph.members(self.bonds, molecules(), self.dealt[1]))
        self.summary = once("clusters", lambda: graph.with_largest(graph.clusters(self.bonds, self.parts, self.small), self.small))

    def members(self) -> DataFrame:
        return graph.cluster_members(self.parts, self.summary, graph.degrees(self.bonds, self.parts.select("case_id", "molecule")))

    def doubles(self) -> DataFrame:
        """Clusters with h2, marked by is_largest."""
        rows = graph.cluster_doubles(self.bonds, self.parts, self.summary)
        return rows.join(self.summary.select("case_id", "cluster_id", "is_largest"), ["case_id", "cluster_id"])


@query
def pair_multiplicity(spark, folder):
    return graph.pairs(dense(spark, folder))


@query
def multiplicity_hist(spark, folder):
    return graph.multiplicity_histogram(dense(spark, folder))


@query
def h2_fractions(spark, folder):
    rows = dense(spark, folder)
    return graph.double_bond_shares(rows, views.molecules(rows, views.DENSE), views.LATTICE**3)


@query
def molecule_degree(spark, folder):
    rows = sparse(spark, folder)
    return graph.degrees(rows, views.molecules(rows, views.SPARSE))


@query
def isolated_count(spark, folder):
    return molecule_degree(spark, folder).groupBy("case_id").agg(F.count_if(F.col("bond_degree") == 0).cast("long").alias("isolated"))


@query
def components_members(spark, folder):
    return Network(spark, folder).members()


@query
def components_summary(spark, folder):
    return Network(spark, folder).summary.select("case_id", "cluster_id", "molecule_count", "bond_count")


@query
def network_summary(spark, folder):
    return graph.network_summary(Network(spark, folder).summary)


@query
def largest_members(spark, folder):
    net = Network(spark, folder)
    largest = net.summary.where("is_largest").select("case_id", "cluster_id")
    return net.members().join(largest, ["case_id", "cluster_id"], "left_semi")


@query
def largest_edges(spark, folder):
    net = Network(spark, folder)
    largest = net.summary.where("is_largest").select("case_id", "root", "cluster_id")
    inside = net.parts.join(largest, ["case_id", "root"]).select("case_id", F.col("molecule").alias("molecule_a"), "cluster_id")
    return net.bonds.join(inside, ["case_id", "molecule_a"]).select("case_id", "bond_id", "molecule_a", "molecule_b", "endpoint_a", "endpoint_b", "cluster_id")


@query
def tied_largest(spark, folder):
    return Network(spark, folder).summary.where("tied").select("case_id", "cluster_id", "molecule_count")


@query
def cluster_moments(spark, folder):
    return stats.moments(Network(spark, folder).summary)


@query
def cluster_histogram(spark, folder):
    return stats.size_histogram(Network(spark, folder).summary)


@query
def cluster_h2(spark, folder):
    return Network(spark, folder).doubles().drop("is_largest", "root")


@query
def size_bins(spark, folder):
    return stats.size_bins(Network(spark, folder).doubles())


@query
def size_relation(spark, folder):
    net = Network(spark, folder)
    conditions = net.bonds.select("case_id").distinct().withColumn("condition", F.expr(f"case_id div {100 * views.CASES}"))
    return stats.size_relation(stats.size_bins(net.doubles()), conditions)


@query
def presence_counts(spark, folder):
    return stats.presence(Network(spark, folder).doubles())


@query
def cycles4(spark, folder):
    return motifs.cycle_counts(dense(spark, folder), 4, halves(spark, folder)).select("case_id", "cycles")


@query
def cycles6(spark, folder):
    return motifs.cycle_counts(dense(spark, folder), 6, halves(spark, folder)).select("case_id", "cycles")


@query
def cycles_edge_multiplicity(spark, folder):
    rows = dense(spark, folder)
    four, six = (motifs.cycle_counts(rows, n, halves(spark, folder)).select("case_id", F.col("edge_cycles").alias(f"c{n}_edge")) for n in (4, 6))
    return four.join(six, "case_id")


@query
def cycle_endpoint_share(spark, folder):
    return motifs.participating(dense(spark, folder), 4, halves(spark, folder))


@query
def two_core(spark, folder):
    return cores.two_core(sparse(spark, folder))


@query
def stencil_candidates(spark, folder):
    return spatial.candidates(views.sites(spark, folder), views.LATTICE, ("case_id",))


@query
def stencil_stats(spark, folder):
    return spatial.search_effort(views.sites(spark, folder), views.LATTICE, ("case_id",))


@query
def endpoint_decode(spark, folder):
    return views.sites(spark, folder).select("case_id", "endpoint", F.expr("endpoint div 4").alias("molecule"), F.pmod("endpoint", F.lit(4)).cast("long").alias("arm"))


@query
def site_coord_roundtrip(spark, folder):
    n = views.LATTICE
    rows = views.sites(spark, folder).select("case_id", "site", F.expr(f"site div {n * n}").alias("x"), F.expr(f"site div {n} % {n}").alias("y"), F.expr(f"site % {n}").cast("long").alias("z"))
    return rows.withColumn("again", (F.col("x") * n + F.col("y")) * n + F.col("z"))


def small_cases(spark, folder) -> DataFrame:
    """One small network per supplier, seeded by its key."""
    key = F.col("s_suppkey")
    return table(spark, folder, "supplier").select(key.alias("case_id"), F.lit(8).alias("size"), key.cast("decimal(20,0)").alias("seed"), F.lit("0.15").alias("phi"), F.lit(3).alias("arm_length"), F.lit(0.5).alias("p_a"))


@query
def placement_sample(spark, folder):
    return kernels.place(small_cases(spark, folder)).select("case_id", "target", "placed", "attempts", "center_occupied", "trapped", "completed", F.size("endpoints").alias("endpoints"))


@query
def greedy_matching(spark, folder):
    return kernels.bond(saved(kernels.place(small_cases(spark, folder)), "placed"), 8)


@query
def condition_summary(spark, folder):
    return stats.condition_summary(views.samples(spark, folder))


@query
def mean_of_ratios_vs_pooled(spark, folder):
    return stats.mean_and_pooled(views.samples(spark, folder))


@query
def null_safe_ratio(spark, folder):
    """Orders per finished order: undefined, not zero, where none is finished."""
    return views.samples(spark, folder).select("sample", rounded(ratio(F.col("n"), F.col("h"))).alias("ratio"))


@query
def convergence_prefix(spark, folder):
    return stats.convergence(views.samples(spark, folder), ratio(F.col("n"), F.col("h")), ["sample"])


@query
def prefix_at_peak(spark, folder):
    """As convergence, at each segment's peak, with samples in the order of their number as text."""
    rows = views.samples(spark, folder)
    peak = stats.peaks(stats.condition_summary(rows)).select("segment", F.col("peak_region").alias("region"))
    return stats.convergence(rows.join(F.broadcast(peak), ["segment", "region"]), ratio(F.col("h"), F.col("n")), [F.col("sample").cast("string")])


@query
def peak_by_group(spark, folder):
    return stats.peaks(stats.condition_summary(views.samples(spark, folder)))


@query
def threshold_selection(spark, folder):
    return stats.thresholds(stats.condition_summary(views.samples(spark, folder)), 0.34, 0.33)


@query
def nearest_condition(spark, folder):
    return stats.nearest(stats.condition_summary(views.samples(spark, folder)), 0.33)


@query
def resource_summary(spark, folder):
    return stats.resources(table(spark, folder, "orders").select(F.col("o_orderpriority").alias("grp"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("value")))


@query
def bond_violations(spark, folder):
    return constraints.bond_violations(views.faulty(sparse(spark, folder)))


@query
def coverage_check(spark, folder):
    """Conditions of customers that no sample has, and the other way round."""
    customers = table(spark, folder, "customer").join(F.broadcast(table(spark, folder, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    expected = customers.select(F.col("c_mktsegment").alias("segment"), F.col("n_nationkey").cast("long").alias("nation"))
    orders = table(spark, folder, "orders").where("o_orderstatus = 'P'").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return constraints.coverage(orders.select(F.col("c_mktsegment").alias("segment"), F.col("n_nationkey").cast("long").alias("nation")), expected, ["segment", "nation"])


@query
def duplicate_check(spark, folder):
    return constraints.duplicates(table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


@query
def reconciliation(spark, folder):
    """Orders whose status is not what their lines say, or that have no lines."""
    lines = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.when(F.count_if(F.col("l_linestatus") == "O") == 0, "F").when(F.count_if(F.col("l_linestatus") == "F") == 0, "O").otherwise("P").alias("status"))
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"))
    return constraints.mismatches(orders, lines, ["key"], ["status"])


@query
def value_reconciliation(spark, folder):
    """Orders whose price is within tolerance of the sum over their lines, by day."""
    lines = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("lines"))
    rows = table(spark, folder, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count_if(near(F.col("o_totalprice"), F.col("lines"), 0.25, 1.0)).cast("long").alias("near"), F.count("*").cast("long").alias("orders"))


@query
def grid_plan(spark, folder):
    """Sizes of the parts by fractions of the customers by replicates; the sizes, at most fifty, go along as an array."""
    sizes = table(spark, folder, "part").agg(F.array_sort(F.collect_set((8 * F.col("p_size")).cast("long"))).alias("sizes"))
    phis = table(spark, folder, "customer").select(F.format_string("0.%04d", F.col("c_custkey")).alias("phi")).distinct()
    plan = phis.join(F.broadcast(sizes)).withColumn("size", F.explode("sizes")).withColumn("index", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))))
    return plan.select("size", "phi", "index", F.concat(F.lit("L"), F.col("size"), F.lit("_phi"), F.col("phi"), F.lit("_i"), F.lpad(F.col("index").cast("string"), 6, "0")).alias("case_id"))


@query
def derived_seeds(spark, folder):
    return grid_plan(spark, folder).select("case_id", derived_seed("study", F.col("size"), F.col("phi"), F.col("index")).cast("string").alias("seed"))


@query
def resume_antijoin(spark, folder):
    """Planned customers without a finished order."""
    done = table(spark, folder, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, folder, "customer").select("c_custkey").join(done, "c_custkey", "left_anti")


@query
def group_union(spark, folder):
    """Two groups of runs under prefixed names, and how often a key is in both."""
    orders = table(spark, folder, "orders")
    part = lambda status: orders.where(F.col("o_orderstatus") == status).select(F.concat(F.lit(f"{status}_"), F.col("o_orderkey")).alias("run"), F.col("o_custkey").alias("key"))
    both = part("F").unionByName(part("O"))
    return both.groupBy("key").agg(F.count("*").cast("long").alias("runs"), F.min("run").alias("first_run"), F.countDistinct(F.substring("run", 1, 1)).cast("long").alias("groups"))


@query
def trajectory_step_check(spark, folder):
    """Per user the events whose id does not follow the one before by time."""
    rows = numbered(table(spark, folder, "events").select("user_id", "ts", "event_id"), ["user_id"], ["ts", "event_id"])
    before = rows.select("user_id", (F.col("place") + 1).alias("place"), F.col("event_id").alias("before"))
    met = rows.join(before, ["user_id", "place"], "left")
    return met.groupBy("user_id").agg(F.count_if(F.col("event_id") <= F.col("before")).cast("long").alias("backward"), F.count_if(F.col("event_id") == F.col("before") + 1).cast("long").alias("unit_steps"), F.count("*").cast("long").alias("steps"))


@query
def nest_arms(spark, folder):
    """Per user and kind the event ids in order of time, nested and joined again."""
    rows = table(spark, folder, "events").groupBy("user_id", "event_type").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id"))).alias("arm"))
    return rows.select("user_id", "event_type", F.size("arm").cast("long").alias("length"), F.array_join(F.transform("arm", lambda e: e["event_id"].cast("string")), ",").alias("ids"))


@query
def stride_thinning(spark, folder):
    """Every so manyth customer of each nation, such that at most ten of one are shown."""
    placed = numbered(table(spark, folder, "customer").select("c_custkey", "c_nationkey"), ["c_nationkey"], ["c_custkey"], "k")
    sizes = placed.groupBy("c_nationkey").agg(F.count("*").alias("n"), F.ceil(F.count("*") / 10).alias("stride"))
    rows = with_group(placed, sizes, ["c_nationkey"], "n")
    return rows.where(F.col("k") % F.col("stride") == 0).select("c_custkey", F.col("c_nationkey").cast("long").alias("nation"))


from meshwork.jobs import integrity_queries, results_queries, study_queries  # noqa: E402  (register further queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(REGISTRY)


def oracle_sql() -> dict[str, str]:
    return ORACLES | study_queries.ORACLES | integrity_queries.ORACLES | results_queries.ORACLES
