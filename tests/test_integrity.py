"""Validators, numbering, two-core, caches, gate and resume, on small tables with known faults."""

import os
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from meshwork.jobs import study
from meshwork.operators import constraints, cores, graph, numbering, partitions, stats, trajectories
from meshwork.sources import caches, compact, files, storage


def uri(path):
    return "file://" + os.fspath(path)


@pytest.mark.parametrize("partitions_", [1, 7])
def test_numbers_equal_a_window(spark, partitions_):
    rng = random.Random(3)
    rows = [(rng.choice((1, 1, 1, 1, 2, None)), rng.choice(("a", None, "b")), k, float(k)) for k in range(3000)]
    df = spark.createDataFrame(rows, "case_id long, kind string, k long, v double").repartition(partitions_)
    got = numbering.numbered(df, ["case_id", "kind"], ["k"])
    groups = defaultdict(list)
    for case, kind, k, _ in rows:
        groups[case, kind].append(k)
    want = {(case, kind, k): place for (case, kind), ks in groups.items() for place, k in enumerate(sorted(ks))}
    assert {(r.case_id, r.kind, r.k): r.place for r in got.collect()} == want and got.columns == [*df.columns, "place"]
    assert numbering.numbered(df.where("false"), ["case_id"], ["k"]).count() == 0


def test_large_groups_meet_by_broadcast(spark):
    rows = spark.range(5000).select(F.when(F.col("id") < 3000, -1).otherwise(F.col("id")).alias("g"), "id")
    groups = rows.groupBy("g").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    got = numbering.with_group(rows, groups, ["g"], "n")
    assert got.count() == 5000 and got.where("g = -1 and top = 2999").count() == 3000 and got.where("g <> -1 and top = id").count() == 2000


def test_one_case_of_a_million_clusters(spark):
    n = 1_000_000
    molecules = spark.range(n).select(F.lit(5).cast("long").alias("case_id"), F.col("id").alias("molecule"))
    bonds = spark.range(0, 3000, 3).select(F.lit(5).cast("long").alias("case_id"), F.col("id").alias("bond_id"), (F.col("id") * 300).alias("molecule_a"), (F.col("id") * 300 + 1).alias("molecule_b"))
    parts = storage.saved(graph.members(bonds, molecules), "members")
    summary = graph.with_largest(graph.clusters(bonds, parts))
    got = summary.agg(F.count("*"), F.max("cluster_id"), F.count_distinct("cluster_id"), F.count_if("is_largest"), F.count_if("tied"), F.count_if(F.col("root") < F.col("cluster_id"))).first()
    assert tuple(got) == (n - 1000, n - 1001, n - 1000, 1, 1000, 0)
    assert summary.where("is_largest").first().cluster_id == 0


def peeled(edges):
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    leaves = [a for a in near if len(near[a]) < 2]
    while leaves:
        a = leaves.pop()
        for b in near.pop(a, ()):
            near[b].discard(a)
            if len(near[b]) == 1:
                leaves.append(b)
            if not near[b]:
                near[b] = set()
    return {(min(a, b), max(a, b)) for a in near for b in near[a]}


def test_molecules_of_any_number(spark, monkeypatch):
    big = (1 << 24) + 5
    ring = lambda case, at: [(case, at, at + 1), (case, at + 1, at + 2), (case, at + 2, at)]
    rows = ring(3, 0) + ring(3, big) + ring(4, big - (1 << 24)) + ring(1 << 41, 7) + [(3, big, 9), (4, big, 1 << 30), (4, 5, 6)]
    bonds = spark.createDataFrame(rows, "case_id long, molecule_a long, molecule_b long")
    want = {(3, 0, 0), (3, 1, 0), (3, 2, 0), (3, 9, 9), *((3, big + k, 9) for k in range(3)), (4, 5, 5), (4, 6, 5), (4, 7, 5), (4, big, big), (4, 1 << 30, big), *((1 << 41, k, 7) for k in (7, 8, 9))}
    ends = bonds.select("case_id", F.explode(F.array("molecule_a", "molecule_b")).alias("molecule")).distinct()
    for large in (graph.EDGES_AT_ONCE, 4, 0):  # cases of a task, cases of several, both
        monkeypatch.setattr(graph, "EDGES_AT_ONCE", large)
        assert {tuple(r) for r in graph.members(bonds, ends).collect()} == want
    core = {(c, min(a, b), max(a, b)) for c, a, b in rows if (c, a, b) not in ((3, big, 9), (4, big, 1 << 30))}
    assert {(r.case_id, r.molecule_a, r.molecule_b) for r in cores.two_core(bonds).collect()} == core
    with pytest.raises(Exception, match="molecule -1 of a case"):
        cores.two_core(spark.createDataFrame([(1, -1, 2), (1, 2, 3)], bonds.schema)).collect()


def test_two_core_equals_peeling(spark):
    rng = random.Random(7)
    rows, want = [], set()
    for case in range(30):
        n = rng.randint(2, 60)
        edges = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(rng.randint(1, int(1.3 * n)))}
        if case % 3 == 0:  # long tails, and a ring of two between branches
            edges |= {(n + k, n + k + 1) for k in range(40)} | {(0, n), (n + 40, n + 80), (n + 80, n + 81), (n + 40, n + 81)}
        rows += [(case, a, b) for a, b in edges] + [(case, b, a) for a, b in list(edges)[:3]]
        want |= {(case, a, b) for a, b in peeled(edges)}
    got = cores.two_core(spark.createDataFrame(rows, "case_id long, molecule_a long, molecule_b long"))
    assert {(r.case_id, r.molecule_a, r.molecule_b) for r in got.collect()} == want
    assert cores.two_core(spark.createDataFrame([], "case_id long, molecule_a long, molecule_b long")).count() == 0


STEPS = "case_id long, molecule long, type string, arm long, step long, x long, y long, z long"


def molecule(number, kind="A", at=(9, 9, 9), length=2):
    x, y, z = at
    rows = [(1, number, kind, -1, 0, x, y, z)]
    for arm, (dx, dy) in enumerate(((1, 0), (-1, 0), (0, 1), (0, -1))):
        rows += [(1, number, kind, arm, k, x + dx, y + dy, z + k - 1) for k in range(1, length + 1)]
    return rows


def broken():
    """Molecules, each with one change, and the faults that it makes."""
    change = lambda rows, at, **new: [tuple(new.get(c.split()[0], v) for c, v in zip(STEPS.split(", "), r)) if k == at else r for k, r in enumerate(rows)]
    return {
        1: (molecule(1), {}),
        2: (change(molecule(2), 3, type="B"), {"types": 1}),
        3: (molecule(3, "Q"), {"types": 1}),
        4: (molecule(4)[1:], {"centres": 1}),
        5: (change(molecule(5), 0, step=3), {"centres": 1}),
        6: (change(molecule(6), 8, arm=7), {"arms": 1, "lengths": 1}),
        7: (molecule(7)[:-1], {"lengths": 1}),
        8: (change(molecule(8), 2, step=3), {"steps": 1}),
        9: (change(molecule(9), 2, z=12), {"jumps": 1}),
        10: (molecule(10) + [molecule(10)[2]], {"steps": 1, "lengths": 1, "jumps": 1, "crossings": 1}),
        11: (change(molecule(11), 1, x=None), {}),
        12: (molecule(12)[:1], {}),
    }


@pytest.mark.parametrize("fold", [20_000, 0])
def test_molecule_faults(spark, monkeypatch, fold):
    monkeypatch.setattr(trajectories, "FOLD", fold)
    rows = [r for rows, _ in broken().values() for r in rows]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, STEPS)
    got = {r.molecule: {k: r[k] for k in trajectories.FAULTS if r[k]} for r in trajectories.judged(df).collect()}
    assert got == {k: f for k, (_, f) in broken().items()}
    assert trajectories.faults(df.where("false")).count() == 0


def test_nested_molecules(spark):
    rows = [r for rows, _ in broken().values() for r in rows if r[1] in (1, 7)]
    got = trajectories.nested(spark.createDataFrame(rows, STEPS)).collect()
    assert [r.molecule for r in got] == [1] and got[0].type == "A" and tuple(got[0].centre) == (9, 9, 9)
    assert [[tuple(p) for p in arm] for arm in got[0].arms][3] == [(9, 9, 9), (9, 8, 9), (9, 8, 10)]


PAIRS = "case_id long, endpoint_a long, endpoint_b long, distance int, " + ", ".join(f"{c}_{s} {'string' if c == 'type' else 'long'}" for s in "ab" for c in trajectories.FIELDS)


def test_candidates_are_reconciled_both_ways(spark):
    ends = trajectories.ends(spark.createDataFrame(molecule(0) + molecule(1, "B", (13, 9, 9)) + molecule(2, "B", (9, 13, 9)), STEPS))
    want = trajectories.told(spark.createDataFrame([(1, 0, 5, 2), (1, 2, 11, 2)], "case_id long, endpoint_a long, endpoint_b long, distance int"), ends, ["case_id"])
    assert trajectories.reconciled(want, want).count() == 0 and trajectories.bond_faults(want, ends).count() == 0
    rows = [r.asDict() for r in want.collect()]
    first = next(r for r in rows if r["endpoint_a"] == 0)
    listed = [first, first | {"x_a": 0, "distance": 1}, first | {"endpoint_b": 6}]
    table = spark.createDataFrame(listed, PAIRS)
    got = {(r.endpoint_a, r.endpoint_b, r.problem, r.field) for r in trajectories.reconciled(table, want).collect()}
    assert got == {(2, 11, "missing", None), (0, 6, "invented", None), (0, 5, "repeated", None), (0, 5, "altered", "x_a"), (0, 5, "altered", "distance")}
    assert trajectories.reconciled(table.where("false"), want).count() == 2
    faults = {r.rule: r.bad_count for r in trajectories.bond_faults(table, ends).collect()}
    assert faults == {"owner": 1, "coordinates": 2, "reach": 1, "distance": 1, "reuse": 2}


def test_partitions_are_equal_up_to_names(spark):
    parts = spark.createDataFrame([(1, m, r) for m, r in enumerate((0, 0, 0, 3, 3, 5, 6, 6, 8))], "case_id long, molecule long, root long")
    names = spark.createDataFrame([(1, r, k) for k, r in enumerate((0, 3, 5, 6, 8))], "case_id long, root long, cluster_id long")
    labels = (0, 0, 7, 1, 1, 1, 9, 9, 4)  # the first split, the next two merged, one renamed, one right
    stored = spark.createDataFrame([(1, m, v) for m, v in enumerate(labels)], "case_id long, molecule long, cluster_id long")
    got = {(r.label, r.root, r.molecules, r.kind) for r in partitions.differences(partitions.contingency(stored, parts), names).collect()}
    assert got == {(0, 0, 2, "split"), (7, 0, 1, "split"), (1, 3, 2, "merged"), (1, 5, 1, "merged"), (9, 6, 2, "renamed")}


GROUP = "run long, condition long, source string"


def test_gate_refuses_clashes_and_leaves_nothing(spark, tmp_path):
    a, b = spark.createDataFrame([(1, 1, "x"), (2, 2, "x")], GROUP), spark.createDataFrame([(1, 3, "x")], GROUP)
    planned = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "group string, condition long")
    folder = uri(tmp_path / "good")
    study.combine({"a": a, "b": b}, planned, ["condition"], folder, source="source")
    assert {r.run for r in spark.read.parquet(folder).collect()} == {"a/1", "a/2", "b/1"}
    with pytest.raises(FileExistsError):
        study.combine({"a": a, "b": b}, planned, ["condition"], folder)
    bad = {
        "repeated": {"a": a, "b": b.unionAll(a.where("condition = 2"))},
        "unexpected": {"a": a, "b": b.unionAll(spark.createDataFrame([(9, 9, "x")], GROUP))},
        "absent": {"a": a.where("condition = 1"), "b": b},
        "several sources": {"a": a, "b": b.withColumn("source", F.lit("y"))},
    }
    for word, groups in bad.items():
        with pytest.raises(Exception, match=word):
            study.combine(groups, planned, ["condition"], uri(tmp_path / "bad"), source="source")
        assert not (tmp_path / "bad").exists()
    with pytest.raises(ValueError, match="no rows"):
        study.combine({"a": a.where("false")}, planned.where("false"), ["condition"], uri(tmp_path / "bad"))
    assert not (tmp_path / "bad").exists()


def test_resume_digests_files_again(spark, tmp_path):
    folder, manifest = uri(tmp_path / "results"), uri(tmp_path / "manifest")
    spark.range(60).select((F.col("id") % 6).alias("part"), "id").repartition("part").write.partitionBy("part").parquet(folder)
    study.note(spark, folder, "part", manifest, "v1")
    assert {r.state for r in study.states(spark, folder, "part", manifest, "v1").collect()} == {"kept"}
    file = lambda k: next((tmp_path / "results" / f"part={k}").glob("part-*"))
    damaged = bytearray(file(1).read_bytes())
    damaged[len(damaged) // 2] ^= 1
    file(1).with_name(f".{file(1).name}.crc").unlink()  # else the local file system tells it first
    file(1).write_bytes(damaged)
    file(2).unlink()
    (tmp_path / "results" / "part=3" / "part-extra.parquet").write_bytes(b"more")
    found = study.states(spark, folder, "part", manifest, "v1")
    assert {int(r.part): r.state for r in found.collect()} == {0: "kept", 1: "changed", 2: "lost", 3: "added", 4: "kept", 5: "kept"}
    assert sorted(r.part for r in study.to_do(spark.range(8).withColumnRenamed("id", "part"), found, "part").collect()) == [1, 2, 3, 6, 7]
    assert {r.state for r in study.states(spark, folder, "part", manifest, "v2").collect()} == {"foreign"}


def test_union_of_keys(spark, tmp_path):
    kinds = ((2, "map('c', '3', 'a', '4')"), (1, "map('b', '1', 'a', '2')"), (3, "cast(map() as map<string,string>)"), (4, "map('d, e', 'x\"y\\nz')"))
    rows = spark.sql(" UNION ALL ".join(f"SELECT {k}L AS k, {cells} AS cells" for k, cells in kinds)).repartition(3)
    folder = uri(tmp_path / "csv")
    assert files.export_union(rows, "cells", ["k"], folder) == ["b", "a", "c", "d, e"]
    got = [tuple(r) for r in spark.read.option("header", True).option("multiLine", True).option("escape", "\\").csv(folder).collect()]
    assert set(got) == {("1", "2", None, None), (None, "4", "3", None), (None, None, None, None), (None, None, None, 'x"y\nz')}
    for empty in (rows.where("false"), rows.where("k = 3")):
        with pytest.raises(ValueError, match="no rows"):
            files.export_union(empty, "cells", ["k"], uri(tmp_path / "none"))
    assert not (tmp_path / "none").exists()
    with pytest.raises(ValueError, match="missing columns: q"):
        files.columns_in(rows, "k", "q")


def test_cache_lines_are_kept_or_put_aside(spark, tmp_path):
    good = '{"version":"cycle46-v1","case_id":1,"chunk":0,"totals":{"clusters":1,"molecules":2,"largest":2,"h2":1,"bonds":3},"items":[{"cluster_id":0,"size":2,"h2":1,"bonds":3}]}'
    head = good.replace('"chunk":0', '"chunk":-1').split(',"items"')[0] + "}"
    rows = [good, head, good.replace('"size":2', '"size":true'), good.replace('"size":2', '"size":2.5'), good.replace('"size":2', '"size":0'), good.replace('"h2":1,"bonds":3}]', '"h2":2,"bonds":3}]'), good[:-3], '{"version":"cycle46-v1"}', good.replace('"items":[', '"items":[],"x":['), "nothing"]
    (tmp_path / "lines").write_text("\n".join(rows))
    kept, bad = caches.scan(caches.read(spark, uri(tmp_path / "lines")))
    assert kept.count() == 2
    assert sorted(r.reason for r in bad.collect()) == sorted(["corrupt"] * 4 + ["counts", "totals", "counts", "totals", "key", "totals", "empty", "totals"])
    assert [r.differs for r in caches.reconciled(kept).collect()] == [None]
    assert caches.reconciled(kept.where("chunk = 0")).first().differs == "sample"
    assert caches.reconciled(kept.unionAll(kept.where("chunk = 0"))).first().differs == "clusters,molecules,h2,bonds,repeated"


def test_compact_documents(spark):
    arms = "[[1,0,0],[0,1,0],[0,0,1],[1,1,1]]"
    doc = '{"format":"f","hasBonds":true,"molecules":[[0,"A",0,0,0,[[1,0,0,2,0,0],[0,1,0,0,2,0],[0,0,1,0,0,2],[0,0,9,0,0,9]]]],"bonds":[]}'
    rows = [(1, "{"), (2, doc), (3, doc.replace('"f"', '"g"')), (4, '{"format":"f","hasBonds":false,"molecules":[[0,"A",1,1,1,%s]],"bonds":[[0,0,0,0]]}' % arms), (5, '{"format":"f","hasBonds":true,"molecules":[[0,"A",1,1,1.5,%s],[0,"B",-1,1,1,%s]],"bonds":[[0,1],[0,7,0,0]]}' % (arms, arms))]
    found = compact.Documents(spark.createDataFrame(rows, "case_id long, value string"), "f")
    got = defaultdict(set)
    for r in found.faults.collect():
        got[r.case_id].add(r.fault)
    assert got[1] == {"text"} and "jumps" in got[2] and "sites" in got[2] and "format" in got[3] and "format" in got[4]
    assert got[5] == {"molecule", "bond", "target"}
    assert found.summary().count() == 0


def test_grids_and_alignment_fail_as_a_whole(spark):
    rows = spark.createDataFrame([(1, 10, 5.0), (2, 20, None)], "a long, b long, v double")
    got = {(r.a, r.b): r.v for r in stats.on_grid(rows, ["a"], ["b"], {"v": None}).collect()}
    assert got == {(1, 10): 5.0, (1, 20): None, (2, 10): None, (2, 20): None}
    assert {r.v for r in stats.on_grid(rows, ["a"], ["b"], {"v": 0}).collect()} == {5.0, 0.0}
    with pytest.raises(Exception, match="repeated row"):
        stats.on_grid(rows.unionAll(rows), ["a"], ["b"], {"v": None}).collect()
    assert constraints.aligned(rows, rows, ["a"]).count() == 2
    with pytest.raises(Exception, match="not aligned"):
        constraints.aligned(rows, rows.where("a = 1"), ["a"]).collect()


def test_numbers_of_bonds_have_no_gaps_that_repeats_hide(spark):
    rows = spark.createDataFrame([(1, k, 8 * k, 8 * k + 4, 2 * k, 2 * k + 1) for k in (0, 0, 2)], "case_id long, bond_id long, endpoint_a long, endpoint_b long, molecule_a long, molecule_b long")
    assert {r.rule: r.bad_count for r in constraints.bond_violations(rows).collect()}["numbering"] == 2


def test_kept_tables_follow_their_source(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    spark.range(1).write.parquet(uri(tmp_path / "t.parquet"))
    for _ in range(2):
        assert storage.kept(spark, uri(tmp_path), ("t",), "x", make).count() == 3
    assert len(made) == 1
    spark.range(9).write.mode("append").parquet(uri(tmp_path / "t.parquet"))
    assert storage.kept(spark, uri(tmp_path), ("t",), "x", make).count() == 3 and len(made) == 2


def test_medians_of_large_groups(spark):
    import statistics

    rng = random.Random(2)
    rows = [(k % 3 if k % 2 else 0, rng.choice((None, rng.randrange(50), rng.random()))) for k in range(2000)]
    df = spark.createDataFrame([(g, None if v is None else float(v)) for g, v in rows], "g long, v double").repartition(5)
    want = {g: statistics.median([v for h, v in rows if h == g and v is not None]) for g in range(3)}
    got = {r.g: r.median for r in stats.medians(df, ["g"], "v").collect()}
    assert got.keys() == want.keys() and all(abs(got[g] - want[g]) < 1e-12 for g in want)
