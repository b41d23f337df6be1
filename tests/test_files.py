import gzip

import pytest

from meshwork.sources import files


def test_samples_plain_and_packed(spark, tmp_path):
    for k, opener in enumerate((open, gzip.open)):
        d = tmp_path / f"case{k}"
        d.mkdir()
        with opener(d / ("cluster-summary.csv" + ".gz" * k), "wt") as f:
            f.write("cluster_id,molecule_count,bond_count\n0,3,2\n")
    got = files.samples(spark, f"file://{tmp_path}", "cluster-summary").collect()
    assert sorted((r.case_id, r.molecule_count) for r in got) == [("case0", 3), ("case1", 3)]
    (tmp_path / "case1" / "cluster-summary.csv").write_text("cluster_id,molecule_count,bond_count\n")
    cases = spark.createDataFrame([("case0",), ("case1",), ("case2",)], "case_id string")
    assert {r.case_id: r.files for r in files.copies(spark, f"file://{tmp_path}", "cluster-summary", cases).collect()} == {"case1": 2, "case2": 0}


def test_bad_cell_fails(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "cluster-summary.csv").write_text("cluster_id,molecule_count,bond_count\n0,x,2\n")
    with pytest.raises(Exception):
        files.samples(spark, f"file://{tmp_path}", "cluster-summary").collect()


GOOD = "dim = 3\nL = 10 # edge\nseed=3\narm_length = 5\na_probability = 0.5\n"


@pytest.mark.parametrize("phi,n", [("0.105", 5), ("0.104999999999999999", 4), ("0.105000000000000001", 5), ("1.05e-1", 5), ("1", 47), (".105", 5)])
def test_settings(spark, tmp_path, phi, n):
    (tmp_path / "n.cfg").write_text(f"# made\n{GOOD}target_phi = {phi}\n")
    rows = files.settings(spark, f"file://{tmp_path}/n.cfg")
    assert files.setting_faults(rows).count() == 0
    assert files.networks(rows).first().molecules == n


def test_setting_faults(spark, tmp_path):
    (tmp_path / "n.cfg").write_text("dim = 3\nL = -1\nseed = 3\nseed = 4\ncolour = 1\narm_length = 5\ntarget_phi = 0.1\ntarget_molecules = 4\n")
    rows = files.settings(spark, f"file://{tmp_path}/n.cfg")
    assert {r.fault for r in files.setting_faults(rows).collect()} == {"bad L", "unknown colour", "repeated seed", "missing a_probability", "one target"}
    assert files.networks(rows).count() == 0


def test_save_never_overwrites(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2)], "case_id long, v long")
    files.save(rows, f"file://{tmp_path}/t", "case_id")
    with pytest.raises(Exception):
        files.save(rows, f"file://{tmp_path}/t", "case_id")


def test_viewer_model(spark):
    rows = [("c", 0, "A", -1, 0, 1, 1, 1)] + [("c", 0, "A", a, s, a, s, 0) for a in range(4) for s in (2, 1)]
    got = files.viewer_model(spark.createDataFrame(rows, "case_id string, molecule long, type string, arm int, step int, x int, y int, z int")).first()
    assert got.json == '{"id":0,"type":"A","centre":[1,1,1],"arms":[[0,1,0,0,2,0],[1,1,0,1,2,0],[2,1,0,2,2,0],[3,1,0,3,2,0]]}'
