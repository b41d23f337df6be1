import duckdb
import pytest

import corpus_pipeline
from meshwork.llm import decontaminate, queries
from tests.llm.cases import SMALL


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        from meshwork.llm.rows import saved

        docs = saved(stage(spark, docs, SMALL), "stage")
        out.append(docs)
    return out


def test_stages_keep_the_columns(spark, stages):
    want = spark.read.parquet(f"{SMALL}/documents.parquet").schema
    assert all(s.schema == want for s in stages[:-1])
    assert all(s.where("n_chars <> length(text)").count() == 0 for s in stages[1:-1])


def test_stages_take_effect(spark, stages):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    counts = [docs.count(), *(s.count() for s in stages)]
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.7 * counts[0]
    clean = labels.where("toxic = 0").join(docs, "doc_id").count()
    assert labels.where("toxic = 0").join(stages[0], "doc_id").count() >= 0.97 * clean
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    assert decontaminate.find_hits(stages[3], bench).where("n_hit > 0").count() == 0


def test_run_gives_the_last_stage(spark, stages):
    same = lambda df: sorted((r.doc_id, r.n_tokens, r.decoded_sha256) for r in df.collect())
    assert same(corpus_pipeline.run(spark, SMALL)) == same(stages[-1])


def test_stages_bear_odd_rows(spark, tmp_path):
    """Nulls, empty and repeated rows, an empty table and further columns; each stage against what it should leave."""
    base = spark.read.parquet(f"{SMALL}/documents.parquet").schema
    line = "the river walks over the stone in a light that never ends"
    rows = [(1, f"{line}\n{line}\nanother line"), (1, f"{line}\n{line}\nanother line"), (2, None), (3, ""), (4, line), (None, line), (None, None), (5, "a b c d e f g h i j k l and more that stays here for all the others"), (6, "x" * 30_000)]
    docs = spark.createDataFrame([(i, t, None, "s", len(t or ""), "extra") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, cuts string")
    docs = docs.select(*(docs[f.name].cast(f.dataType) for f in base), "cuts")
    spark.createDataFrame([("b", "a b c d e f g h i j"), (None, None)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 0, 1), (None, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    texts_of = lambda df: sorted(((r.doc_id or -1, r.text) for r in df.collect()), key=str)
    want = {
        "toxicity": [(i or -1, t) for i, t in rows],  # labels of one kind teach nothing
        "line dedup": [(1, f"{line}\nanother line")] * 2 + [(2, None), (3, ""), (4, ""), (-1, line), (-1, None)] + [(i, t) for i, t in rows[7:]],
        "simhash near-dedup": [(i or -1, t) for i, t in rows if i not in (3, 4)],  # 3 is as empty as 2, 4 is what 1 says twice
        "benchmark decontamination": [(i or -1, t if i != 5 else " k l and more that stays here for all the others") for i, t in rows],
    }
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, str(tmp_path))
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0
        if name in want:
            assert got.columns == docs.columns
            assert texts_of(got) == sorted(want[name], key=str), name
        else:
            assert got.count() == len(rows)


def test_queries_equal_their_sql(spark):
    con = duckdb.connect()
    for t in ("pages", "documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    for name, sql in queries.oracle_sql().items():
        got = queries.queries()[name](spark, SMALL)
        want = con.execute(sql)
        names = [c[0] for c in want.description]
        assert sorted(got.columns) == sorted(names)
        assert sorted(map(str, (tuple(r[n] for n in names) for r in got.collect()))) == sorted(map(str, want.fetchall()))


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_every_query_runs(spark, name):
    assert queries.queries()[name](spark, SMALL).count() >= 50
