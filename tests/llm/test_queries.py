import os

import duckdb
import pytest

from pathloom.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")

COLUMNS = {
    "p1_found": ["record_kind", "row_id", "start_pos", "run_length"], "p2_found": ["record_kind", "row_id"], "p3_found": ["group_id", "candidate_id", "place"], "p4_found": ["field_name", "row_id", "defect"],
    "p5_found": ["table_name", "id_a", "id_b"], "p6_found": ["table_name", "id_a", "id_b"], "p7_found": ["table_name", "keep_id", "copy_id"], "p8_ids": ["doc_id", "ids"], "p10_found": ["doc_id", "subject"],
}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_runs_with_its_columns(spark, name):
    df = queries.queries()[name](spark, SF)
    rows = df.collect()
    assert rows
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
        assert len({tuple(map(str, r)) for r in rows}) == len(rows)


def test_places_equal_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW review_candidates AS SELECT * FROM '{SF}/review_candidates.parquet'")
    assert sorted(map(tuple, queries.p3_found(spark, SF).collect())) == sorted(con.execute(queries.oracle_sql()["p3_found"]).fetchall())


def test_runs_stay_in_the_scan(spark):
    plan = queries.p1_found(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "ui_tree" not in plan


def test_consistent_forms_of_both_tables(spark):
    df = queries.p6_consistent(spark, SF)
    assert df.columns == ["table_name", "row_id", "form", "changed"]
    con = duckdb.connect()
    for name in ("listwise_tasks", "review_candidates"):
        own = df.where(f"table_name = '{name}'")
        assert sorted(r.row_id for r in own.select("row_id").collect()) == sorted(r[0] for r in con.execute(f"SELECT row_id FROM '{SF}/{name}.parquet'").fetchall())
        assert own.where("changed").count() and own.where("NOT changed").count()
