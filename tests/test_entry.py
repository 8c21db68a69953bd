"""The entry points, and every SQL-checked query against DuckDB at the smallest scale that fills the fields."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from streamweft import queries

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()
#: Of the whole list, which takes ten minutes: STREAMWEFT_ALL_SQL=1.
SOME = ["field_from_events", "inflow_region", "trilinear_sample", "vorticity", "extrema_per_step", "assign_seeds", "amr_finest", "tet_face_adjacency", "rk4_fixed",
        "sample_repeated_points", "source_box", "trajectory_file", "streamlines_by_blocks", "streaks_of_a_rotation", "enqueued_items", "lambda2_gamma2", "halo_nodes", "overlapping_blocks"]
CHECKED = sorted(queries.SQL) if os.environ.get("STREAMWEFT_ALL_SQL") else SOME

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
    found = con.execute(queries.SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted((tuple(row[names.index(c)] for c in columns) for row in found.fetchall()), key=repr)
    assert got == want


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(queries.QUERIES) >= 150 and len(queries.SQL) >= 140
