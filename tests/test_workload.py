"""A few registered queries against their SQL on the smallest data set; the full run is ``workload.check``."""

import os

import pytest

SF = "/root/testdata/sf0.001"
QUICK = [
    "silver_telemetry", "temporal_split", "incident_context", "near_duplicates_in_time", "backward_asof_join",
    "report_box_summary", "table_constraints", "outlier_robust_z", "downsample_majority", "sql_dump_source",
]


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, name):
    import duckdb

    import __spark_entry__ as entry
    from workload.check import TABLES, compare

    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    message, ok = compare(spark, connection, name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert ok, message


def test_every_query_is_registered_with_sql():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 90
