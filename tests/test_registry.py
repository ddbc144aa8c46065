import re
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_module

SF = Path("/root/testdata/sf0.001")


def test_every_check_belongs_to_a_query():
    queries, checks = entry_module.queries(), entry_module.oracle_sql()
    assert set(checks) <= set(queries) and len(queries) >= 78
    assert all(re.fullmatch(r"[a-z][a-z0-9_]*", name) for name in queries)


@pytest.mark.skipif(not SF.exists(), reason="test tables not here")
@pytest.mark.parametrize(
    "name",
    [
        "cast_decision", "cast_allowlist", "cast_materialize_failures", "cast_materialize_long_texts",
        "cast_object_nested", "consistent_read", "dataset_fingerprint", "dataset_fingerprint_merkle", "decision_field_errors",
        "execution_transitions", "infer_logical_type", "output_match", "plan_route", "publish_version",
        "register_versions", "run_violations", "schema_delta", "set_fingerprint_changes", "ticket_lineage", "trusted_read_summary",
        "variant_kinds",
    ],
)
def test_queries_agree_with_their_sql(spark, name):
    con = duckdb.connect()
    for path in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    df = entry_module.queries()[name](spark, str(SF))
    cursor = con.execute(entry_module.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    got = sorted(tuple(str(r[n]) for n in names) for r in df.collect())
    assert got == sorted(tuple(str(v) for v in r) for r in cursor.fetchall())


@pytest.mark.skipif(not SF.exists(), reason="test tables not here")
def test_entry(spark):
    assert entry_module.entry(spark).count() == 4
