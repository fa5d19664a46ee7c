"""Further queries against their SQL on DuckDB: telemetry, tables, trees, the judges' side."""

import pytest

from tests.unit.test_oracles import DATA, duck, plain, pytestmark  # noqa: F401
from turnloom.plans.registry import ORACLES, QUERIES

MORE = ["telemetry_stream", "telemetry_transcripts", "phases_table", "judge_phases", "audit_flags", "main_spans", "span_records", "tool_pairs", "operator_match", "span_packing", "scan_round_trip", "transcript_order", "result_votes", "branch_trees", "colours"]


@pytest.mark.parametrize("name", MORE)
def test_query_equals_sql(spark, duck, name):  # noqa: F811
    df = QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*names).collect()), key=repr)
    r = duck.sql(ORACLES[name])
    assert sorted(r.columns) == names
    at = [r.columns.index(n) for n in names]
    assert got == sorted((tuple(plain(row[i]) for i in at) for row in r.fetchall()), key=repr)
