"""Plan rules for all queries, and a sample of them against DuckDB."""

import re

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = ["events", "lineitem", "documents", "labels"]
# One query per area; tools/check_oracles.py runs all of them.
SAMPLE = ["A2_load_events", "B3_adapt_unsw", "B14_chronological_split", "C7_token_ids", "D2_window_features", "E1_baselines",
          "E13_described_scores", "E14_score_stream_with_cooldown", "F6_day_thresholds", "G5_family_metrics", "G12_drift_rollup",
          "H7_predict_next"]


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


def canon(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cell = lambda v: round(float(v), 5) + 0.0 if not isinstance(v, (str, bool, type(None))) else v
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, sf, con, name):
    df = entry.queries()[name](spark, sf)
    cur = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(columns)
    assert canon(df.columns, df.collect()) == canon(columns, cur.fetchall())


def test_entry_runs(spark):
    alerts = entry.entry(spark).collect()
    assert alerts and all(r.score >= r.threshold for r in alerts)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["D1_sequences", "D2_window_features", "D3_multiscale_features", "D5_position_in_entity"])
def test_windows_have_keys_and_one_shuffle(spark, sf, name):
    plan = entry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1
    for spec in re.findall(r"windowspecdefinition\(([^,]+),", plan):
        assert spec.startswith("entity_id")
    assert "SinglePartition" not in plan


def test_scans_read_only_needed_columns(spark, sf):
    plan = entry.queries()["B11_keep_entities"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "props" not in "".join(re.findall(r"ReadSchema: \S+", plan))
