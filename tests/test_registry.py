"""Registry smoke test at sf0.001 (oracle comparison of a sample) and the entry point."""
import importlib
import math
import os
import sys
from collections import Counter

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = "/root/testdata/sf0.001"
SAMPLE = ["performance_metrics", "auprc", "drift_by_feature", "psi", "impute_median", "clip_iqr", "build_cohort",
          "fairness_by_group", "top_features", "gate_checks", "history_last_n", "scan_predictions"]


def _norm(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v.isoformat() if hasattr(v, "isoformat") else v


def _bag(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return Counter(tuple(_norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def con():
    from modelwatch.plans.fixtures import TABLES
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_entry(spark):
    entry = importlib.import_module("__spark_entry__")
    df = entry.entry(spark)
    assert df.count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_oracle(spark, con, name):
    from modelwatch.plans.registry import ORACLE, QUERIES
    df = QUERIES[name](spark, SF)
    rel = con.sql(ORACLE[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert _bag(df.columns, df.collect()) == _bag(rel.columns, rel.fetchall())


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                 "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "array<string>": "VARCHAR[]"}


@pytest.mark.parametrize("name", SAMPLE)
def test_query_types_match_oracle(spark, con, name):
    from modelwatch.plans.registry import ORACLE, QUERIES
    df = QUERIES[name](spark, SF)
    rel = con.sql(ORACLE[name])
    duck = dict(zip(rel.columns, [str(t) for t in rel.types]))
    for f in df.schema.fields:
        t = f.dataType.simpleString()
        assert SPARK_TO_DUCK.get(t, t) == duck[f.name], (f.name, t, duck[f.name])
