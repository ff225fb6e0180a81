"""Every registered query of the general operators against its SQL in DuckDB, on the smallest tables."""

import math
import re
from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from quarry.plans.registry import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"


def plain(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "isoformat"):
        return pd.Timestamp(v).isoformat()
    if isinstance(v, float):
        return f"{v + 0.0:.9g}"
    return str(v)


def rows(frame, columns):
    return sorted((tuple(map(plain, r)) for r in frame[columns].astype(object).itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(FOLDER).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


#: Windows in one task run over aggregates: a row per segment, model, check, range, month or period of one series.
ONE_TASK = re.compile(r"^(rg09|am05|au11|au18|ts)")


def whole_table_windows(plan):
    """Windows whose rows all come from one exchange to a single task."""
    lines = [x for x in plan.splitlines() if not re.search(r"Project|InputAdapter|WholeStageCodegen|AQEShuffleRead|ShuffleQueryStage", x)]
    return [x for x, *rest in zip(lines, lines[1:], lines[2:], lines[3:], strict=False) if re.search(r"\bWindow \[", x) and any("Exchange SinglePartition" in y for y in rest)]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    made = QUERIES[name](spark, FOLDER)
    got, want = made.toPandas(), duck.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) > 0
    assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))
    told = [c for c in got.columns if got[c].dtype.kind in "ifb"]
    assert not told or any(got[c].fillna(0).astype(float).ne(0).any() for c in told), "all zero"
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|InArrow", plan)
    assert ONE_TASK.match(name) or not whole_table_windows(plan)


def test_checks_and_flags_are_not_all_alike(spark):
    """Over all queries of a group, some rows pass and some don't."""
    flags = [r.flag for name in ("an01_zscore", "an03_iqr_fence", "an06_centroid_outliers") for r in QUERIES[name](spark, FOLDER).select("flag").distinct().collect()]
    passes = [r["pass"] for name in ("au02_completeness", "au03_uniqueness", "au18_scorecard") for r in QUERIES[name](spark, FOLDER).select("pass").collect()]
    assert set(flags) == {True, False} and set(passes) == {True, False}


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_names_are_registered():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
