"""Every query that has SQL against DuckDB, on the smallest tables."""

import math
import os

import __spark_entry__ as entry
import duckdb
import pytest
from spinel import queries
from spinel import queries_files, queries_io  # noqa: F401  register their queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return f"{float(v):.9g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_against_sql(spark, sf, duck, name):
    df = queries.QUERIES[name](spark, sf)
    rel = duck.sql(queries.ORACLE[name])
    assert sorted(df.columns) == sorted(rel.columns)
    cols = sorted(df.columns)
    got = sorted("|".join(plain(r[c]) for c in cols) for r in df.collect())
    at = [rel.columns.index(c) for c in cols]
    want = sorted("|".join(plain(r[k]) for k in at) for r in rel.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_runs(spark, sf, name):
    assert queries.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["name", "global", "rank"] and df.count() == 9
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(n for n in queries.ORACLE if n not in ("u06_term_subsets", "j14_assert_square", "r13_sweep_energy", "j06_shape_check", "j16_others", "s13_profile_report", "s14_domain_report", "s15_pair_report", "s13_large_reports")))
def test_plans_stay_native(spark, sf, name):
    plan = queries.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "Python" not in plan and "Pandas" not in plan
