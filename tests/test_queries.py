"""Every query of the core runs on the smallest tables and gives the rows of its SQL."""

import math
import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test tables")


def core():
    from ostinato.plans import analysis, files, general, measures, notes, series

    return [(n, m.registry) for m in (general, notes, series, analysis, measures, files) for n in m.registry.queries]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in SF.iterdir():
        con.sql(f"create view {p.stem} as select * from '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, bool):
        return x
    return round(float(x), 9) + 0.0 if isinstance(x, (int, float)) else str(x)


def rows(columns, data):
    by = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in by) for r in data), key=repr)


@pytest.mark.parametrize("name, registry", core(), ids=[n for n, _ in core()])
def test_query(spark, duck, name, registry):
    df = registry.queries[name](spark, str(SF))
    got = df.collect()
    if name in registry.sql:
        want = duck.sql(registry.sql[name])
        assert sorted(df.columns) == sorted(want.columns)
        assert rows(df.columns, got) == rows(want.columns, want.fetchall())


def test_mapped_values_of_copies_that_differ(spark, tmp_path):
    """Copies of a note that differ are rows of their own, as in the SQL; NaN stays NaN, null stays null; blanks of any kind go."""
    from ostinato.plans.measures import registry

    nan = math.nan
    data = [
        (1, "lab", 1.0, 2.0), (1, "lab", 1.0, 2.0), (1, "LAB ", 1.0, 2.0), (2, "own", 1.0, None), (2, "own", 3.0, None), (3, None, nan, 0.5),
        (3, None, nan, 0.5), (3, None, None, 0.5), (4, "\u00a0Lab\u3000", 1.0, nan), (5, "\tlab", 1.0, 1.0), (None, " ", 0.0, 1.0), (None, "", 0.0, 1.0),
    ]
    spark.createDataFrame(data, "note_key long, instrument string, f0_avg double, f0_var double").write.parquet(f"{tmp_path}/notes.parquet")
    con = duckdb.connect()
    con.sql(f"create view notes as select * from '{tmp_path}/notes.parquet/*.parquet'")
    got = registry.queries["mapped_values"](spark, str(tmp_path)).select("note_key", "instrument", "f0_avg", "f0_var").collect()
    want = con.sql(registry.sql["mapped_values"]).fetchall()
    assert len(want) == 10
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_names_are_unique():
    assert len(entry.queries()) == sum(len(r.queries) for r in entry._registries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
