"""Every query of the problems on text and matching runs on the smallest tables and gives the rows of its SQL."""

import os
from pathlib import Path

import duckdb
import pytest

from ostinato.llm.queries import registry

SF = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test tables")


@pytest.mark.parametrize("name", registry.queries)
def test_query(spark, name):
    df = registry.queries[name](spark, str(SF))
    got = df.collect()
    assert got
    if name in registry.sql:
        con = duckdb.connect()
        for p in SF.iterdir():
            con.sql(f"create view {p.stem} as select * from '{p}{'/*.parquet' if p.is_dir() else ''}'")
        want = con.sql(registry.sql[name])
        assert sorted(map(repr, (tuple(r[c] for c in want.columns) for r in got))) == sorted(map(repr, want.fetchall()))


def test_every_document_and_recording_once(spark):
    ids = registry.queries["p7_ids"](spark, str(SF))
    docs = spark.read.parquet(str(SF / "documents.parquet"))
    assert ids.count() == docs.count() == ids.select("doc_id").distinct().count()
    packed = registry.queries["p8_packed"](spark, str(SF))
    assert packed.select("doc_id").distinct().count() == docs.count()
    split = registry.queries["p5_splits"](spark, str(SF))
    assert split.count() == spark.read.parquet(str(SF / "recordings.parquet")).count()
