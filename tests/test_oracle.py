"""Every registered query against its DuckDB oracle at sf0.01 (the driver's gate)."""

import os
import re

import duckdb
import pytest

import __spark_entry__ as E
from tools.check_oracle import TABLES, digest

SF = os.environ.get("ORACLE_SF", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.mark.parametrize("key", sorted(E.oracle_sql()))
def test_matches_oracle(spark, con, key):
    df = E.queries()[key](spark, SF)
    srows = [tuple(r) for r in df.collect()]
    res = con.sql(E.oracle_sql()[key])
    drows = res.fetchall()
    assert sorted(df.columns) == sorted(res.columns)
    stypes = {f.name: _TYPES.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}
    dtypes = dict(zip(res.columns, (str(t) for t in res.types)))
    assert stypes == dtypes
    assert len(srows) == len(drows)
    assert digest(df.columns, srows)[0] == digest(res.columns, drows)[0]


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["doc_id", "masked", "n_entities"]
    assert df.count() >= 0


def test_every_query_has_an_oracle():
    # the training-data queries have their own brute-force tests
    rows_only = {q for q in set(E.queries()) - set(E.oracle_sql()) if not re.match(r"op\d+_|pipeline$", q)}
    assert not rows_only
