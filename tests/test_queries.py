"""Every query against its SQL on the small tables, as rows in any order."""

import datetime
import decimal
import glob
import math
import os

import duckdb
import pytest

import __spark_entry__
from sightline.plans import catalog

SF = "/root/testdata/sf0.001"
#: Columns of the two engines that are the same kind of value.
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def ordered(rows):
    return sorted(rows, key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_against_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = ordered([tuple(plain(r[c]) for c in columns) for r in df.collect()])
    cur = duck.execute(catalog.ORACLES[name])
    kinds = {d[0]: str(d[1]) for d in cur.description}
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    assert ordered([tuple(plain(r[names.index(c)]) for c in columns) for r in cur.fetchall()]) == rows
    assert {c: kinds[c] for c, t in df.dtypes if t in KINDS} == {c: KINDS[t] for c, t in df.dtypes if t in KINDS}


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_without_training_data_operators(monkeypatch):
    """The entry works where the subpackage is not there, and does not hide other failures."""

    def missing(name):
        raise ModuleNotFoundError(name=name)

    monkeypatch.setattr(__spark_entry__.importlib, "import_module", missing)
    assert set(__spark_entry__.queries()) == set(catalog.QUERIES)
    assert set(__spark_entry__.oracle_sql()) == set(catalog.ORACLES)

    def broken(name):
        raise ModuleNotFoundError(name="numpy")

    monkeypatch.setattr(__spark_entry__.importlib, "import_module", broken)
    with pytest.raises(ModuleNotFoundError):
        __spark_entry__.queries()
