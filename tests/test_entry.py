"""All registered queries against their SQL on the small tables."""

import datetime
import decimal
import math
import pathlib
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from ledgerlake.plans import library

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return str(v) if isinstance(v, datetime.date) else v


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def compare(df, cursor):
    names = [x[0] for x in cursor.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(plain(v) for _, v in sorted(zip(names, r, strict=True))) for r in cursor.fetchall()), key=repr)
    got = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", [n for n in library.QUERIES if n in library.SQL])
def test_query(spark, sf_dir, duck, name):
    compare(library.QUERIES[name](spark, sf_dir), duck.execute(library.SQL[name]))


@pytest.mark.parametrize("name", [n for n in library.QUERIES if n not in library.SQL])
def test_runs(spark, sf_dir, name):
    assert library.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_import_needs_no_session():
    root = pathlib.Path(entry.__file__).parent
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=root, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0 and int(said.stdout.split()[-1]) == len(entry.queries()), said.stderr
