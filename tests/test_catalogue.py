"""Every registered query runs; those with SQL give what DuckDB gives."""

import duckdb
import pytest

import __spark_entry__ as entry
from siftlake.plans import catalogue

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def plain(value):
    return f"{value:.6g}" if isinstance(value, float) else str(value)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(name, spark, duck):
    df = catalogue.queries()[name](spark, DIR)
    rows = df.collect()
    if name in SQL:
        r = duck.execute(SQL[name])
        assert normal(df.columns, rows) == normal([d[0] for d in r.description], r.fetchall())
    else:
        assert rows


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_depends_on_the_training_data_package():
    import pathlib
    import re

    root = pathlib.Path(entry.__file__).parent
    for f in (root / "siftlake").rglob("*.py"):
        if "llm" not in f.parts:
            assert not re.search(r"(from|import)\s+siftlake\.llm", f.read_text()), f
