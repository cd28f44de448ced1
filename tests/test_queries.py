"""Every query with SQL gives the rows that DuckDB gives; the others give rows of a stable schema."""

import duckdb
import pytest

from quillwork import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, float):
        return round(x, 6) + 0.0
    return float(x) if type(x).__name__ == "Decimal" else x


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(v[i]) for i in order) for v in values), key=repr)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_against_sql(spark, sf_dir, con, name):
    df = plans.QUERIES[name](spark, sf_dir)
    want = con.execute(plans.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_without_sql(spark, sf_dir, name):
    a = plans.QUERIES[name](spark, sf_dir)
    assert rows(a.columns, [tuple(r) for r in a.collect()]) == rows(a.columns, [tuple(r) for r in plans.QUERIES[name](spark, sf_dir).collect()])


def test_entry_lists_everything(spark):
    import __spark_entry__ as e

    assert set(plans.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns
