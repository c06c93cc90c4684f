import duckdb
import pandas as pd
import pytest

from emberline.plans import queries as Q

TABLES = "region nation customer supplier part orders lineitem events documents pages labels benchmark".split()


def rows(df):
    df = df[sorted(df.columns)].astype(object)

    def plain(name, x):
        if pd.isna(x):
            return None
        if isinstance(x, bool) or type(x).__name__ == "bool":
            return bool(x)
        if "date" in name and "time" not in name:
            return str(x)[:10]
        return float(x) if isinstance(x, (int, float)) or hasattr(x, "dtype") else str(x)

    return sorted(str(tuple(plain(c, x) for c, x in zip(df.columns, r))) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, sf_dir, duck, name):
    found = Q.QUERIES[name](spark, sf_dir).toPandas()
    if name in Q.ORACLES:
        want = duck.sql(Q.ORACLES[name]).df()
        assert sorted(found.columns) == sorted(want.columns)
        assert rows(found) == rows(want)
    else:
        assert len(found)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["class", "n"] and set(entry.oracle_sql()) <= set(entry.queries())
