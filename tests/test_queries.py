"""Every registered query of the library against its SQL, on the small tables."""

import duckdb
import pandas as pd
import pytest

from momentspark.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    with duckdb.connect() as c:
        for t in TABLES:
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        yield c


def plain(df):
    value = lambda v: "" if v is None or v is pd.NA or v is pd.NaT or v != v else float(v) if not isinstance(v, str | bool) and hasattr(v, "__float__") else str(v)
    return sorted((tuple(value(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, db, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    assert len(got)
    if name in registry.ORACLE_SQL:
        want = db.sql(registry.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert plain(got) == plain(want)
