"""Each catalogue query against its SQL oracle on the smallest tables."""

from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")

from skein.plans import catalog  # noqa: E402

ORACLES = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from '{p}'")
    return c


def canonical(df):
    df = df[sorted(df.columns)]
    for c in df.columns:
        kind = df[c].dtype.kind
        df = df.assign(**{c: df[c].astype(float).round(6) if kind in "fiu" else df[c].astype(str) if kind == "M" else df[c]})
    return sorted(map(repr, df.astype(object).where(df.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, sf_dir, con, name):
    got = catalog.queries()[name](spark, sf_dir).toPandas()
    want = con.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(ORACLES)))
def test_runs(spark, sf_dir, name):
    df = catalog.queries()[name](spark, sf_dir)
    assert df.columns and df.count() >= 0


def test_flagship(spark, sf_dir):
    rows = catalog.flagship(spark, sf_dir).collect()
    assert rows and {r["routing"] for r in rows} <= {"answer", "partial", "no_answer"}
