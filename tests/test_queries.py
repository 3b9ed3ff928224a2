"""Every registered query of the core runs on the smallest data; those with SQL agree with it."""

from pathlib import Path

import duckdb
import pytest

from leafmill.plans.general import GENERAL
from leafmill.plans.notes import NOTES
from leafmill.plans.reader import READER
from leafmill.plans.reading import READING
from verify import rows

QUERIES = {name: (run, part.sqls.get(name)) for part in (GENERAL, READING, NOTES, READER) for name, run in part.runs.items()}


@pytest.fixture(scope="module")
def con(data_dir):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in Path(data_dir).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, data_dir, name):
    run, sql = QUERIES[name]
    df = run(spark, data_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        assert got
        return
    cur = con.execute(sql)
    want = rows([d[0] for d in cur.description], cur.fetchall())
    assert sorted(df.columns) == sorted(d[0] for d in cur.description)
    assert got == want
