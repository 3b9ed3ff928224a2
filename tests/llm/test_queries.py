from pathlib import Path

import duckdb
import pytest

from leafmill.llm.queries import LLM
from verify import rows


@pytest.mark.parametrize("name", sorted(LLM.runs))
def test_query(spark, data_dir, name):
    df = LLM.runs[name](spark, data_dir)
    got = df.collect()
    assert got
    if name in LLM.sqls:
        con = duckdb.connect()
        for p in Path(data_dir).glob("*.parquet"):
            con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
        cur = con.execute(LLM.sqls[name])
        assert rows(df.columns, [tuple(r) for r in got]) == rows([d[0] for d in cur.description], cur.fetchall())
