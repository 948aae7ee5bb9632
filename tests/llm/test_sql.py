from pathlib import Path

import duckdb
import pytest

from sentrel.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df, want = QUERIES[name](spark, SF), con.sql(ORACLES[name])
    cut = lambda cols, data: sorted(tuple(round(r[cols.index(c)], 6) if isinstance(r[cols.index(c)], float) else r[cols.index(c)] for c in sorted(cols)) for r in data)
    assert cut(df.columns, df.collect()) == cut(want.columns, want.fetchall())


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
