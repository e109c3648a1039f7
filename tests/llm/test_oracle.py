"""Every query with SQL gives DuckDB's rows on the whole tables."""

import duckdb
import pytest

from rulegrain.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(queries.ORACLE[name])
    names = sorted(d[0] for d in want.description)
    order = [[d[0] for d in want.description].index(n) for n in names]
    rows = sorted(tuple(r[k] for k in order) for r in want.fetchall())
    df = queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == names
    got = sorted(tuple(r) for r in df.select(*names).collect())
    assert len(got) == len(rows)
    assert [(g, w) for g, w in zip(got, rows, strict=True) if g != w][:3] == []
