"""Registered queries over stores, streams and hooks against DuckDB."""
import duckdb
import pytest
from conftest import SF001

from tessera.plans import registry_stores as RS
from tessera.session import ensure_checkpoint_dir


def plain(rows):
    return sorted(repr(tuple(round(x, 6) if isinstance(x, float) else x for x in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(RS.QUERIES))
def test_equals_sql(spark, name):
    ensure_checkpoint_dir(spark)
    con = duckdb.connect()
    for t in ("part", "documents", "benchmark", "embeddings", "labels", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    got = RS.QUERIES[name](spark, SF001)
    want = con.sql(RS.ORACLE_SQL[name])
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    rows = got.select(*cols).collect()
    assert rows and plain(rows) == plain(want.select(*cols).fetchall())


def test_preview_and_order(spark):
    ranked = RS.q_fragment_preview(spark, SF001).collect()
    assert [r.score for r in ranked] == sorted((r.score for r in ranked), reverse=True)
    assert all(r.preview.startswith("Fragment(score=") and len(r.preview) <= len("Fragment(score=0.000, text=)") + 60 for r in ranked)
