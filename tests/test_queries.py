"""Every registered query with SQL against DuckDB on the smallest tables."""

import math
import os
import sys
from pathlib import Path

import pytest

SF = os.environ.get("IDSYNC_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
import __spark_entry__ as entry  # noqa: E402

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(frame):
    shown = lambda v: "" if v is None or v != v else f"{v:.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v) else str(v)
    columns = sorted(frame.columns)
    return columns, sorted(tuple(shown(v) for v in row) for row in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, name):
    assert plain(QUERIES[name](spark, SF).toPandas()) == plain(duck.execute(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(n for n in set(QUERIES) - set(SQL) if not n.startswith("p") or n in ("p6_found", "player_sync")))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
