"""Every query of the engine against its SQL, on the smallest tables."""

import pytest

from deltascope.plans import catalog
from tests.conftest import SF

SQL = catalog.oracle_sql()


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return round(float(v), 9) if isinstance(v, (int, float)) or type(v).__name__ == "Decimal" else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    found = catalog.queries()[name](spark, SF)
    want = duck.execute(SQL[name])
    columns = sorted(found.columns)
    at = [[d[0] for d in want.description].index(c) for c in columns]
    assert sorted(d[0] for d in want.description) == columns
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in found.collect()), key=str)
    assert rows == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=str)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_query_runs(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


def test_latest_status_of_all_users(spark, tmp_path):
    """Every user of the events, however many, and some without events."""
    spark.sql("SELECT id AS event_id, id AS user_id, timestamp'2024-01-01' AS ts, 'click' AS event_type FROM range(1500)").write.parquet(f"file://{tmp_path}/events.parquet")
    found = {r.id: r.status for r in catalog.queries()["scenario_latest_status_all"](spark, f"file://{tmp_path}").collect()}
    assert found == {str(i): "click" if i < 1500 else "a_faire" for i in range(1550)}


def test_hypotheses_over_whole_tables(duck):
    """The SQL covers every order and all its lines."""
    count = lambda text: duck.execute(f"SELECT count(*) FROM ({text})").fetchone()[0]
    assert count(SQL["hyp_sum_lines"]) == count("SELECT DISTINCT l_orderkey FROM lineitem")
    assert count(SQL["hyp_copy"]) == count("SELECT * FROM orders")


def test_entry_imports_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parent.parent, check=True)
