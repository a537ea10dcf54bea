"""The driver's contract: all queries import, agree with DuckDB on small tables, and stand without the llm folders."""

import re
import shutil
import subprocess
import sys
from decimal import Decimal
from pathlib import Path

import pytest

from exactframe import catalog

ROOT = Path(__file__).resolve().parent.parent
SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")


def plain(v):
    if isinstance(v, Decimal):
        return format(v.normalize(), "f")
    return "null" if v is None else v.isoformat() if hasattr(v, "isoformat") else str(v)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_agrees_with_sql(spark, name):
    c = duckdb.connect()
    for t in catalog.FILES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, SF)
    want = c.sql(catalog.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    at = [want.columns.index(x) for x in df.columns]
    assert sorted(tuple(map(plain, r)) for r in df.collect()) == sorted(tuple(plain(r[k]) for k in at) for r in want.fetchall())


def test_float_arithmetic_on_odd_discounts(spark, tmp_path):
    """A negative zero divides to Infinity, as the SQL has it."""
    odd = ["-0.0", "0.0", "nan", "inf", "-inf", "5e-324", "-5e-324", "1e308", "-1e308", "1e16", "0.07", "-0.05"]
    rows = ", ".join(f"({k}, '{v}'::DOUBLE)" for k, v in enumerate(odd)) + f", ({len(odd)}, NULL)"
    c = duckdb.connect()
    c.sql(f"CREATE TABLE lineitem AS SELECT l.* REPLACE (k::BIGINT AS l_orderkey, v AS l_discount) FROM (SELECT * FROM '{SF}/lineitem.parquet' LIMIT 1) l, (VALUES {rows}) o(k, v)")
    c.sql(f"COPY lineitem TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    have = sorted(tuple(map(plain, r)) for r in catalog.QUERIES["float_arithmetic"](spark, str(tmp_path)).select("l_orderkey", "l_linenumber", "x", "y").collect())
    assert have == sorted(tuple(map(plain, r)) for r in c.sql(catalog.SQL["float_arithmetic"]).fetchall())
    assert [r[2:] for r in have if r[0] == "0"] == [("1.0", "inf")]


@pytest.mark.parametrize("name", ["row_number", "rank", "dense_rank", "window_sum_all", "window_sum_running", "window_sum_around"])
def test_windows_over_all_orders(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() == spark.read.parquet(f"{SF}/orders.parquet").count()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_stands_without_llm(tmp_path):
    shutil.copytree(ROOT / "exactframe", tmp_path / "exactframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'flagship' in q and 'pipeline' not in q and not any(n.startswith('op') for n in q if n[2:3].isdigit()); print(len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin", "PYTHONPATH": str(tmp_path)})
    assert done.returncode == 0, done.stderr


def test_nothing_imports_llm():
    for p in (ROOT / "exactframe").rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"\bllm\b", p.read_text()), p
