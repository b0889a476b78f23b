"""Every query with SQL against DuckDB on the smallest tables, and the rule that nothing here needs the llm package."""

import os
import re
from pathlib import Path

import pytest

import __spark_entry__ as entry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
ROOT = Path(__file__).resolve().parent.parent
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in Path(DATA).iterdir():
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def plain(v):
    import pandas as pd

    if hasattr(v, "tolist") and not isinstance(v, str):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    if v is None or pd.isna(v):
        return "null"
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return f"{float(v):.8g}"
    return str(v).removesuffix(" 00:00:00")


def rows(df):
    columns = sorted(df.columns)
    return columns, sorted(tuple(map(plain, r)) for r in df[columns].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, duck, name):
    assert rows(entry.queries()[name](spark, DATA).toPandas()) == rows(duck.execute(entry.oracle_sql()[name]).df())


def test_nothing_imports_llm():
    for path in (ROOT / "palimpsest").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not re.search(r"import .*\bllm\b|from \S*\bllm\b", path.read_text()), path
