"""The registered queries against their SQL, and the entry module without its removable part."""

import decimal
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from chatterforge import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def sql(sf_dir):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return float(v) if v % 1 else int(v)
    return v


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_its_sql(spark, sf_dir, sql, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    found = sql.sql(catalog.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(found.columns)
    names = sorted(df.columns)
    mine = sorted(repr([plain(r[c]) for c in names]) for r in df.collect())
    rows = [dict(zip(found.columns, r)) for r in found.fetchall()]
    assert mine == sorted(repr([plain(r[c]) for c in names]) for r in rows)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_corpus_part():
    """The guard holds where the corpus modules cannot be found."""
    root = Path(__file__).resolve().parents[1]
    code = (
        "import sys, importlib.abc\n"
        "class Gone(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name == 'corpus_pipeline' or name.startswith('chatterforge.llm'):\n"
        "            raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert 'pipeline' not in e.queries() and not any(n.startswith('op') for n in e.queries())\n"
        "assert e.oracle_sql() and len(e.queries()) > 40\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)


def test_nothing_outside_imports_the_corpus_part():
    root = Path(__file__).resolve().parents[1] / "chatterforge"
    for path in root.rglob("*.py"):
        if "llm" not in path.parts:
            assert "chatterforge.llm" not in path.read_text(), path
