"""Every catalogue query against its SQL, and that the library stands without its optional parts."""

import subprocess
import sys
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from loomgraph import catalogue

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_matches_sql(spark, tables, name):
    got = catalogue.queries()[name](spark, str(DATA))
    columns = sorted(got.columns)
    expected = tables.sql(catalogue.oracle_sql()[name])
    assert columns == sorted(expected.columns)
    picked = expected.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall()
    assert Counter(map(tuple, got.select(*columns).collect())) == Counter(picked)


def test_every_sql_has_its_query():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())
    assert set(catalogue.queries()) == set(catalogue.oracle_sql())


def test_entry_point_without_optional_parts():
    code = """
import sys
class Absent:
    def find_spec(self, name, path=None, target=None):
        if name == 'corpus_pipeline' or name.startswith('loomgraph.llm'):
            raise ModuleNotFoundError(f'No module named {name!r}', name=name)
sys.meta_path.insert(0, Absent())
import __spark_entry__ as e
assert set(e.queries()) and not any(n.startswith('op') for n in e.queries()) and 'pipeline' not in e.queries()
assert set(e.oracle_sql()) <= set(e.queries())
"""
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[1], check=True)


def test_every_statement_and_line_is_there(spark, tables, monkeypatch):
    """Edges of lineitem and lines after the third too."""
    queries, n = catalogue.queries(), spark.read.parquet(str(DATA / "lineitem.parquet")).count()
    for name in ("load_ntriples_uri_filter", "encode_roundtrip", "store_loaded"):
        got = queries[name](spark, str(DATA))
        assert got.where("p LIKE '%hasPart'").count() == got.where("p LIKE '%suppliedBy'").count() == n
    built = []
    monkeypatch.setattr(catalogue.Store, "build", lambda given, build=catalogue.Store.build: built.append(given) or build(given))
    assert queries["answer_decoded"](spark, str(DATA)).count() == queries["path3"](spark, str(DATA)).count()
    assert built[0].count() == queries["scan_triples"](spark, str(DATA)).count()
    assert queries["kway_merge"](spark, str(DATA)).count() == n
