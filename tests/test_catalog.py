"""Every named query against its SQL, on the smallest test tables."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT / "tools"))

from check import compare  # noqa: E402

from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402
from cohortwise.catalog import REGISTRY  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for path in sorted(Path(SF).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", list(queries()))
def test_query_agrees_with_sql(spark, con, name):
    note, _, good = compare(spark, con, name, SF)
    assert good, note


def test_entry_is_the_stability_index(spark):
    assert entry(spark).columns == ["variable", "bucket", "frequency_x", "proportion_x", "frequency_y", "proportion_y", "ie"]


def test_sql_belongs_to_queries():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("missing", ["public_tokenizers", "regex", "cohortwise.llm", "corpus_pipeline"])
def test_entry_without_an_optional_module(missing):
    """Whatever the text queries lack, the others are there."""
    code = f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; q = e.queries(); print(len(q), any(n.startswith('op') for n in q), set(e.oracle_sql()) <= set(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.stdout.split() == [str(len(REGISTRY)), "False", "True"], done.stderr
