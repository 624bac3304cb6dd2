"""Every named query against its SQL on the smallest tables, and the driver contract."""

import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as driver
from compare import difference, duck

SF_DIR = "/root/testdata/sf0.001"
WITHOUT_SQL = ["c3_encode", "c15_project2d", "m4_smote", "s8_schema_report"]


@pytest.fixture(scope="module")
def connection():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(driver.oracle_sql()))
def test_query_equals_sql(spark, connection, name):
    assert difference(driver.queries()[name](spark, SF_DIR), connection, driver.oracle_sql()[name]) is None


def test_every_sql_has_its_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_entry(spark):
    assert driver.entry(spark).columns == ["bloc", "submitted", "approved", "rate"]
    assert driver.entry(spark).count() == 5


@pytest.mark.parametrize("name", WITHOUT_SQL)
def test_queries_without_sql_give_rows(spark, name):
    assert driver.queries()[name](spark, SF_DIR).count() > 0


def test_driver_contract_without_the_optional_part():
    code = (
        "import sys; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e;"
        "assert e.queries() and e.oracle_sql() and not any(n.startswith('op') or n == 'pipeline' for n in e.queries())"
    )
    root = Path(driver.__file__).resolve().parent
    assert subprocess.run([sys.executable, "-c", code], cwd=root, check=False).returncode == 0
