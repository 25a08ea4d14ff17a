import pytest

import __spark_entry__ as entry
from tests.compare import same
from tidewatch.plans.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(name, spark, sf, duck):
    same(QUERIES[name], ORACLES[name], spark, sf, duck)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(name, spark, sf):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark, sf):
    assert set(QUERIES) <= set(entry.queries())
    assert set(ORACLES) <= set(entry.oracle_sql())
    assert entry.entry(spark).columns == ["name", "ts_ms", "value"]


def test_entry_without_the_corpus_package():
    import subprocess
    import sys

    code = "import sys; sys.modules['corpus_pipeline'] = sys.modules['tidewatch.llm'] = None; import __spark_entry__ as e; assert len(e.queries()) > 100 and 'pipeline' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=entry.__file__.rpartition("/")[0])
