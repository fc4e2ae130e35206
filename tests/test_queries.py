"""Every query with SQL, on the smallest tables, the way the driver compares them."""

import importlib
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from oracle import compare, connection  # noqa: E402

MODULES = ["timeline", "describe", "space", "artefacts", "more", "further"]
ALL = [(m, n) for m in MODULES for n in importlib.import_module(f"stratamesh.plans.{m}").QUERIES]


@pytest.fixture(scope="module")
def con(sf):
    return connection(sf)


@pytest.mark.parametrize(("module", "name"), ALL)
def test_query(spark, sf, con, module, name):
    m = importlib.import_module(f"stratamesh.plans.{module}")
    if name in m.SQL:
        assert compare(spark, con, m.QUERIES[name], m.SQL[name], sf) == ""
    else:
        m.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()


def test_entry_needs_no_session():
    import subprocess

    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(len(q))"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
