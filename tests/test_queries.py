"""Every query of the engine runs, and gives the rows of its SQL where it has some."""

import pytest
from conftest import SF
from oracle import rows

from votemill import plans

QUERIES, SQL = plans.queries(), plans.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in SQL:
        assert rows(got) == rows(duck.execute(SQL[name]).fetchdf())
    else:
        assert len(got.columns)


def test_entry_imports_without_a_session():
    import subprocess
    import sys

    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], capture_output=True, text=True, cwd=__file__.rsplit("/", 2)[0])
    assert out.returncode == 0, out.stderr
    assert set(SQL) <= set(QUERIES)
