import os
import re

import pytest

from docsignal.plans import registry

from . import compare

pytestmark = pytest.mark.skipif(not os.path.isdir(compare.SF), reason="no driver tables here")


@pytest.fixture(scope="module")
def duck():
    return compare.connect()


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, compare.SF)
    got = compare.ordered(df.columns, [tuple(r) for r in df.collect()])
    assert len(set(df.columns)) == len(df.columns)
    if name in registry.ORACLE_SQL:
        q = duck.execute(registry.ORACLE_SQL[name])
        assert got == compare.ordered([c[0] for c in q.description], q.fetchall())
    else:
        assert got[1]


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_else_imports_the_llm_subpackage():
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, names in os.walk(f"{top}/docsignal"):
        if folder.endswith(("llm", "__pycache__")) or "/llm/" in folder:
            continue
        for n in names:
            if n.endswith(".py"):
                with open(f"{folder}/{n}") as f:
                    assert not re.search(r"^\s*(from|import)\b.*\bllm\b", f.read(), re.M), f"{folder}/{n}"
