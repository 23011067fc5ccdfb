"""Every registered query against its SQL, row by row, at the smallest scale."""

from __future__ import annotations

import pytest

from lodestone.plans import answering, catalogue  # noqa: F401

from .conftest import DATA, comparable

SF = "sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, f"{DATA}/{SF}")
    names, rows = duck(SF, catalogue.ORACLE_SQL[name])
    assert sorted(names) == sorted(got.columns)
    order = sorted(names)
    assert comparable([tuple(r) for r in got.collect()], got.columns, order) == comparable(rows, names, order)


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
