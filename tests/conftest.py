from __future__ import annotations

import math
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from lodestone.session import session

    shared = f"file://{tmp_path_factory.mktemp('shared')}"
    s = session("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__checkpoint__dir=shared, spark__driver__memory="4g")
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    """Runs SQL on the tables of a scale factor: (column names, rows)."""
    import duckdb

    def run(sf: str, sql: str):
        c = duckdb.connect()
        for f in os.listdir(f"{DATA}/{sf}"):
            c.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{DATA}/{sf}/{f}')")
        r = c.execute(sql)
        return [d[0] for d in r.description], r.fetchall()

    return run


def comparable(rows, names, order):
    at = [names.index(c) for c in order]
    return sorted((tuple("nan" if isinstance(r[i], float) and math.isnan(r[i]) else r[i] for i in at) for r in rows), key=str)
