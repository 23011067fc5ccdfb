"""Stored cells: the same rows as comparing everything, and how much is read."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import cells, retrieval
from lodestone.sources import shared


def frames(spark, rows, asked):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "doc long, vec array<double>").repartition(3), spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "query long, vec array<double>")


def clustered(seed, n=3000, width=12, groups=40, spread=0.05):
    rng = np.random.default_rng(seed)
    middle = rng.standard_normal((groups, width)) * 3
    return middle[rng.integers(0, groups, n)] + spread * rng.standard_normal((n, width)), middle[rng.integers(0, groups, 25)] + spread * rng.standard_normal((25, width))


def rows_of(df):
    return sorted(tuple(r) for r in df.select("query", "doc", "score", "rank").collect())


@pytest.mark.parametrize("spread,steps", [(0.05, (4, 32)), (0.05, (1,)), (3.0, (4, 32))])
def test_cells_give_what_all_rows_give(spark, spread, steps):
    vectors, asked = frames(spark, *clustered(3, spread=spread))
    stored = cells.save_cells(vectors, shared.fresh_path(spark, "cells"))
    assert rows_of(cells.nearest(stored, asked, 7, steps)) == rows_of(retrieval.dense(vectors, asked, 7))
    if spread < 1:  # with clusters most rows are never read
        assert cells.read_share(stored, asked, 7, steps) < 0.35


def test_radius_holds_every_row_and_parts_split_large_cells(spark):
    rows = np.concatenate([np.tile([1.0, 2.0], (900, 1)), np.random.default_rng(1).standard_normal((300, 2))])
    vectors, asked = frames(spark, rows, np.array([[1.0, 2.0], [-1.0, 0.5], [0.0, 0.0]]))
    stored = cells.save_cells(vectors, shared.fresh_path(spark, "cells"), part_rows=100)
    both = stored.members.join(stored.cells, "cell").toPandas()
    off = np.linalg.norm(np.stack(both.vec) - np.stack(both.centre), axis=1)
    assert (off <= both.radius + 1e-9).all() and len(both) == 1200
    assert both.groupby(["cell", "part"]).size().max() < 250 and stored.cells.agg(F.max("parts")).first()[0] >= 9
    assert rows_of(cells.nearest(stored, asked, 5)) == rows_of(retrieval.dense(vectors, asked, 5))  # 900 ties: the smallest ids


def test_small_and_empty_tables(spark):
    vectors, asked = frames(spark, np.array([[1.0, 0.0], [0.5, 0.5]]), np.array([[1.0, 1.0]]))
    few = cells.save_cells(vectors, shared.fresh_path(spark, "cells"))
    assert rows_of(cells.nearest(few, asked, 5)) == rows_of(retrieval.dense(vectors, asked, 5))
    none = cells.save_cells(vectors.limit(0), shared.fresh_path(spark, "cells"))
    assert cells.nearest(none, asked).count() == 0 and cells.nearest(few, asked.limit(0)).count() == 0
