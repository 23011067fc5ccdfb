"""The pipeline's stages, each on what the one before kept, against the operators' plain definitions."""

from __future__ import annotations

import pytest

import corpus_pipeline as P

from . import helpers
from .test_near_dedup import brute as components
from .test_secret_scan import brute as secrets
from .test_tokens_packing import check_packed, library  # noqa: F401

SF = "/root/testdata/sf0.001"


def test_stages_in_order():
    assert [name for name, _ in P.STAGES] == ["toxicity", "near_dedup", "secret_scan", "mixing", "packing"]


def test_each_stage(spark, library):  # noqa: F811
    from lodestone.llm import mixing, state

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clean = state.written(P.remove_toxic(spark, docs, SF), "t1")
    assert clean.columns == docs.columns and 0.7 * docs.count() < clean.count() <= docs.count()

    left = state.written(P.remove_near_duplicates(spark, clean, SF), "t2")
    rows = [tuple(r) for r in clean.select("doc_id", "text").collect()]
    assert sorted(r.doc_id for r in left.collect()) == sorted({c for _, _, c, _ in components(rows, 5)})

    safe = state.written(P.redact_secrets(spark, left, SF), "t3")
    assert safe.count() == left.count() and not any(secrets(r.text) for r in safe.collect())
    before = {r.doc_id: r.text for r in left.collect()}
    assert all(r.text == before[r.doc_id] or secrets(before[r.doc_id]) or "[SECRET]" in r.text for r in safe.collect())
    assert all(r.n_chars == len(r.text) for r in safe.collect())

    mixed = state.written(P.mix_sources(spark, safe, SF), "t4")
    _, plan = mixing.laid_out(safe)
    assert mixed.columns == docs.columns and sum(len(helpers.WORD.findall(r.text)) for r in mixed.collect()) == sum(plan.taken)

    packed = P.pack_sequences(spark, mixed, SF)
    assert packed.groupBy("sequence_id").agg({"length": "sum"}).where("`sum(length)` > 1024").count() == 0
    assert packed.where("piece = 0").count() == mixed.count()


@pytest.mark.parametrize("clash", [False, True])
def test_awkward_documents(spark, clash, tmp_path):
    spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    for docs in (helpers.awkward(spark, clash), helpers.empty(spark)):
        for _, stage in P.STAGES:
            from lodestone.llm import state

            docs = state.written(stage(spark, docs, f"file://{tmp_path}"), "awkward")
        assert "sequence_id" in docs.columns
