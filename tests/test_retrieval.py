"""The stored keyword index: pruned reading equals scoring everything; folders of a session."""

from __future__ import annotations

import os
import random
import subprocess
import sys
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from lodestone.operators import retrieval as R
from lodestone.sources import shared, store


@pytest.fixture(scope="module")
def stored(spark):
    """Documents of 30 topics with words of their own beside common ones, some repeated; questions of one topic each."""
    rng = random.Random(4)
    docs = []
    for i in range(1500):
        topic = i % 30
        words = [f"topic{topic}word{rng.randrange(40)}" for _ in range(rng.randrange(5, 60))] + [f"common{rng.randrange(20)}" for _ in range(rng.randrange(30))]
        docs.append((i, " ".join(words)))
    docs += [(2000 + i, docs[7][1]) for i in range(300)] + [(3000, None), (3001, "")]
    asked = [(t, " ".join([f"topic{t}word{rng.randrange(40)}" for _ in range(4)] + ["common3"])) for t in range(0, 30, 3)] + [(90, "unknown things"), (91, None)]
    index = store.save_keyword_index(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), f"{shared.folder(spark)}/idx-pruned", posts_of_bucket=1500)
    return index, spark.createDataFrame(asked, "item_id long, text string")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("k1,b", [(1.5, 0.75), (1.2, 0.3)])
@pytest.mark.parametrize("k,seeds", [(10, 2), (3, 1), (5000, 1)])
def test_pruned_search_equals_scoring_everything(stored, k1, b, k, seeds):
    index, asked = stored
    want = rows(R.bm25_search(replace(index, blocks=None), asked, k, k1=k1, b=b))
    assert rows(R.bm25_search(index, asked, k, k1=k1, b=b, seeds=seeds, direct=0)) == want
    assert rows(R.bm25_search(index, asked, k, k1=k1, b=b)) == want


def test_bounds_hold_and_leave_few_blocks(stored):
    index, asked = stored
    corpus = index.corpus.first()
    terms = R.query_terms(asked, "item_id", "text").join(index.terms.select("term", "idf"), "term")
    bounds = R.block_bounds(index, terms, list(range(index.buckets)), corpus["avg_len"]).toPandas()
    scored = R._scored(index, index.postings.join(terms, "term"), R.K1, R.B).join(index.postings.select("doc", "block").distinct(), "doc").toPandas()
    both = scored.merge(bounds, on=["query", "block"])
    assert len(both) == len(scored) and (both.bound >= both.score - 1e-9).all()
    tenth = scored.sort_values("score").groupby("query").score.apply(lambda s: s.iloc[-10] if len(s) >= 10 else 0.0).rename("least")
    left = bounds.merge(tenth, on="query")
    assert (left.bound >= left.least).mean() < 0.4


def test_only_the_terms_folders_are_read(stored):
    index, asked = stored
    few = asked.where("item_id = 3").withColumn("text", F.lit("topic3word1"))
    found = R.bm25_search(index, few)
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan
    buckets = [r[0] for r in R.query_terms(few, "item_id", "text").select(R.bucket_of(F.col("term"), index.buckets)).collect()]
    read, every = R.in_buckets(index.postings, buckets), index.postings
    assert 0 < read.count() < every.count() / 4
    files = lambda df: df.select(F.input_file_name()).distinct().count()
    assert files(read) < files(every) / 4


def test_blocks_hold_every_document_once(stored):
    index, _ = stored
    per_block = index.postings.select("doc", "block").distinct().groupBy("block").count()
    assert per_block.agg(F.max("count")).first()[0] <= 64
    assert index.postings.select("doc", "block").distinct().count() == index.postings.select("doc").distinct().count()


def test_scratch_removes_all_but_the_result(spark):
    with shared.scratch(spark) as keep:
        inner = shared.written(spark.range(5), "inner")
        kept = keep(inner.selectExpr("id * 2 AS id"), "kept")
    path = inner.inputFiles()[0].replace("file://", "")
    assert not os.path.exists(path) and sorted(r.id for r in kept.collect()) == [0, 2, 4, 6, 8]


def test_a_session_without_a_shared_folder(tmp_path):
    """A fresh process whose settings name no folder: the entry query and another one run, and the folder goes."""
    code = """
import sys; sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
import __spark_entry__ as e
from lodestone.sources import shared
print("ROWS", e.entry(spark).count(), shared.folder(spark))
"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    conf = tmp_path / "conf"
    conf.mkdir()
    done = subprocess.run([sys.executable, "-c", code, root], env=os.environ | {"SPARK_CONF_DIR": str(conf)}, capture_output=True, text=True, timeout=600, cwd=tmp_path)
    assert done.returncode == 0, done.stderr[-3000:]
    _, n, folder = [x for x in done.stdout.splitlines() if x.startswith("ROWS")][0].split(" ")
    assert int(n) > 0 and not os.path.exists(folder.replace("file://", ""))
