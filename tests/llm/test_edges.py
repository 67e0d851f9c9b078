"""Every operator and stage on rough and on empty tables."""

import time
from pathlib import Path

import pytest
import cases
from pyspark.sql import functions as F

import corpus_pipeline
from seqtables.llm.common import settled
from seqtables.llm.queries import QUERIES
from seqtables.session import release


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    rough = cases.save(
        tmp_path_factory.mktemp("rough"),
        spark,
        documents=cases.rough(spark),
        benchmark=cases.bench_items(spark),
        pages=cases.pages(spark),
        embeddings=cases.vectors(spark),
    )
    nothing = cases.save(
        tmp_path_factory.mktemp("empty"),
        spark,
        documents=cases.empty(spark),
        benchmark=cases.bench_items(spark).limit(0),
        pages=cases.pages(spark).limit(0),
        embeddings=cases.vectors(spark).limit(0),
    )
    return rough, nothing


EXPECTED = {"op1_language_id": len(cases.ROWS) + 8, "op3_url_filter": 8, "op5_decontamination": 1, "op11_whitening": 12 * 4}


@pytest.mark.parametrize("name", list(QUERIES))
def test_rough_and_empty_tables(spark, folders, name):
    rough, nothing = folders
    found = QUERIES[name](spark, rough).collect()
    assert len(found) == EXPECTED.get(name, len(cases.ROWS))
    assert QUERIES[name](spark, nothing).collect() == []


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_keep_columns(spark, folders, stage):
    rough, nothing = folders
    docs = spark.read.parquet(f"{rough}/documents.parquet")
    out = stage(spark, docs, rough)
    if stage is not corpus_pipeline.STAGES[-1][1]:
        assert out.columns == docs.columns
    assert 0 < out.count() <= len(cases.ROWS)
    assert stage(spark, spark.read.parquet(f"{nothing}/documents.parquet"), nothing).count() == 0


def test_shuffle_files_of_settled_tables_are_released(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f for folder in manager.localDirs() for f in Path(folder.toString()).rglob("shuffle_*.data")}
    before = files()
    counts = settled(spark.range(10_000).groupBy((F.col("id") % 7).alias("key")).count())
    assert files() - before
    for _ in range(20):  # Spark learns of a table's end by one collection and deletes its files some time after it
        release(spark, 0.0)
        if not files() - before:
            break
        time.sleep(0.2)
    assert not files() - before
    assert counts.count() == 7
