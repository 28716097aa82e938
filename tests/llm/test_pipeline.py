"""The pipeline, and that the rest stands without it."""

from collections import Counter

import corpus_pipeline
from glintscan.llm import decontaminate, quality, simhash

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    source = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER).cache()
        if name != "shards":
            assert out.columns == source.columns
        ids = {r.doc_id for r in out.select("doc_id").collect()}
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        assert ids <= before
        if name == "quality_rules":
            assert ids == {r.doc_id for r in quality.repetition(docs).where("kept").collect()}
        if name == "near_dedup":
            assert ids == {r.component_id for r in simhash.near_groups(docs).collect()}
        if name == "decontamination":
            bench = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
            hit = {r.doc_id for r in decontaminate.contaminated(docs, bench).collect()}
            assert hit and ids == before - hit
        if name == "shards":
            assert out.count() == docs.count()
        docs = out
    again = corpus_pipeline.run(spark, FOLDER).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, docs.collect()))
