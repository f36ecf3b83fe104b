"""The pipeline as a whole: its stages one by one give the same rows, and only
those rows' table stays in the shared folder."""

import os
from urllib.parse import urlparse

import corpus_pipeline
from cairn.session import ensure_checkpoint_dir

SF_DIR = "/root/testdata/sf0.001"


def test_run_equals_its_stages_and_leaves_one_table(spark, tmp_path):
    folder = urlparse(ensure_checkpoint_dir(spark)).path
    before = set(os.listdir(folder))
    out = corpus_pipeline.run(spark, SF_DIR)
    left = {f for f in os.listdir(folder) if f.startswith("cairn-")} - before
    assert len(left) == 1 and "tokens" in next(iter(left))
    docs = corpus_pipeline.table(spark, SF_DIR, "documents")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / str(k))
        stage(spark, docs, SF_DIR).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == columns or k == len(corpus_pipeline.STAGES) - 1, name
    assert out.exceptAll(docs).count() == 0 == docs.exceptAll(out).count()
    assert 0 < out.count()
