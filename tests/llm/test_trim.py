"""Between stages of the pipeline idle workers are asked for what they do not need."""

import gc

import corpus_pipeline
from quillgraph.llm import spark_util


def test_workers_are_trimmed_between_stages(spark, monkeypatch):
    order = []
    monkeypatch.setattr(corpus_pipeline, "table", lambda s, d, name: s.range(8).selectExpr("id as doc_id", "'a b' as text"))
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(n, lambda s, docs, d, n=n: order.append(n) or docs) for n in ("one", "two")])
    trim = corpus_pipeline.trim_workers
    monkeypatch.setattr(corpus_pipeline, "trim_workers", lambda s: order.append("trim") or trim(s))
    assert corpus_pipeline.run(spark, "").count() == 8 and order == ["one", "trim", "two", "trim"]


def test_executors_collect_their_garbage(spark):
    jvm = spark.sparkContext._jvm
    thing = jvm.java.util.ArrayList()
    weak = jvm.java.lang.ref.WeakReference(thing)
    del thing
    gc.collect()
    spark_util.trim_workers(spark)
    assert weak.get() is None
