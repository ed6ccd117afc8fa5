"""Candidate pairs are made once, however often their verification counts them."""

from pyspark.sql import DataFrame

from quillgraph.llm import ngram_join


def test_candidate_pairs_are_stored_before_they_are_verified(spark, monkeypatch):
    checked, verified = [], ngram_join.verified
    monkeypatch.setattr(ngram_join, "verified", lambda pairs, *a: checked.append(pairs) or verified(pairs, *a))
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text), (2, text + " more"), (3, "other words stand here")], "doc_id long, text string")
    plans = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(ngram_join, "drop", lambda df: None)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_components(docs, 3, 90).collect()}
    assert got == {1: 1, 2: 1, 3: 3}
    assert checked and all(isinstance(p, DataFrame) and "MapInArrow" not in plans(p) for p in checked)
