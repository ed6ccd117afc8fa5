"""Wide tables of the n-gram join are kept compressed, not as checkpoints of plain rows."""

from quillgraph.llm import ngram_join


def test_wide_tables_are_compressed(spark, monkeypatch):
    plain, cut = [], ngram_join.cut
    monkeypatch.setattr(ngram_join, "cut", lambda df: plain.append(set(df.columns)) or cut(df))
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text), (2, text + " more"), (3, "other words stand here")], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_components(docs, 3, 90).collect()}
    assert got == {1: 1, 2: 1, 3: 3}
    assert not any(c & {"bits", "items", "firsts"} or {"key", "pos"} <= c for c in plain)
