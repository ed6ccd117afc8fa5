"""Rows that repeat a doc_id, with the same or with other texts, and hot groups, for the operators that compare documents."""

import random

import pytest
from test_operators import brute_components, docs, words

from quillgraph.llm import ngram_join, spark_util, substring_dedup


def test_passages_stay_with_their_own_text(spark):
    """A span found in one text of a doc_id is not cut out of another one, whatever its bytes."""
    rng = random.Random(31)
    p = words(rng, 60)
    held = " ".join(words(rng, 10) + p)
    for other in ("é" * 700, " ".join(words(rng, 90))):
        d = docs(spark, [" ".join(p + words(rng, 5)), held, other], ids=[1, 2, 2])
        rows = substring_dedup.repeated_passages(d).collect()
        assert [(r["doc_id"], r["source_doc_id"], r["start_word"]) for r in rows] == [(2, 1, 10)]
        kept = sorted(r["text"].strip() for r in substring_dedup.remove_repeats(d).where("doc_id = 2").collect())
        assert kept == sorted([" ".join(held.split()[:10]), other])


def test_each_text_of_an_id_is_a_source_and_has_passages(spark):
    rng = random.Random(32)
    p, q = words(rng, 60), words(rng, 70)
    texts = [" ".join(p), " ".join(words(rng, 20) + q), " ".join(q + words(rng, 90) + p), " ".join(p + words(rng, 15)), " ".join(q + p)]
    d = docs(spark, [*texts, texts[2]], ids=[1, 1, 2, 2, 1, 2])
    got = {(r["doc_id"], r["text_key"], r["start_word"], r["end_word"]) for r in substring_dedup.repeated_passages(d).collect()}
    assert {(i, a, b) for i, _, a, b in got} == {(2, 0, 70), (2, 160, 220), (2, 0, 60)} and len({k for _, k, _, _ in got}) == 2
    kept = [r["text"] for r in substring_dedup.remove_repeats(d).where("doc_id = 2").collect()]
    assert sorted(len(t.split()) for t in kept) == [15, 90, 90]


def test_hot_seed_matched_inside_slices(spark, monkeypatch):
    """A line that nearly every document holds, and a passage that only the source and the last one share."""
    rng = random.Random(33)
    line, p = words(rng, 55), words(rng, 80)
    texts = [" ".join(words(rng, 10) + line + (p if i in (7, 59) else []) + words(rng, 10)) for i in range(60)]
    rows = substring_dedup.repeated_passages(docs(spark, texts)).collect()
    assert {r["doc_id"] for r in rows} == set(range(1, 60)) and all(r["source_doc_id"] < r["doc_id"] for r in rows)
    held = {w for r in rows if r["doc_id"] == 59 for w in range(r["start_word"], r["end_word"])}
    assert set(range(10, 145)) <= held


def test_packed_numbers():
    import numpy as np

    for v in ([], [5], [7] * 9, [-(2**63), 2**63 - 1, 0], list(range(-3, 300)), [2**40, 2**40 + 1]):
        x = np.array(v, np.int64)
        if len(x):
            assert substring_dedup._unpack_numbers(substring_dedup._pack_numbers(x)).tolist() == v


def test_cover_is_smallest():
    rng = random.Random(34)
    for _ in range(300):
        spans = sorted({(0, a, a + rng.randint(1, 9)) for a in (rng.randint(0, 20) for _ in range(rng.randint(1, 7)))}, key=lambda s: (s[0], s[1], -s[2]))
        got = substring_dedup._cover(spans)
        whole = {x for _, a, b in spans for x in range(a, b)}
        hold = lambda pick: {x for i in pick for x in range(*spans[i][1:])}  # noqa: E731, B023
        assert hold(got) == whole
        least = min(bin(m).count("1") for m in range(1, 1 << len(spans)) if hold([i for i in range(len(spans)) if m >> i & 1]) == whole)
        assert len(got) == least


@pytest.mark.parametrize("percent", [80, 90])
def test_components_over_repeated_ids(spark, percent):
    rng = random.Random(35)
    a, b = words(rng, 40), words(rng, 50)
    near = " ".join([*b, "more"])
    texts, ids = [" ".join(a), " ".join(a), " ".join(b), near], [1, 5, 5, 9]
    for _ in range(40):
        base = words(rng, rng.choice((5, 12, 30)))
        for _ in range(rng.randint(1, 3)):
            w = list(base)
            if rng.random() < 0.6:
                w[rng.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
            ids.append(rng.randrange(20, 60))
    n, comp = brute_components(texts, ids, 3, percent)
    got = ngram_join.ngram_components(docs(spark, texts, ids), 3, percent).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(zip(ids, n, comp))
    assert {r["component_id"] for r in got if r["doc_id"] in (1, 5, 9)} == {1}


def test_one_row_of_a_repeated_document_stays(spark):
    rng = random.Random(36)
    a, b = " ".join(words(rng, 30)), " ".join(words(rng, 30))
    kept = ngram_join.keep_one_of_each(docs(spark, [a, a, a, b, None, b, None], ids=[1, 1, 2, 1, 4, None, None]))
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == sorted([(1, a), (1, b), (4, ""), (0, b), (0, "")])


def test_long_lists_in_blocks(spark, monkeypatch):
    """Lists cut into blocks find the links that whole lists find."""
    rng = random.Random(37)
    base = words(rng, 60)
    texts = []
    for _ in range(80):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(60)] = rng.choice("xyzw")
        texts.append(" ".join(w))
    monkeypatch.setattr(ngram_join, "LIST_ROWS", 7)
    n, comp = brute_components(texts, list(range(80)), 3, 80)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_components(docs(spark, texts), 3, 80).collect()}
    assert [got[i] for i in range(80)] == comp


def test_join_of_hot_keys(spark):
    rows = spark.range(6000).selectExpr("id", "case when id % 2 = 0 then 1 else id end as k")
    keyed = spark.range(6000).selectExpr("id as k", "id * 10 as x")
    got = spark_util.join_hot(rows, keyed, ["k"], "left")
    assert got.count() == 6000 and got.where("x is null or x <> k * 10").count() == 0 and got.columns == ["k", "id", "x"]
