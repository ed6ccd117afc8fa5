"""Ways beyond a bound give what the way below it gives."""

import random

import numpy as np
from test_operators import ODD, docs, words

from quillgraph.llm import decontaminate, embedding_dedup, language_id, toxicity


def test_many_phrase_sets_find_what_one_finds(spark, monkeypatch):
    rng = random.Random(51)
    items = [words(rng, n) for n in (4, 12, 25, 10, 30)]
    texts = [" ".join(words(rng, 15) + sum((rng.choice(items) for _ in range(rng.randint(0, 2))), []) + words(rng, 15)) for _ in range(25)] + ODD
    d = docs(spark, [*texts, texts[0]], ids=[*range(len(texts) - 1), None, 0])
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)] + [(9, None)], "item_id long, text string")
    one = sorted(map(repr, decontaminate.find_contamination(d, bench).collect()))
    kept = sorted(map(repr, decontaminate.remove_contamination(d, bench).collect()))
    monkeypatch.setattr(decontaminate, "PASS_PHRASES", 3)
    assert sorted(map(repr, decontaminate.find_contamination(d, bench).collect())) == one and any("contaminated" not in r and "Row" in r for r in one)
    assert sorted(map(repr, decontaminate.remove_contamination(d, bench).collect())) == kept


def test_model_as_a_table_scores_alike(spark, monkeypatch):
    rng = random.Random(52)
    clean, bad = words(rng, 200), words(rng, 15)
    texts = [" ".join(rng.choices(clean, k=40) + (rng.choices(bad, k=12) if i % 4 == 0 else [])) for i in range(240)] + ODD
    d = docs(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(240)], "doc_id long, toxic int")
    one = {r["doc_id"]: r["score"] for r in toxicity.toxicity_scores(d, labels).collect()}
    monkeypatch.setattr(toxicity, "MODEL_WORDS", 0)
    two = {r["doc_id"]: r["score"] for r in toxicity.toxicity_scores(d, labels).collect()}
    assert one.keys() == two.keys() and all(abs(one[i] - two[i]) < 1e-9 for i in one)
    assert min(one[i] for i in range(0, 240, 4)) > max(one[i] for i in range(240) if i % 4)


def test_every_language_is_learned(spark):
    rng = random.Random(53)
    pools = {f"l{i}": ["".join(rng.choice("abcdefghijklmnop"[i : i + 6]) for _ in range(5)) for _ in range(40)] for i in range(10)}
    names = [n for n in pools for _ in range(12)]
    texts = [" ".join(rng.choices(pools[n], k=30)) for n in names]
    d = docs(spark, texts, langs=names)
    got = language_id.predict_languages(d, train_docs=5).collect()  # fewer documents than languages
    assert np.mean([r["lang_pred"] == names[r["doc_id"]] for r in got]) > 0.8 and {r["lang_pred"] for r in got} == set(pools)


def test_rare_links_are_found(spark):
    """Few links, all at the threshold: made pairs decide how many cells are visited."""
    rng = np.random.default_rng(54)
    x = rng.normal(size=(1500, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(40):
        away = rng.normal(size=32)
        away -= (away @ x[i]) * x[i]
        x[1400 + i] = 0.951 * x[i] + np.sqrt(1 - 0.951**2) * away / np.linalg.norm(away)
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), 0.95).collect()}
    found = sum(got[1400 + i]["component_id"] == i for i in range(40))
    assert found >= 38 and sum(r["n_links"] for r in got.values()) >= 76
