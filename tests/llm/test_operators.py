"""The training-data operators against brute force, on small tables with nulls, empty and repeated rows and clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import types as T

from quillgraph.llm import bpe, chat, decontaminate, embedding_dedup, language_id, ngram_join, quality, queries, substring_dedup, token_counts, toxicity
from quillgraph.llm import textkit as K
from quillgraph.llm.spark_util import connected_components

DOCS = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()), ("seed", T.LongType()), ("key", T.StringType()), ("score", T.DoubleType()), ("n", T.LongType()))])


def words(rng, n, pool=None):
    return [rng.choice(pool) if pool else "".join(rng.choice("abcdefghijé") for _ in range(rng.randint(2, 6))) for _ in range(n)]


def docs(spark, texts, ids=None, langs=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, langs[k] if langs else "en", "s", 0, 1, "k", 0.5, 9) for k, (i, t) in enumerate(zip(ids, texts))], DOCS)


ODD = [None, "", "   ", "\n\t", "one", "two words", "ÀÉ ﷺ 漢字 ok", "!!! ???", "a" * 3000, "Same Text here now", "Same Text here now"]


def test_text_kit_finds_words_and_hashes():
    import pyarrow as pa

    texts = ["Ab c", None, "", "x  y\x00z é1", "ab C"]
    data, at = K.text_buffer(pa.array(texts))
    low = K.LOWER[data]
    s, e, w = K.word_spans(low, at, K.ALNUM)
    found = [[bytes(low[s[j] : e[j]]).decode() for j in range(w[i], w[i + 1])] for i in range(len(texts))]
    assert found == [["ab", "c"], [], [], ["x", "y", "z", "é1"], ["ab", "c"]]
    h = K.span_hashes(low, s, e)
    assert h[0] == h[-2] == K.word_hash("ab") and h[1] != h[0]
    g, ga = K.shingle_hashes(h, w, 3, short=True)
    assert np.diff(ga).tolist() == [1, 0, 0, 2, 1] and g[0] == g[-1]


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)] + [(500, i) for i in range(501, 560)] + [(None, 3), (7, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            ra, rb = find(a), find(b)
            root[max(ra, rb)] = min(ra, rb)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# 1 -------------------------------------------------------------------------------------------------------------------------


def test_chains_are_best():
    rng = random.Random(3)
    for _ in range(40):
        pts = sorted({(rng.randrange(40), rng.randrange(40)) for _ in range(rng.randint(1, 9))})
        x, y = np.array([p[0] for p in pts]), np.array([p[1] for p in pts])
        best = {}
        for i in range(len(pts)):
            best[i] = 5.0
            for j in range(i):
                if x[j] < x[i] and y[j] < y[i]:
                    best[i] = max(best[i], best[j] + 5.0 - 0.05 * (x[i] - x[j] + y[i] - y[j]))
        chain = substring_dedup.best_chains(x, y, 5.0)[0]
        got = 5.0 * len(chain) - 0.05 * (x[chain[-1]] - x[chain[0]] + y[chain[-1]] - y[chain[0]])
        assert got == pytest.approx(max(best.values()))
        assert all(x[a] < x[b] and y[a] < y[b] for a, b in zip(chain, chain[1:]))


def test_winnowing_matches_its_definition():
    rng = np.random.default_rng(2)
    sizes = [0, 3, 16, 17, 90, 1]
    at = np.concatenate([[0], np.cumsum(sizes)])
    h = rng.integers(0, 50, at[-1]).astype(np.uint64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    got = substring_dedup._batch_winnow(h, at, owner, 16)
    want = np.concatenate([at[i] + substring_dedup.winnow(h[at[i] : at[i + 1]], 16) for i in range(len(sizes))])
    assert got.tolist() == want.tolist()


def test_repeated_passages(spark):
    rng = random.Random(5)
    a, b, c = words(rng, 60), words(rng, 70), words(rng, 45)
    fuzzy = list(b)
    fuzzy[20], fuzzy[45] = "changed", "other"
    del fuzzy[33]
    texts = [
        " ".join(words(rng, 30) + a + words(rng, 20)),
        " ".join(words(rng, 80)),
        " ".join(words(rng, 10) + a + words(rng, 200) + b + words(rng, 15)),
        " ".join(fuzzy + words(rng, 40)).upper().replace("É", "é"),
        " ".join(c + words(rng, 20)),
        " ".join(words(rng, 20) + c),
        None,
        "",
    ]
    rows = substring_dedup.repeated_passages(docs(spark, texts)).collect()
    got = {(r["doc_id"], r["source_doc_id"]): r for r in rows}
    assert set(got) == {(2, 0), (3, 2)}
    r = got[2, 0]
    assert (r["start_word"], r["end_word"], r["source_start_word"], r["n_matched"], r["similarity"]) == (10, 70, 30, 60, 1.0)
    assert texts[2].encode()[r["start_byte"] : r["end_byte"]].decode().split() == a
    r = got[3, 2]
    assert (r["start_word"], r["end_word"], r["n_matched"]) == (0, 69, 67)
    kept = {r["doc_id"]: r["text"] for r in substring_dedup.remove_repeats(docs(spark, texts)).collect()}
    assert kept[0] == texts[0] and kept[2].split() == texts[2].split()[:10] + texts[2].split()[70:] and len(kept[3].split()) == 40
    assert {i for i in kept} == set(range(8)) and all(kept[i] == texts[i] for i in (0, 1, 4, 5, 6, 7))


def test_repeats_of_many_copies_and_odd_rows(spark):
    rng = random.Random(6)
    p = words(rng, 55)
    texts = [" ".join(p + words(rng, 5)) for _ in range(30)] + ODD
    rows = substring_dedup.repeated_passages(docs(spark, texts, ids=[*range(39), None, 40])).collect()
    assert {r["doc_id"] for r in rows} == set(range(1, 30)) and all(r["end_word"] - r["start_word"] >= 55 for r in rows)
    assert substring_dedup.repeated_passages(docs(spark, [])).count() == 0


def test_every_passage_at_the_similarity_is_found(spark):
    """Lengths and edit rates down to similarity 0.8, with changes at random, evenly spread and near the ends."""
    rng = random.Random(11)
    texts, planted = [], []
    for n, edits in ((50, 1), (50, 2), (50, 5), (50, 10), (55, 3), (55, 11), (60, 3), (60, 6), (60, 12), (80, 12), (80, 16)):
        for kind in ("random", "even", "ends", "mixed"):
            p = words(rng, n)
            at = {"random": rng.sample(range(1, n - 1), edits), "even": [(2 * i + 1) * n // (2 * edits) for i in range(edits)], "ends": [15 + i if i % 2 else n - 16 - i for i in range(edits)], "mixed": rng.sample(range(1, n - 1), edits)}[kind]
            if kind == "mixed":  # half dropped, half changed
                q = [w if i not in at else "changed%d" % rng.randrange(10**6) for i, w in enumerate(p) if i not in at[: edits // 2]]
            else:
                q = [w if i not in at else "changed%d" % rng.randrange(10**6) for i, w in enumerate(p)]
            a, b = np.array([K.word_hash(w) for w in p]), np.array([K.word_hash(w) for w in q])
            if len(q) < 50 or substring_dedup.common_words(a, b) < 0.8 * max(len(p), len(q)):
                continue
            start = rng.randint(0, 40)
            texts += [" ".join(words(rng, 30) + p + words(rng, 30)), " ".join(words(rng, start) + q + words(rng, 30))]
            planted.append((len(texts) - 1, start, len(q)))
    assert len(planted) >= 40
    rows = substring_dedup.repeated_passages(docs(spark, texts)).collect()
    got = {r["doc_id"]: r for r in rows}
    assert all(r["source_doc_id"] == r["doc_id"] - 1 and r["end_word"] - r["start_word"] >= 50 and r["similarity"] >= 0.8 for r in rows)
    assert sorted(got) == [i for i, _, _ in planted]
    for i, start, n in planted:
        r = got[i]
        assert min(r["end_word"], start + n) - max(r["start_word"], start) >= 45
        x, y = ([K.word_hash(w) for w in texts[j].lower().split()[a:b]] for j, a, b in ((i, r["start_word"], r["end_word"]), (i - 1, r["source_start_word"], r["source_end_word"])))
        assert r["n_matched"] <= substring_dedup.common_words(np.array(x), np.array(y))


def test_passages_of_common_sentences_find_their_source(spark):
    """Sentences that stand alone in other documents, first and just before: only their order names the source."""
    rng = random.Random(12)
    for sizes in ((30, 30), (15, 15, 15, 15), (5,) * 12, (10,) * 5):
        parts = [words(rng, n) for n in sizes]
        alone = [" ".join(p + words(rng, 60)) for p in parts for _ in range(2)]
        both = " ".join(w for p in parts for w in p)
        # pairs of neighbours alone as well, so that no seed across a boundary names the source
        pairs = [" ".join(p + q + words(rng, 60)) for p, q in zip(parts, parts[1:]) if len(parts) > 2]
        texts = [*alone, *pairs, " ".join(words(rng, 20)) + " " + both + " " + " ".join(words(rng, 20)), *alone, *pairs, both + " " + " ".join(words(rng, 20))]
        source = len(alone) + len(pairs)
        rows = substring_dedup.repeated_passages(docs(spark, texts)).where(f"doc_id = {len(texts) - 1}").collect()
        assert [(r["source_doc_id"], r["start_word"], r["source_start_word"], r["n_matched"] >= sum(sizes)) for r in rows if r["source_doc_id"] == source] == [(source, 0, 20, True)]


def test_periodic_text_is_not_reported_over_and_over(spark):
    rng = random.Random(13)
    line = words(rng, 10)
    texts = [" ".join(line * 40 + words(rng, 20)), " ".join(words(rng, 10) + line * 40)]
    rows = substring_dedup.repeated_passages(docs(spark, texts)).collect()
    held = {w for r in rows for w in range(r["start_word"], r["end_word"])}
    assert set(range(10, 410)) <= held and len(rows) <= 10


# 2 -------------------------------------------------------------------------------------------------------------------------


def greedy(word: bytes, begins, continues) -> int:
    at, n = 0, 0
    while at < len(word):
        sets = [begins, continues] if at == 0 else [continues]
        step = 0
        for s in sets:
            step = max((k for k in range(1, len(word) - at + 1) if word[at : at + k] in s), default=0)
            if step:
                break
        at, n = at + max(step, 1), n + 1
    return n


def test_token_counts_match_greedy_pieces():
    rng = random.Random(8)
    for _ in range(60):
        piece = lambda: bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 6)))
        begins, continues = {piece() for _ in range(rng.randint(0, 8))}, {piece() for _ in range(rng.randint(0, 12))}
        auto = token_counts.MatchAutomaton(sorted(begins), sorted(continues))
        own = [bytes(rng.choice(b"abcd") for _ in range(rng.randint(1, 14))) for _ in range(40)]
        ends = np.cumsum([len(w) for w in own])
        got = auto.counts(np.frombuffer(b"".join(own), np.uint8), ends - [len(w) for w in own], ends)
        assert got.tolist() == [greedy(w, begins, continues) for w in own]


def test_token_count_query_on_odd_rows(spark):
    import base64

    with open(queries.COUNT_VOCABULARY, "rb") as f:
        pieces = [base64.b64decode(x.split()[0]) for x in f]
    begins, continues = {p[1:] for p in pieces if p[:1] == b" " and len(p) > 1}, {p for p in pieces if p[:1] != b" "}
    texts = ODD + ["The quick brown fox, naïve café"]
    got = token_counts.token_counts(docs(spark, texts), queries.COUNT_VOCABULARY).orderBy("doc_id").collect()
    split = [[w for w in re.split(rb"[ \t-\r]+", (t or "").encode()) if w] for t in texts]
    assert [r["n_tokens"] for r in got] == [sum(greedy(w, begins, continues) for w in s) for s in split]
    assert [r["n_words"] for r in got] == [len(s) for s in split]


# 3 -------------------------------------------------------------------------------------------------------------------------


def test_fm_index_finds_all():
    rng = np.random.default_rng(4)
    for n in (1, 2, 17, 400):
        s = rng.integers(1, 4, n)
        index = decontaminate.FMIndex(s)
        for m in (1, 2, 5):
            p = rng.integers(1, 5, (20, m))
            lo, hi = index.find(p)
            for k in range(20):
                want = [i for i in range(n - m + 1) if (s[i : i + m] == p[k]).all()]
                assert sorted(index.locate(np.arange(lo[k], hi[k])).tolist()) == want


def test_decontamination(spark):
    rng = random.Random(9)
    pool = words(rng, 12)
    items = [(i, " ".join(words(rng, n, pool))) for i, n in enumerate((25, 10, 3, 1, 14))] + [(7, None), (8, ""), (9, "??"), (None, "abc"), (1, "zz yy")]
    texts = [" ".join(words(rng, rng.randint(0, 60), pool)) for _ in range(40)]
    texts += [" - ".join(["qq", *items[0][1].upper().replace("É", "é").split()[4:20], "rr"]), *ODD]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.find_contamination(docs(spark, texts), bench, 10).collect()}
    low = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if c < "\x80" else c for c in t or ""))
    for i, t in enumerate(texts):
        w, hit, found = low(t), set(), set()
        for item, x in items:
            q = low(x)
            if q and item is not None:
                for s in range(max(1, len(q) - 9)):
                    g = q[s : s + 10]
                    for k in range(len(w) - len(g) + 1):
                        if w[k : k + len(g)] == g:
                            hit |= set(range(k, k + len(g)))
                            found.add(str(item))
        assert (got[i]["n_words"], got[i]["n_hit"], got[i]["items"]) == (len(w), len(hit), sorted(found))
        assert got[i]["cleaned"] is None or low(got[i]["cleaned"]) == [x for k, x in enumerate(w) if k not in hit]
    cleaned = decontaminate.remove_contamination(docs(spark, texts), bench, 10)
    assert cleaned.columns == [f.name for f in DOCS] and {r["doc_id"] for r in cleaned.collect()} == {i for i, r in got.items() if not r["n_hit"] or r["n_hit"] < r["n_words"]}
    assert decontaminate.find_contamination(docs(spark, texts[:3]), bench.where("false"), 10).agg({"n_hit": "sum"}).first()[0] == 0


# 4, 7, 10 ------------------------------------------------------------------------------------------------------------------


def corpus(rng, n):
    good, bad = words(rng, 300), ["buy", "now", "CLICK!!", "$$$"]
    rows = []
    for i in range(n):
        q = i % 3 != 0
        rows.append((i, " ".join(words(rng, rng.randint(30, 120), good if q else bad)), int(q)))
    return rows


def test_quality(spark):
    rows = corpus(random.Random(10), 600)
    d = docs(spark, [r[1] for r in rows] + ODD, ids=[*range(600), *range(1000, 1010), None])
    labels = spark.createDataFrame([(r[0], r[2], 0) for r in rows] + [(None, 1, 0), (1000, None, None), (3, 0, 0)], "doc_id long, quality int, toxic int")
    got = quality.quality_scores(d, labels).collect()
    assert len(got) == 611 and all(0 <= r["score"] <= 1 for r in got)
    held = [(r["score"] >= 0.3) == bool(rows[r["doc_id"]][2]) for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 600]
    assert sum(held) / len(held) > 0.95
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got if r["doc_id"] is not None)
    kept = quality.keep_good(d, labels, 0.3)
    assert kept.columns == d.columns and kept.where("doc_id % 3 = 0 and doc_id < 600").count() < 10
    none = quality.quality_scores(d, labels.where("false")).collect()
    assert {r["score"] for r in none} == {0.5} and quality.quality_scores(docs(spark, []), labels).count() == 0


def test_maximal_segments_match_their_definition():
    def slow(s):  # the segment of largest sum, shortest and first, then the same on both sides
        if not any(x > 0 for x in s):
            return []
        total = max(sum(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1))
        i, j = min(((i, j) for i in range(len(s)) for j in range(i + 1, len(s) + 1) if sum(s[i:j]) == total), key=lambda x: (x[1] - x[0], x[0]))
        return [*slow(s[:i]), (i, j, total), *((a + j, b + j, v) for a, b, v in slow(s[j:]))]

    rng = random.Random(11)
    for _ in range(200):
        s = [rng.choice([-7, -3, -2, -1, 1, 2, 5, 11]) + rng.randrange(3) * 0.25 for _ in range(rng.randint(1, 14))]
        got, want = toxicity.maximal_segments(np.array(s)), slow(s)
        assert sum(x[2] for x in got) == pytest.approx(sum(x[2] for x in want)) and max((x[2] for x in got), default=0) == pytest.approx(max((x[2] for x in want), default=0))


def test_toxicity(spark):
    rng = random.Random(12)
    pool, rude = words(rng, 200), ["vile", "scoundrel", "rotter"]
    texts, marks = [], []
    for i in range(900):
        w = words(rng, rng.randint(40, 120), pool)
        if i % 6 == 0:
            at = rng.randrange(len(w))
            w[at:at] = words(rng, 5, rude)
        texts.append(" ".join(w))
        marks.append(int(i % 6 == 0))
    labels = spark.createDataFrame([(i, 1, m) for i, m in enumerate(marks)] + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    d = docs(spark, texts + ODD, ids=[*range(900), *range(2000, 2010), None])
    got = toxicity.toxicity_scores(d, labels).collect()
    assert len(got) == 911 and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 900]
    assert all((r["score"] >= 0.7) == bool(marks[r["doc_id"]]) for r in held)
    for r in held:
        if marks[r["doc_id"]]:
            assert any(set(texts[r["doc_id"]].encode()[s["start"] : s["end"]].decode().split()) & set(rude) for s in r["segments"])
    assert {r["score"] for r in toxicity.toxicity_scores(d, labels.where("false")).collect()} == {0.5}


def test_forward_backward_matches_enumeration():
    from itertools import product

    rng = np.random.default_rng(13)
    sizes = [4, 1, 3, 0, 2]
    at = np.concatenate([[0], np.cumsum(sizes)])
    emit, move = rng.normal(size=(at[-1], 3)), rng.normal(size=(3, 3))
    q, moves = language_id.forward_backward(emit, at, move, pairs=True)
    total = np.zeros((3, 3))
    for i, n in enumerate(sizes):
        if n:
            want, z = np.zeros((n, 3)), 0.0
            pairs = np.zeros((3, 3))
            for path in product(range(3), repeat=n):
                w = np.exp(sum(emit[at[i] + t, y] for t, y in enumerate(path)) + sum(move[a, b] for a, b in zip(path, path[1:])))
                z += w
                for t, y in enumerate(path):
                    want[t, y] += w
                for a, b in zip(path, path[1:]):
                    pairs[a, b] += w
            assert np.allclose(q[at[i] : at[i + 1]], want / z)
            total += pairs / z
    assert np.allclose(moves, total)


def test_language(spark):
    rng = random.Random(14)
    pools = {"aa": ["the", "and", "thing", "other"], "bb": ["der", "und", "schön", "nicht"]}
    langs = ["aa" if i % 2 else "bb" for i in range(300)]
    texts = [" ".join(words(rng, rng.randint(5, 40), pools[x])) for x in langs]
    d = docs(spark, texts + ["the and der und nicht schön"] + ODD, ids=[*range(300), 900, *range(1000, 1010), None], langs=langs + [None] * 12)
    got = {r["doc_id"]: r for r in language_id.predict_languages(d).collect()}
    assert all(got[i]["lang_pred"] == langs[i] for i in range(300) if got[i]["held_out"]) and len(got) == 312
    assert [got[1000 + i]["lang_pred"] for i in (0, 1, 2, 3, 7)] == ["und"] * 5 and got[1004]["lang_pred"] in pools
    assert set(got[900]["word_share"]) == {"aa", "bb"}
    nothing = language_id.predict_languages(docs(spark, ["abc"], langs=[None])).first()
    assert (nothing["lang_pred"], nothing["score"]) == ("und", 0.0)


# 5 -------------------------------------------------------------------------------------------------------------------------


def test_chat(spark):
    texts = ["a <|end|> b", "</s>[INST] ok [/INST]", "<\\</s>", "[\\\\INST] <|turn|><|says|>", "", None, "é\n<s"]
    for t in texts:
        assert chat.unescape(chat.escape(t or "")) == (t or "")
    rows = [(c, i, ("user", "assistant", None, "<|says|>")[i % 4], t) for c in (1, 2, None) for i, t in enumerate(texts)] + [(3, 0, "assistant", "x"), (3, 0, "assistant", "x")]
    got = {r["conv_id"]: r for r in chat.digests(chat.loss_mask(chat.format_paths(chat.linear_messages(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))))).collect()}
    assert set(got) == {1, 2, 3, None}
    want = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in rows[:7])
    learnt = "".join(t or "" for _, _, r, t in rows[:7] if r == "assistant")
    for c in (1, 2, None):
        assert got[c]["n_turns"] == 7 and got[c]["turns_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    assert got[3]["n_turns"] == 2


def test_reply_trees(spark):
    rng = random.Random(15)
    parent = {i: (None if i == 0 else rng.randrange(max(0, i - 6), i)) for i in range(60)}
    score = {i: rng.random() for i in parent}
    m = spark.createDataFrame([(1, i, p, score[i], "user", f"t{i}") for i, p in parent.items()] + [(2, 5, 99, None, "user", "root")], "conv long, node long, parent long, score double, role string, text string")
    path = {}
    for r in chat.reply_paths(m).where("conv = 1").collect():
        path.setdefault((r["leaf"], r["rank"]), {})[r["position"]] = r["node"]
    want = {}
    for leaf in set(parent) - set(parent.values()):
        x, p = leaf, []
        while x is not None:
            p.append(x)
            x = parent[x]
        want[leaf] = p[::-1]
    assert {k[0]: [v[i] for i in range(len(v))] for k, v in path.items()} == want
    order = sorted(want, key=lambda x: (-sum(score[i] for i in want[x]) / len(want[x]), -len(want[x]), x))
    assert [leaf for leaf, _ in sorted(path, key=lambda k: k[1])] == order
    assert {(r["conv"], r["leaf"]) for r in chat.format_paths(m, branches=1).collect()} == {(1, order[0]), (2, 5)}


# 6 -------------------------------------------------------------------------------------------------------------------------


def test_multi_sequence_is_in_order():
    rng = np.random.default_rng(16)
    a, b = rng.random(7), rng.random(5)
    got = embedding_dedup.multi_sequence(a, b, 35)
    assert sorted(got) == [(i, j) for i in range(7) for j in range(5)]
    sums = [a[i] + b[j] for i, j in got]
    assert sums == sorted(sums)


def test_embeddings(spark):
    rng = np.random.default_rng(17)
    base = rng.normal(size=(60, 16))
    x = np.concatenate([base[rng.integers(0, 60, 400)] + rng.normal(size=(400, 16)) * 0.18, rng.normal(size=(100, 16))])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, x[3].tolist()) for i in range(5)]
    odd = [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [float("nan")] + [1.0] * 15), (2004, [None] + [1.0] * 15), (None, [1.0] * 16), (2005, [1.0, 2.0]), (2006, [1.0, 2.01])]
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>"), 0.95).collect()}
    u = np.stack([np.array(v) for _, v in rows])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    links = (u @ u.T) >= 0.95
    want = dict(zip([i for i, _ in rows], links.sum(1) - 1))
    assert len(got) == len(rows) + len(odd) and all(got[i]["n_links"] <= n for i, n in want.items())
    assert sum(got[i]["n_links"] for i in want) >= 0.95 * sum(want.values())
    assert all(got[1000 + i]["component_id"] == got[3]["component_id"] for i in range(5))
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(2000, 2005)) and got[2006]["component_id"] == 2005 and not got[2006]["kept"]
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# 8 -------------------------------------------------------------------------------------------------------------------------


def brute_components(texts, ids, k, percent):
    sets = []
    for t in texts:
        w = [x for x in re.split("[ \t-\r]+", "".join(c.lower() if c < "\x80" else c for c in t or "")) if x]
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * len(sets[a] | sets[b]):
                ra, rb = find(ids[a]), find(ids[b])
                root[max(ra, rb)] = min(ra, rb)
    return [len(s) for s in sets], [find(i) for i in ids]


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_jaccard_join(spark, k, percent):
    rng = random.Random(18)
    texts = []
    for n in (4, 8, 9, 10, 11, 12, 14, 20, 25, 33, 60, 150, 400):
        base = words(rng, n)
        for _ in range(7):
            w = list(base)
            for _ in range(rng.choice((0, 0, 1, 1, 2, max(1, n // 40)))):
                at = rng.choice((0, len(w) - 1, rng.randrange(len(w))))
                w[at : at + rng.randint(0, 1)] = words(rng, rng.randint(0, 1))
            texts.append(" ".join(w))
    texts += ODD
    ids = rng.sample(range(1000), len(texts))
    n, comp = brute_components(texts, ids, k, percent)
    got = {r["doc_id"]: r for r in ngram_join.ngram_components(docs(spark, texts, ids), k, percent).collect()}
    assert [got[i]["n_shingles"] for i in ids] == n and [got[i]["component_id"] for i in ids] == comp
    kept = ngram_join.keep_one_of_each(docs(spark, texts, ids), k, percent)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(comp)) and kept.columns == [f.name for f in DOCS]


def test_forest_with_failing_edges_is_completed(spark, monkeypatch):
    rng = random.Random(19)
    base = words(rng, 80)
    texts = []
    for _ in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(80)] = rng.choice("xyz")
        texts.append(" ".join(w))
    monkeypatch.setattr(ngram_join, "_close", lambda n, maps, row_at, size, i, j, percent: np.ones(len(i), bool))
    n, comp = brute_components(texts, list(range(60)), 3, 90)
    key, doc = np.zeros(60, np.int64), np.arange(60)
    a, b = ngram_join.list_pairs(key, np.full(60, 78), np.zeros(60, int), [b"\0" * 16] * 60, doc, 90, True)
    assert len(a) == 59
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_components(docs(spark, texts), 3, 90).collect()}
    assert [got[i] for i in range(60)] == comp


# 9 -------------------------------------------------------------------------------------------------------------------------


def test_bpe(spark, monkeypatch):
    enc = bpe.encoding(queries.BPE_RANKS, public_tokenizers.PATTERN)
    assert isinstance(enc, tiktoken.Encoding)
    rng = random.Random(20)
    long = [" ".join(words(rng, 30000)), "x" * 120_000, " " * 60_000 + "a", "\n \t a'll   b's" * 9000, "<|endoftext|> don't"]
    for t in long:
        assert bpe.encode(t, enc) == enc.encode_ordinary(t) and "".join(bpe.safe_parts(t)) == t
    texts = ODD + long[-2:]
    for r in bpe.encode_documents(docs(spark, texts), queries.BPE_RANKS, public_tokenizers.PATTERN, ("ids", "decoded", "digests")).collect():
        t = texts[r["doc_id"]] or ""
        ids = enc.encode_ordinary(t)
        assert (r["ids"], r["n_tokens"], bytes(r["decoded"])) == (ids, len(ids), t.encode())
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and r["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(21)
    item, passage = words(rng, 15), words(rng, 60)
    pool = words(rng, 4000)
    rows = []
    for i in range(80):
        rows.append(" ".join(words(rng, 20) + (item if i == 5 else []) + words(rng, 60, pool) + (passage if i in (7, 9) else []) + words(rng, 20)))
    rows += [rows[0], " ".join(["spam"] * 50), None, ""] + [" ".join(["spam"] * n) for n in range(30, 60)]
    d = docs(spark, rows)
    d.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 81), 0) for i in range(len(rows))], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    names = [s[0] for s in corpus_pipeline.STAGES]
    assert len(names) == 5
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(range(1, 80)) <= set(got) and 80 not in got and 0 in got and not set(range(84, len(rows))) & set(got)
    enc = bpe.encoding(queries.BPE_RANKS, public_tokenizers.PATTERN)
    text = {i: enc.decode(list(got[i]["ids"])) for i in got}
    assert all(text[i] == rows[i] for i in range(80) if i not in (5, 9))
    assert " ".join(item) not in text[5] and passage[10] + " " + passage[11] not in text[9] and " ".join(passage) in text[7]
