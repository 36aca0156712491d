"""Block-max WAND against full scoring, and the retrieval with its check against brute force over all pairs."""

import math

import numpy as np
import pytest

from vitrine.llm.bm25_decontam import B, K1, Index, clean, contaminated, matches, overlap, question_and_answer, words_of


def make(seed=0, n_items=60, n_docs=80):
    rng = np.random.default_rng(seed)
    p = 1 / np.arange(1, 301)
    p /= p.sum()
    vocab = np.array([f"w{k}" for k in range(300)])

    def prose(n):
        w = rng.choice(vocab, n, p=p).tolist()
        return " ".join(x + ("." if rng.random() < 0.1 else "") for x in w)

    items = [(k, prose(rng.integers(3, 60)) + rng.choice(["", "?", "."]) + " " + prose(rng.integers(1, 8))) for k in range(n_items)]
    docs = []
    for d in range(n_docs):
        text = prose(int(rng.choice([0, 5, 80, 400, 3000], p=[0.05, 0.15, 0.4, 0.3, 0.1])))
        for k in rng.choice(n_items, rng.integers(0, 3), replace=False):
            words = items[k][1].split(" ")
            if rng.random() < 0.4:  # a near copy
                words[rng.integers(len(words))] = "changed"
            body = text.split(" ")
            at = int(rng.integers(0, len(body) + 1))
            text = " ".join(body[:at] + [w.upper() for w in words] + body[at:])
        docs.append((d, text))
    return items, docs


def statistics(items):
    freq = {}
    for _, t in items:
        for w in set(words_of(t)):
            freq[w] = freq.get(w, 0) + 1
    return freq, len(items), float(np.mean([len(words_of(t)) for _, t in items]))


def plain_scores(items, passage):
    freq, n, mean = statistics(items)
    out = []
    for _, t in items:
        words = words_of(t)
        weight = {w: math.log(1 + (n - freq[w] + 0.5) / (freq[w] + 0.5)) * words.count(w) * (K1 + 1)
                  / (words.count(w) + K1 * (1 - B + B * len(words) / mean)) for w in set(words)}
        out.append(sum(x for w, x in weight.items() if w in passage) / sum(weight.values()))
    return out


def plain_matches(items, docs, min_score, min_overlap):
    window = max(64, *(len(words_of(t)) for _, t in items))
    found = {}
    for d, text in docs:
        words = words_of(text or "")
        for start in range(0, max(1, len(words) - window), window):
            passage = words[start:start + 2 * window]
            for (i, t), s in zip(items, plain_scores(items, set(passage))):
                q, a = question_and_answer(t)
                if s >= min_score and overlap(q, passage) >= min_overlap and overlap(a, passage) >= min_overlap:
                    found[d, i] = max(s, found.get((d, i), 0))
    return found


@pytest.mark.parametrize("min_score", [0.2, 0.5, 0.9])
def test_search_finds_all_above_the_threshold(min_score):
    items, docs = make()
    index = Index.build(items, *statistics(items), min_score)
    for _, text in docs[:40]:
        passage = words_of(text)[:128]
        want = {k: s for k, s in enumerate(plain_scores(items, set(passage))) if s >= min_score}
        got = dict(index.search(passage, min_score))
        assert got.keys() == want.keys()
        assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


@pytest.mark.parametrize("min_score", [0.3, 0.5])
def test_first_step_drops_no_result(min_score):
    items, docs = make(3)
    index = Index.build(items, *statistics(items), min_score)
    got = {(d, m["item_id"]): m["score"] for (d, _), ms in zip(docs, matches(index, [t for _, t in docs], min_score, 0.8)) for m in ms}
    want = plain_matches(items, docs, min_score, 0.8)
    assert got.keys() == want.keys() and len(want) > 20
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


@pytest.mark.parametrize("shard_chars", [16_000_000, 3000])
def test_on_spark(spark, shard_chars):
    items, docs = make(5)
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, item_id int")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in contaminated(d.drop("item_id"), b, shard_chars=shard_chars).collect()}
    assert got == set(plain_matches(items, docs, 0.5, 0.8)) or shard_chars < 16_000_000 and got >= {k for k, s in plain_matches(items, docs, 0.5, 0.8).items()}
    left = {r["doc_id"] for r in clean(d, b, shard_chars=shard_chars).collect()}
    assert left == {i for i, _ in docs} - {x for x, _ in got}
    assert clean(d, b).columns == d.columns


def test_question_and_answer():
    assert question_and_answer("What is it? A thing.") == (["what", "is", "it"], ["a", "thing"])
    assert question_and_answer("One two. Three four.") == (["one", "two"], ["three", "four"])
    assert question_and_answer("a b c d e f g h") == (list("abcdef"), list("gh"))
    assert question_and_answer("one") == ([], ["one"])


def test_edge_rows(spark):
    d = spark.createDataFrame([(1, "x where is the red house on the hill it is in town y"), (1, "x where is the red house on the hill it is in town y"), (2, None), (3, ""),
                               (None, "Where is the red house on the hill? It is in town"), (4, "where is the red house on the hill"), (5, "z " * 200_000)], "doc_id long, text string")
    b = spark.createDataFrame([(9, "Where is the red house on the hill? It is in town."), (9, "Where is the red house on the hill? It is in town."), (8, None), (7, ""), (6, "...")], "item_id long, text string")
    assert sorted((r["doc_id"] or -1, r["item_id"]) for r in contaminated(d, b).collect()) == [(-1, 9), (1, 9), (1, 9)]
    assert sorted(r["doc_id"] for r in clean(d, b).collect()) == [2, 3, 4, 5]
    assert contaminated(d, b.limit(0)).count() == 0 and clean(d, b.limit(0)).count() == d.count()
    assert contaminated(d.limit(0), b).count() == 0


def test_items_with_ids_of_any_type(spark):
    from vitrine.llm.bm25_decontam import clean, contaminated

    text = "which planet of the inner system turns backwards around its own axis? the planet venus turns backwards very slowly"
    items = spark.createDataFrame([("q-1", text), (None, "some other question about rivers and lakes? the river nile flows north")], "item_id string, text string")
    docs = spark.createDataFrame([(1, f"before {text} after"), (2, "nothing of that kind here")], "doc_id long, text string")
    assert [(r["doc_id"], r["item_id"]) for r in contaminated(docs, items).collect()] == [(1, "q-1")]
    assert [r["doc_id"] for r in clean(docs, items).collect()] == [2]
    assert contaminated(docs, items.limit(0)).schema["item_id"].dataType.simpleString() == "string"
