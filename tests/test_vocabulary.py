"""Long vocabularies: the automaton against the regex on the fixed lists and a plain search on random ones."""

import random
import time

import pytest

from vitrine.functions import vocab
from vitrine.functions.text import COLORS_RX, SIZES_RX, match_vocab
from vitrine.functions.sqltext import X
from vitrine.operators import vocabulary as V


@pytest.mark.parametrize("seed", range(20))
def test_automaton_equals_a_plain_search(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("AB É-1") for _ in range(rng.randint(1, 5)))
    words = {w for w in (word() for _ in range(60)) if w.strip() == w and w}
    found = V.automaton(words)
    for _ in range(50):
        text = "".join(rng.choice("AB É-1_") for _ in range(60))
        want, at = [], 0
        while at < len(text):
            hit = max((w for w in words if text.startswith(w, at) and V._bound(text, at) and V._bound(text, at + len(w))), key=len, default=None)
            if hit:
                want.append(hit)
            at += len(hit) if hit else 1
        assert V.hits(text, found) == want


def test_equals_the_regex_of_the_fixed_lists(spark, monkeypatch):
    colors = [w for w in vocab.COLORS]
    texts = ["Bleu marine et ROUGE, or bleu", "noir-blanc/noirs", None, "", "écru É bleu_marine", "multicolore multicolor"] + [
        f"{a} {b}{c}" for a in colors[:12] for b in ("x", "-") for c in colors[:12]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    regex = df.select("i", match_vocab(X("t"), COLORS_RX).alias("r").col).orderBy("i").collect()
    monkeypatch.setattr(V, "SHORT", 0)
    fast = df.select("i", V.match_words("t", colors).alias("r")).orderBy("i").collect()
    assert [r["r"] for r in fast] == [r["r"] for r in regex]


def test_short_lists_are_a_regex_and_long_ones_are_checked(spark, monkeypatch):
    df = spark.createDataFrame([("a big red box",)], "t string")
    assert "Python" not in df.select(V.match_words("t", ["red", "big red"]))._jdf.queryExecution().executedPlan().toString()
    assert df.select(V.match_words("t", ["red", "big red"]).alias("h")).first()["h"] == ["BIG RED"]
    assert df.select(V.match_words("t", []).alias("h")).first()["h"] == []
    monkeypatch.setattr(V, "MOST_CHARS", 5)
    with pytest.raises(ValueError):
        V.match_words("t", ["red", "big red"])
    with pytest.raises(ValueError):
        V.match_table(df, "t", df, "t")


def test_hundred_thousand_entries():
    rng = random.Random(1)
    words = {"".join(rng.choice("ABCDEFGHIJ") for _ in range(8)) for _ in range(100_000)}
    found = V.automaton(words)
    some = rng.sample(sorted(words), 2000)
    text = " ".join(w + (" x" if i % 2 else "") for i, w in enumerate(some))
    t = time.perf_counter()
    assert V.hits(text, found) == some
    assert time.perf_counter() - t < 2
