"""Collocations against plain counting, and the defined cases."""

import re
from collections import Counter

import numpy as np

from vitrine.llm.collocations import collocations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, min_count, top, within, max_words):
    """rows: (group, text)."""
    counts, out = {}, []
    for group, text in rows:
        c = counts.setdefault(group or "und", Counter())
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            for k in range(1, max_words + 1):
                c.update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    for group, c in counts.items():
        n = sum(v for p, v in c.items() if len(p) == 1)
        cand = {p: v for p, v in c.items() if len(p) >= 2 and v >= min_count}
        found = []
        for p, a in cand.items():
            if any(len(q) > len(p) and 100 * b >= within * a and any(q[i:i + len(p)] == p for i in range(len(q))) for q, b in cand.items()):
                continue
            score, _, l, r = min((10**6 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((group, rank, p.decode(), -a, l, r, n, -s))
    return sorted(out)


def rows(seed=3, n=120):
    rng = np.random.default_rng(seed)
    words = ["New", "york", "CITY", "é", "x", "Ünder", "the", " ", "a­b"]
    out = []
    for i in range(n):
        text = "".join(str(rng.choice(words)) + str(rng.choice([" ", " ", " ", "\t", "  ", ". ", "\n", "\r", "; ", "!"])) for _ in range(rng.integers(0, 60)))
        out.append((i, [None, "en", "fr"][i % 3], text))
    return out + [(1000, "en", None), (1001, "de", ""), (1002, "fr", out[1][2]), (1002, "fr", out[1][2]), (1003, None, " . \t!")]


def test_equals_plain_counting(spark):
    data = rows()
    docs = spark.createDataFrame(data, "doc_id long, lang string, text string")
    for min_count, top, within, max_words in [(10, 2000, 50, 3), (3, 7, 30, 3), (2, 50, 80, 4), (5, 20, 50, 2)]:
        got = collocations(docs, min_count=min_count, top=top, within=within, max_words=max_words).collect()
        assert sorted(map(tuple, got)) == plain([r[1:] for r in data], min_count, top, within, max_words)
        assert got


def test_products_beyond_64_bits(spark):
    """Counts near 2^33 make products beyond 64 bits; the score stays exact."""
    from vitrine.llm.collocations import scored

    a, l, r = 6_000_000_001, 8_589_934_593, 7_589_934_597
    counts = spark.createDataFrame([("g", "a b", 2, a), ("g", "a", 1, l), ("g", "b", 1, r)], "grp string, phrase string, k int, f long")
    assert scored(counts).first()["score"] == 10**6 * a * a // (l * r)


def test_empty_table_and_clashing_names(spark):
    empty = spark.createDataFrame([], "doc_id long, lang string, text string")
    assert collocations(empty).collect() == []
    odd = spark.createDataFrame([("a b " * 20, "q", 1, "z", 2)], "text string, phrase string, f long, lang string, rank int")
    assert [tuple(r) for r in collocations(odd, min_count=5).orderBy("rank").collect()] == [
        ("z", 1, "a b a", 19, 20, 20, 40, 902500), ("z", 2, "b a b", 19, 20, 20, 40, 902500)]
