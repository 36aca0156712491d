"""SimHash trie join against a comparison of every pair of fingerprints."""

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from vitrine.llm.components import connected_components
from vitrine.llm.simhash_trie import fingerprint, fingerprint_links, keep_one, near_duplicates


def plain_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ")
             .replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(ids, fps, budget=4):
    root = {i: i for i in ids}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, x in zip(ids, fps):
        for b, y in zip(ids, fps):
            if a < b and bin(x ^ y).count("1") <= budget:
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return {i: find(i) for i in ids}


TEXTS = [None, "", " \t\n", "One", "one", "a b c", "A B C D", "a b c d e f g h i j", "a b c d e f g h i j",
         "Ä b\x0bc\rd é f", "nbsp joined words stay one", "x " * 5000, "the cat sat on the mat " * 40, "the cat sat on the mat " * 41]


def test_fingerprints_as_defined():
    for t in TEXTS:
        assert fingerprint(t) == plain_fingerprint(t), t


def planted(n, seed):
    """Random fingerprints, with balls of near ones around some of them."""
    rng = np.random.default_rng(seed)
    fps = set(rng.integers(0, 2**63, n, dtype=np.uint64).tolist())
    for c in list(fps)[: n // 10]:
        for _ in range(6):
            x = c
            for b in rng.choice(64, rng.integers(1, 6), replace=False).tolist():
                x ^= 1 << b
            fps.add(x)
    return sorted(fps)


@pytest.mark.parametrize("unit", [20_000, 8])
def test_links_join_what_all_pairs_join(spark, unit):
    fps = planted(300, 3)
    rows = [(int(np.uint64(f).astype(np.int64)), i) for i, f in enumerate(fps)]
    links = fingerprint_links(spark.createDataFrame(rows, "fp long, node long"), unit=unit)
    got = {r["node"]: r["component"] for r in connected_components(links).collect()}
    want = plain_components(range(len(fps)), fps)
    assert {i: got.get(i, i) for i in range(len(fps))} == want
    assert len(set(want.values())) < len(fps)


def test_hot_ball_is_split(spark):
    rng = np.random.default_rng(5)
    base = int(rng.integers(0, 2**63))
    fps = sorted({base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (400, 2))})
    rows = [(int(np.array([f], np.uint64).view(np.int64)[0]), i) for i, f in enumerate(fps)]
    links = fingerprint_links(spark.createDataFrame(rows, "fp long, node long"), unit=16)
    assert {r["component"] for r in connected_components(links).collect()} == {0}


def test_edge_rows(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "a b c", "x"), (3, "One", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = [(r["doc_id"], r["fp"] & (2**64 - 1), r["component_id"]) for r in near_duplicates(docs).collect()]
    want = plain_components(range(len(TEXTS)), [plain_fingerprint(t) for t in TEXTS])
    assert len(got) == len(rows)
    for i, fp, c in got:
        if i is not None:
            assert (fp, c) == (plain_fingerprint(TEXTS[i]), want[i])
    kept = sorted(r["doc_id"] for r in keep_one(docs).where("doc_id IS NOT NULL").collect())
    assert kept == sorted(set(want.values()))
    assert keep_one(docs).columns == docs.columns
    assert near_duplicates(docs.limit(0)).count() == 0


def test_one_id_with_two_texts(spark):
    a, b, c = ("the quick brown fox jumps over it", "rain falls on the old stone bridge", "no text of the others at all")
    rows = [(1, a), (1, b), (1, a), (2, a), (3, b), (4, c), (5, "x y z"), (5, "X Y  Z"), (6, None), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = [(r["doc_id"], r["text"]) for r in keep_one(docs).collect()]
    assert sorted(r for r in kept if r[0] < 5) == sorted([(1, a), (1, b), (4, c)])
    assert sorted(i for i, _ in kept if i > 4) == [5, 6]
    of = {(r["doc_id"], r["fp"]): r["component_id"] for r in near_duplicates(docs.where("doc_id > 0")).collect()}
    assert {i: c for (i, _), c in of.items()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6}


def test_components_against_a_plain_walk(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (250, 2))] + [(i, i + 1) for i in range(500, 560)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {}
    find = lambda a: a if root.setdefault(a, a) == a else find(root[a])
    for a, b in edges[:-1]:
        ra, rb = find(a), find(b)
        root[max(ra, rb)] = min(ra, rb)
    linked = {x for a, b in edges[:-1] if a != b for x in (a, b)}
    assert got == {a: find(a) for a in linked}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_a_null_id_links_others(spark, monkeypatch):
    """1 - null - 3 in a chain: neighbours within four bits, the ends further apart."""
    from pyspark.sql import functions as F

    from vitrine.llm import simhash_trie

    monkeypatch.setattr(simhash_trie, "fingerprint_column", lambda text, shingle: F.conv(text, 16, 10).cast("long"))
    docs = spark.createDataFrame([(1, "00"), (None, "0f"), (3, "ff"), (4, "ffff00"), (None, "ff000000")], "doc_id long, text string")
    got = {(r["doc_id"], r["fp"]): r["component_id"] for r in simhash_trie.near_duplicates(docs).collect()}
    assert got == {(1, 0): 1, (None, 0x0F): 1, (3, 0xFF): 1, (4, 0xFFFF00): 4, (None, 0xFF000000): None}
    assert sorted((r["doc_id"] or 0, r["text"]) for r in simhash_trie.keep_one(docs).collect()) == [(0, "0f"), (0, "ff000000"), (1, "00"), (4, "ffff00")]
