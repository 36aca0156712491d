"""Merged transforms against a plain suffix sort, and removal against every string of the length."""

import hashlib

import numpy as np
import pytest

from vitrine.llm.bwt import Shard, least_of_repeats, merged_intervals
from vitrine.llm.bwt_dedup import anchors, remove_repeats


def matrix(strings):
    out = np.zeros((len(strings), max(map(len, strings), default=1) or 1), np.uint8)
    for k, s in enumerate(strings):
        out[k, :len(s)] = np.frombuffer(s, np.uint8)
    return out, np.array([len(s) for s in strings])


def test_merged_intervals_and_common_prefixes():
    rng = np.random.default_rng(0)
    strings = [bytes(rng.integers(97, 99, rng.integers(0, 14)).astype(np.uint8)) for _ in range(60)] + [b"abab"] * 5 + [b"\x00\x00", b"\xff", b"ab" * 20]
    m, n = matrix(strings)
    cuts = [(0, 20), (20, 21), (21, len(strings))]
    shards = [Shard(m[a:b], n[a:b]) for a, b in cuts]
    suffixes = []
    for s, (a, b) in zip(shards, cuts):
        want = sorted(((tuple(c + 1 for c in strings[a + k][o:]) + (0,), k, o) for k in range(b - a) for o in range(n[a + k] + 1)), key=lambda x: x[:2])
        assert list(zip(s.string.tolist(), s.offset.tolist())) == [(k, o) for _, k, o in want]
        assert s.transform.tolist() == [strings[a + k][o - 1] + 1 if o else 0 for _, k, o in want]
        suffixes += [(a + k, o) for _, k, o in want]
    texts = [strings[k][o:] for k, o in suffixes]

    def shared(x, y):
        p = 0
        while p < min(len(x), len(y)) and x[p] == y[p]:
            p += 1
        return p

    for length in (1, 4, 30):
        place, block, common = merged_intervals(shards, length)
        assert common.tolist() == [max(min(length, shared(t, u)) for j, u in enumerate(texts) if j != i) for i, t in enumerate(texts)]
        again = {t[:length] for i, t in enumerate(texts) if len(t) >= length and any(u[:length] == t[:length] for j, u in enumerate(texts) if j != i)}
        assert sorted(place.tolist()) == [i for i, t in enumerate(texts) if len(t) >= length and t[:length] in again]
        got = [texts[p][:length] for p in place]
        assert got == sorted(got) and len({(b, g) for b, g in zip(block.tolist(), got)}) == len(set(got)) == (block.max() + 1 if len(block) else 0)


@pytest.mark.parametrize("shard_strings", [3, 1000])
def test_least_of_repeats(shard_strings):
    rng = np.random.default_rng(1)
    strings = [bytes(rng.integers(97, 99, rng.integers(4, 12)).astype(np.uint8)) for _ in range(80)]
    m, n = matrix(strings)
    value = rng.permutation(80)
    got = least_of_repeats(m, n, value, 5, shard_strings)
    for k, s in enumerate(strings):
        for o in range(len(s) - 4):
            assert got[k, o] == min(value[j] for j, t in enumerate(strings) if s[o:o + 5] in t)


def test_equal_strings_have_equal_anchors():
    rng = np.random.default_rng(2)
    shared = rng.integers(97, 123, 120).astype(np.uint8)
    buf = np.concatenate((rng.integers(97, 123, 500).astype(np.uint8), shared, rng.integers(97, 123, 300).astype(np.uint8), shared))
    ends = np.array([0, 30, 30, 700, 760, len(buf)])
    at, key = anchors(buf, ends)
    doc = np.searchsorted(ends, at, side="right")
    for s in range(len(buf) - 49):
        d = int(np.searchsorted(ends, s, side="right"))
        if s + 50 <= ends[d]:
            assert ((at >= s) & (at + 24 <= s + 50) & (doc == d)).any()
    left = {int(a) - 500 for a in at if 526 <= a <= 570}
    right = {int(a) - 920 for a in at if 946 <= a <= 990}
    assert left == right and left


def plain_removal(rows, length=50):
    first = {}
    for i, t in rows:
        raw = (t or "").encode()
        if i is not None:
            for s in range(len(raw) - length + 1):
                g = raw[s:s + length]
                first[g] = min(i, first.get(g, i))
    out = []
    for i, t in rows:
        raw = (t or "").encode()
        gone = [False] * len(raw)
        if i is not None:
            for s in range(len(raw) - length + 1):
                if first[raw[s:s + length]] < i:
                    gone[s:s + length] = [True] * length
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((i, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept))
    return out


def corpus(seed, n=60):
    rng = np.random.default_rng(seed)
    letters = np.array(list("abcdé 日"))
    prose = lambda k: "".join(rng.choice(letters, k))
    shared = [prose(int(k)) for k in rng.integers(40, 200, 8)]
    rows = []
    for i in range(n):
        text = prose(int(rng.integers(0, 300)))
        for s in rng.choice(shared, rng.integers(0, 3)):
            a, b = sorted(rng.integers(0, len(s) + 1, 2).tolist()) if rng.random() < 0.4 else (0, len(s))
            at = int(rng.integers(0, len(text) + 1))
            text = text[:at] + s[a:b] + text[at:]
        rows.append((i, text))
    rows += [(n, rows[3][1]), (n + 1, rows[3][1]), (n + 2, "x" * 49), (n + 3, "x" * 49), (n + 4, "y" * 50), (n + 5, "y" * 51), (n + 6, "z" * 500), (n + 7, "z" * 400),
             (n + 8, "ab" * 300), (n + 9, "ba" * 300), (n + 10, None), (n + 11, ""), (None, rows[3][1]), (5, rows[3][1]), (5, rows[3][1])]
    # a hot passage whose ends differ everywhere
    rows += [(n + 20 + k, prose(30) + shared[0][:60] + prose(30)) for k in range(25)]
    return rows


@pytest.mark.parametrize("group_bytes,hot_groups,bucket_bytes", [(1 << 22, 500, 1 << 24), (600, 500, 2000), (400, 3, 1 << 24)])
def test_as_every_string(spark, group_bytes, hot_groups, bucket_bytes):
    rows = corpus(group_bytes)
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, kept string").repartition(3)
    out = remove_repeats(df, group_bytes=group_bytes, hot_groups=hot_groups, bucket_bytes=bucket_bytes)
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted((tuple(r) for r in out.collect()), key=key) == sorted(plain_removal(rows), key=key)


def test_long_text_and_empty(spark):
    rng = np.random.default_rng(9)
    text = "".join(rng.choice(list("abcdefgh"), 2_300_000))
    rows = [(1, text[1_048_000:1_049_400]), (2, text), (3, text[:100])]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"]) for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (1400, 0, 0), 2: (2_300_000, 1400, 1), 3: (100, 100, 1)}
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_ids_that_are_no_whole_numbers_are_refused(spark):
    import pytest

    from vitrine.llm.bwt_dedup import remove_repeats

    with pytest.raises(TypeError, match="whole-numbered"):
        remove_repeats(spark.createDataFrame([("a", "x")], "doc_id string, text string"))
