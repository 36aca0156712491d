"""Packing: token ids against the library, places against their definition, the solver against small cases."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from vitrine.llm.packing import combinations, ids_crc32, layout, pack, solve

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(rows, pieces, window):
    """rows: list of (doc_id, ids); pieces: (doc_id, start, length, crc, doc_tokens, sequence_id, offset)."""
    sequences, docs = {}, {}
    for doc, start, length, crc, total, seq, offset in pieces:
        assert length > 0
        sequences.setdefault(seq, []).append((offset, length))
        docs.setdefault((doc, total), []).append((start, length, crc))
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    want = {}
    for doc, ids in rows:
        want.setdefault((doc, len(ids)), []).append(ids)
    assert docs.keys() == want.keys()
    for key, texts in want.items():
        assert sum(length for _, length, _ in docs[key]) == sum(map(len, texts))
        if len(texts) == 1:
            at = 0
            for start, length, crc in sorted(docs[key]):
                assert start == at
                at += length
                assert zlib.crc32(np.array(texts[0][start:at], "<u4").tobytes()) == crc
            assert at == key[1]
    return padding


def run(spark, rows, window=2048):
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(5)
    found, kind = pack(docs, PATH, window=window)
    out = found.select("doc_id", "start", "length", ids_crc32(found["ids"], kind).alias("crc"), "doc_tokens", "sequence_id", "offset").collect()
    tok = Tokenizer.from_file(PATH)
    return check([(r[0], tok.encode(r[1] or "", add_special_tokens=False).ids + [1]) for r in rows], out, window)


@pytest.mark.parametrize("window", [64, 2048])
def test_pieces_hold_every_id_once(spark, window):
    rng = np.random.default_rng(4)
    words = ["The", "quick", "brown", "fox,", "don't", "naïve", "123", "…", "日本", "supercalifragilistic", "J̌", "x\x1cy"]
    rows = [(i, " ".join(rng.choice(words, rng.integers(0, 200))), 0) for i in range(150)]
    rows += [(1000, None, 0), (1001, "", 0), (None, "no id", 0), (1002, "again and again", 0), (1002, "again and again", 0), (1003, "word " * 9000, 0),
             (1004, "a <|endoftext|> b", 0), (1005, " \n\t ", 0)]
    assert run(spark, rows, window) == 0


def test_equal_lengths_and_few_rows(spark):
    assert run(spark, [(i, "one two three four five six", 0) for i in range(101)], 16) == 0
    assert run(spark, [(1, "alone", 0)]) == 0


def test_empty_table(spark):
    found, _ = pack(spark.createDataFrame([], "doc_id long, text string"), PATH)
    assert found.columns == ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    assert found.collect() == []


def test_combinations_fill_the_window():
    lengths = np.array([1, 3, 4, 7, 9, 12])
    first, places, repeats = combinations(lengths, 16)
    found = set()
    for lo, hi in zip(first, [*first[1:], len(places)]):
        combo = tuple((int(lengths[p]), int(r)) for p, r in zip(places[lo:hi], repeats[lo:hi]))
        assert sum(a * r for a, r in combo) == 16 and all(r > 0 for _, r in combo)
        found.add(combo)
    assert len(found) == len(first)
    want = set()
    for a in lengths.tolist():
        for i in range(1, 17):
            if a * i == 16:
                want.add(((a, i),))
            want |= {((a, i), (b, j)) for b in lengths.tolist() if b > a for j in range(1, 17) if a * i + b * j == 16}
            want |= {((a, 1), (b, 1), (c, 1)) for b in lengths.tolist() for c in lengths.tolist() if a < b < c and a + b + c == 16}
    assert found == want


def test_solver_reaches_an_exact_solution():
    """Counts made of known repeat counts: almost nothing is left over, no repeat count is negative."""
    rng = np.random.default_rng(1)
    lengths = np.arange(1, 64)
    first, places, repeats = combinations(lengths, 64)
    x = np.zeros(len(first))
    x[rng.choice(len(first), 40, replace=False)] = rng.integers(1, 500, 40)
    owner = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(places))))
    counts = np.bincount(places, weights=repeats * x[owner], minlength=len(lengths))
    got = solve(first, places, repeats, counts, rounds=500)
    assert (got >= 0).all()
    left = counts - np.bincount(places, weights=repeats * got[owner], minlength=len(lengths))
    assert np.linalg.norm(left) < 0.05 * np.linalg.norm(counts)


def test_most_rests_stay_whole():
    rng = np.random.default_rng(2)
    lengths, counts = np.unique(rng.integers(1, 2048, 20_000), return_counts=True)
    out = layout(dict(zip(lengths.tolist(), counts.tolist())))
    pieces = sum(i[2] - i[1] for i in out.intervals)
    assert pieces < 1.1 * 20_000
    assert out.sequences - 11 <= (lengths * counts).sum() / 2048 <= out.sequences
