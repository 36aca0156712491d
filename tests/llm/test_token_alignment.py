"""Alignment against a plain version over the libraries' tokens, and the word cache against whole texts."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from vitrine.llm import token_alignment
from vitrine.llm.token_alignment import alignment, merge
from vitrine.llm.token_words import byte_alphabet, json_tokenizer, piece_tokenizer

A_PATH, B_PATH, W_PATH = map(public_tokenizers.path, ("byte_bpe_50k.json", "piece_bpe_32k.model", "word_bpe_49k.json"))
COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def tokens(text):
    a = Tokenizer.from_file(A_PATH)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    alphabet = byte_alphabet()
    at = [(i, bytes(alphabet[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    bt = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
    return at, bt


def plain_groups(text):
    if not text:
        return []
    a, b = tokens(text)
    if not b"".join(x for _, x in a) == b"".join(x for _, x in b) == (" " + text).encode():
        return []
    a_ends, b_ends = np.cumsum([len(x) for _, x in a]), np.cumsum([len(x) for _, x in b])
    shared = sorted(set(a_ends.tolist()) & set(b_ends.tolist()))
    out, lo = [], 0
    for hi in shared:
        out.append(([i for (i, _), e in zip(a, a_ends) if lo < e <= hi], [i for (i, _), e in zip(b, b_ends) if lo < e <= hi]))
        lo = hi
    return out


def plain(rows):
    groups = [plain_groups(t) for _, t in rows]
    links = [Counter((x, y) for a, b in g for x in a for y in b) for g in groups]
    count = Counter(p for c in links for p in c)
    top = Counter()
    for (a, _), n in count.items():
        top[a] = max(top[a], n)
    out = []
    for (doc, _), g, c in zip(rows, groups, links):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        out.append((doc, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(c.values()), sum(n for p, n in c.items() if count[p] == top[p[0]]),
                    sum(n * count[p] for p, n in c.items()), hashlib.sha256(text.encode()).hexdigest() if g else ""))
    return out


ROWS = [(1, "The quick brown fox isn't here."), (2, None), (3, ""), (4, " "), (5, "a▁b"), (6, "naïve 日本語 🙂 café\n\n  two"), (7, "<|endoftext|> <s> <0x41>"),
        (8, "x" * 70), (9, "The quick brown fox isn't here."), (None, "The null id"), (10, "aaaaaaaaa bbbbbb 12345 --==--"), (11, "\t tab \r\n"), (12, "ab " * 40)]


def test_equals_plain_version(spark, monkeypatch):
    rng = random.Random(5)
    words = ["The", "quick", "undeniably", "fox,", "isn't", "naïveté", "2024", "…", "日本", "antidisestablishmentarianism", "\n", " ", "J̌", "x\x1cy"]
    rows = ROWS + [(100 + i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 90)))) for i in range(60)]
    want = sorted(plain(rows), key=str)
    docs = spark.createDataFrame([(d, t, 7, "z") for d, t in rows], "doc_id long, text string, pairs int, n_best string").repartition(4)
    # hot and shuffled pairs, lanes and large groups: the same result
    for hot, lane, spread in [(200_000, 256, 4096), (20, 4, 1), (0, 256, 4096)]:
        monkeypatch.setattr(token_alignment, "LANE", lane)
        monkeypatch.setattr(token_alignment, "SPREAD", spread)
        got = alignment(docs, A_PATH, B_PATH, hot_pairs=hot).select("doc_id", *COLUMNS).collect()
        assert sorted(map(tuple, got), key=str) == want


def test_lanes_give_what_one_lane_gives():
    work = token_alignment.Aligner(open(A_PATH, "rb").read(), open(B_PATH, "rb").read())
    rng = random.Random(2)
    texts = pa.array([" ".join("".join(rng.choice("abcdeéü日 ") for _ in range(rng.randint(1, 9))) for _ in range(3000)), "short one"])
    for size in (3, 50, 10**9):
        token_alignment.lanes.__defaults__ = (size,)
        found = work(texts)
        found = {k: v.to_pylist() if isinstance(v, pa.Array) else list(v) for k, v in found.items()}
        assert size == 3 or found == first
        first = found
    token_alignment.lanes.__defaults__ = (token_alignment.LANE,)


def test_merge_of_small_ends():
    a, b = np.array([2, 3, 6, 9]), np.array([1, 3, 4, 9])
    cut_a, cut_b, doc, left, right, n = merge(np.array([10, 11, 12, 13]), a, np.array([20, 21, 22, 23]), b, [(0, 0, 4)], np.array([5]))
    assert cut_a.tolist() == [False, True, False, True] and cut_b.tolist() == [False, True, False, True]
    assert sorted(zip(left.tolist(), right.tolist())) == [(x, y) for p, q in (((10, 11), (20, 21)), ((12, 13), (22, 23))) for x in p for y in q]
    assert set(doc.tolist()) == {5} and set(n.tolist()) == {1}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert alignment(docs, A_PATH, B_PATH).collect() == []


@pytest.mark.parametrize("signs", [
    "aAbZ 's'll é J̌ İ Σς \n\t\r\x0b\x0c\x1c\x1f\x85\xa0   　  ​᠎ 0123½ .,;!?<|endoftext|>日本語 🙂́̇ǅÀßÿɏ×÷ªµ²ŁŒ",
    "aAbZ 's'll'VE'd é É \n\t\r\x0b\x0c\x1c\x1f\x85\xa0 0123½ .,;!?<>|  ÀßÿDž×÷ªµ²"])
def test_words_give_the_ids_of_whole_texts(signs):
    rng = random.Random(1)
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    texts += ["<|endoftext|>x <|startoftext|>", "a<|ENDOFTEXT|>b", "", " ", "  a  b", "a \n b", "a\n\nb", "<s> </s> <0x41>", "x" * 300]
    data = [open(p, "rb").read() for p in (A_PATH, W_PATH, B_PATH)]
    a, w = Tokenizer.from_str(data[0].decode()), Tokenizer.from_str(data[1].decode())
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_proto=data[2])

    def lists(words):
        ids, counts = words(pa.array(texts))
        return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]

    assert lists(json_tokenizer(data[0], plain_specials=True, before=" ")) == [e.ids for e in a.encode_batch([" " + t for t in texts], add_special_tokens=False)]
    assert lists(json_tokenizer(data[1])) == [e.ids for e in w.encode_batch(texts, add_special_tokens=False)]
    assert [x for x, t in zip(lists(piece_tokenizer(data[2])), texts) if t] == [x for x, t in zip(b.encode(texts), texts) if t]
