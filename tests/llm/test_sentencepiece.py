"""Offset-preserving SentencePiece against the library."""

import hashlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
spm = pytest.importorskip("sentencepiece")

from vitrine.llm.sentencepiece_offsets import CharacterMap, Model, decode, encode  # noqa: E402

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", " ", "   ", "a", " a", "a ", "Hello world", "  two  spaces   here ", "line\nbreak\n\n x", "tab\there\r\n", "é à ü ñ ß", "日本語のテキスト",
         "mixed 日本 und Straße nbsp", "👍🏽 emoji 👩‍👩‍👧", "▁literal ▁▁ space symbol▁", "<s> </s> <unk> <0x41>", "\x00\x01 control", "� replacement",
         "a" * 300, "ab " * 2000, "x" * 5000 + "\n" + "é" * 500, "é combining", "​ zero width ﻿ bom", "1234567890 3.14 1,000", "don't can't", "\n", "\n\n\n", "\U0010ffff"]


@pytest.fixture(scope="module")
def pair():
    return spm.SentencePieceProcessor(model_file=PATH), Model(open(PATH, "rb").read())


def check(lib, own, text):
    ids, begins, ends = own.encode(text)
    want = lib.encode(text)
    assert ids.tolist() == want, text[:80]
    assert own.numbers(ids).decode() == ",".join(map(str, want))
    assert own.decode(ids) == lib.decode(want)
    raw = text.encode()
    spans = [(p.begin, p.end) for p in lib.encode(text, return_type="proto").pieces]
    assert list(zip(begins.tolist(), ends.tolist())) == spans, text[:80]
    if raw:
        assert begins[0] == 0 and ends[-1] == len(raw)


def test_ids_spans_and_text_as_the_library(pair):
    for t in TEXTS:
        check(*pair, t)


def test_random_texts(pair):
    rng = np.random.default_rng(0)
    alphabet = list("abcdefgh the ing  \n\t.,éñ日本▁") + ["\U0001f600", "<", ">", "0"]
    for _ in range(400):
        check(*pair, "".join(rng.choice(alphabet, rng.integers(1, 60))))


def test_decode_of_any_ids(pair):
    lib, own = pair
    rng = np.random.default_rng(1)
    for n in range(400):
        ids = rng.integers(0, 32000 if n % 2 else 300, rng.integers(1, 12)).tolist()
        assert own.decode(ids) == lib.decode(ids), ids


def test_compiled_map_as_the_library():
    """The longest-prefix walk of a compiled map, and its alignment, against the library's own normaliser."""
    norm = spm.SentencePieceNormalizer(rule_name="nmt_nfkc_cf", add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=True)
    from vitrine.llm.sentencepiece_offsets import _fields
    blob = dict(_fields(dict(_fields(norm.serialized_model_proto()))[3]))[2]
    own = Model(open(PATH, "rb").read())
    own.map, own.squeeze = CharacterMap(blob), 1
    for t in [*TEXTS, "ＦＵＬＬ　ｗｉｄｔｈ ①②", "ﬁ ligature ﬀ", "ÀÉÎ  Ω ", "ｱｲｳ ㌔"]:
        text, origin = own.normalise(t)
        want, at = norm.normalize(t, with_offsets=True)
        assert text == want, t[:60]
        chars = np.cumsum([0] + [len(c.encode()) for c in t])
        own_at = origin[np.cumsum([0] + [len(c.encode()) for c in text])]
        assert [int(x) for x in own_at] == [int(chars[a]) for a in at], t[:60]


def test_round_trip_on_spark(spark, pair):
    rows = [(i, t, i) for i, t in enumerate(TEXTS)] + [(99, None, 1), (None, "a b", 2), (3, "a", 3), (3, "a", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids long")
    out = encode(docs, PATH)
    assert out.columns == ["doc_id", "text", "ids", "begins", "ends"]
    back = decode(out, PATH).collect()
    assert len(back) == len(rows)
    for r in back:
        want = pair[0].encode(r["text"] or "")
        assert r["ids"] == want and r["decoded"] == pair[0].decode(want)
    one = encode(docs, PATH, outputs=("n_tokens", "span_bytes", "ids_sha256", "decoded_sha256")).where("doc_id = 6").first()
    ids = pair[0].encode("Hello world")
    assert (one["n_tokens"], one["span_bytes"]) == (len(ids), 11)
    assert one["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert encode(docs.limit(0), PATH).count() == 0
