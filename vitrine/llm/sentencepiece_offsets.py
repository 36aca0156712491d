"""SentencePiece BPE encoding with byte offsets, and decoding.

Normalisation walks the text by the longest prefix in the model's compiled
character map (a double-array trie of byte strings) and notes for each byte of
the normalised text the byte of the source it came from. BPE pieces are
intervals of the normalised text, so that alignment gives every piece its span
of original bytes. Ids equal those of the sentencepiece library (no begin or
end ids, no sampling), and ``decode`` equals its ``decode(ids)``.

A vocabulary in which no piece holds a space symbol behind another character
lets merges never cross a word start; then the text is encoded word by word,
with a bounded memory of words. A vocabulary that breaks the rule is encoded as
one word.

The model file's bytes travel with the task (``MODEL_BYTES`` at most); tasks
are independent, so nothing is shuffled and a lost executor repeats its tasks.

Defined cases: null counts as empty; an empty text has no ids and decodes to the
empty text; any Unicode text, of any length, is encoded whole; repeated rows
give repeated results; other columns pass through ``encode`` and keep their
names (a column of the output's name is replaced). Models other than BPE, and
models with user-defined or unused pieces, are refused with ValueError.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import text_or_empty

SPACE = "▁"
#: Largest model file that is sent to the tasks.
MODEL_BYTES = 64 << 20
#: Words (of at most MEMO_CHARS characters) whose pieces a worker remembers: so
#: many new ones, and as many from before that were not used again.
MEMO_WORDS = 400_000
MEMO_CHARS = 64
#: Symbols of a word from which merges are kept in a heap instead of a list.
HEAP_FROM = 100
#: Piece types of the model format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
_BPE = 2


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of each field of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, data[at:at + size]
            at += size


class CharacterMap:
    """Longest-prefix replacement by a compiled character map; an empty map keeps every character."""

    def __init__(self, blob: bytes):
        self.units, self.strings = [], b""
        if blob:
            size = struct.unpack_from("<I", blob)[0]
            self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist()
            self.strings = blob[4 + size:]

    def longest(self, text: bytes, at: int) -> tuple[bytes, int] | None:
        """The replacement of the longest key that starts at ``at``, and the key's length."""
        found, node, units = None, 0, self.units
        step = lambda u: (u >> 10) << ((u & 512) >> 6)
        node ^= step(units[0])
        for i in range(at, len(text)):
            node ^= text[i]
            if node >= len(units) or units[node] & 0x800000FF != text[i]:
                break
            unit = units[node]
            node ^= step(unit)
            if unit >> 8 & 1:
                found = units[node] & 0x7FFFFFFF, i + 1 - at
        if found is None:
            return None
        start = found[0]
        return self.strings[start:self.strings.index(b"\0", start)], found[1]


def _word_patterns(pieces: list[str]) -> tuple[re.Pattern, re.Pattern]:
    """Two ways to cut a normalised text where no piece reaches across.

    Words: before a space symbol that follows another character, and around
    control characters that no piece holds. Parts of words: also between a
    letter or digit and a mark that no piece holds behind one.
    """
    if any(SPACE in p.lstrip(SPACE) for p in pieces):
        return re.compile(".+", re.S), re.compile(".+", re.S)
    used = set().union(*pieces)
    signs = {c for c in used if not c.isalnum() and c != SPACE}
    glue = {b for p in pieces for a, b in zip(p, p[1:]) if b in signs and a not in signs and a != SPACE}
    apart = "".join(c for c in "\n\r\t\v\f" if c not in used)

    def one_of(chars: set[str]) -> str:
        return f"[{''.join(map(re.escape, sorted(chars)))}]" if chars else "(?!)"

    sign, letter = one_of(signs), f"[^{SPACE}{apart}{''.join(map(re.escape, sorted(signs)))}]"
    on = f"(?:{one_of(glue)}{sign}*{letter}*)*"
    control = f"|[{apart}]+" if apart else ""
    return (re.compile(f"{SPACE}*[^{SPACE}{apart}]+|{SPACE}+" + control),
            re.compile(f"{SPACE}+{sign}*{letter}*{on}|(?:{sign}+{letter}*|{letter}+){on}" + control))


class Spelling:
    """The bytes of each id, and their concatenation for arrays of ids."""

    def __init__(self, words: list[bytes]):
        self.flat = np.frombuffer(b"".join(words), np.uint8)
        self.sizes = np.array([len(w) for w in words], np.int32)
        self.starts = (np.cumsum(self.sizes) - self.sizes).astype(np.int32)

    def __call__(self, ids: np.ndarray) -> bytes:
        out = []
        for lo in range(0, len(ids), 1 << 18):
            part = ids[lo:lo + (1 << 18)]
            size = self.sizes[part]
            ends = np.cumsum(size, dtype=np.int32)
            at = np.repeat(self.starts[part] - ends + size, size)
            at += np.arange(len(at), dtype=np.int32)
            out.append(self.flat[at].tobytes())
        return b"".join(out)


class Model:
    """A SentencePiece BPE model: normaliser, encoder and decoder."""

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        self.types: list[int] = []
        scores: list[float] = []
        kind, fallback, suffix, unknown = 1, 0, 0, b" \xe2\x81\x87 "
        charsmap, self.dummy, self.squeeze, self.escape = b"", 1, 1, 1
        for number, value in _fields(data):
            if number == 1:
                piece, score, type_ = b"", 0.0, NORMAL
                for n, v in _fields(value):
                    if n == 1:
                        piece = v
                    elif n == 2:
                        score = struct.unpack("<f", v)[0]
                    elif n == 3:
                        type_ = v
                self.pieces.append(piece.decode())
                self.types.append(type_)
                scores.append(score)
            elif number == 2:
                spec = dict(_fields(value))
                kind, fallback, suffix, unknown = spec.get(3, 1), spec.get(35, 0), spec.get(24, 0), spec.get(44, unknown)
            elif number == 3:
                spec = dict(_fields(value))
                charsmap, self.dummy, self.squeeze, self.escape = spec.get(2, b""), spec.get(3, 1), spec.get(4, 1), spec.get(5, 1)
        if kind != _BPE or not fallback or suffix or not self.escape or {USER_DEFINED, UNUSED} & set(self.types):
            raise ValueError("only BPE models with byte fallback and escaped space prefixes, and without user-defined or unused pieces, are supported")
        self.map = CharacterMap(charsmap)
        order = {x: k for k, x in enumerate(sorted({s for s, t in zip(scores, self.types) if t == NORMAL}, reverse=True))}
        #: Place of a piece's score (equal scores: the leftmost pair goes first), and its id.
        self.rank = {p: order[s] for p, s, t in zip(self.pieces, scores, self.types) if t == NORMAL}
        self.ids = {p: i for i, (p, t) in enumerate(zip(self.pieces, self.types)) if t == NORMAL}
        self.byte_ids = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(self.pieces, self.types)) if t == BYTE}
        n = len(self.pieces)
        self._types = np.array(self.types, np.int8)
        self.byte_of = np.full(n, -1, np.int16)
        self.byte_of[list(self.byte_ids.values())] = list(self.byte_ids)
        self.words, self.parts = _word_patterns(list(self.rank))
        self.size_of = np.array([len(p.encode()) for p in self.pieces], np.int64)
        #: What each id stands for: in a decoded text, and as a number before a comma.
        self.text_of = Spelling([unknown if t == UNKNOWN else b"" if t == CONTROL else bytes((int(p[3:5], 16),)) if t == BYTE
                                 else p.replace(SPACE, " ").encode() for p, t in zip(self.pieces, self.types)])
        self.number_of = Spelling([b"%d," % i for i in range(n)])
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    # -- normalisation -------------------------------------------------------

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its bytes (and its end) the source byte."""
        raw = text.encode("utf-8", "replace")
        if not raw:
            return "", np.zeros(1, np.int64)
        if not self.map.units and not self.squeeze:
            plain = np.frombuffer(raw, np.uint8)
            origin = np.repeat(np.arange(len(raw)), np.where(plain == 32, 3, 1))
            lead = np.zeros(3 if self.dummy else 0, np.int64)
            return SPACE * bool(self.dummy) + raw.decode().replace(" ", SPACE), np.concatenate((lead, origin, [len(raw)]))
        out, origin, at = bytearray(), [], 0
        space = SPACE.encode()

        def prefix(at: int) -> tuple[bytes, int]:
            hit = self.map.longest(raw, at) if self.map.units else None
            if hit:
                return hit
            first = raw[at]
            size = 1 if first < 128 else 2 if first < 224 else 3 if first < 240 else 4
            return raw[at:at + size], size

        if self.squeeze:
            while at < len(raw):
                piece, size = prefix(at)
                if piece != b" ":
                    break
                at += size
            if at >= len(raw):
                return "", np.zeros(1, np.int64)

        def put(piece: bytes) -> None:
            for b in piece:
                new = space if b == 32 else bytes((b,))
                out.extend(new)
                origin.extend([at] * len(new))

        if self.dummy:
            put(b" ")
        after_space = bool(self.squeeze)
        while at < len(raw):
            piece, size = prefix(at)
            if after_space:
                piece = piece.lstrip(b" ")
            if piece:
                put(piece)
                after_space = piece.endswith(b" ")
            at += size
            if not self.squeeze:
                after_space = False
        end = at
        if self.squeeze:
            while out.endswith(space):
                del out[-3:]
                end = origin[len(out)]
                del origin[len(out):]
        return out.decode(), np.array([*origin, end], np.int64)

    # -- encoding ------------------------------------------------------------

    def merge(self, word: str) -> list[str]:
        """BPE symbols of one word: always the best-scored pair, the leftmost of equals."""
        if len(word) >= HEAP_FROM:
            return self._merge_long(word)
        symbols, get, none = list(word), self.rank.get, len(self.pieces)
        ranks = [get(a + b, none) for a, b in zip(symbols, symbols[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            both = symbols[i] + symbols[i + 1]
            symbols[i:i + 2] = [both]
            del ranks[i]
            if i:
                ranks[i - 1] = get(symbols[i - 1] + both, none)
            if i < len(ranks):
                ranks[i] = get(both + symbols[i + 1], none)
        return symbols

    def _merge_long(self, word: str) -> list[str]:
        symbols = list(word)
        n, rank = len(symbols), self.rank
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[int, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            if 0 <= i and j < n and (place := rank.get(both := symbols[i] + symbols[j])) is not None:
                heapq.heappush(heap, (place, i, j, both))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if not symbols[i] or not symbols[j] or after[i] != j or symbols[i] + symbols[j] != both:
                continue
            symbols[i], symbols[j] = both, ""
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [s for s in symbols if s]

    def word(self, word: str) -> bytes:
        """The ids of one word, as int32; the word is remembered."""
        ids = self.older.get(word)
        if ids is None:
            parts = self.parts.findall(word)
            ids = b"".join([self.memo.get(p) or self.word(p) for p in parts]) if len(parts) > 1 else self._spelt(word)
        if len(word) <= MEMO_CHARS:
            if len(self.memo) >= MEMO_WORDS:
                self.memo, self.older = {}, self.memo
            self.memo[word] = ids
        return ids

    def _spelt(self, word: str) -> bytes:
        symbols = self.merge(word)
        ids = list(map(self.ids.get, symbols))
        if None in ids:  # a symbol outside the vocabulary: its bytes
            ids = [i for s, k in zip(symbols, ids) for i in ([self.byte_ids[b] for b in s.encode()] if k is None else [k])]
        return array("i", ids).tobytes()

    def _piece_sizes(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of normalised text of each piece; of a character spelt in bytes the last byte has them all."""
        sizes, byte = self.size_of[ids], self.byte_of[ids]
        at = np.nonzero(byte >= 0)[0]
        if len(at):
            inner = (byte[at] & 0xC0) == 0x80
            sizes[at] = 0
            last = np.append(~inner[1:], True)
            heads = at[~inner]
            sizes[at[last]] = at[last] - heads + 1
        return sizes

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and the first and the end byte of each in ``text``."""
        normal, origin = self.normalise(text)
        ids = np.frombuffer(b"".join([self.memo.get(w) or self.word(w) for w in self.words.findall(normal)]), np.int32)
        ends = np.cumsum(self._piece_sizes(ids))
        starts = np.concatenate(([0], ends[:-1])) if len(ids) else ends
        return ids, origin[starts].astype(np.int32), origin[ends].astype(np.int32)

    def numbers(self, ids: np.ndarray) -> bytes:
        """The ids in decimal, joined by commas."""
        return self.number_of(ids)[:-1]

    # -- decoding ------------------------------------------------------------

    def decode(self, ids) -> str:
        """The text of any ids, as the library's ``decode``."""
        ids = np.asarray(ids, np.int64)
        types = self._types[ids]
        ids, types = ids[types != CONTROL], types[types != CONTROL]
        if not len(ids):
            return ""
        at = 0
        if self.squeeze:  # all leading spaces go
            while at < len(ids) - 1 and self.pieces[ids[at]] == SPACE:
                at += 1
        raw = self.text_of(ids[at:])
        # the space that stands for the added prefix, if a piece (not a byte) begins the text with it
        if (self.dummy or self.squeeze) and types[at] == NORMAL and raw[:1] == b" ":
            raw = raw[1:]
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return _by_character(raw)


def _by_character(raw: bytes) -> str:
    """UTF-8 text of the bytes; each byte that begins no valid character gives U+FFFD."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(raw):
            for size in (1, 2, 3, 4):
                try:
                    out.append(raw[at:at + size].decode())
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                size = 1
            at += size
        return "".join(out)


#: Columns that ``encode`` can return.
OUTPUTS = {"ids": "array<int>", "begins": "array<int>", "ends": "array<int>", "n_tokens": "long", "span_bytes": "long",
           "ids_sha256": "string", "decoded": "string", "decoded_sha256": "string"}


_MODELS: dict[bytes, Model] = {}


def _model(data: bytes) -> Model:
    """The model of a file's bytes; a worker keeps the last one, and the words it remembers, between tasks."""
    key = hashlib.sha256(data).digest()
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = Model(data)
    return _MODELS[key]


def _model_bytes(model_path: str) -> bytes:
    with open(model_path, "rb") as f:
        data = f.read(MODEL_BYTES + 1)
    if len(data) > MODEL_BYTES:
        raise ValueError(f"{model_path} has more than {MODEL_BYTES} bytes")
    return data


def encoding(text: Column, model_path: str, outputs: tuple[str, ...] = tuple(OUTPUTS)) -> Column:
    """A struct of ``outputs`` for a text column; the model file is read on the driver."""
    data = _model_bytes(model_path)

    @F.pandas_udf(", ".join(f"{o} {OUTPUTS[o]}" for o in outputs))
    def pieces(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = _model(data)
        for texts in batches:
            rows: dict[str, list] = {o: [] for o in outputs}
            for t in texts:
                ids, begins, ends = model.encode(t or "")
                decoded = model.decode(ids) if "decoded" in outputs or "decoded_sha256" in outputs else None
                values = {"ids": ids, "begins": begins, "ends": ends, "n_tokens": len(ids), "decoded": decoded}
                for o in outputs:
                    if o == "span_bytes":
                        rows[o].append(int((ends - begins).sum()))
                    elif o == "ids_sha256":
                        rows[o].append(hashlib.sha256(model.numbers(ids)).hexdigest())
                    elif o == "decoded_sha256":
                        rows[o].append(hashlib.sha256(decoded.encode("utf-8", "replace")).hexdigest())
                    else:
                        rows[o].append(values[o])
            yield pd.DataFrame(rows, columns=list(outputs))

    return pieces(text)


def encode(docs: DataFrame, model_path: str, text_col: str = "text", outputs: tuple[str, ...] = ("ids", "begins", "ends")) -> DataFrame:
    """``docs`` with the ids of each text and the original byte span of each id."""
    kept = [c for c in docs.columns if c not in outputs and c != "__pieces"]
    return docs.withColumn("__pieces", encoding(text_or_empty(text_col), model_path, outputs)).select(
        *[F.col(c) for c in kept], *[F.col("__pieces")[o].alias(o) for o in outputs])


def decode(rows: DataFrame, model_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``rows`` with the text of an id column; null ids give the empty text."""
    data = _model_bytes(model_path)

    @F.pandas_udf("string")
    def back(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = _model(data)
        for lists in batches:
            yield pd.Series([model.decode(x) if x is not None else "" for x in lists])

    return rows.withColumn(out_col, back(F.col(ids_col)))
