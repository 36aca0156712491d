"""Ids of whole texts from public tokenizers, each distinct word asked from the library once.

A tokenizer whose rules never look across certain places gives a text the ids of
the stretches between these places, one after the other. The stretches recur, so
a worker remembers their ids and joins them in numpy; new ones go to the library
many at a time. Which places are safe is decided from the tokenizer's own rules;
where none are known, the library gets every text whole. Words with letters
beyond Latin are cut at blanks only, so no table of character classes but the
library's decides about them.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A memory of more words or characters than this is begun anew.
MEMO_WORDS = 600_000
MEMO_CHARS = 32_000_000
#: Characters of text that are worked on at a time (a longer text by itself).
SLICE_CHARS = 4_000_000

# The rules under which a text may be cut, as the tokenizer files state them.
_BYTE_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LOWER_WORDS = ({"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
                "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+")
SPACE = "▁"


def slices(sizes: list[int], limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of about ``limit`` in total size."""
    first = total = 0
    for i, size in enumerate(sizes):
        if total and total + size > limit:
            yield first, i
            first = i
            total = 0
        total += size
    if first < len(sizes):
        yield first, len(sizes)


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one range after the other."""
    total = int(sizes.sum())
    return np.arange(total) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


class Words:
    """Ids of texts by their words; ``encode`` is asked once for each distinct word.

    ``split`` cuts an Arrow array of texts into lists of words. A text with a word
    that ``joins`` its neighbours (only where ``before`` is not empty) is cut by ``cut`` instead, into longer words.
    """

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], split: Callable[[pa.Array], pa.Array] | None = None,
                 joins: Callable[[str], bool] | None = None, cut: Callable[[str], list[str]] = lambda text: [text], before: str = ""):
        self.encode, self.split, self.joins, self.cut, self.before = encode, split, joins, cut, before
        self.most_words = MEMO_WORDS
        self._clear()

    def _clear(self) -> None:
        self.memo: dict[str, int] = {}
        self.chars = 0
        self.flat = np.zeros(0, np.int32)
        self.starts = np.zeros(0, np.int64)
        self.sizes = np.zeros(0, np.int64)

    def _learn(self, words: list[str]) -> None:
        ids = self.encode(words)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        self.memo.update(zip(words, range(len(self.memo), len(self.memo) + len(words))))
        self.chars += sum(map(len, words))
        self.starts = np.concatenate((self.starts, len(self.flat) + np.cumsum(sizes) - sizes))
        self.sizes = np.concatenate((self.sizes, sizes))
        self.flat = np.concatenate((self.flat, np.fromiter(chain.from_iterable(ids), np.int32, int(sizes.sum()))))

    def _places(self, words: list[str]) -> np.ndarray:
        at = list(map(self.memo.get, words))
        if None in at:
            self._learn(list(dict.fromkeys(w for w, k in zip(words, at) if k is None)))
            at = list(map(self.memo.__getitem__, words))
        return np.array(at, np.int64)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (no nulls) one after the other, and how many each text has; the ids are those of ``before`` + text."""
        if len(self.memo) > self.most_words or self.chars > MEMO_CHARS:
            self._clear()
        if self.split is None:
            cuts = [self.cut(self.before + t) for t in texts.to_pylist()]
            counts = np.array([len(c) for c in cuts], np.int64)
            at = self._places(list(chain.from_iterable(cuts)))
        else:
            parts = self.split(texts)
            counts = np.diff(parts.offsets.to_numpy().astype(np.int64))
            coded = parts.flatten().dictionary_encode()
            words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
            which = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            joining = np.fromiter(map(self.joins, words), bool, len(words)) if self.joins else np.zeros(len(words), bool)
            place = np.zeros(len(words), np.int64)
            place[~joining] = self._places([self.before + w for w, j in zip(words, joining.tolist()) if not j] if self.before else words)
            at = place[which]
            if joining.any():
                row = np.repeat(np.arange(len(counts)), counts)
                whole = np.zeros(len(counts), bool)
                whole[row[joining[which]]] = True
                numbers = np.flatnonzero(whole)
                cuts = [self.cut(self.before + texts[int(i)].as_py()) for i in numbers]
                extra = self._places(list(chain.from_iterable(cuts)))
                rest = at[~whole[row]]
                counts[numbers] = [len(c) for c in cuts]
                row = np.repeat(np.arange(len(counts)), counts)
                at = np.empty(len(row), np.int64)
                at[whole[row]], at[~whole[row]] = extra, rest
        sizes = self.sizes[at]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        edges = np.concatenate(([0], np.cumsum(counts)))
        return self.flat[ranges(self.starts[at], sizes)], np.diff(ends[edges])


def _split(ids: np.ndarray, ends: np.ndarray) -> list[list[int]]:
    """Lists of ids, each up to a place of ``ends`` (exclusive)."""
    flat, out, first = ids.tolist(), [], 0
    for end in ends.tolist():
        out.append(flat[first:end])
        first = end
    return out


def _mixed(words: list[str], fast: Callable[[list[str]], list[list[int]] | None], slow: Callable[[list[str]], list[list[int]]],
           is_fast: Callable[[str], object]) -> list[list[int]]:
    """Ids by ``fast`` (None: it can't) for words that allow it, by ``slow`` for the others."""
    able = list(map(bool, map(is_fast, words)))
    done = fast([w for w, k in zip(words, able) if k]) if any(able) else []
    if done is None:
        return slow(words)
    if all(able):
        return done
    quick, others = iter(done), iter(slow([w for w, k in zip(words, able) if not k]))
    return [next(quick) if k else next(others) for k in able]


#: Letters, numbers and blanks of Latin-1, whose classes are the same in every version of Unicode.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", " \\t-\\r\\x85\\xa0"
_LOWER_PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+")


def _latin(word: str) -> bool:
    try:
        word.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class _Merges:
    """Byte-pair merging of single words by the merges of a model: always the earliest, leftmost first."""

    def __init__(self, model: dict):
        alphabet = {b: c for c, b in byte_alphabet().items()}
        self.vocab, self.suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        self.spell = [alphabet[b] for b in range(256)]
        self.rank, self.made = {}, []
        for place, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            self.rank[a, b] = place
            self.made.append(a + b)

    def symbols(self, token: str) -> list[str]:
        """The symbols that a token is merged from."""
        if self.suffix and token.endswith(self.suffix):
            out = list(token[:-len(self.suffix)])
            out[-1] += self.suffix
            return out
        return list(token)

    def merge(self, symbols: list[str]) -> tuple[list[str], int]:
        """The symbols merged, and the latest merge that was made."""
        get, none, latest = self.rank.get, len(self.rank), -1
        ranks = [get(pair, none) for pair in zip(symbols, symbols[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            latest = max(latest, best)
            i = ranks.index(best)
            both = symbols[i] + symbols[i + 1]
            symbols[i:i + 2] = [both]
            del ranks[i]
            if i:
                ranks[i - 1] = get((symbols[i - 1], both), none)
            if i < len(ranks):
                ranks[i] = get((both, symbols[i + 1]), none)
        return symbols, latest

    def ranked(self) -> bool:
        """Whether merging any two neighbours that spell a token, by the order of ids, is the same as following the merges.

        It is if ids follow the merges' order and each token is what its own
        symbols merge to, its own merge being the last: two neighbours that spell a
        token have come about as in the token alone, so they are its own merge.
        """
        ids = [self.vocab[t] for t in self.made]
        return ids == sorted(set(ids)) and len(set(self.made)) == len(self.made) and all(
            self.merge(self.symbols(t)) == ([t], place) for place, t in enumerate(self.made))

    def __call__(self, word: str) -> list[int]:
        symbols = [self.spell[b] for b in word.encode()]
        symbols[-1] += self.suffix
        return [self.vocab[x] for x in self.merge(symbols)[0]]


#: Bytes that words of lower-case Latin letters, digits and ASCII signs are made of: ASCII but A-Z, and U+00E0 to U+00FF.
_COMMON = bytes([*range(33, 65), *range(91, 127), 0xC3, *range(0xA0, 0xC0)])
_COMMON_WORD = re.compile("[!-@\\[-~à-ÿ]+")


class _SuffixedWords:
    """Merging of common words by a library that knows bytes only: another byte stands for a byte at a word's end."""

    def __init__(self, merges: _Merges):
        import tiktoken

        self.slow, self.memo = merges, {}
        spare = [b for b in range(256) if b not in _COMMON]
        closing = dict(zip([b for b in _COMMON if b != 0xC3], spare))
        self.closing = bytes(closing.get(b, b) for b in range(256))
        letters = {merges.spell[b]: b for b in _COMMON}
        ranks = {}
        for token, i in merges.vocab.items():
            body = token.removesuffix(merges.suffix)
            if body and all(c in letters for c in body):
                raw = bytes(letters[c] for c in body)
                if body != token:
                    if raw[-1] not in closing:
                        continue
                    raw = raw[:-1] + raw[-1:].translate(self.closing)
                ranks[raw] = i
        self.fast = tiktoken.Encoding("words", pat_str=".+", mergeable_ranks=ranks, special_tokens={}, explicit_n_vocab=None)

    def __call__(self, word: str) -> list[int]:
        ids = self.memo.get(word)
        if ids is None:
            if _COMMON_WORD.fullmatch(word):
                raw = word.encode()
                ids = self.fast._encode_single_piece(raw[:-1] + raw[-1:].translate(self.closing))
            else:
                ids = self.slow(word)
            if len(self.memo) > MEMO_WORDS // 2:
                self.memo.clear()
            self.memo[word] = ids
        return ids


def json_tokenizer(data: bytes, plain_specials: bool = False, before: str = "") -> Words:
    """Words of a tokenizer file of the ``tokenizers`` library, for texts with ``before`` in front.

    Special tokens are never added; their strings in a text are special tokens, unless ``plain_specials``.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals the work out
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(data.decode())
    tokenizer.no_truncation()
    tokenizer.no_padding()
    tokenizer.encode_special_tokens = plain_specials
    rules = json.loads(data)
    pre, normal, model = rules.get("pre_tokenizer") or {}, rules.get("normalizer"), rules["model"]
    steps = pre.get("pretokenizers", [pre])
    added = rules.get("added_tokens", [])
    specials = None if plain_specials or not added else re.compile("|".join(re.escape(t["content"]) for t in added), re.I)
    odd = any(re.search(r"\s", t["content"]) or t.get("single_word") for t in added) or model["type"] != "BPE" or model.get("dropout")

    def slow(words: list[str]) -> list[list[int]]:
        return [e.ids for e in tokenizer.encode_batch(words, add_special_tokens=False)]

    lower = (normal == _LOWER_WORDS[0] and len(steps) == 2 and steps[0].get("pattern") == {"Regex": _LOWER_WORDS[1]} and steps[0].get("invert")
             and steps[0].get("behavior") == "Removed" and steps[1].get("type") == "ByteLevel" and not steps[1].get("use_regex", True)
             and not steps[1].get("add_prefix_space"))
    if lower and not odd and not before and model.get("end_of_word_suffix"):
        # no rule matches white space or looks beyond it, so blanks part the words
        merges = _Merges(model)
        merges = _SuffixedWords(merges) if merges.ranked() else merges

        def fast(words: list[str]) -> list[list[int]]:
            return [[i for part in _LOWER_PARTS.findall(w.lower()) for i in merges(part)] for w in words]

        return Words(lambda words: _mixed(words, fast, slow, lambda w: len(w) < 100 and _latin(w) and not (specials and specials.search(w))), pc.ascii_split_whitespace)
    plain_bytes = normal is None and len(steps) == 1 and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    if plain_bytes and not odd and not specials and before == " " and not model.get("ignore_merges"):
        # a blank before another character always begins a word of the tokenizer's own
        fast, able = slow, lambda word: True
        if _Merges(model).ranked():
            import tiktoken

            alphabet = byte_alphabet()
            places = {bytes(alphabet[c] for c in t): i for t, i in model["vocab"].items() if all(c in alphabet for c in t)}
            ranked = tiktoken.Encoding("words", pat_str=_BYTE_WORDS, mergeable_ranks=places, special_tokens={})
            fast, able = (lambda words: list(map(ranked.encode_ordinary, words))), _latin
        return Words(lambda words: _mixed(words, fast, slow, able), lambda texts: pc.split_pattern(texts, " "),
                     lambda word: not word or word[0].isspace(), re.compile(r"(?= \S)").split, before)
    return Words(slow, before=before)


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level token stands for: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def byte_tokens(data: bytes) -> list[bytes]:
    """The bytes of each id of a byte-level tokenizer file; none for ids that text is never encoded to."""
    alphabet = byte_alphabet()
    vocab = json.loads(data)["model"]["vocab"]
    out = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        if all(c in alphabet for c in token):
            out[i] = bytes(alphabet[c] for c in token)
    return out


def piece_tokenizer(data: bytes) -> Words:
    """Words of a SentencePiece model: the ids of whole texts as ``encode`` gives them (an empty text has those of a lone space)."""
    import sentencepiece

    from vitrine.llm.sentencepiece_offsets import _fields

    model = sentencepiece.SentencePieceProcessor(model_proto=data)
    normaliser = next((dict(_fields(v)) for n, v in _fields(data) if n == 3), {})
    plain = not normaliser.get(2, b"") and normaliser.get(3, 1) and not normaliser.get(4, 1) and normaliser.get(5, 1)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    joined = any(SPACE in p.lstrip(SPACE) for p in pieces)
    opens = np.array([p.startswith(SPACE) for p in pieces])
    space_id = model.piece_to_id(SPACE)

    def whole(words: list[str]) -> list[list[int]]:
        return model.encode(words, num_threads=1)

    if not plain or joined or pieces[space_id] != SPACE:
        return Words(whole)

    def together(words: list[str]) -> list[list[int]] | None:
        ids = np.array(model.encode("".join(words)[1:], num_threads=1), np.int64)
        begins = np.flatnonzero(opens[ids])
        return _split(ids, np.append(begins[1:], len(ids))) if len(begins) == len(words) else None

    def slow(words: list[str]) -> list[list[int]]:
        # a lone space at the end of a text is the piece of the space; without a text there is no added space
        return [[space_id] if w == " " else ids for w, ids in zip(words, whole([w[1:] for w in words]))]

    # no piece holds a space after another character, so nothing merges across the place before a run of spaces
    return Words(lambda words: _mixed(words, together, slow, lambda w: len(w) > 1 and w[1] != " " and SPACE not in w),
                 lambda texts: pc.split_pattern(texts, " "), lambda word: not word, re.compile(" +[^ ]*").findall, " ")
