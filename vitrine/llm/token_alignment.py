"""Alignment of two tokenizers' tokens by lockstep merging.

A byte-level tokenizer (A) encodes a space and the text, a SentencePiece model (B)
the text, to which it adds that space itself. Both give the same bytes, so the
ends of their tokens are places in one string. The documents of a batch are
merged together: a NumPy state vector holds one pair of pointers a document; each
step compares the two ends, moves the pointer (or both) whose token ends first,
emits the cut and the links of the group where both end together, and the
documents that are done leave the vector. A long document enters as several
lanes, each from a place where both end (found by bisection), so that the steps
of a batch are bounded by the lane and not by its longest text.

All A and B tokens of a group are linked. ``align`` gives each document's groups
and its distinct linked id pairs with their numbers of links; ``pair_counts``
says how many documents hold each pair; ``count_links`` brings the counts back to
the documents.

Scale: texts are read and encoded once; what a document needs later, its distinct
pairs, is written. Pair counts are partial aggregates. Of the way back, the best
count of each A id is bounded by A's vocabulary, and the pairs with the highest
counts are taken down to a power of two that leaves at most ``HOT_PAIRS``: those
tables go to the tasks. All other pairs are joined by shuffle; none of them can be
in more than (all pairs of documents) / HOT_PAIRS documents, so no key is hot.

Defined cases: a null or empty text, and one whose tokens' bytes are not space +
text (it has U+2581), has no tokens: zeros and an empty group string; special
tokens' strings are plain text; repeated rows count as documents each; a null id
stays null; an empty table gives none. Other columns pass through ``align``
(columns of its own names are replaced).
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.llm.common import written
from vitrine.llm.token_words import MEMO_WORDS, SPACE, byte_tokens, json_tokenizer, piece_tokenizer, ranges, slices

#: A tokens of a lane, about; the steps of a batch are some three times as many.
LANE = 256
#: Links of a group that are spread out pair by pair; larger groups are counted by distinct ids.
SPREAD = 4096
#: Most pairs whose counts go to every task (24 bytes each).
HOT_PAIRS = 200_000
MODEL_BYTES = 64_000_000
#: Characters of text that are aligned at a time.
BATCH_CHARS = 2_000_000

OUTPUTS = T.StructType([
    T.StructField("n_a", T.LongType()), T.StructField("n_b", T.LongType()), T.StructField("n_groups", T.LongType()),
    T.StructField("n_links", T.LongType()), T.StructField("groups_sha256", T.StringType()),
    T.StructField("pairs", T.ArrayType(T.LongType())), T.StructField("times", T.ArrayType(T.LongType()))])


# ---------------------------------------------------------------- in lockstep
def lanes(a_ends: np.ndarray, b_ends: np.ndarray, a0: int, b0: int, size: int = LANE) -> list[tuple[int, int, int]]:
    """(first A token, first B token, end of A tokens) of stretches of a document that begin where both tokenizers end.

    ``a_ends`` and ``b_ends`` are the document's own, ``a0`` and ``b0`` the places of its first tokens in the batch.
    """
    out, first_a, first_b, n = [], 0, 0, len(a_ends)
    while n - first_a > 2 * size:
        # the first A token from first_a + size on whose end is an end of B
        lo, found = first_a + size, None
        while lo < n - 1:
            some = a_ends[lo:lo + size]
            at = np.minimum(np.searchsorted(b_ends, some), len(b_ends) - 1)
            hit = np.flatnonzero(b_ends[at] == some)
            if len(hit):
                found = (lo + int(hit[0]) + 1, int(at[hit[0]]) + 1)
                break
            lo += size
        if found is None or found[0] >= n:
            break
        out.append((a0 + first_a, b0 + first_b, a0 + found[0]))
        first_a, first_b = found
    out.append((a0 + first_a, b0 + first_b, a0 + n))
    return out


def merge(a_ids: np.ndarray, a_ends: np.ndarray, b_ids: np.ndarray, b_ends: np.ndarray, starts: list[tuple[int, int, int]],
          owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Advance all lanes together, a token end a step.

    ``starts`` are lanes, ``owner`` their documents. Returns a flag for each A
    and each B token that closes a group, and the links as (document, A id, B id, number).
    """
    at = np.array(starts, np.int64).reshape(-1, 3)
    a, b, a_stop, doc = at[:, 0], at[:, 1], at[:, 2], owner.astype(np.int64)
    a_open, b_open = a.copy(), b.copy()
    a_cut, b_cut = np.zeros(len(a_ids), bool), np.zeros(len(b_ids), bool)
    links: list[tuple[np.ndarray, ...]] = []
    while len(a):
        end_a, end_b = a_ends[a], b_ends[b]
        cut = np.flatnonzero(end_a == end_b)
        if len(cut):
            last_a, last_b, first_a, first_b = a[cut], b[cut], a_open[cut], b_open[cut]
            a_cut[last_a] = True
            b_cut[last_b] = True
            links.extend(_links(a_ids, b_ids, first_a, last_a, first_b, last_b, doc[cut]))
            a_open[cut], b_open[cut] = last_a + 1, last_b + 1
        a = a + (end_a <= end_b)
        b = b + (end_b <= end_a)
        going = a < a_stop
        if not going.all():  # lanes that are done leave the vector
            a, b, a_stop, doc, a_open, b_open = (x[going] for x in (a, b, a_stop, doc, a_open, b_open))
    parts = [np.concatenate([x[k] for x in links]) if links else np.zeros(0, np.int64) for k in range(4)]
    return a_cut, b_cut, *parts


def _links(a_ids, b_ids, first_a, last_a, first_b, last_b, doc) -> Iterator[tuple[np.ndarray, ...]]:
    """(document, A id, B id, number) of all pairs within groups of tokens first .. last."""
    size_a, size_b = last_a - first_a + 1, last_b - first_b + 1
    links = size_a * size_b
    one = links == 1
    if one.any():
        yield doc[one], a_ids[first_a[one]], b_ids[first_b[one]], np.ones(int(one.sum()), np.int64)
    some = np.flatnonzero((links > 1) & (links <= SPREAD))
    if len(some):
        n = links[some]
        turn = ranges(np.zeros(len(some), np.int64), n)
        wide = np.repeat(size_b[some], n)
        yield (np.repeat(doc[some], n), a_ids[np.repeat(first_a[some], n) + turn // wide],
               b_ids[np.repeat(first_b[some], n) + turn % wide], np.ones(len(turn), np.int64))
    for k in np.flatnonzero(links > SPREAD).tolist():
        ua, na = np.unique(a_ids[first_a[k]:last_a[k] + 1], return_counts=True)
        ub, nb = np.unique(b_ids[first_b[k]:last_b[k] + 1], return_counts=True)
        yield (np.full(len(ua) * len(ub), doc[k]), np.repeat(ua, len(ub)), np.tile(ub, len(ua)), (na[:, None] * nb).ravel())


# ---------------------------------------------------------------- a batch of texts
class _Spelled:
    """The bytes of ids, looked up and joined in numpy."""

    def __init__(self, words: list[bytes]):
        self.sizes = np.fromiter(map(len, words), np.int64, len(words))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(words), np.uint8)

    def __call__(self, ids: np.ndarray) -> np.ndarray:
        return self.flat[ranges(self.starts[ids], self.sizes[ids])]


class Aligner:
    """Both tokenizers, and what their ids stand for."""

    def __init__(self, a_data: bytes, b_data: bytes):
        import sentencepiece

        self.a, self.b = json_tokenizer(a_data, plain_specials=True, before=" "), piece_tokenizer(b_data)
        self.a.most_words = self.b.most_words = MEMO_WORDS // 2  # two memories in a worker
        model = sentencepiece.SentencePieceProcessor(model_proto=b_data)
        pieces = range(model.get_piece_size())
        self.a_bytes = _Spelled(byte_tokens(a_data))
        self.b_bytes = _Spelled([bytes([int(p[3:5], 16)]) if model.is_byte(i) else b"" if model.is_control(i) or model.is_unknown(i)
                                 else p.replace(SPACE, " ").encode() for i, p in ((i, model.id_to_piece(i)) for i in pieces)])
        numbers = [b"%d," % i for i in range(max(len(self.a_bytes.sizes), len(self.b_bytes.sizes)))]
        self.numbers = _Spelled(numbers)

    def _same(self, ids: np.ndarray, counts: np.ndarray, spelled: _Spelled, raw: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Whether the tokens of each document are a space and its text (``raw``: these of all documents, ``sizes`` bytes each)."""
        doc = np.repeat(np.arange(len(counts)), counts)
        length = np.bincount(doc, weights=spelled.sizes[ids], minlength=len(counts)).astype(np.int64)
        fits = length == sizes
        joined = spelled(ids[fits[doc]])
        wanted = raw[np.repeat(fits, sizes)]
        wrong = joined != wanted
        if wrong.any():
            fits[np.repeat(np.arange(len(counts)), sizes)[np.repeat(fits, sizes)][wrong]] = False
        return fits

    def __call__(self, texts: pa.Array) -> dict[str, object]:
        """``OUTPUTS`` of a batch of texts (no nulls)."""
        a_ids, a_n = self.a(texts)
        b_ids, b_n = self.b(texts)
        n = len(texts)
        raw = np.frombuffer(b"".join([b" " + t.encode() for t in texts.to_numpy(zero_copy_only=False)]), np.uint8)
        sizes = np.asarray(pa.compute.binary_length(texts)).astype(np.int64) + 1
        good = (sizes > 1) & self._same(a_ids, a_n, self.a_bytes, raw, sizes) & self._same(b_ids, b_n, self.b_bytes, raw, sizes)
        a_ids, b_ids = a_ids[np.repeat(good, a_n)].astype(np.int64), b_ids[np.repeat(good, b_n)].astype(np.int64)
        a_n, b_n = np.where(good, a_n, 0), np.where(good, b_n, 0)
        a_edge, b_edge = np.concatenate(([0], np.cumsum(a_n))), np.concatenate(([0], np.cumsum(b_n)))

        def ends_of(ids: np.ndarray, edge: np.ndarray, counts: np.ndarray, spelled: _Spelled) -> np.ndarray:
            total = np.concatenate(([0], np.cumsum(spelled.sizes[ids])))
            return total[1:] - np.repeat(total[edge[:-1]], counts)

        a_ends, b_ends = ends_of(a_ids, a_edge, a_n, self.a_bytes), ends_of(b_ids, b_edge, b_n, self.b_bytes)
        starts, owner = [], []
        for d in np.flatnonzero(good).tolist():
            mine = lanes(a_ends[a_edge[d]:a_edge[d + 1]], b_ends[b_edge[d]:b_edge[d + 1]], int(a_edge[d]), int(b_edge[d]))
            starts += mine
            owner += [d] * len(mine)
        a_cut, b_cut, doc, left, right, number = merge(a_ids, a_ends, b_ids, b_ends, starts, np.array(owner, np.int64))
        a_doc = np.repeat(np.arange(n), a_n)
        groups = np.bincount(a_doc[a_cut], minlength=n)
        # distinct pairs of each document
        code = left << 32 | right
        order = np.lexsort((code, doc))
        code, doc, number = code[order], doc[order], number[order]
        fresh = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (doc[1:] != doc[:-1]))) if len(code) else np.zeros(0, np.int64)
        times = np.add.reduceat(number, fresh) if len(fresh) else np.zeros(0, np.int64)
        pair_edge = np.concatenate(([0], np.cumsum(np.bincount(doc[fresh], minlength=n)))).astype(np.int32)
        links = np.bincount(doc, weights=number, minlength=n).astype(np.int64)
        return {"n_a": a_n, "n_b": b_n, "n_groups": groups, "n_links": links,
                "groups_sha256": self._digests(a_ids, a_cut, b_ids, b_cut, a_doc, np.repeat(np.arange(n), b_n), groups),
                "pairs": pa.ListArray.from_arrays(pa.array(pair_edge, pa.int32()), pa.array(code[fresh], pa.int64())),
                "times": pa.ListArray.from_arrays(pa.array(pair_edge, pa.int32()), pa.array(times, pa.int64()))}

    def _digests(self, a_ids, a_cut, b_ids, b_cut, a_doc, b_doc, groups) -> list[str]:
        """Digest of each document's ``a1,a2|b1;a3|b2,b3``."""
        group_a, group_b = np.cumsum(a_cut) - a_cut, np.cumsum(b_cut) - b_cut
        total = int(a_cut.sum())
        per_a, per_b = np.bincount(group_a, minlength=total), np.bincount(group_b, minlength=total)
        # A's tokens of a group stand before B's
        place_a = np.arange(len(a_ids)) + (np.cumsum(per_b) - per_b)[group_a]
        place_b = np.arange(len(b_ids)) + np.cumsum(per_a)[group_b]
        ids = np.empty(len(a_ids) + len(b_ids), np.int64)
        doc, closing = np.empty_like(ids), np.full(len(ids), ord(","), np.uint8)
        ids[place_a], ids[place_b] = a_ids, b_ids
        doc[place_a], doc[place_b] = a_doc, b_doc
        closing[place_a[a_cut]], closing[place_b[b_cut]] = ord("|"), ord(";")
        text = self.numbers(ids)
        ends = np.cumsum(self.numbers.sizes[ids])
        text[ends - 1] = closing
        edge = np.concatenate(([0], np.cumsum(np.bincount(doc, weights=self.numbers.sizes[ids], minlength=len(groups)).astype(np.int64)))).tolist()
        raw = text.tobytes()
        return [hashlib.sha256(raw[lo:hi - 1]).hexdigest() if hi > lo else "" for lo, hi in zip(edge, edge[1:])]


_ALIGNERS: dict[tuple[int, int], Aligner] = {}


def _aligner(a_data: bytes, b_data: bytes) -> Aligner:
    """A worker keeps the last tokenizers, and the words they remember, between tasks."""
    key = (zlib.crc32(a_data), zlib.crc32(b_data))
    if key not in _ALIGNERS:
        _ALIGNERS.clear()
        _ALIGNERS[key] = Aligner(a_data, b_data)
    return _ALIGNERS[key]


# ---------------------------------------------------------------- on Spark
def _file(path: str) -> bytes:
    with open(path, "rb") as f:
        data = f.read(MODEL_BYTES + 1)
    if len(data) > MODEL_BYTES:
        raise ValueError(f"{path} has more than {MODEL_BYTES} bytes")
    return data


def align(docs: DataFrame, a_path: str, b_path: str, text_col: str = "text") -> DataFrame:
    """``docs`` without the text, with ``OUTPUTS``: counts, the groups' digest, and the distinct pairs (A id << 32 | B id) with their links."""
    a_data, b_data = _file(a_path), _file(b_path)
    kept = [f for f in docs.schema.fields if f.name != text_col and f.name not in OUTPUTS.names]
    text = "__text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = _aligner(a_data, b_data)
        for whole in batches:
            sizes = pa.compute.binary_length(whole.column(text)).to_pylist()
            for lo, hi in slices(sizes, BATCH_CHARS):
                batch = whole.slice(lo, hi - lo)
                found = work(batch.column(text))
                new = [x if isinstance(x, pa.Array) else pa.array(x, pa.string() if name == "groups_sha256" else pa.int64())
                       for name, x in ((name, found[name]) for name in OUTPUTS.names)]
                yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in kept] + new, names=[f.name for f in kept] + OUTPUTS.names)

    # a text's column may share its name with one of the outputs
    plain = docs.select(*[F.col(f.name) for f in kept], F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias(text))
    return plain.mapInArrow(run, T.StructType([*kept, *OUTPUTS.fields]))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``(pair, n)``: documents that hold each pair."""
    return aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))


def _hot(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (ascending) of 2^k documents or more and their counts, for the least k that leaves at most ``most``."""
    sizes = {r["k"]: r["n"] for r in counts.groupBy(F.floor(F.log2("n")).alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()}
    total, least = 0, None
    for k in sorted(sizes, reverse=True):
        total += sizes[k]
        if total > most:
            break
        least = k
    if least is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows = counts.where(F.floor(F.log2("n")) >= least).toPandas().sort_values("pair")
    return rows["pair"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)


def count_links(aligned: DataFrame, counts: DataFrame, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """``aligned`` (a written table with a number ``__row`` for each row) without its pairs, with ``n_best`` (links whose count is the highest of their A id) and ``count_sum``."""
    best = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n").alias("n")).toPandas()  # a row an A id: bounded by the vocabulary
    top = np.zeros(int(best["a"].max()) + 1 if len(best) else 1, np.int64)
    top[best["a"].to_numpy(np.int64)] = best["n"].to_numpy(np.int64)
    pairs, numbers = _hot(counts, hot_pairs)
    sc = aligned.sparkSession.sparkContext
    shared = sc.broadcast((top, pairs, numbers))
    light = [f for f in aligned.schema.fields if f.name not in ("pairs", "times", "n_best", "count_sum")]
    rest = T.StructType([T.StructField("__row", T.LongType()), T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType()),
                         T.StructField("rest", T.ArrayType(T.LongType())), T.StructField("rest_times", T.ArrayType(T.LongType()))])

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, known, numbers = shared.value
        for batch in batches:
            lists = batch.column("pairs")
            edge = lists.offsets.to_numpy().astype(np.int64)
            pair = lists.values.to_numpy()[edge[0]:edge[-1]]
            weight = batch.column("times").values.to_numpy()[edge[0]:edge[-1]]
            n = len(lists)
            doc = np.repeat(np.arange(n), np.diff(edge))
            at = np.minimum(np.searchsorted(known, pair), max(0, len(known) - 1))
            hit = known[at] == pair if len(known) else np.zeros(len(pair), bool)
            count = numbers[at[hit]]
            is_best = count == top[pair[hit] >> 32]
            # exact sums: links and counts are whole numbers beyond what doubles hold
            total, good = np.zeros(n, np.int64), np.zeros(n, np.int64)
            np.add.at(total, doc[hit], count * weight[hit])
            np.add.at(good, doc[hit], np.where(is_best, weight[hit], 0))
            left = np.concatenate(([0], np.cumsum(np.bincount(doc[~hit], minlength=n)))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("__row"), pa.array(good), pa.array(total),
                 pa.ListArray.from_arrays(pa.array(left, pa.int32()), pa.array(pair[~hit], pa.int64())),
                 pa.ListArray.from_arrays(pa.array(left, pa.int32()), pa.array(weight[~hit], pa.int64()))], names=rest.names)

    looked = written(aligned.select("__row", "pairs", "times").mapInArrow(look_up, rest), "hot-links")
    cold = (looked.where(F.size("rest") > 0).select("__row", F.inline(F.arrays_zip("rest", "rest_times")))
            .join(counts, F.col("rest") == F.col("pair")))
    best_of = aligned.sparkSession.createDataFrame(best.astype("int64").rename(columns={"n": "top"}), "a long, top long")
    cold = (cold.join(F.broadcast(best_of), F.shiftright("pair", 32) == F.col("a"))
            .groupBy("__row").agg(F.sum(F.when(F.col("n") == F.col("top"), F.col("rest_times")).otherwise(0)).alias("cold_best"),
                                  F.sum(F.col("n") * F.col("rest_times")).alias("cold_sum")))
    both = (aligned.select(*[f.name for f in light]).join(looked.select("__row", "n_best", "count_sum"), "__row")
            .join(cold, "__row", "left"))
    return both.select(*[F.col(f.name) for f in light if f.name != "__row"],
                       (F.col("n_best") + F.coalesce("cold_best", F.lit(0))).alias("n_best"),
                       (F.col("count_sum") + F.coalesce("cold_sum", F.lit(0))).alias("count_sum"))


def alignment(docs: DataFrame, a_path: str, b_path: str, text_col: str = "text", hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """``align`` and ``count_links`` over a whole table."""
    numbered = docs.withColumn("__row", F.monotonically_increasing_id())
    aligned = written(align(numbered, a_path, b_path, text_col), "aligned")
    counts = written(pair_counts(aligned), "pair-counts")
    return count_links(aligned, counts, hot_pairs)
