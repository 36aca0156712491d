"""Packing of token sequences by non-negative least squares over length combinations.

Each document's ids (and one end id) are cut into whole windows and a rest. Only
the histogram of the rests' lengths leaves Spark; it has fewer bins than the
window has places. On it, shallow combinations of lengths that fill a window
exactly are listed (two lengths with any repeat counts, three lengths once each),
their repeat counts are solved by non-negative least squares against the
histogram and rounded, and what is left is packed greedily: the longest rests
that fit, and a piece of one more where a gap remains. The last tokens, less than
a window in all, go to sequences of powers of two. So no sequence needs padding.

The solution is a table of intervals: of the rests of one length, those ranked
from .. to have their place in such a sequence at such an offset. The documents
find their intervals by their rank among the rests of their length, and no
sequence is ever gathered in one place.

Scale: texts are read and encoded once, and the ids are written (two bytes an id
where the vocabulary allows). Ranks are counted in two steps, per block of
written rows and length and then over the blocks, so a length that a third of all
rests have is ranked in as many tasks as there are blocks. The intervals are
broadcast while they are few (``MOST_INTERVALS``) and joined otherwise. The ids
are shuffled once, to their pieces. An id table that is lost with an executor is
read again from the checkpoint folder.

Defined cases: a null or empty text has the end id alone; rows that share an id or
are equal are packed each by itself; a null id stays null; an empty table gives
no pieces; only the id column is taken from the input.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.llm.common import text_or_empty, written
from vitrine.llm.token_words import json_tokenizer, slices

WINDOW = 2048
END_ID = 1
#: Rounds of exact steps along combinations that share no length.
ROUNDS = 60
#: Best combinations that a round chooses from.
CHOICE = 30_000
#: Intervals that are broadcast (72 bytes each); more are joined by shuffle.
MOST_INTERVALS = 200_000
#: Bytes of a tokenizer file at most, as it goes to every task.
MODEL_BYTES = 64_000_000
#: Fixed value: Spark's monotonically_increasing_id counts rows of a partition in its lower 33 bits.
ROW_BITS = 33


# ---------------------------------------------------------------- the solution on the histogram
def combinations(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Combinations that fill the window, as (first entry of each, place of a length, its repeats).

    ``lengths`` ascend, each below ``window``. At most O(window^2 / 12) combinations.
    """
    place = np.full(window + 1, -1)
    place[lengths] = np.arange(len(lengths))
    sizes, places, repeats = [], [], []

    def put(p: np.ndarray, r: np.ndarray) -> None:
        sizes.append(np.full(len(p), p.shape[1]))
        places.append(p.ravel())
        repeats.append(r.ravel())

    for k, a in enumerate(lengths.tolist()):
        times = np.arange(1, window // a + 1)
        left = window - a * times
        if left[-1] == 0:
            put(np.array([[k]]), np.array([[times[-1]]]))
        longer = lengths[k + 1:]
        if len(longer):
            of, with_ = np.nonzero((left[:, None] >= longer) & (left[:, None] % longer == 0)) if len(times) * len(longer) < 4_000_000 else _divisors(left, longer)
            put(np.stack([np.full(len(of), k), k + 1 + with_], 1), np.stack([times[of], left[of] // longer[with_]], 1))
            third = window - a - longer
            ok = third > longer
            mid, third = k + 1 + np.flatnonzero(ok), place[third[ok]]
            mid, third = mid[third >= 0], third[third >= 0]
            put(np.stack([np.full(len(mid), k), mid, third], 1), np.ones((len(mid), 3), np.int64))
    if not sizes:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = np.concatenate(sizes)
    return np.cumsum(size) - size, np.concatenate(places), np.concatenate(repeats)


def _divisors(left: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found = [np.flatnonzero((x >= lengths) & (x % lengths == 0)) for x in left]
    return np.repeat(np.arange(len(left)), [len(f) for f in found]), np.concatenate(found)


def solve(first: np.ndarray, places: np.ndarray, repeats: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Repeat counts x >= 0 that make |A x - counts| small.

    A round steps exactly along the combinations of largest gain, no two of which
    share a length, so that no step disturbs another.
    """
    x = np.zeros(len(first))
    if not len(first):
        return x
    owner = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(places))))
    norm = np.bincount(owner, weights=repeats * repeats)
    left = counts.astype(float)
    for _ in range(rounds):
        slope = np.add.reduceat(repeats * left[places], first)
        step = np.maximum(slope / norm, -x)
        gain = step * (2 * slope - step * norm)
        best = np.argpartition(-gain, min(CHOICE, len(gain)) - 1)[:CHOICE]
        best = best[np.argsort(-gain[best], kind="stable")]
        taken, chosen = bytearray(len(counts)), []
        for j in best[gain[best] > 1e-9].tolist():
            mine = places[first[j]:first[j + 1] if j + 1 < len(first) else None].tolist()
            if not any(taken[p] for p in mine):
                chosen.append(j)
                for p in mine:
                    taken[p] = 1
        if not chosen or gain[chosen].sum() < 1e-4 * (left @ left):
            break
        x[chosen] += step[chosen]
        mask = np.zeros(len(first), bool)
        mask[chosen] = True
        used = mask[owner]
        left -= np.bincount(places[used], weights=repeats[used] * step[owner[used]], minlength=len(counts))
    return x


class Layout:
    """Intervals of rests, laid into sequences.

    A row of ``intervals``: of the rests of length ``rest``, those ranked in
    [from_rank, to_rank) have their tokens [start, start + length) in sequence
    sequence + (rank - from_rank + phase) // per, at
    offset + (rank - from_rank + phase) % per * length.
    """

    def __init__(self, lengths: Iterable[int], counts: Iterable[int], window: int):
        self.window, self.sequences, self.intervals = window, 0, []
        self.left = np.zeros(window, np.int64)
        self.stock: dict[int, deque] = {}
        for length, count in zip(lengths, counts):
            self._add(int(length), int(length), 0, 0, int(count))

    def _add(self, length: int, rest: int, start: int, rank: int, count: int) -> None:
        self.stock.setdefault(length, deque()).append((rest, start, rank, count))
        self.left[length] += count

    def _take(self, length: int, cut: int, items: int, per: int, sequence: int, offset: int) -> None:
        """Lay ``items`` pieces of ``length`` (cut to ``cut`` tokens; what is cut off goes back)."""
        stock, phase = self.stock[length], 0
        self.left[length] -= items
        while items:
            rest, start, rank, count = stock.popleft()
            used = min(items, count)
            if used < count:
                stock.appendleft((rest, start, rank + used, count - used))
            self.intervals.append((rest, rank, rank + used, start, cut, sequence, per, phase, offset))
            if cut < length:
                self._add(length - cut, rest, start + cut, rank, used)
            items -= used
            phase += used

    def lay(self, pattern: list[tuple[int, int]], times: int, cut: tuple[int, int] | None = None) -> None:
        """``times`` sequences, each of the lengths of ``pattern`` and the first tokens of one more (length, tokens)."""
        offset = 0
        for length, per in pattern:
            self._take(length, length, per * times, per, self.sequences, offset)
            offset += length * per
        if cut:
            self._take(cut[0], cut[1], times, 1, self.sequences, offset)
        self.sequences += times

    def combine(self, x: np.ndarray, first: np.ndarray, places: np.ndarray, repeats: np.ndarray, lengths: np.ndarray) -> None:
        """Lay the solved combinations, rounded, the most repeated first, as far as their lengths last."""
        ends = np.append(first[1:], len(places))
        for j in np.argsort(-x, kind="stable").tolist():
            if x[j] < 0.5:
                break
            pattern = [(int(lengths[p]), int(r)) for p, r in zip(places[first[j]:ends[j]], repeats[first[j]:ends[j]])]
            times = min(int(x[j] + 0.5), *(int(self.left[length]) // r for length, r in pattern))
            if times:
                self.lay(pattern, times)

    def greedy(self) -> None:
        """Pack what is left: the longest that fit, then a piece of the shortest that doesn't."""
        sizes = np.arange(self.window)
        while int(self.left @ sizes) >= self.window:
            present = np.flatnonzero(self.left)
            gap, pattern, at = self.window, [], len(present)
            while gap and at and (at := int(np.searchsorted(present[:at], gap, "right"))):
                length = int(present[at - 1])
                per = min(gap // length, int(self.left[length]))
                pattern.append((length, per))
                gap -= per * length
                at -= 1
            used = dict(pattern)
            cut = None
            if gap:
                spare = next(int(s) for s in present[np.searchsorted(present, gap, "right"):] if self.left[s] > used.get(int(s), 0))
                cut = (spare, gap)
                used[spare] = used.get(spare, 0) + 1
            self.lay(pattern, min(int(self.left[length]) // n for length, n in used.items()), cut)
        total = int(self.left @ sizes)
        for size in [1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1]:
            offset = 0
            while offset < size:
                length = int(np.flatnonzero(self.left)[-1])
                cut = min(length, size - offset)
                self._take(length, cut, 1, 1, self.sequences, offset)
                offset += cut
            self.sequences += 1


_INTERVAL = T.StructType([T.StructField(n, T.LongType()) for n in (
    "rest", "from_rank", "to_rank", "at", "length", "sequence", "per", "phase", "first")])


def layout(histogram: dict[int, int], window: int = WINDOW) -> Layout:
    """The packing of rests given as length -> count (1 <= length < window)."""
    lengths = np.array(sorted(histogram), np.int64)
    counts = np.array([histogram[x] for x in lengths.tolist()], np.int64)
    out = Layout(lengths, counts, window)
    first, places, repeats = combinations(lengths, window)
    out.combine(solve(first, places, repeats, counts), first, places, repeats, lengths)
    out.greedy()
    return out


# ---------------------------------------------------------------- the work on Spark
_WORDS: dict[int, object] = {}


def _tokenizer(data: bytes):
    """A worker keeps the last tokenizer, and the words it remembers, between tasks."""
    key = zlib.crc32(data)
    if key not in _WORDS:
        _WORDS.clear()
        _WORDS[key] = json_tokenizer(data)
    return _WORDS[key]


def _id_type(data: bytes, end_id: int) -> str:
    from tokenizers import Tokenizer

    return "<u2" if max(Tokenizer.from_str(data.decode()).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"


def token_table(docs: DataFrame, data: bytes, end_id: int, id_col: str, text_col: str, id_type: str) -> DataFrame:
    """``(row, id, n, ids)`` written: a row number, the ids of the whole text and the end id as little-endian integers."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _tokenizer(data)
        for whole in batches:
            sizes = pa.compute.binary_length(whole.column("text")).to_pylist()
            for lo, hi in slices(sizes):
                batch = whole.slice(lo, hi - lo)
                ids, counts = words(batch.column("text"))
                ids, out, first = ids.astype(id_type), [], 0
                end = np.array([end_id], id_type).tobytes()
                for last in np.cumsum(counts).tolist():
                    out.append(ids[first:last].tobytes() + end)
                    first = last
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row"), batch.column("id"), pa.array(counts + 1, pa.int64()), pa.array(out, pa.binary())], names=["row", "id", "n", "ids"])

    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("id", docs.schema[id_col].dataType),
                           T.StructField("n", T.LongType()), T.StructField("ids", T.BinaryType())])
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    return written(numbered.mapInArrow(encode, schema), "token-ids")


def _ranked(rests: DataFrame) -> DataFrame:
    """``(row, full, rest, rank)``: each row's rank among the rows of its rest length, from 0."""
    per_block = written(rests.groupBy("rest", "block").agg(F.count(F.lit(1)).alias("n")), "rest-blocks")
    before = per_block.select("rest", "block", (F.sum("n").over(Window.partitionBy("rest").orderBy("block")) - F.col("n")).alias("before"))
    inside = rests.withColumn("place", F.row_number().over(Window.partitionBy("rest", "block").orderBy("row")) - 1)
    return inside.join(before, ["rest", "block"]).select("row", "full", "rest", (F.col("before") + F.col("place")).alias("rank"))


def pieces(lengths: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(row, start, length, sequence_id, offset)`` of every piece of rows given as ``(row, n)``, n >= 1.

    Sequences of one whole window have odd ids, packed ones even ids.
    """
    spark = lengths.sparkSession
    rows = lengths.select("row", F.shiftright("row", ROW_BITS).alias("block"),
                          F.floor(F.col("n") / window).cast("long").alias("full"), (F.col("n") % window).alias("rest"))
    whole = (rows.where("full > 0")
             .withColumn("before", F.sum("full").over(Window.partitionBy("block").orderBy("row")) - F.col("full"))
             .select("row", F.shiftleft("block", 40).alias("base"), "before", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1)).alias("i"))
             .select("row", (F.col("i") * window).alias("start"), F.lit(window).cast("long").alias("length"),
                     ((F.col("base") + F.col("before") + F.col("i")) * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset")))
    rests = rows.where("rest > 0")
    histogram = {r["rest"]: r["n"] for r in rests.groupBy("rest").agg(F.count(F.lit(1)).alias("n")).collect()}
    intervals = layout(histogram, window).intervals
    frame = pd.DataFrame(np.array(intervals, np.int64).reshape(-1, len(_INTERVAL.names)), columns=_INTERVAL.names)
    table = spark.createDataFrame(frame, _INTERVAL)
    if len(intervals) <= MOST_INTERVALS:
        table = F.broadcast(table)
    turn = F.col("rank") - F.col("from_rank") + F.col("phase")
    packed = (_ranked(rests).join(table, "rest").where("rank >= from_rank AND rank < to_rank")
              .select("row", (F.col("full") * window + F.col("at")).alias("start"), "length",
                      ((F.col("sequence") + F.floor(turn / F.col("per"))) * 2).cast("long").alias("sequence_id"),
                      (F.col("first") + turn % F.col("per") * F.col("length")).alias("offset")))
    return whole.unionByName(packed)


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
         end_id: int = END_ID) -> tuple[DataFrame, str]:
    """Pieces of all documents and the numpy type of their ids.

    A piece: the id column, ``start`` (its document's ids before it), ``length``,
    ``ids`` (little-endian integers of that type), ``doc_tokens`` (with the end
    id), ``sequence_id`` and ``offset`` (there, gapless from 0).
    """
    with open(tokenizer_path, "rb") as f:
        data = f.read(MODEL_BYTES + 1)
    if len(data) > MODEL_BYTES:
        raise ValueError(f"{tokenizer_path} has more than {MODEL_BYTES} bytes")
    id_type = _id_type(data, end_id)
    size = np.dtype(id_type).itemsize
    tokens = token_table(docs, data, end_id, id_col, text_col, id_type)
    laid = written(pieces(tokens.select("row", "n"), window), "pieces")
    # the ids are the streamed side: a document's pieces are few
    out = tokens.join(laid, "row").select(
        F.col("id").alias(id_col), "start", "length",
        F.substring("ids", (F.col("start") * size + 1).cast("int"), (F.col("length") * size).cast("int")).alias("ids"),
        F.col("n").alias("doc_tokens"), "sequence_id", "offset")
    return out, id_type


def ids_crc32(ids: Column, id_type: str) -> Column:
    """crc32 (unsigned) of the ids as little-endian unsigned 32-bit integers."""
    if id_type == "<u4":
        return F.crc32(ids)

    @F.pandas_udf("long")
    def crc(parts: pd.Series) -> pd.Series:
        return pd.Series([zlib.crc32(np.frombuffer(p, id_type).astype("<u4").tobytes()) for p in parts], dtype="int64")

    return crc(ids)
