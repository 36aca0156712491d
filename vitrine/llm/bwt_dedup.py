"""Exact removal of repeated byte strings over merged Burrows-Wheeler transforms.

A byte goes if a string of ``LENGTH`` bytes covers it that also starts in a
document with a smaller id. What is compared is the input; matches never cross
documents; matches may overlap.

How the strings meet. In every string of ``LENGTH`` bytes the ``GRAM`` bytes with
the least hash are its anchor, a choice that depends on the string alone. So
equal strings share an anchor, and only the surroundings of anchors that occur in
more than one document need be compared, anchor by anchor:

1. Documents are packed into groups of about ``GROUP_BYTES`` and written, so
   every later pass sees the same groups.
2. Each group sends its distinct anchor hashes, delta-coded, to buckets by hash;
   a bucket answers each group with one bit per hash: is it in more than one
   document?
3. For those anchors each group sends its distinct contexts (the bytes of all
   strings that can choose the anchor) with the least id that has them. Where an
   anchor has one context only, its least id is known. The others of a bucket
   form shards with a Burrows-Wheeler transform each, which are merged by
   iterative interleave refinement; its repeated intervals give every string's
   least id. Each group gets back one bit per context and offset.
4. Each group marks the strings that start in a smaller document, and takes out
   the bytes they cover.

Scale: groups, buckets and answers have bounded sizes whatever repeats. A
repeated passage is one hash, and one context, of a group. An anchor in more
than ``HOT_GROUPS`` groups, whose contexts would all meet in one bucket, is
dealt out anew by its single strings. Buckets grow in number with the bytes of
the input. Anchors are matched by 40 bits of hash, but what is equal is decided
byte by byte.

Defined cases: ids are whole numbers (another type is refused); null counts as empty; texts shorter than ``LENGTH`` keep
everything; a null id is neither a source nor shortened; rows that share an id
don't remove from each other; repeated rows are each answered; very long texts
are groups of their own and are read in pieces that overlap; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.llm.bwt import least_of_repeats
from vitrine.llm.common import text_or_empty, written

LENGTH = 50
GRAM = 24
GROUP_BYTES = 2 << 20
BUCKET_BYTES = 8 << 20
#: Contexts whose transforms are merged together, about: as many whole anchors' contexts.
TOGETHER = 2000
HOT_GROUPS = 500
KEY_BITS = 40
#: Positions, and contexts, that are worked on at once.
_PIECE = 1 << 17
_ROWS = 1 << 14
_rng = np.random.default_rng(20)
_TABLE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_WORD = (1 << 64) - 1
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _pack(values: np.ndarray) -> bytes:
    """Compressed byte planes of integers."""
    import zstandard

    width = values.dtype.itemsize
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).view(np.uint8).reshape(-1, width).T.tobytes())


def _unpack(data: bytes, dtype) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(dtype).reshape(-1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * _MIX
    return h ^ (h >> np.uint64(29))


def _hash_rows(rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row and its length; rows hold zeros behind their length."""
    h = lengths.astype(np.uint64) * _MIX
    for column in np.ascontiguousarray(rows.T):
        h *= _FACTOR
        h += _TABLE[column]
    return _mixed(h)


def _gram_hashes(buf: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the ``gram`` bytes from every position, by doubling."""
    h, size, power = _TABLE[buf], 1, int(_FACTOR)  # h: of the ``size`` bytes from every position
    out, done = None, 0
    while True:
        if gram & size:
            piece = h[done:]
            if out is None:
                out = piece
            else:
                n = min(len(out), len(piece))
                out = out[:n] * np.uint64(power) + piece[:n]
            done += size
        if size * 2 > gram:
            break
        h = h[:-size] * np.uint64(power) + h[size:]
        power = power * power & _WORD
        size *= 2
    return _mixed(out[:len(buf) - gram + 1])


def anchors(buf: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Positions and key hashes of the anchors of all strings of ``length`` bytes that lie within a document."""
    n, found, keys = len(buf), [], []
    mask = np.uint64((1 << 24) - 1)
    starts = np.concatenate(([0], ends[:-1]))
    for lo in range(0, max(0, n - length + 1), _PIECE):
        hi = min(n, lo + _PIECE + length - 1)
        h = _gram_hashes(buf[lo:hi], gram)
        packed = (h & ~mask) | np.arange(len(h), dtype=np.uint64)
        window, least, size = length - gram + 1, packed, 1
        while size * 2 <= window:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < window:
            least = np.minimum(least[:len(packed) - window + 1], least[window - size:])
        # string starts too close to their document's end
        bad = np.zeros(len(least) + 1, np.int32)
        here = (ends > lo) & (starts < hi)
        a = np.clip(np.maximum(starts[here], ends[here] - length + 1) - lo, 0, len(least))
        b = np.clip(ends[here] - lo, 0, len(least))
        np.add.at(bad, a, 1)
        np.add.at(bad, b, -1)
        at = (least[np.cumsum(bad[:-1]) == 0] & mask).astype(np.int64)
        if len(at):
            at = at[np.concatenate(([True], at[1:] != at[:-1]))]
            found.append(at + lo)
            keys.append(_mixed(h[at]) >> np.uint64(64 - KEY_BITS))  # least hashes are small: mixed anew, keys spread over all buckets
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at, key = np.concatenate(found), np.concatenate(keys)
    fresh = np.concatenate(([True], at[1:] != at[:-1]))  # pieces overlap
    return at[fresh], key[fresh]


class Group:
    """One packed group: its bytes, documents, anchors and the distinct keys among them."""

    def __init__(self, payload: bytes, lens: np.ndarray, ids: list, length: int):
        import zstandard

        self.buf = np.frombuffer(zstandard.ZstdDecompressor().decompress(payload), np.uint8)
        self.ends = np.cumsum(lens).astype(np.int64)
        self.starts = self.ends - lens
        self.named = np.array([i is not None for i in ids], bool)
        self.ids = np.array([i if i is not None else 0 for i in ids], np.int64)
        self.length = length
        at, key = anchors(self.buf, self.ends, length, min(GRAM, length))
        doc = np.searchsorted(self.ends, at, side="right")
        keep = self.named[doc] if len(doc) else np.zeros(0, bool)
        self.at, self.key, self.doc = at[keep], key[keep], doc[keep]
        self.keys, self.of = np.unique(self.key, return_inverse=True)

    def several(self) -> np.ndarray:
        """Of each distinct key: does it occur in documents of different ids here?"""
        ids = self.ids[self.doc]
        low, high = np.full(len(self.keys), np.iinfo(np.int64).max), np.full(len(self.keys), np.iinfo(np.int64).min)
        np.minimum.at(low, self.of, ids)
        np.maximum.at(high, self.of, ids)
        return low != high

    def occurrences(self, again: np.ndarray, hot: np.ndarray) -> None:
        """Contexts of the anchors whose key is marked; single strings where it is hot."""
        length, reach = self.length, self.length - min(GRAM, self.length)
        pick = again[self.of] if len(self.of) else np.zeros(0, bool)
        at, doc, key, warm = self.at[pick], self.doc[pick], self.key[pick], hot[self.of][pick] if len(self.of) else np.zeros(0, bool)
        a, b = np.maximum(at - reach, self.starts[doc]), np.minimum(at + length, self.ends[doc])
        if warm.any():
            n = (b - a - length + 1)[warm]
            single = np.repeat(a[warm], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            sdoc = np.repeat(doc[warm], n)
            skey = np.zeros(len(single), np.uint64)
            for lo in range(0, len(single), _ROWS):
                at_once = single[lo:lo + _ROWS]
                full = np.full(len(at_once), length)
                skey[lo:lo + _ROWS] = _hash_rows(self._texts(at_once, full, length), full) >> np.uint64(64 - KEY_BITS)
            a, b = np.concatenate((a[~warm], single)), np.concatenate((b[~warm], single + length))
            doc, key = np.concatenate((doc[~warm], sdoc)), np.concatenate((key[~warm], skey))
        self.a, self.size, self.who = a, b - a, doc
        width = 2 * length - min(GRAM, length)
        name = np.zeros(len(a), np.uint64)
        for lo in range(0, len(a), _ROWS):
            name[lo:lo + _ROWS] = _hash_rows(self._texts(a[lo:lo + _ROWS], self.size[lo:lo + _ROWS], width), self.size[lo:lo + _ROWS])
        order = np.lexsort((self.size, name, key))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (key[order][1:] != key[order][:-1]) | (name[order][1:] != name[order][:-1]) | (self.size[order][1:] != self.size[order][:-1])
        self.entry = np.empty(len(order), np.int64)
        self.entry[order] = np.cumsum(fresh) - 1
        head = order[fresh]
        self.entry_key, self.entry_size, self.entry_at = key[head], self.size[head], a[head]
        self.entry_least = np.full(len(head), np.iinfo(np.int64).max)
        np.minimum.at(self.entry_least, self.entry, self.ids[doc])

    def _texts(self, at: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
        """Rows of ``width`` bytes from the places, zeros behind each size."""
        if not len(at):
            return np.zeros((0, width), np.uint8)
        k = np.arange(width)
        rows = self.buf[np.minimum(at[:, None] + k, len(self.buf) - 1)]
        rows[k >= size[:, None]] = 0
        return rows

    def entry_bytes(self, part: slice) -> np.ndarray:
        """The bytes of some entries, one after another."""
        at, size = self.entry_at[part], self.entry_size[part]
        return self.buf[np.repeat(at - np.cumsum(size) + size, size) + np.arange(int(size.sum()))]

    def removed(self, answer: np.ndarray) -> np.ndarray:
        """Which bytes go, given one bit per entry and offset."""
        n, length = len(self.buf), self.length
        begins = np.zeros(n, bool)
        later = self.ids[self.who] > self.entry_least[self.entry] if len(self.entry) else np.zeros(0, bool)
        bits = answer[self.entry] if len(self.entry) else np.zeros(0, np.uint64)
        for o in range(int((self.size - length).max(initial=-1)) + 1):
            go = (later | ((bits >> np.uint64(o)) & np.uint64(1)).astype(bool)) & (self.size - length >= o)
            begins[self.a[go] + o] = True
        total = np.concatenate(([0], np.cumsum(begins)))
        k = np.arange(n)
        return total[k + 1] > total[np.maximum(k - length + 1, 0)]


def _parts(keys: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """Buckets of sorted keys."""
    bucket = (keys >> np.uint64(KEY_BITS - bits)).astype(np.int64)
    for b in np.unique(bucket).tolist():
        yield b, slice(int(np.searchsorted(bucket, b)), int(np.searchsorted(bucket, b, side="right")))


def _may_share(rows: np.ndarray, size: np.ndarray, key: np.ndarray, length: int) -> np.ndarray:
    """False for contexts that share no string with another context of their key, as far as parts of them tell.

    Strings that start at one of a third of the offsets have a part in common,
    at the same place if no context of the key was cut at a document's edge.
    """
    width = rows.shape[1]
    keep = np.isin(key, key[size < width])
    bounds = np.linspace(0, width - length + 1, 4).astype(int)
    for lo, hi in zip(bounds[:-1], bounds[1:] - 1):
        if lo <= hi:
            part = np.ascontiguousarray(rows[:, hi:lo + length])
            _, of, counts = np.unique(_mixed(_hash_rows(part, np.zeros(len(part), np.int64)) ^ key), return_inverse=True, return_counts=True)
            keep |= counts[of] > 1
    return keep


def _by_anchor(classes: np.ndarray, keys: np.ndarray) -> Iterator[np.ndarray]:
    """Consecutive classes, about TOGETHER of them, cut between different keys."""
    if not len(classes):
        return
    heads = np.append(np.nonzero(np.concatenate(([True], keys[1:] != keys[:-1])))[0], len(keys))
    lo = 0
    for hi in heads[1:].tolist():
        if hi - lo >= TOGETHER or hi == len(keys):
            yield classes[lo:hi]
            lo = hi


def _pack_documents(group_bytes: int):
    schema = pa.schema([("grp", pa.string()), ("ids", pa.list_(pa.int64())), ("lens", pa.list_(pa.int64())), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        task, k = TaskContext.get().partitionId(), 0
        ids, texts, size = [], [], 0

        def flush():
            data = zstandard.ZstdCompressor(level=1).compress(b"".join(texts))
            return pa.RecordBatch.from_pylist([{"grp": f"{task}-{k}", "ids": ids, "lens": [len(t) for t in texts], "payload": data}], schema=schema)

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = t.as_buffer().to_pybytes() if t.is_valid else b""
                ids.append(i)
                texts.append(raw)
                size += len(raw) + 16
                if size >= group_bytes:
                    yield flush()
                    ids, texts, size, k = [], [], 0, k + 1
        if ids:
            yield flush()

    return run


def _groups(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[dict, Group]]:
    for batch in batches:
        for k in range(batch.num_rows):
            row = {name: batch.column(name)[k] for name in batch.schema.names}
            yield row, Group(row["payload"].as_py(), np.array(row["lens"].as_py(), np.int64), row["ids"].as_py(), length)


def _answer_contexts(part: pd.DataFrame, length: int) -> pd.DataFrame:
    """The bits of every group of a bucket: string by string, does it start in a document before the entry's first?"""
    width = 2 * length - min(GRAM, length)
    lists = [np.cumsum(_unpack(k, np.uint64)) for k in part["keys"]]
    key = np.concatenate(lists)
    size = np.concatenate([_unpack(x, np.uint8) for x in part["sizes"]]).astype(np.int64)
    flat = np.concatenate([_unpack(x, np.uint8) for x in part["bytes"]])
    least = np.concatenate([_unpack(x, np.int64) for x in part["least"]])
    rows = np.zeros((len(key), width + 9), np.uint8)  # key, length and bytes: what makes a context
    rows[:, :8] = key.astype(">u8").view(np.uint8).reshape(-1, 8)
    rows[:, 8] = size
    rows[:, 9:][np.arange(width) < size[:, None]] = flat
    classes, head, of = np.unique(rows.view(f"V{width + 9}").reshape(-1), return_index=True, return_inverse=True)
    of = of.reshape(-1)
    first = np.full(len(classes), np.iinfo(np.int64).max)
    np.minimum.at(first, of, least)
    ckey, csize = key[head], size[head]
    offsets = width - length + 1
    best = np.repeat(first[:, None], offsets, axis=1)
    alone = np.ones(len(classes), bool)
    same = ckey[1:] == ckey[:-1]
    alone[1:] &= ~same
    alone[:-1] &= ~same
    text = rows[:, 9:]
    some = np.nonzero(~alone)[0]
    some = some[_may_share(text[head[some]], csize[some], ckey[some], length)]
    for part_of in _by_anchor(some, ckey[some]):
        best[part_of] = least_of_repeats(text[head[part_of]], csize[part_of], first[part_of], length)
    # a bit where the string also starts in a document before the entry's first
    answer = np.zeros(len(key), np.uint64)
    for o in range(offsets):
        answer |= (best[of, o] < least).astype(np.uint64) << np.uint64(o)
    out, at = [], 0
    for x in lists:
        out.append(_pack(answer[at:at + len(x)]))
        at += len(x)
    return pd.DataFrame({"bucket": part["bucket"], "grp": part["grp"], "bits": out})


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, group_bytes: int = GROUP_BYTES,
                   bucket_bytes: int = BUCKET_BYTES, hot_groups: int = HOT_GROUPS, keep_text: bool = True) -> DataFrame:
    """One row per input row: id, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and the ``kept`` bytes (binary; null without ``keep_text``)."""
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col} is {docs.schema[id_col].dataType.simpleString()}: the order of documents is that of whole-numbered ids")
    packed = written(docs.select(F.col(id_col).cast("long"), text_or_empty(text_col)).mapInArrow(
        _pack_documents(group_bytes), "grp string, ids array<long>, lens array<long>, payload binary"), "groups")
    total = packed.agg(F.sum(F.aggregate("lens", F.lit(0).cast("long"), lambda x, y: x + y))).first()[0] or 0
    bits = min(24, max(3, math.ceil(math.log2(max(1, total / bucket_bytes)))))

    def send_keys(batches):
        for row, g in _groups(batches, length):
            many = g.several()
            rows = [{"bucket": b, "grp": row["grp"].as_py(), "keys": _pack(np.diff(g.keys[s], prepend=np.uint64(0))), "many": np.packbits(many[s]).tobytes()}
                    for b, s in _parts(g.keys, bits)]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("bucket", pa.int64()), ("grp", pa.string()), ("keys", pa.binary()), ("many", pa.binary())]))

    def answer_keys(part: pd.DataFrame) -> pd.DataFrame:
        lists = [np.cumsum(_unpack(k, np.uint64)) for k in part["keys"]]
        every, of, counts = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
        many = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8), count=len(x)) for m, x in zip(part["many"], lists)]).astype(bool)
        again = counts > 1
        again[of[many]] = True
        hot = counts > hot_groups
        out, at = [], 0
        for x in lists:
            mine = of[at:at + len(x)]
            at += len(x)
            out.append(_pack((again[mine] + 2 * hot[mine]).astype(np.uint8)))
        return pd.DataFrame({"bucket": part["bucket"], "grp": part["grp"], "marks": out})

    sent = packed.mapInArrow(send_keys, "bucket long, grp string, keys binary, many binary")
    marks = sent.groupBy("bucket").applyInPandas(answer_keys, "bucket long, grp string, marks binary")
    marks = written(marks.groupBy("grp").agg(F.collect_list(F.struct("bucket", "marks")).alias("marks")), "marks")
    marked = packed.join(marks, "grp", "left")

    def with_occurrences(batches):
        for row, g in _groups(batches, length):
            flags = np.zeros(len(g.keys), np.uint8)
            have = {m["bucket"]: m["marks"] for m in row["marks"].as_py() or []}
            for b, s in _parts(g.keys, bits):
                flags[s] = _unpack(have[b], np.uint8)
            g.occurrences((flags & 1).astype(bool), (flags & 2).astype(bool))
            yield row, g

    def send_contexts(batches):
        for row, g in with_occurrences(batches):
            rows = []
            for b, s in _parts(g.entry_key, bits):
                rows.append({"bucket": b, "grp": row["grp"].as_py(), "keys": _pack(np.diff(g.entry_key[s], prepend=np.uint64(0))),
                             "sizes": _pack(g.entry_size[s].astype(np.uint8)), "bytes": _pack(g.entry_bytes(s)), "least": _pack(g.entry_least[s])})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("bucket", pa.int64()), ("grp", pa.string()), *[(x, pa.binary()) for x in ("keys", "sizes", "bytes", "least")]]))

    def answer_contexts(part: pd.DataFrame) -> pd.DataFrame:
        return _answer_contexts(part, length)

    contexts = marked.mapInArrow(send_contexts, "bucket long, grp string, keys binary, sizes binary, bytes binary, least binary")
    answers = contexts.groupBy("bucket").applyInPandas(answer_contexts, "bucket long, grp string, bits binary")
    answers = written(answers.groupBy("grp").agg(F.collect_list(F.struct("bucket", "bits")).alias("bits")), "answers")

    def finish(batches):
        schema = pa.schema([(id_col, pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])
        for row, g in with_occurrences(batches):
            answer = np.zeros(len(g.entry_key), np.uint64)
            have = {m["bucket"]: m["bits"] for m in row["bits"].as_py() or []}
            for b, s in _parts(g.entry_key, bits):
                answer[s] = _unpack(have[b], np.uint64)
            gone = g.removed(answer)
            opens = gone.copy()
            opens[1:] &= ~gone[:-1]
            heads = g.starts[g.starts < g.ends]
            opens[heads] = gone[heads]
            n_gone, n_open = np.concatenate(([0], np.cumsum(gone))), np.concatenate(([0], np.cumsum(opens)))
            out = []
            for i, ok, a, b in zip(g.ids.tolist(), g.named.tolist(), g.starts.tolist(), g.ends.tolist()):
                kept = g.buf[a:b][~gone[a:b]].tobytes()
                out.append((i if ok else None, b - a, int(n_gone[b] - n_gone[a]), int(n_open[b] - n_open[a]), hashlib.sha256(kept).hexdigest(), kept if keep_text else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return marked.join(answers, "grp", "left").mapInArrow(
        finish, f"`{id_col}` long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
