"""Burrows-Wheeler transforms of string shards, merged by interleave refinement.

A shard's transform lists, for the sorted suffixes of its strings, the byte
before each; its last-to-first map leads from a suffix to the one that is longer
by that byte. Shards are merged without sorting suffixes of different shards
against each other: an interleave lists the suffixes of all shards, at first
shard after shard. Each round sorts it by the byte before, stably, and moves
every entry along its last-to-first map; after k rounds it is in the order of
the first k bytes (Holt and McMillan, 2014). Entries that a round tells apart
from all others had exactly k - 1 bytes in common with one and are left out of
later rounds, since no longer suffix of theirs is repeated either. So the rounds
give the common prefixes, and what is left after ``length`` rounds are the
repeated intervals of that length.
"""

from __future__ import annotations

import numpy as np

#: Symbols packed into the first sort key of a shard's suffixes (9 bits each).
_FIRST = 7


class Shard:
    """Strings (a byte matrix, zeros behind each string's length) with their sorted suffixes and transform.

    Every string has an end mark, which sorts before every byte; equal suffixes
    sort by string.
    """

    def __init__(self, strings: np.ndarray, lengths: np.ndarray):
        n, width = strings.shape
        wide = np.zeros((n, width + 1 + _FIRST), np.int64)
        wide[:, :width] = np.where(np.arange(width) < lengths[:, None], strings.astype(np.int64) + 1, 0)
        key = np.zeros((n, width + 1), np.int64)
        for k in range(_FIRST):
            key = key * 512 + wide[:, k:k + width + 1]
        inside = np.arange(width + 1) <= lengths[:, None]
        string, offset = np.nonzero(inside)
        rank_of = np.full((n, width + 1), -1, np.int64)
        order = np.argsort(key[inside], kind="stable")
        step = _FIRST
        sorted_key = key[inside][order]
        while True:
            fresh = np.concatenate(([0], np.cumsum(sorted_key[1:] != sorted_key[:-1])))
            if step > width or not len(order) or fresh[-1] == len(order) - 1:
                break
            rank = np.empty(len(order), np.int64)
            rank[order] = fresh
            rank_of[inside] = rank
            after = np.full((n, width + 1), -1, np.int64)
            if step <= width:
                after[:, :width + 1 - step] = rank_of[:, step:]
            both = rank * (len(order) + 1) + after[inside] + 1
            order = np.argsort(both, kind="stable")
            sorted_key = both[order]
            step *= 2
        self.string, self.offset = string[order].astype(np.int32), offset[order].astype(np.int32)
        before = np.zeros((n, width + 1), np.int64)
        before[:, 1:] = wide[:, :width]
        #: Symbol (byte + 1; 0 at a string's start) before each suffix, in suffix order.
        self.transform = before[inside][order].astype(np.uint16 if before.max(initial=0) > 255 else np.uint8)
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        place_of = np.zeros((n, width + 1), np.int32)
        place_of[inside] = place
        #: Place of the suffix that is longer by that symbol (meaningless at a string's start).
        self.longer = place_of[self.string, np.maximum(self.offset - 1, 0)]


def merged_intervals(shards: list[Shard], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge the shards' transforms.

    Returns the places of the suffixes that share ``length`` bytes with another,
    in merged order; the number of the interval of each; and for every place the
    bytes (``length`` at most) that its suffix has in common with another one.
    Places count through the shards' suffix orders, shard after shard.
    """
    sizes = [len(s.transform) for s in shards]
    base = np.cumsum([0] + sizes[:-1])
    transform = np.concatenate([s.transform for s in shards])
    longer = np.concatenate([s.longer + b for s, b in zip(shards, base)]).astype(np.int32)
    common = np.zeros(len(transform), np.int32)
    place = np.arange(len(transform), dtype=np.int32)
    block = np.zeros(len(transform), np.int32)
    for round_ in range(1, length + 1):
        before = transform[place]
        order = np.argsort(before, kind="stable")
        order = order[np.count_nonzero(before == 0):]  # a string's start has no longer suffix
        before, block, place = before[order], block[order], longer[place[order]]
        fresh = np.ones(len(order) + 1, bool)
        fresh[1:-1] = (before[1:] != before[:-1]) | (block[1:] != block[:-1])
        repeated = ~(fresh[:-1] & fresh[1:])
        block = np.cumsum(fresh[:-1], dtype=np.int32)[repeated]
        place = place[repeated]
        common[place] = round_
        if not len(place):
            break
    if len(place):
        block = np.cumsum(np.concatenate(([0], block[1:] != block[:-1])), dtype=np.int32)
    return place, block, common


def least_of_repeats(strings: np.ndarray, lengths: np.ndarray, value: np.ndarray, length: int, shard_strings: int = 1024) -> np.ndarray:
    """For every string and offset, the least ``value`` of the strings that hold the ``length`` bytes from there.

    (n, width - length + 1) in the dtype of ``value``; where fewer bytes are left, the string's own value.
    """
    n, width = strings.shape
    out = np.repeat(value[:, None], max(1, width - length + 1), axis=1)
    if not n:
        return out
    cuts = list(range(0, n, shard_strings))
    shards = [Shard(strings[a:a + shard_strings], lengths[a:a + shard_strings]) for a in cuts]
    place, block, _ = merged_intervals(shards, length)
    if len(place):
        string = np.concatenate([s.string + a for s, a in zip(shards, cuts)])[place]
        offset = np.concatenate([s.offset for s in shards])[place]
        heads = np.concatenate(([True], block[1:] != block[:-1])).nonzero()[0]
        out[string, offset] = np.minimum.reduceat(value[string], heads)[block]
    return out
