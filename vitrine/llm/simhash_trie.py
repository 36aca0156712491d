"""SimHash near-duplicates by a binary-trie self-join.

Fingerprints: words of the lower-cased (A-Z only) text, ``shingle``-word
shingles with repeats, XXH64 of each; a bit is 1 if it is set in more than half
of the shingle hashes.

Join: the distinct fingerprints form a binary trie, kept as a sorted array in
which a node is a range. Pairs of nodes are walked down together; a pair that
took different branches has one more differing bit, and a pair whose count
exceeds ``max_distance`` is dropped with everything below it.

Distribution: two fingerprints that differ in at most d of 64 bits agree on at
least one of d + 1 fixed bit blocks. Each block is in turn rotated to the top
of the trie, so that every linked pair lies below one node (block, value) of at
least one rotation, and these subtrees are the units of work. A subtree pair
that is still large is split on Spark into its child pairs, a few bits at a
time, with the same count and the same pruning, before it becomes a unit; so no
task ever holds more than a bounded number of fingerprints, however many share
a block. A unit returns for each fingerprint the root of its local component,
not the pairs: at most one row per fingerprint.

Defined cases: a null or empty text, or one without words, has fingerprint 0
and is linked like any other; a text with fewer words than a shingle is one
shingle; repeated rows are linked with each other (equal fingerprints); a null
id is fingerprinted and links others like any id, but is never a component's id
(of a component of null ids alone it is null). Columns beside id and text are carried along by
``keep_one`` and ignored elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import text_or_empty, written
from vitrine.llm.components import connected_components

#: Word shingles and the largest bit distance of the contract.
SHINGLE = 4
MAX_DISTANCE = 4
#: A unit of work holds at most this many fingerprints on either side (but for
#: subtrees that no bit is left to split).
UNIT = 20_000
#: Bits by which Spark splits a subtree pair that is larger.
STEP = 4
_HASHES_AT_ONCE = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of one text as an unsigned integer."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return 0
    line = b" ".join(words)
    if n <= shingle:
        return xxhash.xxh64_intdigest(line, 42)
    sizes = np.fromiter(map(len, words), np.int64, n) + 1
    ends = np.cumsum(sizes) - 1
    starts = (ends + 1 - sizes)[: n - shingle + 1].tolist()
    ends = ends[shingle - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for i in range(0, len(starts), _HASHES_AT_ONCE):
        part = [digest(line[a:b], 42) for a, b in zip(starts[i:i + _HASHES_AT_ONCE], ends[i:i + _HASHES_AT_ONCE])]
        bits = np.unpackbits(np.array(part, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return sum(1 << j for j in np.nonzero(ones * 2 > len(starts))[0].tolist())


def fingerprint_column(text: Column, shingle: int = SHINGLE) -> Column:
    """``fingerprint`` of a text column as a (signed) long."""

    @F.pandas_udf("long")
    def simhash(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))

    return simhash(text)


def _blocks(max_distance: int) -> list[tuple[int, int]]:
    """(first bit from the top, width) of max_distance + 1 blocks that cover the 64 bits."""
    edges = [round(64 * i / (max_distance + 1)) for i in range(max_distance + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _bits(col: Column, first: int, width: int) -> Column:
    """``width`` bits of a long from bit ``first``, counted from the top."""
    return F.shiftrightunsigned(F.shiftleft(col, first), 64 - width) if width else F.lit(0).cast("long")


def trie_pairs(keys: np.ndarray, roots: list[np.ndarray], depth: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Walk node pairs of the trie over sorted uint64 ``keys``; yields index pairs of linked leaves.

    ``roots``: arrays a_lo, a_hi, b_lo, b_hi, diff of node pairs at bit ``depth``
    (a node paired with itself: equal ranges). Pairs of small nodes are compared
    bit by bit at once; the frontier is worked in slices, so memory is bounded.
    """
    zeros: dict[int, np.ndarray] = {}
    stack = [(depth, roots)]
    while stack:
        d, (al, ah, bl, bh, diff) = stack.pop()
        if len(al) > 200_000:
            half = len(al) // 2
            stack += [(d, [x[half:] for x in (al, ah, bl, bh, diff)]), (d, [x[:half] for x in (al, ah, bl, bh, diff)])]
            continue
        na, nb = ah - al, bh - bl
        small = (na * nb <= 32) | (d >= 64)
        if small.any():
            yield from _leaf_pairs(keys, al[small], na[small], bl[small], nb[small], budget)
        al, ah, bl, bh, diff = (x[~small] for x in (al, ah, bl, bh, diff))
        if not len(al):
            continue
        if d not in zeros:
            bit = (keys >> np.uint64(63 - d)) & np.uint64(1)
            zeros[d] = np.concatenate(([0], np.cumsum(1 - bit.astype(np.int64))))
        z = zeros[d]
        am, bm = al + z[ah] - z[al], bl + z[bh] - z[bl]
        own = al == bl
        child = [np.concatenate(x) for x in zip(
            (al, am, bl, bm, diff), (am, ah, bm, bh, diff), (al, am, bm, bh, diff + 1),
            tuple(x[~own] for x in (am, ah, bl, bm, diff + 1)))]
        live = (child[1] > child[0]) & (child[3] > child[2]) & (child[4] <= budget)
        if live.any():
            stack.append((d + 1, [x[live] for x in child]))


def _leaf_pairs(keys, al, na, bl, nb, budget):
    sizes = na * nb
    ends = np.cumsum(sizes)
    for lo in range(0, len(sizes), 50_000):
        hi = min(lo + 50_000, len(sizes))
        s = sizes[lo:hi]
        at = np.repeat(np.arange(lo, hi), s)
        k = np.arange(s.sum()) - np.repeat(ends[lo:hi] - s - (ends[lo - 1] if lo else 0), s)
        i, j = al[at] + k // nb[at], bl[at] + k % nb[at]
        keep = np.bitwise_count(keys[i] ^ keys[j]) <= budget
        keep &= i != j
        if keep.any():
            yield i[keep], j[keep]


class Forest:
    """Components of integer nodes, joined by arrays of links."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, u: np.ndarray, v: np.ndarray) -> None:
        while True:
            a, b = self.root[u], self.root[v]
            open_ = a != b
            if not open_.any():
                return
            u, v, a, b = u[open_], v[open_], a[open_], b[open_]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up


def _join_units(max_distance: int, blocks: list[tuple[int, int]]):
    """mapInArrow body: rows sorted by unit; each whole unit is joined once its last row is there."""
    key_cols = ["turn", "value", "bits", "x", "y", "diff"]

    def rotated(fp: np.ndarray, turn: int) -> np.ndarray:
        first = np.uint64(blocks[turn][0])
        return fp if not first else (fp << first) | (fp >> (np.uint64(64) - first))

    def unit_roots(df: pd.DataFrame) -> pd.DataFrame:
        """All units of ``df`` at once, per rotation and depth."""
        out = []
        for (turn, bits), part in df.groupby(["turn", "bits"], sort=False):
            fp = part["fp"].to_numpy().view(np.uint64)
            rot = rotated(fp, turn)
            name = part[["value", "x", "y"]].to_numpy()
            unit = np.concatenate(([0], np.cumsum((name[1:] != name[:-1]).any(axis=1))))
            side = part["side"].to_numpy()
            order = np.lexsort((rot, side, unit))
            fp, rot, unit, side, diff = fp[order], rot[order], unit[order], side[order], part["diff"].to_numpy()[order]
            n_units = unit[-1] + 1
            lo = np.searchsorted(unit, np.arange(n_units))
            hi = np.append(lo[1:], len(unit))
            mid = lo + np.bincount(unit, weights=side == 0, minlength=n_units).astype(np.int64)
            own = part["x"].to_numpy()[order][lo] == part["y"].to_numpy()[order][lo]
            roots = [lo, np.where(own, hi, mid), np.where(own, lo, mid), hi, diff[lo].astype(np.int64)]
            forest = Forest(len(fp))
            for i, j in trie_pairs(rot, roots, blocks[turn][1] + int(bits), max_distance):
                forest.add(i, j)
            linked = forest.root != np.arange(len(fp))
            node = part["node"].to_numpy()[order]
            out.append(pd.DataFrame({"u": node[linked], "v": node[forest.root[linked]]}))
        return pd.concat(out) if out else pd.DataFrame({"u": [], "v": []}, dtype="int64")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pd.DataFrame] = []
        rows = 0
        schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

        def flush(df):
            if len(df):
                yield from pa.Table.from_pandas(unit_roots(df), schema=schema, preserve_index=False).to_batches()

        for batch in batches:
            held.append(batch.to_pandas())
            rows += batch.num_rows
            if rows >= 100_000:
                df = pd.concat(held, ignore_index=True)
                keys = df[key_cols].to_numpy()
                whole = int((keys != keys[-1]).any(axis=1).sum())  # rows before the unit that may go on
                yield from flush(df.iloc[:whole])
                held, rows = [df.iloc[whole:]], len(df) - whole
        if held:
            yield from flush(pd.concat(held, ignore_index=True))

    return run


def fingerprint_links(classes: DataFrame, max_distance: int = MAX_DISTANCE, unit: int = UNIT) -> DataFrame:
    """``classes(fp long, node long)``, distinct in both -> links ``(u, v)`` between nodes.

    The links join exactly the fingerprints that a chain of steps of at most
    ``max_distance`` bits joins.
    """
    blocks = _blocks(max_distance)
    turned = F.array(*[
        F.struct(F.lit(t).alias("turn"), _bits(F.col("fp"), first, width).alias("value"),
                 (F.shiftleft("fp", first).bitwiseOR(F.shiftrightunsigned("fp", 64 - first)) if first else F.col("fp")).alias("rot"),
                 F.lit(width).alias("width"))
        for t, (first, width) in enumerate(blocks)])
    rows = classes.select("fp", "node", F.inline(turned))

    def below(bits: int) -> Column:
        """The ``bits`` bits of the rotated fingerprint below its block."""
        if not bits:
            return F.lit(0).cast("long")
        return F.expr(f"shiftrightunsigned(shiftleft(rot, width), {64 - bits})")

    sizes = rows.groupBy("turn", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    pairs = written(sizes.select("turn", "value", F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"),
                                 F.lit(0).alias("diff"), F.col("n").alias("nx"), F.col("n").alias("ny")), "trie-pairs")
    done, bits = [], 0
    deepest = 64 - max(w for _, w in blocks)
    while True:
        large = (F.greatest("nx", "ny") > unit) & F.lit(bits + STEP <= deepest)
        done.append((bits, pairs.where(~large)))
        if not pairs.where(large).take(1):
            break
        heavy = pairs.where(large).select("turn", "value", "x", "y", "diff")
        # children of the nodes that large pairs name: counts of distinct prefixes, not of pairs
        named = heavy.select("turn", "value", F.explode(F.array("x", "y")).alias("at")).distinct()
        kids = (rows.select("turn", "value", below(bits).alias("at"), below(bits + STEP).alias("kid"))
                .join(named, ["turn", "value", "at"], "left_semi")
                .groupBy("turn", "value", "at", "kid").agg(F.count(F.lit(1)).alias("n")))
        kids = written(kids, "trie-nodes")
        left = kids.select("turn", "value", F.col("at").alias("x"), F.col("kid").alias("kx"), F.col("n").alias("nx"))
        right = kids.select("turn", "value", F.col("at").alias("y"), F.col("kid").alias("ky"), F.col("n").alias("ny"))
        mask = (1 << STEP) - 1
        pairs = written(
            heavy.join(left, ["turn", "value", "x"]).join(right, ["turn", "value", "y"])
            .where("x != y OR kx <= ky")
            .withColumn("diff", F.col("diff") + F.expr(f"bit_count((kx ^ ky) & {mask})"))
            .where(F.col("diff") <= max_distance)
            .where("NOT (kx = ky AND nx = 1)")
            .select("turn", "value", F.col("kx").alias("x"), F.col("ky").alias("y"), "diff", "nx", "ny"), "trie-pairs")
        bits += STEP
    parts = []
    for bits, units in done:
        ends = units.select("turn", "value", "x", "y", "diff", F.inline(F.when(
            F.col("x") == F.col("y"), F.array(F.struct(F.lit(0).alias("side"), F.col("x").alias("at")))).otherwise(
            F.array(F.struct(F.lit(0).alias("side"), F.col("x").alias("at")), F.struct(F.lit(1).alias("side"), F.col("y").alias("at"))))))
        parts.append(rows.withColumn("at", below(bits)).join(ends, ["turn", "value", "at"])
                     .select("turn", "value", F.lit(bits).alias("bits"), "x", "y", "diff", "side", "fp", "node"))
    work = parts[0]
    for p in parts[1:]:
        work = work.union(p)
    keys = ["turn", "value", "bits", "x", "y", "diff"]
    return (work.repartition(*keys).sortWithinPartitions(*keys)
            .mapInArrow(_join_units(max_distance, blocks), "u long, v long"))


def _groups(docs: DataFrame, id_col: str, text_col: str, shingle: int, max_distance: int) -> tuple[DataFrame, DataFrame]:
    """``(id, fp)`` of every row, and ``(fp, keeper)``: the least ``(id, key)`` of the fingerprint's component.

    ``key`` tells texts of one id apart. Nodes are fingerprints, so that an id
    with two unlike texts doesn't join their components.
    """
    prints = written(docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"),
                                 fingerprint_column(text_or_empty(text_col), shingle).alias("fp")), "fingerprints")
    classes = prints.groupBy("fp").agg(F.min(F.when(F.col("id").isNotNull(), F.struct("id", "key"))).alias("least"))
    # fingerprints of null ids alone link others too
    links = fingerprint_links(classes.select("fp", F.col("fp").alias("node")), max_distance)
    comps = connected_components(links)
    roots = written(classes.join(comps, F.col("fp") == F.col("node"), "left")
                    .select("fp", "least", F.coalesce("component", "fp").alias("root")), "trie-roots")
    # written, so that both sides of the join are plain exchanges and AQE can split a large component
    keepers = written(roots.groupBy("root").agg(F.min("least").alias("keeper")), "trie-keepers")
    return prints.select("id", "fp"), roots.join(keepers, "root").select("fp", "keeper")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = SHINGLE, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """One row per input row: id, ``fp`` (signed long) and ``component_id``, the smallest id reachable."""
    prints, named = _groups(docs, id_col, text_col, shingle, max_distance)
    return prints.join(named, "fp").select(F.col("id").alias(id_col), "fp", F.col("keeper.id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             shingle: int = SHINGLE, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """One document of each group: the one with the smallest id, and of that id's texts in the group one.

    Rows that repeat id and text leave one row; unlike texts of one id are
    documents of their own. Rows with a null id have no name by which a group
    could keep them; they stay, though they link others into groups.
    """
    rows = docs.where(F.col(id_col).isNotNull())
    kept = (_groups(docs, id_col, text_col, shingle, max_distance)[1].where("keeper IS NOT NULL")
            .select(F.col("keeper.id").alias("__kept"), F.col("keeper.key").alias("__kept_key")).distinct())
    # the key is of the text alone: with it the join's exchange serves the removal of repeated rows too
    named = (rows.withColumn("__key", F.xxhash64(text_col))
             .join(kept, (F.col(id_col) == F.col("__kept")) & (F.col("__key") == F.col("__kept_key")), "left_semi")
             .dropDuplicates([id_col, "__key", text_col]).drop("__key"))
    return named.unionByName(docs.where(F.col(id_col).isNull()))
