"""Embedding near-duplicates: exact threshold pairs by cover trees walked in pairs.

Vectors are taken as directions; a cosine of c is a distance of sqrt(2 - 2c) on
the unit sphere. Equal vectors form one class with a weight. A bounded set of
pivots splits the classes into cells (nearest pivot), and a cell that is still
large is dealt out by a hash, so a block holds at most about ``BLOCK`` classes,
whatever share of the rows one place has. Two blocks meet unless their pivots
are further apart than both radii and the threshold.

In a meeting each block has a cover tree: nested levels whose covering radii
halve, each child the centre of a greedy net of its parent's points. A level
that does not condense its points (``CONDENSE`` for each centre, from ``TRIAL``
centres on) ends the tree there in a leaf. The two trees are walked together: a
pair of nodes whose centres are further apart than both covering radii and the
threshold is pruned with everything below it, otherwise the wider node is
opened; two leaves are compared vector by vector, in double precision.

A meeting returns for each class the weight of its links found there and the
root of its component within the meeting: at most a row per class, never the
pairs. Weights add up over meetings, components by the shared component job.

On unclustered vectors nothing condenses: at 64 dimensions and cosines mostly
within 0.3 of zero a tree is one node, and the blocks are compared in whole, by
matrix products. Opened down to the link distance such a tree would have about a
node a vector; its walk prunes over 99 % of the vector pairs, but by testing as many
node pairs, which costs more than the products (figures in the README).

Scale: no block, task or group grows with the table; the pivots are the only
broadcast data (``PIVOTS`` vectors at most). Meetings of blocks that bounds
can't separate are quadratic, as an exact join of unclustered vectors is.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components link with nothing; vectors of different lengths don't link; a
repeated row is another vector of its class, also when it repeats an id; a null
id counts as a vector but names no component unless it stands alone; an empty
table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import written
from vitrine.llm.components import connected_components
from vitrine.llm.simhash_trie import Forest

MIN_COSINE = 0.95
#: Classes of a block, about; pivots at most.
BLOCK = 4000
PIVOTS = 2048
#: Points for each centre that a level must condense at least, from so many centres on; points of a leaf that is not opened further.
CONDENSE = 2
TRIAL = 16
LEAF = 32
#: Distances and cosines this close to a bound are not decided by it.
SLACK = 1e-9


class CoverTree:
    """Nodes as arrays: centre, covering radius, the node's points and its children."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.members: list[np.ndarray] = []
        self.children: list[list[int]] = []
        if len(points):
            self._add(0, np.arange(len(points)))
            # the root's net radius covers the sphere; levels below halve it
            todo = [(0, 2.0)]
            while todo:
                node, radius = todo.pop()
                todo += self._open(node, radius / 2)

    def _add(self, centre: int, members: np.ndarray) -> int:
        d = _distances(self.points[members], self.points[centre])
        self.centre.append(centre)
        self.radius.append(float(d.max()))
        self.members.append(members)
        self.children.append([])
        return len(self.centre) - 1

    def _open(self, node: int, radius: float) -> list[tuple[int, float]]:
        members = self.members[node]
        while self.radius[node] <= radius and radius > 1e-7:
            radius /= 2  # levels on which the node has itself as its only child
        if len(members) <= LEAF or radius <= 1e-7:
            return []
        nets, rest = [], members
        centre = self.centre[node]  # nested: a centre stays one on every level below
        while len(rest):
            if len(nets) >= TRIAL and len(members) - len(rest) < CONDENSE * len(nets):
                return []
            near = _distances(self.points[rest], self.points[centre]) <= radius
            nets.append((centre, rest[near]))
            rest = rest[~near]
            if len(rest):
                centre = int(rest[0])
        kids = [self._add(c, m) for c, m in nets]
        self.children[node] = kids
        return [(k, radius) for k in kids]


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(((a - b) ** 2).sum(axis=-1), 0))


def leaf_pairs(one: CoverTree, two: CoverTree, reach: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Dual traversal: members of leaf pairs that may hold points within ``reach``. Of a tree with itself, each pair of nodes once."""
    if not one.centre or not two.centre:
        return
    same = one is two
    stack = [(0, 0)]
    while stack:
        a, b = stack.pop()
        if not (same and a == b):
            d = _distances(one.points[one.centre[a]], two.points[two.centre[b]])
            if d > one.radius[a] + two.radius[b] + reach + SLACK:
                continue
        ka, kb = one.children[a], two.children[b]
        if same and a == b and ka:
            stack += [(x, y) for i, x in enumerate(ka) for y in ka[i:]]
        elif ka and (not kb or one.radius[a] >= two.radius[b]):
            stack += [(x, b) for x in ka]
        elif kb:
            stack += [(a, y) for y in kb]
        else:
            yield one.members[a], two.members[b]


def meeting(raw: np.ndarray, unit: np.ndarray, first: np.ndarray, second: np.ndarray | None, weight: np.ndarray,
            min_cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Links' weight of each point, and the root of each, among points ``first`` (and ``second``, if given, against them)."""
    reach = float(np.sqrt(max(0.0, 2 - 2 * min_cosine)))
    links, forest = np.zeros(len(raw)), Forest(len(raw))
    one = CoverTree(unit[first])
    two = one if second is None else CoverTree(unit[second])
    other = first if second is None else second
    norm = np.sqrt((raw * raw).sum(axis=1))
    for x, y in leaf_pairs(one, two, reach):
        mirrored = second is None and x is y
        x, y = first[x], other[y]
        for lo in range(0, len(x), 512):
            part = x[lo:lo + 512]
            cosine = unit[part] @ unit[y].T
            near = cosine >= min_cosine - SLACK
            if mirrored:
                near &= part[:, None] < y[None, :]
            i, j = np.nonzero(near)
            if not len(i):
                continue
            close = np.abs(cosine[i, j] - min_cosine) <= SLACK
            u, v = part[i], y[j]
            if close.any():  # decided by the vectors as given
                exact = (raw[u] * raw[v]).sum(axis=1) / (norm[u] * norm[v])
                keep = ~close | (exact >= min_cosine)
                u, v = u[keep], v[keep]
            links += np.bincount(u, weights=weight[v], minlength=len(raw)) + np.bincount(v, weights=weight[u], minlength=len(raw))
            forest.add(u, v)
    return links, forest.root


def _unit(vectors: np.ndarray) -> np.ndarray:
    big = np.abs(vectors).max(axis=1, keepdims=True)  # before squaring: no overflow
    v = vectors / big
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", min_cosine: float = MIN_COSINE,
                 block: int = BLOCK, pivots: int = PIVOTS) -> DataFrame:
    """One row per input row: id, ``n_links`` (other vectors linked directly), ``component_id``, ``kept``."""
    value = F.col(vector_col).cast("array<double>")
    fine = (F.size(value) > 0) & F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(value, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).alias("id"), F.when(F.coalesce(fine, F.lit(False)), value).alias("vec"))
    classes = written(rows.where("vec IS NOT NULL").groupBy("vec").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("weight"))
                      .withColumn("node", F.monotonically_increasing_id()).withColumn("dim", F.size("vec")), "vectors")
    links = written(_links(classes, min_cosine, block, pivots), "vector-links")
    spread = links.groupBy("node").agg(F.sum("links").alias("links"))
    comps = connected_components(links.where("node != root").select(F.col("node").alias("u"), F.col("root").alias("v")))
    named = classes.join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    facts = (named.join(least, "component").join(spread, "node", "left")
             .select("vec", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).cast("long").alias("n_links"), "component_id"))
    return (rows.join(facts, "vec", "left")
            .select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("component_id", "id").alias("component_id"))
            .withColumn("kept", F.col(id_col) == F.col("component_id")))


def _links(classes: DataFrame, min_cosine: float, block: int, pivots: int) -> DataFrame:
    """``(node, links, root)``: partial weights and local roots, of classes with a link."""
    spark = classes.sparkSession
    schema = "node long, links double, root long"
    sizes = {r["dim"]: r["n"] for r in classes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    out = spark.createDataFrame([], schema)
    for dim, n in sorted(sizes.items()):
        out = out.union(_links_of(classes.where(F.col("dim") == dim), n, min_cosine, block, pivots, schema))
    return out


def _links_of(classes: DataFrame, n: int, min_cosine: float, block: int, pivots: int, schema: str) -> DataFrame:
    spark = classes.sparkSession
    wanted = max(1, min(pivots, -(-n // block)))
    # a bounded sample by hash: some more than wanted, the first of them in hash order
    share = min(1.0, 4.0 * wanted / n + 64 / n)
    ticket = F.xxhash64("vec")
    some = classes.where(F.pmod(ticket, F.lit(1_000_003)) < F.lit(int(share * 1_000_003))).orderBy(ticket).limit(wanted).select("vec").collect()
    if not some:
        some = classes.limit(1).select("vec").collect()
    centres = _unit(np.array([r["vec"] for r in some]))
    shared = spark.sparkContext.broadcast(centres)

    @F.pandas_udf("cell int, far double")
    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for vecs in batches:
            if len(vecs):
                u = _unit(np.array(vecs.tolist()))
                cell = (u @ shared.value.T).argmax(axis=1)
                far = _distances(u, shared.value[cell])
            else:
                cell, far = np.zeros(0, np.int32), np.zeros(0)
            yield pd.DataFrame({"cell": cell.astype(np.int32), "far": far})

    placed = written(classes.withColumn("at", nearest("vec")).select("node", "vec", "weight", "at.cell", "at.far"), "cells")
    cells = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius")).collect()  # a row per pivot
    parts = {r["cell"]: -(-r["n"] // block) for r in cells}
    radius = {r["cell"]: r["radius"] for r in cells}
    reach = float(np.sqrt(max(0.0, 2 - 2 * min_cosine)))
    live = sorted(parts)
    meet = []  # of cells; their parts are paired on Spark
    for k, a in enumerate(live):
        d = _distances(centres[live[k:]], centres[a])
        for b, far in zip(live[k:], d):
            if far <= radius[a] + radius[b] + reach + SLACK:
                meet.append((a, b, parts[a], parts[b]))
    meetings = spark.createDataFrame(meet, "a int, b int, na int, nb int")
    # each class joins the meetings of its part with every part of the other cell
    part = F.expr("cast(pmod(xxhash64(node), n) as int)")
    left = (placed.join(meetings.withColumnRenamed("a", "cell"), "cell").withColumn("n", F.col("na")).withColumn("p", part)
            .withColumn("q", F.explode(F.when(F.col("cell") == F.col("b"), F.sequence(F.col("p"), F.col("nb") - 1)).otherwise(F.sequence(F.lit(0), F.col("nb") - 1))))
            .select(F.col("cell").alias("a"), "b", "p", "q", F.lit(0).alias("side"), "node", "vec", "weight"))
    right = (placed.join(meetings.withColumnRenamed("b", "cell"), "cell").withColumn("n", F.col("nb")).withColumn("q", part)
             .withColumn("p", F.explode(F.when(F.col("cell") == F.col("a"), F.sequence(F.lit(0), F.col("q"))).otherwise(F.sequence(F.lit(0), F.col("na") - 1))))
             .where("NOT (a = cell AND p = q)")
             .select("a", F.col("cell").alias("b"), "p", "q", F.lit(1).alias("side"), "node", "vec", "weight"))

    def join(group: pd.DataFrame) -> pd.DataFrame:
        raw = np.array(group["vec"].tolist())
        side, node, weight = group["side"].to_numpy(), group["node"].to_numpy(), group["weight"].to_numpy(np.float64)
        first, second = np.nonzero(side == 0)[0], np.nonzero(side == 1)[0]
        own = group["a"].iloc[0] == group["b"].iloc[0] and group["p"].iloc[0] == group["q"].iloc[0]
        if not own and (not len(first) or not len(second)):
            return pd.DataFrame({"node": [], "links": [], "root": []})
        links, root = meeting(raw, _unit(raw), first, None if own else second, weight, min_cosine)
        some = links > 0
        return pd.DataFrame({"node": node[some], "links": links[some], "root": node[root[some]]})

    return left.union(right).groupBy("a", "b", "p", "q").applyInPandas(join, schema)
