"""Cover-tree join against all pairs."""

import numpy as np
import pytest

from vitrine.llm.cover_tree import CoverTree, leaf_pairs, near_vectors


def plain(rows, min_cosine=0.95):
    """rows: (id, vector or None) -> (id, n_links, component)."""
    ok, vecs = [], []
    for k, (i, v) in enumerate(rows):
        if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok.append(k)
            vecs.append(np.array(v, float))
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for x in range(len(ok)):
        for y in range(x + 1, len(ok)):
            a, b = vecs[x], vecs[y]
            if len(a) == len(b) and a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)) >= min_cosine:
                links[ok[x]] += 1
                links[ok[y]] += 1
                root[find(ok[x])] = find(ok[y])
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(i, least.get(find(k), i))
    return sorted((i, links[k], least[find(k)]) for k, (i, _) in enumerate(rows))


def sample(seed, n=150, dim=16):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dim))
    near = base[:30] + rng.normal(scale=0.12, size=(30, dim))
    ball = base[0] + rng.normal(scale=0.05, size=(60, dim))
    all_ = np.concatenate((base, near, near * 3, ball, np.repeat(base[5:6], 40, axis=0))).astype(np.float32)
    return [(i, v.tolist()) for i, v in enumerate(all_[rng.permutation(len(all_))])]


@pytest.mark.parametrize("block,pivots", [(4000, 2048), (25, 6), (20, 1)])
def test_all_links(spark, block, pivots):
    rows = sample(4)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in near_vectors(df, block=block, pivots=pivots).collect())
    assert got == plain(rows)


def test_tree_covers_and_halves():
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 8))
    x = np.concatenate([c + rng.normal(scale=s, size=(60, 8)) for c, s in zip(centres, np.geomspace(0.01, 0.3, 12))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree = CoverTree(x)
    assert len(tree.centre) > 12
    for k, kids in enumerate(tree.children):
        d = np.linalg.norm(x[tree.members[k]] - x[tree.centre[k]], axis=1)
        assert d.max() <= tree.radius[k] + 1e-12
        if kids:
            assert sorted(np.concatenate([tree.members[c] for c in kids])) == sorted(tree.members[k])
            assert tree.centre[k] in [tree.centre[c] for c in kids]
            assert max(tree.radius[c] for c in kids) <= tree.radius[k]
    compared = sum(len(a) * len(b) for a, b in leaf_pairs(tree, tree, 0.1))
    assert compared < len(x) ** 2 / 3


def test_edge_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]),
            (7, [None, 1.0]), (8, [1.0, 0.0, 0.0]), (9, [-1.0, 0.0]), (10, [1e30, 1e29]), (11, [1.0, 0.0]), (12, [-0.0, 0.0]), (13, [1.0, 0.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, node string")
    out = {r["vec_id"]: r for r in near_vectors(df).collect()}
    assert sorted((i, r["n_links"], r["component_id"]) for i, r in out.items()) == plain(rows)
    assert sorted(i for i, r in out.items() if not r["kept"]) == [1, 10, 11, 13]
    assert near_vectors(df.limit(0)).count() == 0


def test_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(1, [1.0, 0.1]), (1, [1.0, 0.1]), (None, [1.0, 0.1]), (None, None)], "vec_id long, embedding array<double>")
    out = near_vectors(df).collect()
    assert sorted((r["vec_id"] or -1, r["n_links"], r["component_id"] or -1) for r in out) == [(-1, 0, -1), (-1, 2, 1), (1, 2, 1), (1, 2, 1)]
