"""Hard negatives and embedding near-duplicates against plain all-pairs versions."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from keepsake.llm import embeddings, negatives

SCHEMA = "vec_id long, embedding array<float>, label int, node string, score int"


def frame(spark, rows, kind=SCHEMA):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], l, "n", 1) for i, v, l in rows], kind).repartition(7)


ODD = [(9000, None, 1), (9001, [], 1), (9002, [1.0, None, 0.0], 1), (9003, [float("nan")] * 3, 1), (9004, [float("inf"), 0, 0], 2), (9005, [0.0] * 6, 2), (None, [1.0] * 6, 1), (9006, [0.5] * 6, None)]


def clustered(n, size, seed, spread=0.06):
    """Vectors of a few directions, some of them close copies, exact copies and opposite ones."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, size))
    rows = []
    for k in range(n):
        v = centres[rng.integers(5)] * rng.uniform(0.5, 2) + rng.normal(size=size) * rng.choice([0.0, spread, 3.0])
        rows.append((k, v.astype(np.float32).tolist(), int(rng.integers(4))))
    return rows + [(n + k, rows[k * 3][1], k % 4) for k in range(n // 10)]


def plain_negatives(rows, is_anchor, k=5, low=80, high=100):
    q = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v], l) for i, v, l in rows if i is not None and l is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    score = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    out = Counter()
    for i, v, l in (r for r in q if is_anchor(r[0])):
        others = [(-score(v, w), j, m) for j, w, m in q if len(w) == len(v)]
        for s, j in sorted((s, j) for s, j, m in others if m == l and j != i)[:k]:
            near = sorted((t, n) for t, n, m in others if m != l and low * -s <= 100 * -t <= high * -s)[:k]
            for rank, (t, n) in enumerate(near, 1):
                out[(i, j, rank, n, -s, -t)] += 1
    return out


@pytest.mark.parametrize(("tile", "block"), [(64, 7), (37, 4096), (4096, 4096)])
def test_hard_negatives(spark, tile, block):
    rows = clustered(500, 6, 1) + ODD + [(600, [0.25, 0.5, 1.0], 1), (601, [0.5, 0.5, 1.0], 1), (602, [0.25, 0.5, 0.9], 2)]
    found = negatives.mine_hard_negatives(frame(spark, rows), F.col("vec_id") % 10 == 0, tile=tile, block=block)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert Counter(map(tuple, found.collect())) == plain_negatives(rows, lambda i: i % 10 == 0)


def test_ties_go_to_smaller_ids(spark):
    rows = [(k, [1.0, 0.0], k % 2) for k in range(300)]  # one vector alone
    found = negatives.mine_hard_negatives(frame(spark, rows), F.col("vec_id") == 20, tile=16)
    assert sorted((r.positive_id, r["rank"], r.negative_id) for r in found.collect()) == [(p, k + 1, 2 * k + 1) for p in (0, 2, 4, 6, 8) for k in range(5)]


def test_scores_beyond_doubles_are_exact(spark):
    rows = [(k, [1e6 + k, 3e6 - k * 3], 0 if k < 3 else 1) for k in range(9)]
    found = negatives.mine_hard_negatives(frame(spark, rows, SCHEMA.replace("float", "double")), F.col("vec_id") == 0, low=0, high=200)
    exact = {k: 256 * 256 * (10**6 * (10**6 + k) + 3 * 10**6 * (3 * 10**6 - k * 3)) for k in range(9)}
    assert {(r.positive_id, r.positive_score) for r in found.collect()} == {(k, exact[k]) for k in (1, 2)}
    assert {(r.negative_id, r.negative_score) for r in found.collect()} == {(k, exact[k]) for k in range(3, 8)}


def test_ball_tree_holds_its_rows():
    x = np.random.default_rng(3).normal(size=(700, 9))
    tree = negatives.ball_tree(x, leaf=16)
    leaves = [n for n in range(len(tree.start)) if tree.children[n][0] < 0]
    assert sorted(r for n in leaves for r in tree.order[tree.start[n] : tree.end[n]]) == list(range(700))
    for n in range(len(tree.start)):
        own = x[tree.order[tree.start[n] : tree.end[n]]]
        assert (np.sqrt(((own - tree.center[n]) ** 2).sum(axis=1)) <= tree.radius[n] + 1e-12).all()


def test_no_anchors_and_empty_tables(spark):
    rows = frame(spark, clustered(30, 4, 2))
    assert negatives.mine_hard_negatives(rows, F.lit(False)).count() == 0
    assert negatives.mine_hard_negatives(rows.limit(0), F.lit(True)).count() == 0
    assert embeddings.embedding_groups(rows.limit(0)).count() == 0


def plain_groups(rows, similarity):
    fit = [(n, i, np.array(v, dtype=np.float32).astype(float)) for n, (i, v, _) in enumerate(rows) if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, parent = Counter(), {n: n for n, _, _ in fit}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (n, _, x) in enumerate(fit):
        for m, _, y in fit[:a]:
            if len(x) == len(y) and x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= similarity:
                links[n] += 1
                links[m] += 1
                parent[find(n)] = find(m)
    least = {}
    for n, i, _ in fit:
        least[find(n)] = min(least.get(find(n), i), i)
    return Counter((i, links[n], least[find(n)] if n in parent else i, i is not None and i == (least[find(n)] if n in parent else i)) for n, (i, _, _) in enumerate(rows))


@pytest.mark.parametrize(("size", "similarity", "width", "tile"), [(6, 0.95, 8, 32768), (6, 0.95, 2, 50), (64, 0.95, 8, 64), (24, 0.9, 4, 31), (24, 0.999, 16, 20), (1, 0.95, 8, 10), (16, 0.3, 4, 40)])
def test_links_and_components(spark, size, similarity, width, tile):
    rows = clustered(400, size, size + width, 0.15) + ODD + [(3, [0.25, 0.5, 1.0], 1), (4, [0.26, 0.5, 1.0], 1), (4, [-0.26, -0.5, -1.0], 1)]
    found = embeddings.embedding_groups(frame(spark, rows), similarity, width, tile)
    assert found.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert Counter(map(tuple, found.collect())) == plain_groups(rows, similarity)


def test_a_cosine_just_at_the_bound(spark):
    rows = [(0, [20, 0, 0, 0, 0], 1), (1, [19, 5, 3, 2, 1], 1), (2, [38, 10, 6, 4, 2], 1), (3, [18.99, 5, 3, 2, 1], 1)]  # 380 / (20 x 20)
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.embedding_groups(frame(spark, rows, SCHEMA.replace("float", "double"))).collect()}
    assert found[0] == (2, 0, True) and found[3] == (2, 0, False) and found[1] == (3, 0, False)


def test_rotation_keeps_lengths_and_does_not_depend_on_neighbours():
    x = np.random.default_rng(4).normal(size=(50, 37))
    turned = embeddings.rotate(x)
    assert turned.shape == (50, 64)
    assert np.allclose(np.linalg.norm(turned, axis=1), np.linalg.norm(x, axis=1)) and np.allclose(turned @ turned.T, x @ x.T)
    assert all((embeddings.rotate(x[k : k + 1])[0] == turned[k]).all() for k in range(50))
