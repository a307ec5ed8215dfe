"""SimHash against plain Python: fingerprints, bit-sliced distances, components."""

import random

import numpy as np
import pytest
import xxhash

from keepsake.llm import simhash


def plain_fingerprint(text, width=4):
    words = [w.lower() for w in (text or "").encode().split()]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def plain_components(ids, fps, radius=4):
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    distinct = sorted(set(fps))
    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if bin(a ^ b).count("1") <= radius:
                parent[find(a)] = find(b)
    least = {}
    for d, f in zip(ids, fps, strict=True):
        least[find(f)] = min(least.get(find(f), d), d)
    return {d: least[find(f)] for d, f in zip(ids, fps, strict=True)}


@pytest.mark.parametrize("text", [None, "", " \t", "One", "a b c", "É a B c", "x y z w", "the same the same the same the same", "w " * 5000])
def test_fingerprint_is_the_plain_one(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize(("m", "n"), [(1, 1), (3, 70), (130, 200)])
def test_bit_sliced_distances(m, n):
    rng = np.random.default_rng(m)
    base = rng.integers(0, 2**63, 4, dtype=np.uint64)
    flip = lambda k: base[rng.integers(0, 4, k)] ^ (np.uint64(1) << rng.integers(0, 64, k).astype(np.uint64)) ^ (np.uint64(7) << rng.integers(0, 60, k).astype(np.uint64))
    a, b = flip(m), flip(n)
    for radius in (0, 1, 3, 4, 7):
        i, j = simhash.tile_hits(a, b, radius)
        assert set(zip(i.tolist(), j.tolist(), strict=True)) == {(x, y) for x in range(m) for y in range(n) if bin(int(a[x]) ^ int(b[y])).count("1") <= radius}


def test_components_are_those_of_all_pairs(spark):
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(5)]
    fps = [0, 0, 1]
    for _ in range(400):
        x = rng.choice(centres)
        for _ in range(rng.randint(0, 9)):
            x ^= 1 << rng.randrange(64)
        fps.append(x)
    rows = [(i, f - 2**64 if f >= 2**63 else f) for i, f in enumerate(fps)]
    for tile in (2048, 16):  # with 16, buckets are cut into pairs of parts
        edges = simhash.near_edges(spark.createDataFrame(rows, "doc_id long, fp long").select("fp").distinct(), tile=tile)
        from keepsake.llm.components import connected_components

        member = {r.node: r.component for r in connected_components(edges).collect()}
        got = {}
        for i, f in rows:
            got.setdefault(member.get(f, f), []).append(i)
        want = {}
        for d, c in plain_components(range(len(fps)), fps).items():
            want.setdefault(c, []).append(d)
        assert sorted(got.values()) == sorted(want.values())


def test_documents(spark):
    texts = [(3, "a b c d e", "x"), (1, "A b C d e", "x"), (7, None, "y"), (5, "", "y"), (5, "", "y"), (9, "q w e r t y u i", "z")]
    got = simhash.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string, fp string")).collect()
    fps = {d: plain_fingerprint(t) for d, t, _ in texts}
    want = plain_components([d for d, *_ in texts], [fps[d] for d, *_ in texts])
    assert sorted((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in got) == sorted((d, fps[d], want[d]) for d, *_ in texts)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).count() == 0
