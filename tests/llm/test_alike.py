"""Near-duplicates by shingle similarity against all pairs in plain Python."""

import random

import numpy as np

import corpus_pipeline
from keepsake.llm import alike


def plain_set(text, width=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + width]) for i in range(max(len(w) - width + 1, min(len(w), 1)))}


def plain_groups(rows):
    sets, group = {d: plain_set(t) for d, t in rows}, {d: d for d, _ in rows}
    for a in sorted(sets):
        for b in sorted(sets):
            both = len(sets[a] & sets[b])
            if a < b and 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = {d: new if g == old else g for d, g in group.items()}
    return group


def made(seed):
    rng = random.Random(seed)
    fresh = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    rows, line = [], fresh(12)
    for n in (3, 5, 9, 14, 30, 80, 200):
        base = fresh(n)
        for _ in range(14):
            w = list(base)
            for _ in range(rng.randint(0, max(1, n // 30))):
                w[rng.randrange(n)] = fresh(1)[0]
            rows.append(" ".join(w + fresh(rng.randint(0, max(1, n // 20)))))
        rows.append(" ".join(line + fresh(n)))
    rng.shuffle(rows)
    return [*enumerate(rows), (900, None), (901, " "), (902, rows[3].upper())]


def test_groups_are_those_of_all_pairs(spark):
    for seed in (1, 2):
        rows = made(seed)
        got = alike.alike_groups(spark.createDataFrame([*rows, rows[5], (None, rows[6][1])], "doc_id long, text string"))
        want = plain_groups(rows)
        assert {r.doc_id: r.component_id for r in got.collect()} == want and 10 < len(set(want.values())) < len(rows) - 20
    assert alike.alike_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_groups_do_not_depend_on_tiles(spark):
    rows = made(3)
    want = plain_groups(rows)
    for tile in (1, 5):
        got = alike.alike_groups(spark.createDataFrame(rows, "doc_id long, text string"), tile=tile)
        assert {r.doc_id: r.component_id for r in got.collect()} == want


def joined_rows(spark, words):
    """Rows that the joins with these words in their condition have made in the session, by Spark's own count."""
    store, found = spark._jsparkSession.sharedState().statusStore(), 0
    for e in range(store.executionsCount()):
        execution = store.executionsList().apply(e)
        values, nodes = store.executionMetrics(execution.executionId()), store.planGraph(execution.executionId()).allNodes()
        for node in (nodes.apply(k) for k in range(nodes.size())):
            if "Join" in node.name() and all(w in node.desc() for w in words):
                for metric in (node.metrics().apply(k) for k in range(node.metrics().size())):
                    if metric.name() == "number of output rows" and values.contains(metric.accumulatorId()):
                        found += int(values.apply(metric.accumulatorId()).replace(",", ""))
    return found


def test_a_pair_is_formed_a_few_times_however_many_items_it_shares(spark):
    rng = random.Random(5)
    base = [f"b{i}" for i in range(300)]
    rows = []
    for d in range(60):  # mostly below the similarity of each other, with most of their items in common
        w = list(base)
        for at in rng.sample(range(300), rng.randint(2, 12)):
            w[at] = f"u{rng.randrange(10**9)}"
        rows.append((d, " ".join(w)))
    before = joined_rows(spark, ["bit_count", "<"])
    got = alike.alike_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in got.collect()} == plain_groups(rows)
    assert 0 < joined_rows(spark, ["bit_count", "<"]) - before <= 60 * 59


def test_pipeline_links_at_that_similarity(spark):
    w = [f"w{i}" for i in range(104)]
    edited = [*w[:50], "x", "y", *w[52:80], "z", *w[81:]]  # 11 of 100 shingles differ: similarity 0.80
    rows = [(1, " ".join(w), "en", "s", 1), (2, " ".join(edited), "en", "s", 1), (3, " ".join(f"v{i}" for i in range(104)), "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in corpus_pipeline.distinct(spark, docs, "").collect()} == {1, 3}


def test_an_id_with_several_texts_and_string_ids(spark):
    text = lambda k: " ".join(f"{k}w{i}" for i in range(30))
    rows = [("a", text(1)), ("b", text(2)), ("b", text(1) + " more"), ("c", text(2) + " more"), ("c", text(2) + " more"), ("d", text(3))]
    got = alike.alike_groups(spark.createDataFrame(rows, "doc_id string, text string").selectExpr("*", "1 as node", "2 as n"))
    assert sorted(map(tuple, got.collect())) == [("a", "a"), ("b", "a"), ("b", "b"), ("c", "b"), ("c", "b"), ("d", "d")]


def test_bounds_of_prefixes_and_sketches():
    rng, none = np.random.default_rng(7), np.zeros(0, np.uint64)
    for n in (1, 2, 3, 4, 5, 9, 40, 300, 1100, 2100):
        for _ in range(40):
            a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
            b = np.unique(np.r_[a[rng.random(len(a)) < 0.9], rng.integers(0, 2**63, rng.integers(0, 1 + n // 8), dtype=np.uint64)])
            both = len(np.intersect1d(a, b))
            differ = sum(int(x ^ y).bit_count() for x, y in zip(alike.sketch(a).view(np.uint64).tolist(), alike.sketch(b).view(np.uint64).tolist(), strict=True))
            assert differ <= len(a) + len(b) - 2 * both
            assert alike.least_difference(alike.wide_sketch(a), alike.wide_sketch(b)) <= len(a) + len(b) - 2 * both
            if len(b) and 5 * both >= 4 * (len(a) + len(b) - both):
                for hot in (none, np.sort(rng.choice(a, len(a) // 2, replace=False))):
                    assert len(np.intersect1d(alike.prefix(a, 0.8, hot), alike.prefix(b, 0.8, hot)))


def test_slices_by_bytes():
    import pyarrow as pa

    from keepsake.llm.staging import by_bytes

    texts = ["aaaa", None, "", "b" * 50, "ccc", "dddd", "e" * 9, None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["k", "t"])
    slices = [s.column(0).to_pylist() for s in by_bytes(iter([batch, batch.slice(0, 0)]), (1,), 10)]
    assert slices == [[0, 1, 2], [3], [4, 5], [6, 7]]
