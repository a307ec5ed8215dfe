"""Substring dedup against sets of windows in plain Python."""

import hashlib
import random

from keepsake.llm import substrings


def plain(rows, size):
    words = [(d, (t or "").encode().split()) for d, t in rows]
    first = {}
    for d, w in words:
        for i in range(len(w) - size + 1):
            if d is not None:
                key = tuple(w[i : i + size])
                first[key] = min(first.get(key, d), d)
    out = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - size + 1):
            if d is not None and first[tuple(w[i : i + size])] < d:
                gone.update(range(i, i + size))
        out.append((d, len(w), len(gone), " ".join(x.decode() for i, x in enumerate(w) if i not in gone)))
    return out


def key(r):
    return tuple((x is not None, x) for x in r)


def corpus(seed, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(30)]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randint(5, 40))] for _ in range(8)]
    rows = []
    for d in range(n):
        w = []
        while len(w) < rng.randint(0, 120):
            w += rng.choice(passages)[rng.randint(0, 4) :] if rng.random() < 0.5 else [rng.choice(vocabulary) for _ in range(rng.randint(1, 15))]
        rows.append((d * 3 - 30, rng.choice([" ", "\n", " \t"]).join(w)))
    rows += [(500, None), (501, ""), (502, "same " * 400), (503, "same " * 30), (503, "same " * 30), (503, "other words"), (None, "same " * 30), (504, rows[3][1]), (2, rows[5][1].upper()), (505, "é ö " * 20)]
    return rows


def test_same_as_sets_of_windows(spark):
    for seed, size in ((1, 13), (2, 4), (3, 13)):
        rows = corpus(seed)
        df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as short", "1 as window", "2 as extents").repartition(5)
        got = [(r.doc_id, r.n_words, r.n_removed, r.text) for r in substrings.remove_repeats(df, size).collect()]
        assert sorted(got, key=key) == sorted(plain(rows, size), key=key)


def test_empty_table(spark):
    assert substrings.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_digest(spark, tmp_path):
    from keepsake.llm import queries

    rows = corpus(9)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in queries.op4_substring_dedup(spark, str(tmp_path)).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()]
    want = [(d, n, m, hashlib.sha256(t.encode()).hexdigest()) for d, n, m, t in plain(rows, 13)]
    assert sorted(got, key=key) == sorted(want, key=key)
