"""Sparse suffix arrays against all runs of words in plain Python."""

import random

from keepsake.llm import suffixes


def plain(rows, least):
    """Words of each document inside a run of ``least`` words that another document has."""
    owners = {}
    for d, t in rows:
        w = (t or "").split()
        for i in range(len(w) - least + 1):
            owners.setdefault(tuple(w[i : i + least]), set()).add(d)
    out = {}
    for d, t in rows:
        w = (t or "").split()
        for i in range(len(w) - least + 1):
            if d is not None and owners[tuple(w[i : i + least])] - {d, None}:
                out.setdefault(d, set()).update(range(i, i + least))
    return out


def found(spark, rows, least, parts):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as seed", "2 as start", "3 as other")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    got = {}
    for r in suffixes.repeated_passages(df, least).collect():
        got.setdefault(r.doc_id, set()).update(range(r.start, r.start + r.n_words))
        assert r.other_id != r.doc_id and r.n_words >= least
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    return got


def test_planted_passages(spark):
    rng = random.Random(4)
    fresh = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    passages = [fresh(n) for n in (20, 33, 60, 19)]
    rows = []
    for d in range(50):
        w = fresh(rng.randint(0, 30))
        for p in rng.sample(passages, rng.randint(0, 3)):
            w += p + fresh(rng.randint(1, 20))
        rows.append((d, " ".join(w)))
    rows += [(100, None), (101, ""), (None, rows[1][1]), (102, rows[7][1]), (103, rows[7][1]), (103, rows[7][1]), (104, "one two " * 60), (105, "one two " * 60)]
    for parts in ("4", "13"):
        got, want = found(spark, rows, 20, parts), plain(rows, 20)
        assert got == {d: s for d, s in want.items() if s}


def test_empty_table(spark):
    assert found(spark, [], 50, "4") == {}


def test_matches_behind_nearer_neighbours(spark):
    rng = random.Random(6)
    fresh = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    rows, d = [], 0
    for _ in range(12):  # headers and bodies that are recombined: only few documents have 20 words in a row
        left, right = fresh(20), fresh(20)
        shapes = [(10, 10), (10, 10)] + [(2, 17), (17, 2), (3, 16), (16, 3)] * 6
        for a, b in shapes:
            rows.append((d, " ".join(fresh(9) + left[20 - a :] + right[:b] + fresh(9))))
            d += 1
    rng.shuffle(rows)
    got, want = found(spark, rows, 20, "4"), plain(rows, 20)
    assert want and got == want


def test_a_passage_repeated_inside_a_document(spark):
    passage = [f"p{i}" for i in range(20)]
    long = " ".join(w for i in range(40) for w in [*passage, f"x{i}"])
    rows = [(1, long), (2, "y " + " ".join(passage) + " z")]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert found(spark, rows, 20, "13") == plain(rows, 20)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_section_that_a_document_repeats_whole(spark):
    fresh = lambda k, n: [f"{k}{i}" for i in range(n)]
    x, p, y = fresh("x", 60), fresh("p", 60), fresh("y", 60)
    rows = [(1, " ".join(x + p + y + fresh("m", 30) + x + p + y)), (2, " ".join(fresh("a", 70) + p + fresh("b", 70)))]
    got = found(spark, rows, 50, "4")
    assert got == plain(rows, 50) and len(got[1]) == 120
    rows += [(3, " ".join(x + p + y)), (0, " ".join(fresh("c", 10) + p))]
    assert found(spark, rows, 50, "13") == plain(rows, 50)


def test_random_repeated_sections(spark):
    rng = random.Random(12)
    sections = [[f"s{k}.{i}" for i in range(rng.randint(8, 70))] for k in range(8)]
    rows = [(d, " ".join(w for _ in range(rng.randint(1, 9)) for w in (rng.choice(sections) if rng.random() < 0.9 else [f"u{rng.randrange(10**9)}"]))) for d in range(40)]
    for least in (20, 50):
        assert found(spark, rows, least, "5") == plain(rows, least)


def test_slices_of_one_text_among_decoys(spark):
    rng = random.Random(9)
    base = [f"b{i}" for i in range(70)]  # every slice shares words with all others, few share 20 in a row
    rows = []
    for d in range(2000):
        a = rng.randrange(60)
        n = rng.randint(5, 19) if d % 300 else rng.randint(20, 30)
        rows.append((d, " ".join([f"x{d}", *base[a : a + n], f"y{d}"])))
    got, want = found(spark, rows, 20, "13"), plain(rows, 20)
    assert len(want) >= 5 and got == want


def test_string_ids(spark):
    words = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([("a", words), ("b", "x " + words), ("c", None)], "doc_id string, text string")
    assert sorted(map(tuple, suffixes.repeated_passages(df, 20).collect())) == [("a", 0, 30, "b"), ("b", 1, 30, "a")]
