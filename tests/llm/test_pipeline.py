"""The pipeline's stages against plain Python on a small corpus."""

import random

import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from tests_support import plain_cut, plain_groups

pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")


def build(tmp_path, spark):
    rng = random.Random(11)
    vocabulary = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in ("n", "r", "st", "l")]
    sentence = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n)).capitalize() + "."
    text = lambda: " ".join(sentence(rng.randint(5, 14)) for _ in range(rng.randint(3, 12)))
    items = [sentence(30) for _ in range(5)]
    rows, labels = [], []
    for d in range(240):
        t = text()
        if d % 6 == 5:
            t = " ".join(w + rng.choice(["$$$", "%%%", "###"]) for w in t.split())
        labels.append((d, int(d % 6 != 5), 0))
        rows.append([d, t])
    for d in range(240, 260):  # copies, leaks and shared passages
        source = rows[rng.choice([x for x in range(240) if x % 6 != 5])][1]
        rows.append([d, source if d % 2 else source + " " + items[d % 5] + " " + sentence(6)])
    shared = sentence(40)
    rows += [[d, text() + " " + shared + " " + text()] for d in range(260, 270)]
    rows += [[270, ""], [271, None]]
    spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return rows, items


def test_stages(spark, tmp_path):
    rows, items = build(tmp_path, spark)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name.replace(' ', '-')}")
        docs = spark.read.parquet(f"{tmp_path}/{name.replace(' ', '-')}")
        kept[name] = docs.collect()
        if name != "best-fit packing":
            assert set(corpus_pipeline.COLUMNS) == set(docs.columns)
    texts = dict(map(tuple, rows))
    good = {r.doc_id: r.text for r in kept["quality classifier"]}
    assert {d for d in range(240) if d % 6 != 5} <= good.keys() and not {d for d in range(240) if d % 6 == 5} & good.keys()
    assert all(good[d] == texts[d] for d in good)
    groups = plain_groups(good)
    one = {r.doc_id: r.text for r in kept["SimHash near-dedup"]}
    assert one == {d: t for d, t in good.items() if groups[d] == d}
    cut = plain_cut(one, 13)
    left = {r.doc_id: r.text for r in kept["substring dedup"]}
    assert left == {d: k if m else one[d] for d, (k, n, m) in cut.items() if n == 0 or m < n}
    windows = lambda t: {tuple(w) for w in zip(*[t.lower().replace(".", "").split()[i:] for i in range(8)], strict=False)}
    clean = {r.doc_id for r in kept["benchmark decontamination"]}
    assert clean == {d for d, t in left.items() if not any(2 * len(windows(b) & windows(t or "")) >= len(windows(b)) for b in items)}
    assert {r.doc_id for r in kept["best-fit packing"]} == clean
    whole = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "piece", "length", "ids_crc32").collect()
    assert sorted(map(tuple, whole)) == sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in kept["best-fit packing"])


def plain_alike(texts, width=5, similarity=0.8):
    """The least id of each document's group: pairs whose shingle sets have the similarity, by all pairs."""
    def runs(t):
        w = (t or "").lower().split()
        return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()

    sets, label = {d: runs(t) for d, t in texts.items()}, {d: d for d in texts}
    for _ in texts:
        for a in texts:
            for b in texts:
                if label[a] != label[b] and (sets[a] == sets[b] or len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])):
                    label[a] = label[b] = min(label[a], label[b])
        if len(set(label.values())) == len({label[d] for d in label.values()}):
            break
    return label


def test_odd_rows_and_settings(spark, tmp_path):
    rows, items = build(tmp_path, spark)
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(batch, "777")
    try:
        docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
        few = docs.where("doc_id < 24")
        again = few.where("doc_id = 1")
        lost = few.where("doc_id in (2, 3)").withColumn("doc_id", F.lit(None).cast("long"))
        odd = few.unionByName(again).unionByName(lost).unionByName(docs.where("doc_id in (270, 271)")).withColumn("n_chars", F.lit(1).cast("long"))
        for some in (odd, docs.limit(0)):
            now = some
            for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
                held = now
                now = stage(spark, held, str(tmp_path))
                assert spark.conf.get(batch) == "777"
                left = [r.doc_id for r in now.select("doc_id").collect()]
                assert None in left or some is not odd or number == 0
                assert some is odd or not left
                if number == 1:
                    assert len(left) == len({*left} - {None}) + left.count(None)  # one row of each id
    finally:
        spark.conf.unset(batch)


def test_near_duplicates_are_those_at_the_similarity(spark):
    rng = random.Random(21)
    words = [f"w{k}" for k in range(60)]
    texts = {}
    for d in range(0, 60, 3):
        base = [rng.choice(words) for _ in range(rng.randint(20, 80))]
        for k in range(3):  # copies with some words changed, on both sides of the similarity
            own = list(base)
            for _ in range(rng.randint(0, 4) if k else 0):
                own[rng.randrange(len(own))] = rng.choice(words)
            texts[d + k] = " ".join(own)
    rows = [(d, t, "en", "s", len(t)) for d, t in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.distinct(spark, docs, "").collect()}
    groups = plain_alike(texts)
    assert kept == {d for d in texts if groups[d] == d} and len(kept) < len(texts)
