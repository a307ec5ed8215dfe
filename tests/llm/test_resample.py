"""Importance resampling against a plain version, with odd rows of every kind."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from keepsake.llm import resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, ngrams):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lower)
    return words, [" ".join(words[i : i + n]) for n in range(1, ngrams + 1) for i in range(len(words) - n + 1)]


def plain(docs, target, ngrams=1, buckets=10_000, least=20, percent=10, seed=2024):
    hashed = lambda text: Counter(zlib.crc32(f.encode()) % buckets for f in features(text, ngrams)[1])
    s, t = sum((hashed(x) for _, x in docs), Counter()), sum((hashed(x) for x in target), Counter())
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in s}
    rows = []
    for d, text in docs:
        own, n = hashed(text), len(features(text, ngrams)[1])
        weight = sum(gain[b] * k for b, k in own.items()) // n if n else 0
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append((d, n, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(features(text, ngrams)[0])))
    fit = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[2], r[1]))
    drawn = Counter()
    for place, r in enumerate(fit[: percent * len(fit) // 100], 1):
        drawn[(*r[:4], place)] += 1
    for r in rows:
        drawn[(*r[:4], None)] += 1
    for r in fit[: percent * len(fit) // 100]:
        drawn[(*r[:4], None)] -= 1
    return +drawn


VOCABULARY = ["Alpha", "beta", "γάμμα", "d3lta", "été", "x", "10", "the", "THE", "日本", "I'm", "a-b", "_", "İ", "½"]


def corpus():
    docs = [(d, " ".join(VOCABULARY[(d * k + k * k) % len(VOCABULARY)] for k in range(d % 60))) for d in range(200)]
    docs += [(200, None), (201, ""), (202, " \t.,"), (203, "the " * 30_000), (None, "the end " * 15), (None, None)]
    docs += [(7, docs[47][1]), (7, docs[47][1]), (8, docs[59][1])]  # ids again, with the same and with another text
    return docs, ["the THE beta " * 4, None, "", "日本 10 x", "not there at all"]


@pytest.mark.parametrize(("ngrams", "percent"), [(1, 10), (2, 35), (3, 100)])
def test_weights_and_draw(spark, ngrams, percent):
    docs, target = corpus()
    frame = spark.createDataFrame([(d, t, 0, "n") for d, t in docs], "doc_id long, text string, rank int, bucket string").repartition(5)
    found = resample.importance_resample(frame, spark.createDataFrame([(x,) for x in target], "text string"), ngrams=ngrams, buckets=997, percent=percent)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(map(tuple, found.collect())) == plain(docs, target, ngrams, 997, percent=percent)


def test_empty_tables(spark):
    docs, target = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "text string")
    assert resample.importance_resample(docs.limit(0), target).count() == 0
    assert [tuple(r) for r in resample.importance_resample(docs, target).select("doc_id", "n_features", "weight").collect()] == [(1, 2, -693)]  # floor(1000 ln(10002 / 20000))


def test_string_ids_and_ties(spark):
    docs = spark.createDataFrame([(f"d{k}", "word " * 25) for k in range(40)], "key string, body string")
    found = resample.importance_resample(docs, docs.select("body"), percent=50, doc_id="key", text="body", target_text="body").collect()
    assert {r.weight for r in found} == {0}
    assert sorted(r["rank"] for r in found if r["rank"]) == list(range(1, 21))
    order = [(r.score, r.key) for r in sorted((r for r in found if r["rank"]), key=lambda r: r["rank"])]
    assert order == sorted(order, key=lambda x: (-x[0], x[1]))


def test_buckets_are_forgotten_not_wrong():
    known = resample.Buckets(97, most=3)
    assert [known[w] for w in (b"a", b"b", b"c", b"d", b"a")] == [zlib.crc32(w) % 97 for w in (b"a", b"b", b"c", b"d", b"a")]
