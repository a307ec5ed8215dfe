"""Trees and the label model on made data, and both operators on labelled texts with rows held out."""

import random
import zlib

import numpy as np
import pytest

from keepsake.llm import quality, queries, toxicity

WORDS = [f"{a}{b}{c}" for a in "bdfgklmn" for b in "aeiou" for c in ("n", "r", "st", "l", "m")]


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def plain_predict(model, row):
    """One tree after another, one node after another."""
    total = model.base
    for t in range(len(model.feature)):
        node = 0
        while node < model.feature.shape[1]:
            node = 2 * node + 1 + (row[model.feature[t, node]] > model.threshold[t, node])
        total += model.leaf[t, node - model.feature.shape[1]]
    return 1 / (1 + np.exp(-total))


def test_trees_learn_and_flat_arrays_agree():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 5)).astype(np.float32)
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] < -0.2)).astype(float)
    model = quality.fit_trees(x[:2000], y[:2000], trees=40)
    p = model.predict(x[2000:])
    assert ((p > 0.5) == y[2000:]).mean() > 0.95
    assert np.allclose(p[:50], [plain_predict(model, r) for r in x[2000:2050]])


def test_degenerate_fits():
    for x, y in ((np.zeros((0, 3), np.float32), np.zeros(0)), (np.ones((9, 3), np.float32), np.ones(9))):
        p = quality.fit_trees(x, y).predict(np.zeros((2, 3), np.float32))
        assert p[0] == p[1] and 0 < p[0] < 1


def test_statistics():
    assert not quality.text_features(None).any() and not quality.text_features(" \n").any()
    f = dict(zip(quality.FEATURES, quality.text_features("Ab ab ab X!\n"), strict=True))
    assert (f["repeats"], f["unique_words"], f["upper_words"], f["title_words"]) == (0.25, 0.75, 0.25, 0.5)
    assert f["exclaim"] == pytest.approx(1 / 12) and f["lines_per_word"] == 0.25


def test_label_model_finds_rates_and_correlation():
    rng = np.random.default_rng(3)
    y = rng.random(6000) < 0.2
    rates = [(0.7, 0.02), (0.5, 0.01), (0.6, 0.05), (0.4, 0.03)]
    votes = np.stack([rng.random(6000) < np.where(y, a, b) for a, b in rates], axis=1).astype(float)
    votes = np.hstack([votes, votes[:, :1]])  # a copy of the first voter
    model = toxicity.fit_label_model(votes, 0.2, np.clip(votes.sum(axis=1) * 0.4 + 0.05, 0, 0.95))
    assert np.abs(model.in_toxic[:4] - [a for a, _ in rates]).max() < 0.08
    assert model.correlation[0, 4] > 0.99 and model.discount[0] < 0.6 and model.discount[1] > 0.85
    assert ((model.posterior > 0.5) == y).mean() > 0.93


def corpus(spark, tmp_path, n=700):
    rng = random.Random(8)
    docs, labels = [], []
    for d in range(n):
        w = [rng.choice(WORDS) for _ in range(rng.randint(20, 80))]
        bad, toxic = d % 5 == 1, d % 4 == 2
        if toxic:
            for _ in range(rng.randint(1, 4)):
                w.insert(rng.randrange(len(w)), rng.choice(["zwock", "Zwockig", "quib", "quibel"]))
        text = " ".join(x + rng.choice(["%%%", "$$$"]) for x in w) if bad else " ".join(w).capitalize() + "."
        docs.append((d, text))
        if d % 7:
            labels.append((d, int(not bad), int(toxic)))
    docs += [(n, None), (n + 1, ""), (n + 2, "zwock " * 4000), (n + 2, "zwock " * 4000)]
    labels += [(None, 1, 1), (3, None, None), (9999, 0, 1)]
    spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' as y", "1 as score").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "'t' as text").write.parquet(f"{tmp_path}/labels.parquet")
    return docs


def test_operators_on_held_out_rows(spark, tmp_path):
    docs = corpus(spark, tmp_path)
    for query, truth, cut in ((queries.op5_quality_classifier, lambda d: d % 5 != 1, 0.3), (queries.op2_toxicity, lambda d: d % 4 == 2, 0.5)):
        got = query(spark, str(tmp_path)).collect()
        assert sorted(r.doc_id for r in got) == sorted(d for d, _ in docs)
        assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= cut) and r.held_out == held_out(r.doc_id) for r in got)
        unseen = [r for r in got if r.held_out and r.doc_id < 700]
        assert len(unseen) > 80 and np.mean([r.predicted == truth(r.doc_id) for r in unseen]) > 0.97
        assert len({r.score for r in got if r.doc_id == 702}) == 1
    assert {r.predicted for r in got if r.doc_id == 702} == {1}


def test_without_rows_or_labels(spark):
    docs, none = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for score in (quality.score_quality, toxicity.score_toxicity):
        assert len({r.score for r in score(docs, none).collect()}) == 1
        assert score(docs.limit(0), none).count() == 0
    assert quality.filter_quality(docs, none).count() == 2


def test_held_out_labels_change_no_score(spark, tmp_path):
    corpus(spark, tmp_path)
    docs, labels = spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet")
    ids = [r.doc_id for r in labels.collect() if r.doc_id is not None and held_out(r.doc_id)]
    assert len(ids) > 90
    for value in (0, 1):
        turned = labels.selectExpr("doc_id", *[f"case when doc_id in ({','.join(map(str, ids))}) then {value} else {c} end as {c}" for c in ("quality", "toxic")])
        for score in (quality.score_quality, toxicity.score_toxicity):
            assert sorted(map(tuple, score(docs, turned).collect())) == sorted(map(tuple, score(docs, labels).collect()))
        assert quality.filter_quality(docs, turned).count() == quality.filter_quality(docs, labels).count()


def test_scores_do_not_depend_on_how_rows_are_dealt(spark, tmp_path):
    corpus(spark, tmp_path)
    docs, labels = spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet")
    docs = docs.unionByName(docs.where("doc_id % 9 = 1").selectExpr("doc_id + 5000 as doc_id", "concat(text, ' nolim') as text", "y", "score"))
    labels = labels.unionByName(labels.where("doc_id % 9 = 1").selectExpr("doc_id + 5000 as doc_id", "quality", "toxic", "text"))
    for score in (quality.score_quality, toxicity.score_toxicity):
        runs = [sorted(map(tuple, score(d, labels.repartition(k)).collect())) for k, d in ((1, docs.coalesce(1)), (7, docs.repartition(7, "text")), (3, docs.orderBy("text")))]
        assert runs[0] == runs[1] == runs[2]


def plain_label_model(votes, prior, start, rounds):
    """The label model with loops over documents and voters."""
    n, k, q = len(votes), len(votes[0]), list(start)
    for _ in range(rounds):
        total = sum(q)
        a = [(sum(q[i] * votes[i][j] for i in range(n)) + 0.05) / (total + 0.1) for j in range(k)]
        b = [(sum((1 - q[i]) * votes[i][j] for i in range(n)) + 0.05) / (n - total + 1.0) for j in range(k)]
        left = [[votes[i][j] - q[i] * a[j] - (1 - q[i]) * b[j] for j in range(k)] for i in range(n)]
        cov = [[sum(left[i][j] * left[i][m] for i in range(n)) / n for m in range(k)] for j in range(k)]
        corr = [[cov[j][m] / (max(cov[j][j], 1e-9) * max(cov[m][m], 1e-9)) ** 0.5 for m in range(k)] for j in range(k)]
        part = [1 / (1 + sum(max(corr[j][m] - 0.1, 0) for m in range(k) if m != j)) for j in range(k)]
        new = []
        for i in range(n):
            odds = np.log(prior / (1 - prior))
            for j in range(k):
                odds += part[j] * (np.log(a[j] / b[j]) if votes[i][j] else np.log((1 - a[j]) / (1 - b[j])))
            new.append(1 / (1 + np.exp(-odds)))
        q = new
    return a, b, corr, part, q


def test_label_model_against_loops():
    rng = np.random.default_rng(9)
    y = rng.random(150) < 0.3
    votes = np.stack([rng.random(150) < np.where(y, a, b) for a, b in ((0.7, 0.1), (0.5, 0.05), (0.6, 0.2))], axis=1).astype(float)
    votes = np.hstack([votes, votes[:, :1]])
    start = np.clip(votes.sum(axis=1) * 0.4 + 0.05, 0, 0.95)
    model = toxicity.fit_label_model(votes, 0.3, start, rounds=5)
    a, b, corr, part, q = plain_label_model(votes.tolist(), 0.3, start.tolist(), 5)
    for got, want in ((model.in_toxic, a), (model.in_clean, b), (model.correlation, corr), (model.discount, part), (model.posterior, q)):
        assert np.allclose(got, want, atol=1e-9)


def test_linear_fit_against_plain_descent():
    rng = np.random.default_rng(5)
    x, weight = rng.normal(size=(200, 3)), rng.random(200) + 0.5
    q = 1 / (1 + np.exp(-(x @ [1.0, -2.0, 0.5] + 0.3)))
    got = toxicity.fit_linear(x, q, weight, l2=0.02, rounds=60)
    w, share = [0.0] * 4, (weight / weight.sum()).tolist()
    for _ in range(6000):  # gradient descent on the same penalised loss
        grad = [0.002 * w[0], 0.002 * w[1], 0.002 * w[2], 1e-6 * w[3]]
        for row, target, s in zip(x[:, :].tolist(), q.tolist(), share, strict=True):
            p = 1 / (1 + np.exp(-(sum(c * v for c, v in zip(w, row, strict=False)) + w[3])))
            for j, v in enumerate([*row, 1.0]):
                grad[j] += s * (p - target) * v
        w = [c - 4 * g for c, g in zip(w, grad, strict=True)]
        if max(map(abs, grad)) < 1e-7:
            break
    assert np.allclose(got, w, atol=1e-3)


def plain_trees(x, y, trees, depth, rate, bins, least, l2):
    """Boosted trees with loops over nodes, features and cuts; margins of the rows after the last tree."""
    n, f = x.shape
    mean = y.mean()
    margin = np.full(n, np.log(mean / (1 - mean)))
    cuts = np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], axis=0).astype(np.float32)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        groups = [np.arange(n)]
        for _ in range(depth):
            after = []
            for rows in groups:
                best, where = 1e-6, None
                for j in range(f):
                    for c in cuts[:, j]:
                        left = rows[x[rows, j] <= c]
                        right = rows[x[rows, j] > c]
                        if len(left) < least or len(right) < least:
                            continue
                        gain = sum(g[s].sum() ** 2 / (h[s].sum() + l2) for s in (left, right)) - g[rows].sum() ** 2 / (h[rows].sum() + l2)
                        if gain > best + 1e-9:
                            best, where = gain, (left, right)
                after += list(where or (rows, rows[:0]))
            groups = after
        for rows in groups:
            margin[rows] += rate * g[rows].sum() / (h[rows].sum() + l2)
    return margin


def test_tree_fit_against_loops():
    rng = np.random.default_rng(12)
    x = rng.normal(size=(400, 3)).astype(np.float32)
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] < -0.5)).astype(float)
    model = quality.fit_trees(x, y, trees=4, depth=3, rate=0.3, bins=8, least=15, l2=1.0)
    want = 1 / (1 + np.exp(-plain_trees(x, y, 4, 3, 0.3, 8, 15, 1.0)))
    assert np.allclose(model.predict(x), want, atol=1e-6)
