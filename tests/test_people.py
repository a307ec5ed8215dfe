"""Face clustering, prototypes and suggestions against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from keepsake.operators import nearest, people


def faces(spark, n=90, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 16))
    v = centres[rng.integers(0, 6, n)] + 0.5 * rng.normal(size=(n, 16))
    return v, spark.createDataFrame([(i, v[i].astype(float).tolist()) for i in range(n)] + [(n, [0.0] * 16), (n + 1, None), (n + 2, [])], "id long, v array<double>")


def test_pairs_and_components(spark):
    v, df = faces(spark)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    sim = unit @ unit.T
    want = {(i, j) for i in range(len(v)) for j in range(i + 1, len(v)) if sim[i, j] >= 0.62}
    for block in (16, 2048):
        assert {(r.a, r.b) for r in people.similar_pairs(df, 0.62, block).collect()} == want
    label = list(range(len(v) + 3))
    for _ in label:
        for i, j in want:
            label[i] = label[j] = min(label[i], label[j])
    got = {r.id: r.component for r in people.components(df.select("id"), people.similar_pairs(df, 0.62)).collect()}
    assert got == dict(enumerate(label))


def test_prototypes(spark):
    v, _ = faces(spark, 30)
    rows = [(1 if i < 20 else 2, i, v[i].tolist(), i in (3, 4), 0.5, round(0.3 + 0.01 * (i * 7 % 30), 3)) for i in range(30)]
    df = spark.createDataFrame(rows, "person_id long, id long, embedding array<double>, manual_locked boolean, confidence double, quality_score double")
    got = {}
    for r in people.choose_prototypes(df).orderBy("place").collect():
        got.setdefault(r.person_id, []).append(r.id)
    for person, mine in got.items():
        pool = sorted((r for r in rows if r[0] == person), key=lambda r: (-r[3], -r[5], -r[4], r[1]))[:10]
        chosen = [r[1] for r in sorted(pool, key=lambda r: (-r[5], r[1])) if r[3]]
        rest = [r[1] for r in sorted(pool, key=lambda r: (-r[5], r[1])) if not r[3]]
        chosen = chosen or [rest.pop(0)]
        cos = lambda a, b: v[a] @ v[b] / np.linalg.norm(v[a]) / np.linalg.norm(v[b])
        while len(chosen) < 5:
            chosen.append(rest.pop(int(np.argmin([min(cos(a, b) for b in chosen) for a in rest]))))
        assert mine == chosen


def test_step(spark):
    e = lambda a, b: [float(a), float(b), 0.0]
    rows = [(1, 1, 7, e(1, 0), "assigned", 0, True), (2, 2, None, e(1, 0.1), "pending", 0, False), (3, 3, None, e(0, 1), "pending", 0, False), (4, 4, None, e(0.1, 1), "pending", 0, False), (5, 5, None, [0.0, 0.0, 1.0], "pending", 2, False), (6, 6, None, [0.0, 0.0, -1.0], "pending", 10, False)]
    df = spark.createDataFrame(rows, "id long, photo_id long, person_id long, embedding array<double>, cluster_status string, retry_count int, manual_locked boolean").withColumn("quality_score", F.lit(0.5)).withColumn("confidence", F.lit(0.5))
    got = {r.id: (r.action, r.person_id, r.retries) for r in people.cluster_step(df).collect()}
    assert got == {2: ("attach", 7, 0), 3: ("create", 3, 0), 4: ("create", 3, 0), 5: ("pending", None, 3), 6: ("create", 6, 0)}


def test_suggestions_and_sync(spark):
    protos = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 1.0]), (4, [0.9, 0.1])], "person_id long, v array<double>")
    got = [(r.target, r.candidate, r.rank) for r in people.merge_suggestions(protos).orderBy("target", "rank").collect()]
    assert got == [(1, 2, 1), (2, 4, 1)]
    banned = spark.createDataFrame([(2, 1)], "person_id_a long, person_id_b long")
    assert [(r.target, r.candidate) for r in people.merge_suggestions(protos, banned).collect()] == [(2, 4)]
    known = spark.createDataFrame([(1, "a", 99, True, 0, 0), (2, "b", None, False, 0, 0), (3, "c", None, False, 5, 5)], "id long, name string, representative_face_id long, avatar_locked boolean, face_count long, photo_count long")
    f = spark.createDataFrame([(10, 1, 1, 0.5, 0.5), (11, 2, 2, 0.5, 0.5), (12, 2, 2, 0.9, 0.5)], "id long, photo_id long, person_id long, quality_score double, confidence double")
    assert sorted(tuple(r) for r in people.sync_people(known, f).select("id", "representative_face_id", "face_count", "photo_count").collect()) == [(1, 99, 1, 1), (2, 12, 2, 1)]
    moved = people.merge_people(f.withColumn("cluster_status", F.lit("assigned")), spark.createDataFrame([(2, 1)], "source long, target long"))
    assert {r.person_id for r in moved.collect()} == {1}
    assert [r.id for r in people.split_faces(moved, spark.createDataFrame([(12,)], "id long"), None).where("person_id is null and cluster_status = 'pending'").collect()] == [12]


def attached(spark, component, locked=False, cannot_link=None, **how):
    """The decision on one component of (quality, vector[, previous]) faces, among person 11 and 22."""
    protos = spark.createDataFrame([(11, [1.0, 0.0, 0.0], locked), (11, [0.97, 0.243, 0.0], False), (22, [0.0, 1.0, 0.0], False)], "person_id long, v array<double>, locked boolean")
    rows = [(1, k, [float(x) for x in f[1]], k, float(f[0]), how.get("retries", 0), f[2] if len(f) > 2 else None) for k, f in enumerate(component)]
    members = spark.createDataFrame(rows, "component long, id long, v array<double>, photo_id long, quality_score double, retry_count int, previous long")
    links = spark.createDataFrame(cannot_link, "person_id_a long, person_id_b long") if cannot_link else None
    r = people.attach_components(members, protos, links, attach=0.7).first()
    return r.action, r.person_id, r.score


def test_a_component_joins_the_person_it_is_like(spark):
    action, person, score = attached(spark, [(0.5, (1, 0, 0)), (0.5, (0.92, 0.392, 0))])
    assert (action, person) == ("attach", 11) and score > 0.7
    action, person, score = attached(spark, [(0.5, (0, 0, 1)), (0.5, (0.1, 0.1, 0.99))])
    assert (action, person) == ("create", None) and score < 0.7


def test_its_best_faces_decide_where_the_others_drag_it_down(spark):
    good = [(0.9, (1, 0, 0)), (0.85, (0.98, 0.199, 0)), (0.8, (0.97, 0.243, 0)), (0.75, (0.99, 0.1, 0)), (0.7, (0.96, 0.28, 0))]
    bad = [(0.1, v) for v in ((0, 0, 1), (0.05, 0.05, 0.99), (0.02, 0.02, 0.999), (0, 0.1, 0.995), (0.03, 0, 0.999))]
    action, person, score = attached(spark, good + bad)
    assert (action, person) == ("attach", 11) and score > 0.95
    assert attached(spark, good[:2] + bad[:3])[0] == "create"  # five faces: there are no others


def test_a_confirmed_person_needs_less(spark):
    face = (0.5, (0.68, 0, np.sqrt(1 - 0.68**2)))
    assert attached(spark, [face]) == ("pending", None, pytest.approx(0.68))
    assert attached(spark, [face], locked=True) == ("attach", 11, pytest.approx(0.68))
    assert attached(spark, [(0.5, (0.64, 0, np.sqrt(1 - 0.64**2)))], locked=True)[0] == "pending"


def test_a_cannot_link_of_a_face_blocks_its_component(spark):
    faces = [(0.5, (1, 0, 0), 22), (0.5, (0.98, 0.2, 0))]
    for pair in ((11, 22), (22, 11)):
        action, person, score = attached(spark, faces, cannot_link=[pair])
        assert (action, person) == ("create", None) and score < 0.2  # what is left is person 22
    assert attached(spark, faces, cannot_link=[(11, 33)])[1] == 11


def test_pruned_join_is_exact_and_prunes(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 24))
    v = centres[rng.integers(0, 12, 900)] + 0.15 * rng.normal(size=(900, 24))
    odd = [(900, [0.0] * 24), (901, None), (902, []), (903, [1.0, None]), (904, [float("nan")] * 24), (905, [1.0, 2.0]), (906, [2.0, 4.0]), (907, [2.0, -4.0]), (None, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v[i].tolist()) for i in range(900)] + odd, "id long, v array<double>").repartition(5)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {(i, j) for i, j in zip(*np.nonzero(np.triu(unit @ unit.T >= 0.8, 1)), strict=True)} | {(905, 906)}
    for block, pivots in ((2048, 64), (40, 64), (7, 3)):
        assert {(r.a, r.b) for r in nearest.similar_pairs(df, 0.8, block, pivots).collect()} == want
    _, cells = nearest.celled(df.withColumn("least", F.lit(0.8)), 40, 64)
    sizes = [r.parts for r in cells.where("cell.size = 24").collect()]
    kept = nearest.meeting(cells).where("a.size = 24").count()
    share = 1 - kept / (len(sizes) * (len(sizes) + 1) / 2)
    assert share > 0.6, share  # pairs of cells that are never compared


def test_signatures_find_what_they_promise(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 32))
    v = centres[rng.integers(0, 40, 1500)] + 0.55 * rng.normal(size=(1500, 32))
    df = spark.createDataFrame([(i, v[i].tolist(), int(i % 7)) for i in range(1500)] + [(1500, None, 0), (1501, [0.0] * 32, 0)], "id long, v array<double>, person_id int")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    pairs = lambda keep: {(i, j) for i, j in zip(*np.nonzero(np.triu(unit @ unit.T >= 0.7, 1)), strict=True) if keep(i, j)}
    want = pairs(lambda i, j: True)
    found = {(r.a, r.b) for r in nearest.candidate_pairs(df.select("id", "v"), 0.7, recall=0.9).collect()}
    assert len(want) > 2000 and found <= want and len(found) >= 0.9 * len(want), (len(found), len(want))
    assert {(r.a, r.b) for r in nearest.candidate_pairs(df, 0.7, exact=True, between="person_id").collect()} == pairs(lambda i, j: i % 7 != j % 7)
    between = {(r.a, r.b) for r in nearest.candidate_pairs(df, 0.7, recall=0.99, between="person_id").collect()}
    assert between <= pairs(lambda i, j: i % 7 != j % 7) and len(between) >= 0.97 * len(pairs(lambda i, j: i % 7 != j % 7))


def test_spanning_links_connect_what_the_pairs_do(spark):
    rng = np.random.default_rng(4)
    v = np.repeat(rng.normal(size=(40, 12)), 15, axis=0) + 0.3 * rng.normal(size=(600, 12))
    df = spark.createDataFrame([(int(i), x) for i, x in enumerate(v.tolist())], "id long, v array<double>").repartition(3)
    pairs = nearest.similar_pairs(df, 0.9, 100)
    want = {tuple(r) for r in people.components(df.select("id"), pairs).collect()}
    links = nearest.similar_pairs(df, 0.9, 100, spanning=True).cache()
    assert {tuple(r) for r in people.components(df.select("id"), links).collect()} == want and 1 < len({c for _, c in want}) < 600
    assert nearest.similar_pairs(df, 0.9, spanning=True).count() == 600 - len({c for _, c in want}) < pairs.count()


def test_cells_grow_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK", 8)  # tiles of 8, cells of 25 for 1,600 rows
    v = np.random.default_rng(6).normal(size=(1600, 6))
    df = spark.createDataFrame([(int(i), x) for i, x in enumerate(v.tolist())], "id long, v array<double>")
    _, cells = nearest.celled(df.withColumn("least", F.lit(0.9)))
    assert cells.agg(F.sum("parts")).first()[0] < 64 * 4 < 1600 // 8 * 2
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = set(zip(*(x.tolist() for x in np.nonzero(np.triu(unit @ unit.T >= 0.9, 1))), strict=True))
    assert {(r.a, r.b) for r in nearest.similar_pairs(df, 0.9).collect()} == want


def test_the_query_misses_no_pair_at_the_threshold(spark, tmp_path):
    from keepsake.plans import catalogue

    n = 600  # every pair has a cosine of 0.4505
    v = np.hstack([np.full((n, 1), np.sqrt(0.4505)), np.sqrt(0.5495) * np.eye(n)]).astype(np.float32)
    spark.createDataFrame([(i, x, 0) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = catalogue.candidate_pairs(spark, str(tmp_path)).select("a", "b").toPandas()
    assert (rows["a"] < rows["b"]).all() and len(rows) == len(rows.drop_duplicates()) == n * (n - 1) // 2


def test_suggestions_by_signatures(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(30, 16))
    rows = [(p, (centres[p // 2] + 0.2 * rng.normal(size=16)).tolist()) for p in range(60) for _ in range(3)]
    protos = spark.createDataFrame(rows, "person_id long, v array<double>")
    exact = {(r.target, r.candidate, r.rank): r.similarity for r in people.merge_suggestions(protos, least=0.7).collect()}
    assert len(exact) >= 30
    found = {(r.target, r.candidate, r.rank): r.similarity for r in people.merge_suggestions(protos, least=0.7, exact=False, recall=0.999).collect()}
    assert found.keys() == exact.keys() and all(abs(found[k] - exact[k]) < 1e-12 for k in exact)
    assert nearest.candidate_pairs(protos.limit(0).withColumnRenamed("person_id", "id"), 0.5).count() == 0
    assert nearest.similar_pairs(protos.limit(0).withColumnRenamed("person_id", "id"), 0.5).count() == 0
