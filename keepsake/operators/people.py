"""Faces into people: similarity graph, components, prototypes, attaching, and merge suggestions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keepsake.functions import exprs as X
from keepsake.operators.nearest import candidate_pairs, similar_pairs
from keepsake.session import checkpointed

LINK, ATTACH, SUGGEST, LOW = 0.62, 0.65, 0.55, 0.55
PROTOTYPES = 5
#: The faces a component is scored by once more, and how much less a person needs that a user has confirmed.
BEST_FACES, CONFIRMED = 5, 0.05


def face_graph(faces: DataFrame, base: float = LINK) -> DataFrame:
    """Edges between pending faces: similar enough for the more patient of the two."""
    pending = faces.where("cluster_status = 'pending'")
    return similar_pairs(pending.select("id", F.col("embedding").alias("v"), X.adaptive_threshold(base, F.coalesce("retry_count", F.lit(0))).alias("least")), base)


def components(nodes: DataFrame, edges: DataFrame, rounds: int = 40, write: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(id, component): the least id reachable over edges (a, b); nodes without edges are their own.

    Each round every node takes the least label around it and then its label's label, so chains halve. The
    table is checkpointed each round in the folder of ``spark.checkpoint.dir``, which must be shared.
    """
    write = write or checkpointed
    near = write(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = write(nodes.select("id", F.col("id").alias("label")))
    for _ in range(rounds):
        around = near.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("low"))
        low = labels.join(around, labels["id"] == around["a"], "left").select("id", "label", F.least("label", F.coalesce("low", "label")).alias("new"))
        jump = low.join(labels.select(F.col("id").alias("new"), F.col("label").alias("far")), "new", "left")
        nxt = write(jump.select("id", "label", F.least("new", F.coalesce("far", "new")).alias("new")))
        changed = nxt.where("new <> label").limit(1).count()
        labels = nxt.select("id", F.col("new").alias("label"))
        if not changed:
            return labels.select("id", F.col("label").alias("component"))
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def _unit(v: np.ndarray | None) -> np.ndarray | None:
    """A vector of length one; None for what has no direction."""
    length = 0.0 if v is None else float(np.linalg.norm(np.asarray(v, dtype=np.float64)))
    return np.asarray(v, dtype=np.float64) / length if length else None


def choose_prototypes(faces: DataFrame, k: int = PROTOTYPES, pool: int = 10) -> DataFrame:
    """(person_id, id, place): at most k of each person's best ``pool`` faces that differ most.

    Locked faces first, by quality; else the best face; then again and again the face whose least similarity
    to the chosen is lowest. The pool is cut by rank before it is grouped, so a group has ``pool`` rows at most.
    """
    order = [F.col("manual_locked").desc(), F.col("quality_score").desc(), F.col("confidence").desc(), F.col("id")]
    cut = faces.where("person_id is not null").withColumn("_n", F.row_number().over(Window.partitionBy("person_id").orderBy(*order))).where(F.col("_n") <= pool)

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["quality_score", "id"], ascending=[False, True]).reset_index(drop=True)
        unit = [_unit(x) for x in rows["embedding"]]
        chosen = [i for i, locked in enumerate(rows["manual_locked"]) if locked][:k]
        rest = [i for i in range(len(rows)) if not rows["manual_locked"][i]]
        if not chosen and rest:
            chosen.append(rest.pop(0))
        while len(chosen) < k and rest:
            least = [min(float(unit[i] @ unit[j]) if unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) else -1.0 for j in chosen) for i in rest]
            chosen.append(rest.pop(int(np.argmin(least))))
        return pd.DataFrame({"person_id": rows["person_id"][chosen], "id": rows["id"][chosen], "place": range(1, len(chosen) + 1)})

    types = dict(faces.dtypes)
    narrow = cut.select("person_id", "id", "embedding", F.coalesce("manual_locked", F.lit(False)).alias("manual_locked"), "quality_score")
    return narrow.groupBy("person_id").applyInPandas(pick, f"person_id {types['person_id']}, id {types['id']}, place int")


def component_scores(members: DataFrame, prototypes: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """(component, person_id, score): the mean over the component's faces of the best similarity to the person's prototypes.

    ``members``: component, id, v. ``prototypes``: person_id, v (a few a person). Similarities below zero
    count as no match. With ``candidates`` (component, person_id) only those are scored, by joins: work that
    grows with the candidates. Without, faces come in blocks against all prototypes, which are cut into blocks
    as well.
    """
    if candidates is not None:
        asked = members.join(candidates.select("component", "person_id").distinct(), "component").join(prototypes.select("person_id", F.col("v").alias("_v")), "person_id")
        met = asked.select("component", "person_id", "id", X.cosine(F.col("v"), F.col("_v")).alias("best")).where("best >= 0")
        return _mean_of_best(met)
    blocks = lambda df, key: df.withColumn("_b", F.pmod(F.xxhash64(key), F.lit(max(1, -(-df.count() // 2048)))).cast("int"))
    left, right = blocks(members, "id"), blocks(prototypes.withColumn("pid", F.xxhash64("person_id", "v")), "pid")
    n_left, n_right = (max(1, -(-x.count() // 2048)) for x in (members, prototypes))
    a = left.select("component", "id", "v", F.col("_b").alias("x"), F.explode(F.sequence(F.lit(0), F.lit(n_right - 1))).alias("y"))
    b = right.select("person_id", "v", F.col("_b").alias("y"), F.explode(F.sequence(F.lit(0), F.lit(n_left - 1))).alias("x"))

    def best(faces: pd.DataFrame, people: pd.DataFrame) -> pd.DataFrame:
        if not len(faces) or not len(people):
            return pd.DataFrame({"component": [], "id": [], "person_id": [], "best": []})
        unit = lambda s: (m := np.stack([np.asarray(v, dtype=np.float64) for v in s])) / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
        people = people.sort_values("person_id", kind="stable")
        sim = unit(faces["v"]) @ unit(people["v"]).T
        first = np.flatnonzero(np.r_[True, people["person_id"].to_numpy()[1:] != people["person_id"].to_numpy()[:-1]])
        top = np.maximum.reduceat(sim, first, axis=1)
        i, j = np.nonzero(top >= 0)
        return pd.DataFrame({"component": faces["component"].to_numpy()[i], "id": faces["id"].to_numpy()[i], "person_id": people["person_id"].to_numpy()[first][j], "best": top[i, j]})

    kinds = dict(members.dtypes) | {"person_id": dict(prototypes.dtypes)["person_id"]}
    met = a.groupBy("x", "y").cogroup(b.groupBy("x", "y")).applyInPandas(best, f"component {kinds['component']}, id {kinds['id']}, person_id {kinds['person_id']}, best double")
    return _mean_of_best(met)


def _mean_of_best(met: DataFrame) -> DataFrame:
    return met.groupBy("component", "person_id", "id").agg(F.max("best").alias("best")).groupBy("component", "person_id").agg(F.avg("best").alias("score"))


def blocked_people(members: DataFrame, cannot_link: DataFrame) -> DataFrame:
    """(component, person_id): people a component may not join, since a face of it had a person that a user declared another.

    ``members``: component, previous (the person a face had before). ``cannot_link``: person_id_a, person_id_b,
    in either order.
    """
    both = F.explode(F.array(F.struct(F.col("person_id_a").alias("previous"), F.col("person_id_b").alias("person_id")), F.struct(F.col("person_id_b").alias("previous"), F.col("person_id_a").alias("person_id"))))
    apart = cannot_link.select(both.alias("l")).select("l.*").distinct()
    return members.where("previous is not null").select("component", "previous").distinct().join(apart, "previous").select("component", "person_id").distinct()


def attach_components(members: DataFrame, prototypes: DataFrame, cannot_link: DataFrame | None = None, attach: float = ATTACH, best_faces: int = BEST_FACES, confirmed: float = CONFIRMED, candidates: DataFrame | None = None) -> DataFrame:
    """What becomes of each component: attached to its best person, a new person, or pending again.

    ``members``: component, id, v, photo_id, quality_score, retry_count, previous (the person a face had, or
    null). ``prototypes``: person_id, v, locked (a user's own choice). The best person has the highest mean
    score (ties: the least id) among those that no cannot-link of the faces' previous people blocks. A
    component joins it if that score reaches the threshold, which falls with the tries of its most tried face;
    else if the score of its ``best_faces`` best faces alone does (for components with more), against that one
    person; else if the person is confirmed by a locked prototype and the score is short by at most
    ``confirmed``. Else two faces on two photos, or ten tries, make a new person. ``candidates`` (component,
    person_id) restricts whom a component is compared with.

    Returns component, action (attach, create, pending), person_id, retries, score (that of the decision; of
    components that find no one, the best there was, 0 at least).
    """
    scores = component_scores(members.select("component", "id", "v"), prototypes.select("person_id", "v"), candidates)
    if cannot_link is not None:
        scores = scores.join(blocked_people(members, cannot_link), ["component", "person_id"], "left_anti")
    best = scores.groupBy("component").agg(F.max_by(F.struct("person_id", "score"), F.struct("score", -F.col("person_id"))).alias("b")).select("component", "b.*")
    sizes = members.groupBy("component").agg(F.count("*").alias("faces"), F.countDistinct("photo_id").alias("photos"), F.max(F.coalesce("retry_count", F.lit(0))).alias("retries"))
    judged = sizes.join(best, "component", "left").withColumn("least", X.adaptive_threshold(attach, F.col("retries")))
    again = judged.where((F.col("faces") > best_faces) & (F.col("score") < F.col("least"))).select("component", "person_id")
    top = members.join(again.select("component"), "component", "left_semi").withColumn("_n", F.row_number().over(Window.partitionBy("component").orderBy(F.desc_nulls_last("quality_score"), "id"))).where(F.col("_n") <= best_faces)
    second = component_scores(top.select("component", "id", "v"), prototypes.select("person_id", "v"), again).select("component", F.col("score").alias("second"))
    sure = prototypes.groupBy("person_id").agg(F.bool_or(F.coalesce("locked", F.lit(False))).alias("sure"))
    joined = judged.join(second, "component", "left").join(sure, "person_id", "left")
    by_all, by_best = F.col("score") >= F.col("least"), F.col("second") >= F.col("least")
    fits = F.coalesce(by_all, F.lit(False)) | F.coalesce(by_best, F.lit(False)) | F.coalesce(F.col("sure") & (F.col("score") >= F.col("least") - confirmed), F.lit(False))
    makes = ((F.col("faces") >= 2) & (F.col("photos") >= 2)) | (F.col("retries") >= 10)
    action = F.when(fits, "attach").when(makes, "create").otherwise("pending")
    score = F.when(~F.coalesce(by_all, F.lit(False)) & F.coalesce(by_best, F.lit(False)), F.col("second")).otherwise(F.greatest(F.coalesce("score", F.lit(0.0)), F.lit(0.0)))
    return joined.select("component", action.alias("action"), F.when(fits, F.col("person_id")).alias("person_id"), F.when(action == "pending", F.col("retries") + 1).otherwise(F.lit(0)).alias("retries"), score.alias("score"))


def cluster_step(faces: DataFrame, link: float = LINK, attach: float = ATTACH, write: Callable[[DataFrame], DataFrame] | None = None, cannot_link: DataFrame | None = None, previous: str = "person_id") -> DataFrame:
    """(id, component, action, person_id, retries, score) for all pending faces at once; a new person has its component's id.

    ``previous`` names the column with the person that a pending face had, which its cannot-links go by.
    """
    pending = faces.where("cluster_status = 'pending' and embedding is not null and size(embedding) > 0")
    comp = components(pending.select("id"), face_graph(pending, link), write=write)
    members = pending.join(comp, "id").select("component", "id", F.col("embedding").alias("v"), "photo_id", "quality_score", "retry_count", F.col(previous).alias("previous"))
    assigned = faces.where("cluster_status <> 'pending'")
    prototypes = choose_prototypes(assigned).join(faces.select("id", F.col("embedding").alias("v"), F.col("manual_locked").alias("locked")), "id").select("person_id", "v", "locked")
    decided = attach_components(members, prototypes, cannot_link, attach)
    return comp.join(decided, "component").select("id", "component", "action", F.coalesce("person_id", F.when(F.col("action") == "create", F.col("component"))).alias("person_id"), "retries", "score")


def applied(faces: DataFrame, step: DataFrame) -> DataFrame:
    """Faces after a clustering step: person, status, score and tries of those it decided on."""
    new = step.select("id", F.col("person_id").alias("_p"), F.col("action").alias("_a"), F.col("score").alias("_s"), F.col("retries").alias("_r"))
    joined = faces.join(new, "id", "left")
    done = F.col("_a").isin("attach", "create")
    return joined.withColumns({
        "person_id": F.when(done, F.col("_p")).otherwise(F.col("person_id")), "cluster_status": F.when(done, "assigned").otherwise(F.col("cluster_status")),
        "cluster_score": F.when(done, F.col("_s")).otherwise(F.col("cluster_score")), "retry_count": F.coalesce(F.col("_r").cast("int"), "retry_count"),
    }).select(*faces.columns)


def recluster(faces: DataFrame, least: float = LOW, rounds: int = 3, write: Callable[[DataFrame], DataFrame] | None = None, **how: float) -> DataFrame:
    """Free the faces whose person is doubtful and cluster them again, until no one moves or ``rounds`` are over.

    Doubtful: a score below ``least``, not locked. A face that finds no person keeps the one it had.
    """
    write = write or checkpointed
    for _ in range(rounds):
        low = (F.col("cluster_score") < least) & F.col("person_id").isNotNull() & ~F.coalesce("manual_locked", F.lit(False))
        freed = write(faces.withColumn("_was", F.when(low, F.col("person_id"))).withColumn("cluster_status", F.when(low, "pending").otherwise("held")).withColumn("person_id", F.when(low, F.lit(None)).otherwise(F.col("person_id"))))
        after = applied(freed, cluster_step(freed, write=write, previous="_was", **how))
        settled = write(after.withColumn("_moved", F.col("_was").isNotNull() & F.col("person_id").isNotNull() & (F.col("person_id") != F.col("_was"))).withColumn("person_id", F.coalesce("person_id", "_was")))
        moved = settled.where("_moved").limit(1).count()
        status = faces.select("id", F.col("cluster_status").alias("_old"))
        faces = settled.join(status, "id").withColumn("cluster_status", F.when(F.col("person_id").isNotNull(), "assigned").otherwise(F.col("_old"))).select(*faces.columns)
        if not moved:
            break
    return faces


def pair_similarity(prototypes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, similarity, best): how alike two given people are; the mean of both directions and the best match."""
    sides = [prototypes.select(F.col("person_id").alias(x), F.xxhash64("v").alias(f"{x}_id"), F.col("v").alias(f"{x}_v")) for x in ("a", "b")]
    met = pairs.join(sides[0], "a").join(sides[1], "b").withColumn("s", X.cosine(F.col("a_v"), F.col("b_v")))
    ways = [met.groupBy("a", "b", f"{x}_id").agg(F.max("s").alias("s")).where("s >= 0").groupBy("a", "b").agg(F.avg("s").alias(f"from_{x}"), F.max("s").alias(f"best_{x}")) for x in ("a", "b")]
    return ways[0].join(ways[1], ["a", "b"]).select("a", "b", ((F.col("from_a") + F.col("from_b")) / 2).alias("similarity"), F.col("best_a").alias("best"))


def person_candidates(prototypes: DataFrame, least: float, **how: float | bool) -> DataFrame:
    """(component, person_id): pairs of people, both ways, of which some two prototypes are similar by ``least``; ``how`` is for ``candidate_pairs``.

    A mean of best matches is no higher than the best of them, so with ``exact`` no pair of people whose
    similarity reaches ``least`` is left out.
    """
    numbered = checkpointed(prototypes.select("person_id", "v").withColumn("id", F.monotonically_increasing_id()))
    pairs = candidate_pairs(numbered.select("id", "v", "person_id"), least, between="person_id", **how)
    a, b = (numbered.select(F.col("id").alias(x), F.col("person_id").alias(f"{x}_p")) for x in ("a", "b"))
    people = pairs.join(a, "a").join(b, "b")
    ways = F.explode(F.array(F.struct(F.col("a_p").alias("component"), F.col("b_p").alias("person_id")), F.struct(F.col("b_p").alias("component"), F.col("a_p").alias("person_id"))))
    return people.select(ways.alias("w")).select("w.*").distinct()


def merge_suggestions(prototypes: DataFrame, cannot_link: DataFrame | None = None, least: float = SUGGEST, limit: int | None = None, exact: bool = True, **how: float) -> DataFrame:
    """(target, candidate, similarity, rank): people that may be one, each candidate with its best target only.

    Similarity of two people: the mean, in both directions, of each prototype's best match; a direction without
    a match does not count. ``prototypes``: person_id, v. Only people with two prototypes that are similar by
    ``least`` are scored: no others can reach it. With ``exact`` those are found by the pruned join, without by
    signatures (``candidate_pairs``, which takes ``how``): for very many people, at the recall asked for. Pairs
    that users declared different are left out, whichever way they were written.
    """
    wanted = person_candidates(prototypes, least - 1e-9, exact=exact, **how)
    scores = component_scores(_as_members(prototypes), prototypes, wanted)
    return suggested(pair_scores(scores, least), cannot_link, limit)


def _as_members(prototypes: DataFrame) -> DataFrame:
    """Every person a component of the own prototypes."""
    return prototypes.select(F.col("person_id").alias("component"), F.xxhash64("person_id", "v").alias("id"), "v")


def pair_scores(scores: DataFrame, least: float) -> DataFrame:
    """(lo, hi, similarity) of pairs of people at ``least`` or above, from scores (component, person_id, score) in either direction."""
    both = scores.groupBy(F.least("component", "person_id").alias("lo"), F.greatest("component", "person_id").alias("hi")).agg(F.avg("score").alias("similarity"))
    return both.where((F.col("similarity") >= least) & (F.col("lo") < F.col("hi")))


def suggested(pairs: DataFrame, cannot_link: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """(target, candidate, similarity, rank) from pairs (lo, hi, similarity): each candidate goes to its best target, the lesser of a pair."""
    if cannot_link is not None:
        pairs = pairs.join(cannot_link.select(F.least("person_id_a", "person_id_b").alias("lo"), F.greatest("person_id_a", "person_id_b").alias("hi")).distinct(), ["lo", "hi"], "left_anti")
    best = pairs.groupBy(F.col("hi").alias("candidate")).agg(F.max_by(F.struct(F.col("lo").alias("target"), "similarity"), F.struct("similarity", -F.col("lo"))).alias("b")).select("b.target", "candidate", "b.similarity")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("target").orderBy(F.desc("similarity"), "candidate")))
    return ranked.where(F.col("rank") <= limit) if limit else ranked


def sync_people(people: DataFrame, faces: DataFrame) -> DataFrame:
    """People with fresh counts and avatar (best quality, then confidence, unless locked); those without faces go."""
    counted = faces.where("person_id is not null").groupBy(F.col("person_id").alias("id")).agg(F.count("*").alias("n"), F.countDistinct("photo_id").alias("m"), F.max_by("id", F.struct("quality_score", "confidence", -F.col("id"))).alias("best"))
    keep = [c for c in people.columns if c not in ("id", "representative_face_id", "face_count", "photo_count")]
    avatar = F.when(F.coalesce("avatar_locked", F.lit(False)), F.col("representative_face_id")).otherwise(F.col("best"))
    return people.join(counted, "id").select("id", *keep, avatar.alias("representative_face_id"), F.col("n").alias("face_count"), F.col("m").alias("photo_count"))


def merge_people(faces: DataFrame, merges: DataFrame) -> DataFrame:
    """Faces with merged people replaced by what they were merged into; ``merges``: source, target."""
    into = merges.select(F.col("source").alias("person_id"), "target")
    return faces.join(into, "person_id", "left").withColumn("person_id", F.coalesce("target", "person_id")).select(*faces.columns)


def split_faces(faces: DataFrame, chosen: DataFrame, person_id: int | None) -> DataFrame:
    """Move the chosen faces (id) to a person, or to none: then they are pending again."""
    moved = faces.join(chosen.select("id", F.lit(True).alias("_m")), "id", "left")
    to = F.lit(person_id).cast(dict(faces.dtypes)["person_id"])
    return moved.withColumn("person_id", F.when(F.col("_m"), to).otherwise(F.col("person_id"))).withColumn("cluster_status", F.when(F.col("_m"), F.lit("assigned" if person_id is not None else "pending")).otherwise(F.col("cluster_status"))).select(*faces.columns)
