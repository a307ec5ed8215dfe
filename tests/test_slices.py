"""Slices against full runs, with changes, removals and a run that failed."""

import numpy as np
import pytest

from keepsake.operators import people, slices


def test_slices_follow_changes(spark, tmp_path):
    rng = np.random.default_rng(6)
    path, centres = str(tmp_path / "s"), rng.normal(size=(6, 12))
    person = lambda p: [(centres[p % 6] + 0.5 * rng.normal(size=12)).tolist() for _ in range(3)]
    have = {p: (person(p), 1) for p in range(30)}
    frame = lambda: spark.createDataFrame([(p, v, gen) for p, (vs, gen) in have.items() for v in vs or [None]] + [(None, [1.0] * 12, 99)], "person_id long, v array<double>, gen int")
    told = lambda df: {(r.target, r.candidate, r.rank): round(r.similarity, 9) for r in df.collect()}
    with pytest.raises(ValueError):
        slices.current_pairs(spark, path)
    assert [slices.run_slice(frame(), path, 0.5, limit=13) for _ in range(4)] == [13, 13, 4, 0]
    banned = spark.createDataFrame([(6, 0), (1, 7)], "person_id_a long, person_id_b long")
    full = lambda **how: told(people.merge_suggestions(frame().where("v is not null and person_id is not null").select("person_id", "v"), least=0.5, **how))
    assert told(slices.stored_suggestions(spark, path)) == full() and len(full()) > 10
    assert told(slices.stored_suggestions(spark, path, banned, 2)) == full(cannot_link=banned, limit=2)
    for gen, changed, gone in ((2, (3, 17, 31), ()), (3, (4,), (5, 8)), (4, (5,), ())):
        have |= {p: (person(p + 1), gen) for p in changed} | {p: ([], gen) for p in gone}
        assert {r.person_id for r in slices.dirty_people(frame(), path).collect()} == {*changed, *gone}
        assert slices.run_slice(frame(), path, 0.5) == len(changed) + len(gone)
        written = spark.read.parquet(f"{path}/pairs/run={gen + 2}").collect()
        assert all({r.lo, r.hi} & {*changed} for r in written) and slices.run_slice(frame(), path, 0.5) == 0
        assert told(slices.stored_suggestions(spark, path)) == full()
    # pairs of a run that failed before its people were written
    spark.createDataFrame([(0, 1, 1.0)], "lo long, hi long, similarity double").write.parquet(f"{path}/pairs/run=7")
    assert told(slices.stored_suggestions(spark, path)) == full()
