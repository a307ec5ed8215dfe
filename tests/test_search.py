"""The stored index against a look through all texts."""

import random
import re

import pytest

from keepsake.operators import filters, search

DOCS = [(1, "The well-known café, by night", "a b"), (2, "well known", None), (3, "known well", "night"), (4, None, None), (5, "", "the the the"), (6, "known", "well known"), (6, "twice", ""), (7, "end well", "known start"), (None, "the well known", ""), (8, "日本 the_end ÉTÉ été", "x")]
SCHEMA = "id long, text string, note string"


def plain(docs, query):
    terms = [re.sub(r"[\W_]+", " ", t).strip() for t in query.replace('"', "").lower().split()]
    spaced = lambda t: " " + " ".join(re.findall(r"[^\W_]+", (t or "").lower())) + " "
    held = {}
    for d, *texts in docs:
        held.setdefault(d, []).extend(map(spaced, texts))
    return {d for d, texts in held.items() if d is not None and terms and all(any(f" {t} " in x for x in texts) for t in terms if t)}


QUERIES = ["the", "well-known", "well known", '"Known" night', "the-the", "the-the-the-the", "CAFÉ", "été", "日本 end", "known-start", "missing", "the missing", "a.b"]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "i")
    search.build_index(spark.createDataFrame(DOCS, SCHEMA).withColumnRenamed("note", "gen"), path, columns=["text", "gen"], buckets=8)
    return path


@pytest.mark.parametrize("query", QUERIES)
def test_queries(spark, index, query):
    assert {r.id for r in search.search_index(spark, index, query, 8).collect()} == plain(DOCS, query)


def test_queries_without_words_find_nothing(spark, index):
    assert search.search_index(spark, index, "", 8).count() == 0 and search.search_index(spark, index, ' "-" ', 8).count() == 0


def test_filter_reads_terms_alike(spark):
    rows = spark.createDataFrame([d for d in DOCS if d[0] not in (None, 6)], SCHEMA)
    for query in QUERIES:
        assert {r.id for r in rows.where(filters.matches_terms(["text", "note"], query)).collect()} == plain([d for d in DOCS if d[0] != 6], query)


def test_only_the_terms_folders_are_read(spark, index):
    plan = search.search_index(spark, index, "well-known night", 8)._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    scans = [line for line in plan.split("\n") if "FileScan" in line]
    assert scans and all("/postings" in s or "/documents" in s for s in scans)
    assert any("PartitionFilters: [" in s and "bucket" in s.split("PartitionFilters:")[1].split("]")[0] for s in scans)
    assert all(re.search(r"PushedFilters: \[.*term", s) for s in scans if "/postings" in s)


def test_updates_touch_changed_documents_alone(spark, tmp_path):
    rng = random.Random(3)
    text = lambda: " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 9)))
    docs = {d: text() for d in range(120)}
    path, frame = str(tmp_path / "i"), lambda some: spark.createDataFrame(list(some.items()), "id long, text string")
    search.build_index(frame(docs), path, buckets=4)
    for gen in (2, 3, 4):
        changed = {d: text() for d in rng.sample(range(150), 20)}
        gone = {d: "" for d in rng.sample(sorted(docs.keys() - changed.keys()), 9)}
        assert search.update_index(frame(changed), path, frame(gone), buckets=4) == gen
        assert {r.id for r in spark.read.parquet(f"{path}/postings/gen={gen}").select("id").distinct().collect()} == {d for d, t in changed.items() if t}
        docs = {d: t for d, t in (docs | changed).items() if d not in gone}
        for query in ("a", "a-b", "c a-a", "h g f"):
            assert {r.id for r in search.search_index(spark, path, query, 4).collect()} == plain(list(docs.items()), query), (gen, query)
    # an update that failed before its documents were written
    frame({1: "a b"}).selectExpr("2 as bucket", "'a' as term", "id", "array(0) as positions").write.partitionBy("bucket").parquet(f"{path}/postings/gen=5")
    assert {r.id for r in search.search_index(spark, path, "a", 4).collect()} == plain(list(docs.items()), "a")
    search.compact_index(spark, path, str(tmp_path / "j"))
    for query in ("a", "a-b", "c a-a"):
        assert {r.id for r in search.search_index(spark, str(tmp_path / "j"), query, 4).collect()} == plain(list(docs.items()), query)


def test_an_empty_table(spark, tmp_path):
    search.build_index(spark.createDataFrame([], SCHEMA), str(tmp_path / "i"))
    assert search.update_index(spark.createDataFrame(DOCS[:2], SCHEMA), str(tmp_path / "i")) == 2
    assert {r.id for r in search.search_index(spark, str(tmp_path / "i"), "known").collect()} == {1, 2}


def test_words_are_grouped_before_they_are_dealt():
    import pyarrow as pa

    ids, texts = pa.array([5, 6, 7]), pa.array([["a b a", "", "b c"], ["", "", ""], ["x", "x x", ""]])
    found = pa.Table.from_batches(search._postings_of(iter([pa.RecordBatch.from_arrays([ids, texts], names=["id", "texts"])]))).to_pylist()
    gap = search.APART
    want = {(5, "a"): [0, 2], (5, "b"): [1, 3 + 2 * gap], (5, "c"): [4 + 2 * gap], (7, "x"): [0, 1 + gap, 2 + gap]}
    assert {(r["id"], r["term"]): r["positions"] for r in found} == want and len(found) == len(want)
