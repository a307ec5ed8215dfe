"""Packing against placing one document after another, and ids against the tokenizer itself."""

import random
import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict

import pytest

from keepsake.llm import packing, queries, tokens


def plain_bins(lengths, capacity):
    """Remaining capacities after best-fit decreasing, one piece at a time."""
    left = []
    for x in sorted(lengths, reverse=True):
        k = bisect_left(left, x)
        room = left.pop(k) if k < len(left) else capacity
        insort(left, room - x)
    return left


@pytest.mark.parametrize(("seed", "capacity", "n"), [(1, 16, 300), (2, 100, 2000), (3, 2048, 3000), (4, 7, 1), (5, 64, 0)])
def test_plan_is_best_fit_decreasing(seed, capacity, n):
    rng = random.Random(seed)
    lengths = [min(capacity, int(rng.paretovariate(0.8))) if rng.random() < 0.7 else rng.randint(1, capacity) for _ in range(n)]
    counts = Counter(lengths)
    used, ranks = defaultdict(list), defaultdict(int)
    for length, rank, pieces, first, fill, offset in packing.plan_bins(counts, capacity):
        assert rank == ranks[length]
        ranks[length] += pieces
        for k in range(pieces):
            used[first + k // fill].append((offset + k % fill * length, length))
    assert ranks == counts
    for places in used.values():
        at = 0
        for start, length in sorted(places):
            assert start == at
            at += length
        assert at <= capacity
    assert sorted(capacity - sum(x for _, x in p) for p in used.values()) == plain_bins(lengths, capacity)


def test_documents_are_packed_whole(spark, tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    rng = random.Random(3)
    texts = [None, "", "Don't İstanbul ΑΣ ΑΣΒ é́ it's 1234 ½ x_y <|endoftext|>b", "a\x1cb", "naïve x　y 🙂🙂", "word " * 5000, "x" * 9000]
    texts += [" ".join(rng.choice(["Alpha", "beta,", "γάμμα", "12", "don't"]) for _ in range(rng.randint(0, 900))) for _ in range(120)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3])]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as length", "2 as rank", "'a' as ids").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op3_best_fit_packing(spark, str(tmp_path)).collect()
    reference = tokenizers.Tokenizer.from_file(path)
    want = []
    for d, t in rows:
        ids = reference.encode(t or "", add_special_tokens=False).ids + [0]
        want += [(d, p, at, len(ids[at : at + 2048]), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[at : at + 2048]))) for p, at in enumerate(range(0, len(ids), 2048))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) == len(plain_bins([w[3] for w in want], 2048))


def test_sequences_hold_the_ids(spark):
    rows = [(i, 0, 0, n, bytes(4 * n)) for i, n in enumerate([3, 5, 8, 2, 1])]
    packed = packing.pack(spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids binary"), capacity=8)
    got = packing.sequences(packed).collect()
    assert sorted(len(r.ids) // 4 for r in got) == [3, 8, 8]
    assert sorted(d for r in got for d in r.doc_ids) == [0, 1, 2, 3, 4]


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, piece int, length long")).count() == 0


def test_ids_of_every_code_point_are_the_library_s():
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"{c} a{c}b{c}" for c in points[at : at + 256]) for at in range(0, len(points), 256)]
    texts += ["a." "b, c;d e.. f.. g!? x<|endoftext|>. 5% $5 5$ don't. 's it's' é. É, aé; \u0301. a\u0301. a.\u0301 A. B_ _b I\u0307. "]
    texts += ["line\x08 one \x1b[0m red\x7f", None, "", "<|endoftext|> x<|startoftext|>y"]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        reference = tokenizers.Tokenizer.from_file(public.path(name))
        want = [b"".join(i.to_bytes(4, "little") for i in reference.encode(t or "", add_special_tokens=False).ids) for t in texts]
        assert list(tokens.encode_texts(public.path(name), texts)) == want


def test_words_are_remembered_only_where_the_file_allows_it():
    public = pytest.importorskip("public_tokenizers")
    told = {n: tokens.json.load(open(public.path(n), encoding="utf-8")) for n in ("word_bpe_49k.json", "byte_bpe_50k.json")}
    assert tokens.drops_white_space(told["word_bpe_49k.json"]) and not tokens.drops_white_space(told["byte_bpe_50k.json"])
    small = tokens.Encoder(public.path("word_bpe_49k.json"), limit=5)
    texts = ["one two three", "four five six seven", "", "one two", "eight nine ten eleven twelve thirteen"] * 3
    assert [x for t in texts for x in small.encode([t])] == list(tokens.encode_texts(public.path("word_bpe_49k.json"), texts))


def test_ids_of_files_with_other_normalisers(tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    with open(public.path("word_bpe_49k.json"), encoding="utf-8") as f:
        told = tokens.json.load(f)
    own = tokens.normalizers(told)
    assert any(x["type"] == "Lowercase" for x in own)
    cased = [x for x in own if x["type"] != "Lowercase"]
    texts = ["Hello World", "HELLO, WORLD. don't A.B", "É é \u0130 ǅ ﬁ Ａ", "a\u00a0b  c\n", "", "<|endoftext|> Xy.", "hello World's 5x"]
    forms = [{"type": "Sequence", "normalizers": cased}, {"type": "Lowercase"}, {"type": "NFKC"}, {"type": "NFC"}, None, {"type": "Sequence", "normalizers": []}, {"type": "Sequence", "normalizers": [{"type": "NFKC"}, *own]}]
    for k, form in enumerate(forms):
        path = f"{tmp_path}/{k}.json"
        with open(path, "w", encoding="utf-8") as f:
            tokens.json.dump(told | {"normalizer": form}, f)
        library = tokenizers.Tokenizer.from_file(path)
        want = [b"".join(i.to_bytes(4, "little") for i in library.encode(t, add_special_tokens=False).ids) for t in texts]
        assert list(tokens.encode_texts(path, texts)) == want, form
