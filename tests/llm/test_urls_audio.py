"""URL rules and aliases, and telephony audio against slow plain decoding."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from keepsake.llm import audio, queries, urls
from keepsake.llm.components import connected_components


def plain_judge(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(h + p, a) for a, h, p in queries.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, key=lambda x: len(x[0]), default=(None, "allow"))
    return host, path, best[0], best[1]


def test_rules(spark):
    some = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x?q#f", "http://a.example.com/en", "http://a.example.com/en/", "http://example.com", "http://xexample.com/en/1", "https://net/es/", "http://a.b.net/fr/é#x://y.com/", "x://É.net/es/1", "http://h.org?://a.com/", "http://com/", "http://.com/x", "http://a..net/es/\n", "http://A?B/C"]
    df = spark.createDataFrame([(i, u, None, "z") for i, u in enumerate(some + some[3:6])], "page_id long, url string, html string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(df, queries.RULES).collect()}
    assert got == {i: plain_judge(u) for i, u in enumerate(some + some[3:6])}
    policy = spark.createDataFrame([*queries.RULES, queries.RULES[1], ("block", "com", "/"), (None, None, None)], "action string, host string, path string")
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(df, policy).collect()} == got
    assert urls.filter_urls(df.limit(0), queries.RULES).count() == 0 and urls.filter_urls(df, policy.limit(0)).where("verdict <> 'allow'").count() == 0
    assert {r.verdict for r in urls.filter_urls(df, []).collect()} == {"allow"}


def test_aliases(spark):
    canonical = lambda u: f'<HTML><head><LINK rel="canonical" href="{u}"></head>'
    refresh = lambda u: f"<meta http-equiv=refresh content='0; url={u}'>"
    rows = [
        (1, "http://bad.net/es/1", canonical("http://clean.org/a")), (2, "http://clean.org/a#x", ""), (3, "http://clean.org/b", refresh("http://clean.org/a")),
        (4, "http://www.example.com/en/ok", canonical("http://clean.org/b")), (5, "http://other.org/", canonical("http://other.org/")), (6, "http://far.org/", None),
        (7, "http://only.org/x", canonical("http://gone.net/fr/target")), (8, "http://moved.org/", ""), (8, "http://moved.org/", ""),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    redirects = spark.createDataFrame([("http://moved.org/", "http://far.org/"), ("http://far.org/", "http://clean.org/b"), (None, "http://x.y/")], "src string, dst string")
    verdict = lambda **k: {r.page_id: r.verdict for r in urls.filter_urls(df, queries.RULES, **k).collect()}
    assert verdict() == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow", 7: "block", 8: "allow"}
    assert verdict(redirects=redirects) == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "block", 7: "block", 8: "block"}
    assert set(verdict(html=None).values()) == {"allow", "block"}


def test_relative_and_several_links(spark):
    link = lambda *attributes: "".join(f"<link {a}>" for a in attributes)
    cases = [
        ("http://h.org/d/e?q#f", link("rel=canonical href=/a/b?x#y"), "h.org/a/b?x"),
        ("http://h.org/d/e", link("rel='stylesheet' href='/s.css'", "href='g' rel=\"canonical\""), "h.org/d/g"),
        ("http://h.org/d/e/", link("rel=canonical href='../g/./k'"), "h.org/d/g/k"),
        ("http://h.org", link("rel=canonical href=g"), "h.org/g"),
        ("http://h.org/d", link('rel=canonical href="//O.org/z"'), "o.org/z"),
        ("http://h.org/d", link("rel=canonical href='?a=1&amp;b=2'"), "h.org/d?a=1&b=2"),
        ("http://h.org/d", link('rel=canonical href="http://o.org/it\'s"'), "o.org/it's"),
        ("http://h.org/d", "<META content='3; URL=&quot;../m&quot;' http-equiv='refresh'>", "h.org/m"),
        ("http://h.org/d", link("rel=canonical href='#top'", "rel=canonical href='mailto:a@b.org'", "rel=alternate href=/no", "rel=canonical href=''"), None),
        (None, link("rel=canonical href=/a"), None),
    ]
    for url, html, want in cases:
        got = urls.declared_edges(spark.createDataFrame([(url, html)], "url string, html string")).collect()
        assert [r.dst for r in got] == ([want] if want else []), html
    both = spark.createDataFrame([("http://h.org/d", link("rel=canonical href=/a", "rel=canonical href=/b") + "<meta http-equiv=refresh content='0;url=/c'>")], "url string, html string")
    assert {r.dst for r in urls.declared_edges(both).collect()} == {"h.org/a", "h.org/b", "h.org/c"}


def test_plans_stay_small(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    for df in (urls.declared_edges(pages), urls.filter_urls(pages, queries.RULES)):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract") < 100


def test_made_aliases_in_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    folder = "/root/testdata/sf0.001"
    got = {tuple(r) for r in queries.url_aliases(spark, folder).collect()}
    want = set(duckdb.sql(queries.oracle_sql()["url_aliases"].replace("FROM pages", f"FROM '{folder}/pages.parquet'")).fetchall())
    assert got == want and {r[2] for r in got} == {"allow", "block"}


def test_long_chains(spark):
    edges = [(f"n{i:03}", f"n{i + 1:03}") for i in range(200)] + [("x", "y"), ("x", "x"), (None, "x"), ("y", "x")] + [("hub", f"h{i}") for i in range(300)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert {got[f"n{i:03}"] for i in range(201)} == {"n000"} and got["y"] == "x" and {got[f"h{i}"] for i in range(300)} == {"h0"} and got["hub"] == "h0"
    assert connected_components(spark.createDataFrame([], "src string, dst string")).count() == 0


def plain_mulaw(code):
    code = ~code & 0xFF
    size = ((((code & 15) << 3) + 0x84) << (code >> 4 & 7)) - 0x84
    return -size if code & 0x80 else size


def plain_alaw(code):
    code ^= 0x55
    exponent, size = code >> 4 & 7, (code & 15) << 4
    size = size + 8 if not exponent else (size + 0x108) << exponent - 1
    return size if code & 0x80 else -size


def plain_adpcm(block):
    value, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(audio.STEPS[index])
            change = (step >> 3) + (step >> 2) * (code & 1) + (step >> 1) * (code >> 1 & 1) + step * (code >> 2 & 1)
            value = max(-32768, min(32767, value - change if code & 8 else value + change))
            index = max(0, min(88, index + int(audio.MOVES[code & 7])))
            out.append(value)
    return out


def test_tables_and_blocks():
    assert audio.TABLES[audio.MULAW].tolist() == [plain_mulaw(c) for c in range(256)]
    assert audio.TABLES[audio.ALAW].tolist() == [plain_alaw(c) for c in range(256)]
    raw = np.random.default_rng(2).integers(0, 256, 5 * 32 + 7, dtype=np.uint8)
    raw[2::32] %= 89
    assert audio.decode_adpcm(raw.tobytes(), 32).tolist() == [v for k in range(5) for v in plain_adpcm(raw[32 * k : 32 * k + 32].tobytes())]
    assert len(audio.decode_adpcm(b"", 32)) == 0


@pytest.mark.parametrize("tag", [audio.PCM, audio.ALAW, audio.MULAW, audio.IMA_ADPCM])
def test_files(spark, tag):
    data = bytes(range(256))
    media = audio.wav(data, tag, 8000, 8, 64 if tag == audio.IMA_ADPCM else 1)
    assert audio.read_wav(media)[3] == data and audio.read_wav(media)[0] == tag
    rows = spark.createDataFrame([(1, media), (2, None), (3, b"RIFFxxxx")], "id long, media binary")
    got = {r.id: r for r in audio.decode_audio(rows, keep=("id",)).collect()}
    pcm, rate = audio.to_pcm(media)
    assert bytes(got[1].samples) == data and audio.read_wav(bytes(got[1].pcm))[:2] == (audio.PCM, 16000)
    assert len(audio.read_wav(bytes(got[1].pcm))[3]) == 4 * len(pcm) and got[2].error and got[3].error
    back = np.frombuffer(audio.read_wav(bytes(got[1].pcm))[3], dtype="<i2")
    assert (back[::2] == pcm).all()


def test_query(spark, tmp_path):
    texts = [None, "", "a", "é" * 32, "x" * 65, "🙂 " * 3000, "x" * 65, *("t" * k for k in range(1, 20))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'z' as payload", "1 as media").write.parquet(f"{tmp_path}/documents.parquet")
    got, seen = {r.doc_id: r for r in queries.op7_media_columns(spark, str(tmp_path)).collect()}, set()
    for d, t in enumerate(texts):
        raw = (t or "").encode()
        full = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        media = audio.container(full, (audio.MULAW, audio.ALAW, audio.IMA_ADPCM)[zlib.crc32(full) % 3])
        seen.add(audio.read_wav(media)[0])
        r = got[d]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
    assert got[4].feature == got[6].feature and seen == {audio.MULAW, audio.ALAW, audio.IMA_ADPCM}


def test_every_format_on_a_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id", "cast(text as binary) as p", "1 as media", "2 as feature")
    formats = (audio.MULAW, audio.ALAW, audio.IMA_ADPCM)
    [stored] = audio.store_payloads(docs, "p", formats, keep=("doc_id", "p"))
    rows, seen = audio.decode_audio(stored, keep=("doc_id", "p", "media")).collect(), set()
    for r in rows:
        raw = bytes(r.p or b"")
        tag, rate, block, data = audio.read_wav(bytes(r.media))
        assert (tag, rate, data, bytes(r.samples)) == (formats[zlib.crc32(raw) % 3], 8000, raw, raw)
        if tag == audio.IMA_ADPCM:
            want = [v for at in range(0, len(raw), block) if len(raw) - at > 1 for v in plain_adpcm(raw[at : at + block].ljust(4, b"\0"))]
        else:
            want = [{audio.MULAW: plain_mulaw, audio.ALAW: plain_alaw}[tag](c) for c in raw]
        assert np.frombuffer(audio.read_wav(bytes(r.pcm))[3], dtype="<i2")[::2].tolist() == want and r.error is None
        seen.add(tag)
    assert seen == set(formats) and len(rows) == docs.count()


def test_audio_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op7_media_columns(spark, str(tmp_path)).count() == 0


def test_short_last_blocks_and_channels(spark):
    raw = np.random.default_rng(3).integers(0, 256, 2 * 32 + 9, dtype=np.uint8)
    raw[2::32] %= 89
    for n in (73, 64, 9, 68, 66, 65):
        data = raw[:n].tobytes()
        rest = data[n - n % 32 :]
        want = [v for k in range(n // 32) for v in plain_adpcm(data[32 * k : 32 * k + 32])] + (plain_adpcm(rest.ljust(4, b"\0")) if len(rest) > 1 else [])
        assert audio.to_pcm(audio.wav(data, audio.IMA_ADPCM, 8000, 4, 32))[0].tolist() == want
    stereo = bytearray(audio.wav(bytes(range(64)), audio.MULAW))
    stereo[22:24] = b"\2\0"
    [row] = audio.decode_audio(spark.createDataFrame([(bytes(stereo),)], "media binary")).collect()
    assert row.samples is None and row.pcm is None and row.error == "2 channels"


def test_features_are_of_the_stored_pcm(spark, tmp_path):
    texts = {k: f"{k} some words of a text " * (20 + k) for k in range(8)}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for row in queries.op7_media_columns(spark, str(tmp_path)).collect():
        full = texts[row.doc_id].encode().ljust(-(-len(texts[row.doc_id]) // 64) * 64, b"\0")
        pcm, rate = audio.to_pcm(audio.container(full, (audio.MULAW, audio.ALAW, audio.IMA_ADPCM)[zlib.crc32(full) % 3]))
        assert row.feature == audio.features(audio.resample(pcm, rate, 16000), 16000)
