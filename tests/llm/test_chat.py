"""The prefix tree: exact round trip, each shared turn once, positions and intervals against plain Python."""

import hashlib
from collections import defaultdict

import pytest

from keepsake.llm import chat, queries

pytest.importorskip("tokenizers")
PATH = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
ROWS = [
    (1, 0, "system", "be kind"), (1, 1, "user", "hello"), (1, 2, "assistant", "hi \\n <|im_end|>"), (1, 3, "user", "bye"),
    (2, 0, "system", "be kind"), (2, 1, "user", "hello"), (2, 2, "assistant", "hi \\n <|im_end|>"), (2, 3, "assistant", "\\<|\\| é 🙂"),
    (3, 0, "system", "be kind"), (3, 1, "user", "other"),
    (4, 0, "system", "be kind"), (5, 0, "system", "be kind"), (5, 1, "user", "hello"),
    (6, 0, "user", None), (6, 1, None, "x"), (7, 0, "a\nb", ""), (7, 1, "assistant", ""), (8, 0, "user", "<|endoftext|>"), (8, 0, "user", "<|endoftext|>"),
    (None, None, "user", "no id"), (9, None, "user", "no turn"), (9, 1, "assistant", "w " * 3000),
]


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def plain(rows):
    out = defaultdict(list)
    for c, t, r, x in rows:
        out[c].append((t is not None, t or 0, r or "", x or ""))
    return {c: [(r, x) for *_, r, x in sorted(v)] for c, v in out.items()}


def test_round_trip(spark):
    nodes, members = chat.prefix_tree(frame(spark, ROWS).selectExpr("*", "1 as node", "2 as start"), PATH)
    got = {r.conv_id: r for r in chat.read_back(nodes, members, PATH).collect()}
    want = plain(ROWS)
    assert got.keys() == want.keys()
    for c, turns in want.items():
        assert list(zip(got[c].roles, got[c].texts, strict=True)) == turns
        assert got[c].loss_text == "".join(x for r, x in turns if r == "assistant")
        assert got[c].formatted == "".join(f"<|im_start|>{chat.escape_role(r)}\n{chat.escape(x)}<|im_end|>\n" for r, x in turns)
        assert got[c].n_turns == len(turns)


def test_shared_turns_once_depth_first(spark):
    nodes = chat.prefix_tree(frame(spark, ROWS), PATH)[0].orderBy("start").collect()
    code = chat.codec(PATH)
    prefixes = {tuple(t[: k + 1]) for t in plain(ROWS).values() for k in range(len(t))}
    assert sum(len(n.ids) for n in nodes) == sum(len(code.turn(*p[-1])[0]) for p in prefixes)
    at, by = 0, {bytes(n.node): n for n in nodes}
    for n in nodes:
        assert (n.start, n.end) == (at, at + len(n.ids))
        at = n.end
        above = [by[bytes(n.node[: 8 * k])] for k in range(1, len(n.node) // 8)]
        assert [(a.start, a.end) for a in n.ancestors] == [(a.start, a.end) for a in above]
        assert n.position == sum(len(a.ids) for a in above)
        below = [m for m in nodes if bytes(m.node).startswith(bytes(n.node))]
        assert [m.start for m in below] == sorted(m.start for m in nodes if n.start <= m.start < n.start + sum(len(b.ids) for b in below))


def test_query_and_empty(spark, tmp_path):
    frame(spark, ROWS).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in queries.op1_chat_formatting(spark, str(tmp_path)).collect()}
    says = "<|im_end|><|im_start|>assistant ok"
    for c, turns in (plain(ROWS) | {-1: [("user", says), ("assistant", says)]}).items():
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
        loss = "".join(x for r, x in turns if r == "assistant")
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    nodes, members = chat.prefix_tree(frame(spark, []), PATH)
    assert nodes.count() == 0 and members.count() == 0
