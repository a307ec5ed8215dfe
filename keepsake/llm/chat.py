"""Chat formatting into a prefix tree: shared first turns are emitted once, with positions and attention intervals."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.llm.staging import few_rows, release, staged

#: The markers of a turn, which become ids of their own behind the vocabulary.
START, END = "<|im_start|>", "<|im_end|>"
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(re.escape(START) + "(.*?)" + re.escape(END), re.DOTALL)


def escape(text: str) -> str:
    """Make control strings ordinary text: a backslash is doubled and one is put inside every ``<|``."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    """What ``escape`` (and ``escape_role``) made of a text, back again."""
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


def escape_role(role: str) -> str:
    """As ``escape``; a line break, which ends the role, becomes a backslash and n."""
    return escape(role).replace("\n", "\\n")


class Codec:
    """Ids of formatted turns with a byte-level tokenizer file, and their text again."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self._t = Tokenizer.from_file(path)
        self._t.encode_special_tokens = True
        self.start = self._t.get_vocab_size()
        self.end = self.start + 1
        self.head = lru_cache(maxsize=1024)(self._head)
        self._close = np.array([self.end, *self._t.encode("\n", add_special_tokens=False).ids], dtype=np.int32)

    def _head(self, role: str) -> np.ndarray:
        return np.array([self.start, *self._t.encode(escape_role(role) + "\n", add_special_tokens=False).ids], dtype=np.int32)

    def bodies(self, texts: set[str]) -> dict[str, np.ndarray]:
        """Ids of the escaped texts, encoded about a megabyte at a time: an encoding is many times as large as its text."""
        found, some, size = {}, [], 0
        for text in [*texts, None]:
            if text is None or size > 1 << 20:
                ids = self._t.encode_batch_fast([escape(t) for t in some], add_special_tokens=False)
                found.update((t, np.array(e.ids, dtype=np.int32)) for t, e in zip(some, ids, strict=True))
                some, size = [], 0
            if text is not None:
                some.append(text)
                size += len(text)
        return found

    def turn(self, role: str, text: str) -> tuple[list[int], int, int]:
        """Ids of one turn, and where the escaped text begins and ends in them."""
        parts, lo, hi = self.framed(role, self.bodies({text})[text])
        return np.concatenate(parts).tolist(), lo, hi

    def framed(self, role: str, body: np.ndarray) -> tuple[list[np.ndarray], int, int]:
        """As ``turn``, of encoded text and in parts."""
        head = self.head(role)
        return [head, body, self._close], len(head), len(head) + len(body)

    def texts(self, ids: np.ndarray, cuts: np.ndarray) -> tuple[list[int], list[str]]:
        """The formatted text of ids, markers included, in parts: (begins, texts), cut at markers and at ``cuts``."""
        marks = np.flatnonzero(ids >= self.start)
        at = np.unique(np.concatenate([[0, len(ids)], marks, marks + 1, cuts]).astype(np.int64)).tolist()
        kinds = {self.start: START, self.end: END}
        runs = [ids[lo:hi] for lo, hi in zip(at, at[1:])]
        keys = [r.tobytes() for r in runs]
        open_ = {k: r.tolist() for k, r in zip(keys, runs, strict=True) if r[0] < self.start}
        told = dict(zip(open_, self._t.decode_batch(list(open_.values()), skip_special_tokens=False), strict=True))
        return at[:-1], [told[k] if k in told else kinds[int(r[0])] for k, r in zip(keys, runs, strict=True)]


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def _digest(before: bytes, role: str, text: str) -> bytes:
    """Name of a prefix: of the prefix before it and its last turn."""
    return hashlib.blake2b(before + len(role.encode()).to_bytes(8, "little") + role.encode() + text.encode(), digest_size=16).digest()


def prefix_tree(conversations: DataFrame, tokenizer: str) -> tuple[DataFrame, DataFrame]:
    """Merge conversations that begin with the same turns: (nodes, members), both stored tables.

    nodes: node (name), start and end (its tokens' place in the depth-first order of the forest), position
    (of its first token: how many tokens its ancestors have), ids, loss (token intervals of assistant texts,
    counted inside the node), ancestors (intervals of the depth-first order that its tokens may attend to, in
    order, besides the node itself up to the token). Every shared turn is in one node, once; a run of turns
    that the same conversations share is one node, so long tails cost one row. members: conv_id, node (its
    last), n_turns.

    Turns go by ``turn``, then role and text; null roles and texts are empty; repeated rows are repeated
    turns; rows with a null conv_id make one conversation. A conversation is read as a whole, like a
    document. Counting how many conversations share a prefix, finding ancestors and reading back are joins
    and aggregates, so a first turn that a third of them share is never one group; the depth-first order is
    one sort by range, whose tasks' token counts (a number each) are added up on the driver.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    talks = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    talks = talks.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("owner"), "conv_id", "turns")

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = []
            for turns in b.column(2).to_pylist():
                key, keys = b"", []
                for t in turns:
                    key = _digest(key, t["role"], t["text"])
                    keys.append(key)
                names.append(keys)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.list_(pa.binary()))], names=["owner", "conv_id", "turns", "keys"])

    kind = dict(talks.dtypes)
    named = staged(talks.mapInArrow(name, f"owner string, conv_id {kind['conv_id']}, turns {kind['turns']}, keys array<binary>"), "conversations")
    each = named.select("owner", F.posexplode("keys").alias("depth", "key"))
    shared = each.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("owner").alias("first"))
    counted = each.join(shared, "key").groupBy("owner").agg(F.array_sort(F.collect_list(F.struct("depth", "n", (F.col("first") == F.col("owner")).alias("mine")))).alias("counts"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows for each conversation's nodes; those it owns carry the tokens."""
        code = codec(tokenizer)
        for b in few_rows(batches, 500):
            rows, flat, lengths = [], [np.zeros(0, np.int32)], []
            turns_of = b.column(b.schema.get_field_index("turns")).to_pylist()
            known = code.bodies({t["text"] for turns in turns_of for t in turns})
            for conv, turns, keys, counts in zip(b.column(0).to_pylist(), turns_of, *(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("keys", "counts")), strict=True):
                path, position, ids, size, loss = b"", 0, [], 0, []
                for k, t in enumerate(turns):
                    new, lo, hi = code.framed(t["role"], known[t["text"]])
                    if t["role"] == "assistant" and hi > lo:
                        loss.append({"start": size + lo, "end": size + hi})
                    ids += new
                    size += sum(map(len, new))
                    last = k + 1 == len(turns)
                    if last or counts[k + 1]["n"] != counts[k]["n"]:
                        path += keys[k][:8]
                        mine = counts[k]["mine"]
                        rows.append((conv, last, len(turns), path, position, size, loss if mine else None))
                        flat += ids if mine else []
                        lengths.append(size if mine else 0)
                        position, ids, size, loss = position + size, [], 0, []
            cols = [pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * 7, [b.schema.field("conv_id").type, pa.bool_(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), spans], strict=True)]
            ends = pa.array(np.cumsum([0, *lengths]).astype(np.int32))
            tokens = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(flat)), mask=cols[6].is_null())
            yield pa.RecordBatch.from_arrays([*cols[:6], tokens, cols[6]], names=names)

    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    names = ["conv_id", "last", "n_turns", "path", "position", "size", "ids", "loss"]
    every = staged(named.join(counted, "owner").select("conv_id", "turns", "keys", "counts").mapInArrow(cut, f"conv_id {kind['conv_id']}, last boolean, n_turns long, path binary, position long, size long, ids array<int>, loss array<struct<start:bigint,end:bigint>>"), "tree-rows")
    release(named)
    members = every.where("last").select("conv_id", F.col("path").alias("node"), "n_turns")

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Places inside the task, and the task."""
        at, task = 0, TaskContext.get().partitionId()
        for b in batches:
            ends = at + np.cumsum(b.column(2).to_numpy())
            starts, at = ends - b.column(2).to_numpy(), int(ends[-1]) if len(ends) else at
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(starts, pa.int64()), pa.array(np.full(len(starts), task, np.int32))], names=["node", "position", "size", "ids", "loss", "local", "task"])

    own = every.where("ids is not null").select(F.col("path").alias("node"), "position", "size", "ids", "loss")
    laid = staged(own.repartitionByRange("node").sortWithinPartitions("node").mapInArrow(lay, "node binary, position long, size long, ids array<int>, loss array<struct<start:bigint,end:bigint>>, local long, task int"), "tree-order")
    base, bases = 0, []
    for r in laid.groupBy("task").agg(F.sum("size").alias("n")).orderBy("task").collect():
        bases.append((r["task"], base))
        base += r["n"]
    base_of = laid.sparkSession.createDataFrame(bases, "task int, base long")
    begin = F.col("base") + F.col("local")
    placed = staged(laid.join(F.broadcast(base_of), "task").select("node", begin.alias("start"), (begin + F.col("size")).alias("end")), "tree-places")
    depth = F.octet_length("node") / 8
    up = placed.where(depth > 1).select("node", F.explode(F.sequence(F.lit(1), (depth - 1).cast("int"))).alias("d")).select("node", F.substring(F.col("node"), F.lit(1), (F.col("d") * 8).cast("int")).alias("ancestor"))
    intervals = up.join(placed.select(F.col("node").alias("ancestor"), "start", "end"), "ancestor").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("ancestors"))
    places = placed.join(intervals, "node", "left").select("node", "start", "end", F.coalesce("ancestors", F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("ancestors"))
    nodes = staged(laid.join(places, "node").select("node", "start", "end", "position", "ids", "loss", "ancestors"), "tree")
    release(laid, placed)
    return nodes, members


def read_back(nodes: DataFrame, members: DataFrame, tokenizer: str) -> DataFrame:
    """Each conversation from the tree: its last node's attention intervals, then that node, joined to their tokens.

    Returns conv_id, n_turns, formatted (text with markers), roles, texts (unescaped), loss_text (all text
    under the loss mask, unescaped). The join on a node that many conversations share is split by adaptive
    execution; what is gathered is one conversation.
    """
    leaf = members.join(nodes.select("node", "start", "end", "ancestors"), "node")
    wanted = leaf.select("conv_id", "n_turns", F.explode(F.concat(F.col("ancestors.start"), F.array("start"))).alias("start"))
    parts = wanted.join(nodes.select("start", "ids", "loss"), "start")
    whole = parts.groupBy("conv_id", "n_turns").agg(F.array_sort(F.collect_list(F.struct("start", "ids", "loss"))).alias("parts"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(tokenizer)
        for b in few_rows(batches, 500):
            parts = b.column(2).flatten()
            tokens, spans = parts.field("ids"), parts.field("loss").to_pylist()
            ids = tokens.flatten().to_numpy()
            part_at = np.cumsum([0, *pc.list_value_length(tokens).to_pylist()])
            row_at = np.cumsum([0, *pc.list_value_length(b.column(2)).to_pylist()])
            masked = [(int(part_at[k]) + s["start"], int(part_at[k]) + s["end"]) for k, own in enumerate(spans) for s in own]
            cuts = [x for s in masked for x in s]
            begins, texts = code.texts(ids, np.array([*cuts, *part_at[row_at]], dtype=np.int64))
            first = np.searchsorted(begins, part_at[row_at])
            under = np.searchsorted(begins, np.array(cuts, dtype=np.int64).reshape(-1, 2))
            owner = np.searchsorted(part_at[row_at], [s for s, _ in masked], side="right") - 1
            loss = [""] * b.num_rows
            for row, (lo, hi) in zip(owner.tolist(), under.tolist(), strict=True):
                loss[row] += unescape("".join(texts[lo:hi]))
            rows = []
            for k in range(b.num_rows):
                text = "".join(texts[first[k] : first[k + 1]])
                turns = [t.split("\n", 1) for t in _TURN.findall(text)]
                rows.append((text, [unescape(r) for r, _ in turns], [unescape(t) for _, t in turns], loss[k]))
            cols = list(zip(*rows, strict=True)) or [()] * 4
            kinds = (pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=["conv_id", "n_turns", "formatted", "roles", "texts", "loss_text"])

    return whole.mapInArrow(parse, f"conv_id {dict(members.dtypes)['conv_id']}, n_turns long, formatted string, roles array<string>, texts array<string>, loss_text string")
