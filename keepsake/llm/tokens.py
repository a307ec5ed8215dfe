"""Token ids of whole texts, by the tokenizers library and a public tokenizer file."""

from __future__ import annotations

import json
import os
import string
from array import array
from collections.abc import Iterator
from functools import lru_cache

from tokenizers import Tokenizer

#: Bytes of text that are encoded in one call: an encoding is some fifty times as large as its text.
CALL_BYTES = 1 << 20
#: Fixed value: a splitting pattern none of whose pieces holds white space.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Separators of str.split() that are no white space to the tokenizer.
_ODD = ("\x1c", "\x1d", "\x1e", "\x1f")
_PLAIN, _MARKS = frozenset(string.ascii_letters + string.digits), string.punctuation


def normalizers(told: dict) -> list[dict]:
    """The normalisers of a tokenizer file in their order: none, one, or a sequence of them."""
    own = told.get("normalizer")
    return own.get("normalizers", [own]) if own else []


def drops_white_space(told: dict) -> bool:
    """Whether a tokenizer file says that a text's ids are its words' ids one after another.

    It does if it only composes, lower-cases and folds white space, keeps the pieces of WORD_PATTERN, merges
    inside pieces, and has no control token that takes white space with it or does not begin with ``<|``.
    """
    normal = [(x["type"], x.get("pattern")) for x in normalizers(told)]
    cuts = (told.get("pre_tokenizer") or {}).get("pretokenizers", [])
    return (
        told["model"]["type"] == "BPE"
        and all(x in (("NFC", None), ("Lowercase", None), ("Replace", {"Regex": r"\s+"})) for x in normal)
        and [x["type"] for x in cuts] == ["Split", "ByteLevel"]
        and (cuts[0]["pattern"], cuts[0]["behavior"], cuts[0]["invert"]) == ({"Regex": WORD_PATTERN}, "Removed", True)
        and not cuts[1]["add_prefix_space"] and not cuts[1].get("use_regex", True)
        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or len(t["content"].split()) != 1 or not t["content"].startswith("<|") for t in told["added_tokens"])
    )


def lower_cases(told: dict) -> bool:
    """Whether a tokenizer file has texts in lower case before it cuts them."""
    return any(x["type"] == "Lowercase" for x in normalizers(told))


class Known(dict):
    """Words and their ids' bytes; a word that is not yet known is learned when it is asked for.

    The last ASCII marks after an ASCII letter or digit are a piece of their own, and a word of ASCII letters
    alone is one, which the library's model merges without the rest of its steps; other words go through the
    library. Beyond ``limit`` words the memory is emptied.
    """

    def __init__(self, whole: Tokenizer, lower: bool, limit: int) -> None:
        super().__init__()
        self._encode, self._merge, self._lower, self._limit = whole.encode_batch_fast, whole.model.tokenize, lower, limit

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self._limit:
            self.clear()
        if word.isascii() and word.isalpha():
            found = array("I", [t.id for t in self._merge(word.lower() if self._lower else word)]).tobytes()
        else:
            core = word.rstrip(_MARKS)
            if core != word and core[-1:] in _PLAIN and "<|" not in word:
                found = self[core] + self[word[len(core) :]]
            else:
                found = array("I", self._encode([word], add_special_tokens=False)[0].ids).tobytes()
        self[word] = found
        return found


class Encoder:
    """Ids of texts as little-endian 32-bit bytes, all of them from the library.

    Where the file allows it, words are encoded once and remembered: texts repeat their words (``Known``). Other
    files' texts are encoded whole.
    """

    def __init__(self, path: str, limit: int = 700_000) -> None:
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self._whole = Tokenizer.from_file(path)
        self._known = Known(self._whole, lower_cases(told), limit) if drops_white_space(told) else None

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        if self._known is None or any(c in t for t in texts for c in _ODD):
            for found in self._whole.encode_batch_fast(texts, add_special_tokens=False):
                yield array("I", found.ids).tobytes()
            return
        for t in texts:
            yield b"".join(map(self._known.__getitem__, t.split()))

    def forget(self) -> None:
        """Empty the memory: a worker lives longer than its task."""
        if self._known is not None:
            self._known.clear()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each file and Python worker."""
    return Encoder(path)


def encode_texts(path: str, texts: list[str | None]) -> Iterator[bytes]:
    """The ids of each whole text (null: empty) as little-endian 32-bit bytes, in order, without special tokens."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end] or "") <= CALL_BYTES):
            size += len(texts[end] or "")
            end += 1
        yield from encoder(path).encode([x or "" for x in texts[at:end]])
        at = end
