"""Toxicity by weak supervision: many voters, a label model over their votes, a linear classifier on its labels."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.llm.labelled import class_share, training_sample
from keepsake.llm.staging import staged

_NOT_LETTERS = re.compile(r"[\W\d_]+")
#: Lengths of word beginnings that may become lexicon voters, besides whole words.
STEMS = (3, 4, 5, 6, 7)
#: Pattern voters, after the lexicon: hits repeated, of several terms, dense, shouted; and one that votes "clean".
PATTERNS = ("twice", "thrice", "two_terms", "three_terms", "dense", "shouted", "silent")


def plain(text: str | None) -> str:
    """Lower-case letters with single spaces between words and at both ends."""
    return f" {_NOT_LETTERS.sub(' ', (text or '').lower()).strip()} "


def terms_of(text: str | None) -> set[str]:
    """Candidate terms: each word's beginnings (after a space) and the whole word (between spaces)."""
    found: set[str] = set()
    for w in set(plain(text).split()):
        found.update(f" {w[:n]}" for n in STEMS if len(w) >= n)
        if len(w) < 24:
            found.add(f" {w} ")
    return found


def signature(text: str | None, width: int = 4) -> int:
    """The least hash of the text's shingles of words: copies and most near copies agree on it, others hardly."""
    words = plain(text).split()
    return min((zlib.crc32(" ".join(words[i : i + width]).encode()) for i in range(max(1, len(words) - width + 1))), default=0)


class Voters:
    """Counts of every term in a text in one pass of an automaton; the automaton is built where it is used."""

    def __init__(self, terms: list[str]) -> None:
        self.terms, self._found = terms, None

    def __getstate__(self) -> dict:
        return {"terms": self.terms, "_found": None}

    def counts(self, text: str | None) -> tuple[np.ndarray, int, bool]:
        """(hits of each term, words, whether a hit is in capitals)."""
        if self._found is None:
            self._found = ahocorasick.Automaton()
            for k, term in enumerate(self.terms):
                self._found.add_word(term, k)
            self._found.make_automaton()
        hits, clean = np.zeros(len(self.terms), dtype=np.int32), plain(text)
        last = ""
        for end, k in self._found.iter(clean) if self.terms else ():
            hits[k] += 1
            last = last or clean[end - len(self.terms[k]) + 1 : end + 1].strip()
        return hits, clean.count(" ") - 1 if clean.strip() else 0, bool(last) and last.upper() in (text or "")

    def features(self, texts: list[str | None]) -> np.ndarray:
        """Votes of all terms and patterns (0/1), then log hits, log distinct terms and hits a word."""
        k = len(self.terms)
        out = np.zeros((len(texts), k + len(PATTERNS) + 3), dtype=np.float32)
        for row, text in zip(out, texts, strict=True):
            hits, words, shouted = self.counts(text)
            total, distinct = int(hits.sum()), int((hits > 0).sum())
            row[:k] = hits > 0
            row[k : k + len(PATTERNS)] = hits.max(initial=0) >= 2, hits.max(initial=0) >= 3, distinct >= 2, distinct >= 3, total >= 0.02 * max(words, 1) and total > 0, shouted, total == 0
            row[k + len(PATTERNS) :] = np.log1p(total), np.log1p(distinct), total / max(words, 1)
        return out


@dataclass
class LabelModel:
    """What the label model found: chance that a voter speaks in either class, and its weight for correlation."""

    in_toxic: np.ndarray
    in_clean: np.ndarray
    correlation: np.ndarray
    discount: np.ndarray
    posterior: np.ndarray


def fit_label_model(votes: np.ndarray, prior: float, start: np.ndarray, rounds: int = 30) -> LabelModel:
    """Expectation-maximisation over 0/1 votes of conditionally dependent voters.

    Each voter has a rate of speaking in toxic and in clean documents. Pairs that still agree once the class
    is known (nested terms, repeated patterns) are correlated; a voter's evidence is divided by one plus the
    sum of its correlations, so a block of copies of one voter counts about once.
    """
    n, k = votes.shape
    q, prior = start.astype(np.float64), min(max(prior, 1e-3), 0.5)
    corr, discount = np.eye(k), np.ones(k)
    a = b = np.full(k, 0.5)
    for _ in range(rounds):
        a = (q @ votes + 0.05) / (q.sum() + 0.1)
        b = ((1 - q) @ votes + 0.05) / ((1 - q).sum() + 1.0)
        res = votes - np.outer(q, a) - np.outer(1 - q, b)
        cov = res.T @ res / max(n, 1)
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        corr = cov / np.outer(sd, sd)
        discount = 1 / (1 + np.maximum(np.where(np.eye(k) > 0, 0, corr) - 0.1, 0).sum(axis=1))
        speak, silent = np.log(a / b), np.log((1 - a) / (1 - b))
        odds = np.log(prior / (1 - prior)) + (votes * speak + (1 - votes) * silent) @ discount
        new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        if np.abs(new - q).max(initial=0) < 1e-6:
            break
        q = new
    return LabelModel(a, b, corr, discount, q)


def fit_linear(x: np.ndarray, q: np.ndarray, weight: np.ndarray, l2: float = 0.02, rounds: int = 25) -> np.ndarray:
    """Logistic regression on soft labels by Newton steps; the last coefficient is the intercept."""
    x1 = np.hstack([x, np.ones((len(x), 1))]).astype(np.float64)
    w, weight = np.zeros(x1.shape[1]), weight / max(weight.sum(), 1e-9)
    ridge = np.full(len(w), l2 / 10)
    ridge[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        grad = x1.T @ (weight * (p - q)) + ridge * w
        step = np.linalg.solve((x1 * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x1 + np.diag(ridge), grad)
        w -= step * min(1.0, 4 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-5:
            break
    return w


def mine_terms(sample: DataFrame, clean_weight: float, voters: int, least: int = 6) -> list[str]:
    """The terms that speak for the label in the sample: count them in Spark, bring the best few hundred here.

    A term needs ``least`` toxic documents and a (reweighted) precision of 0.8. Copies of a document would
    make all its words look telling, so of documents that agree on their signature one counts: the least by
    label, id and text, whatever the order of the rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, pos = Counter(), Counter()
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = terms_of(text)
                n.update(found)
                if y:
                    pos.update(found)
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([pos[t] for t in n], pa.int64())], names=["term", "n", "pos"])

    one_each = sample.groupBy("signature").agg(F.min(F.struct("y", "doc_id", "text")).alias("m")).select("m.text", "m.y")
    counts = one_each.mapInArrow(run, "term string, n long, pos long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    clean = (F.col("n") - F.col("pos")) * clean_weight
    best = counts.where((F.col("pos") >= least) & (F.col("pos") / (F.col("pos") + clean + 0.5) >= 0.8)).orderBy(F.desc("pos"), "term").limit(8 * voters).collect()
    # of terms inside each other with the same documents, the shorter says it all
    chosen: dict[str, int] = {}
    for r in sorted(best, key=lambda r: (-r["pos"], len(r["term"]), r["term"])):
        if len(chosen) < voters and not any(r["term"].startswith(t) and r["pos"] >= 0.98 * pos for t, pos in chosen.items()):
            chosen[r["term"]] = r["pos"]
    return list(chosen)


def score_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = 6_000, voters: int = 160, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and ``score`` (0 to 1, higher: more likely toxic) for every document, over whole texts.

    Fitting sees at most ``per_class`` labelled documents of each class, none of them held out: their ids are
    broadcast, their texts stay in the shared folder, and only their votes and three counts as floats come to
    the driver. Neither the order of the rows nor how they are dealt to tasks changes a score. Null and empty
    texts have no hit and are scored as such. Repeated rows are all kept and scored alike; without usable
    labels there are no voters and all texts score alike. Scoring is one pass without a shuffle.
    """
    ids = training_sample(labels, label, per_class)
    small = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([signature(t) for t in b.column(1).to_pylist()], pa.int64())], names=["doc_id", "text", "y", "signature"])

    sample = staged(small.select("doc_id", "text", "y").mapInArrow(sign, f"doc_id {dict(small.dtypes)['doc_id']}, text string, y int, signature long"), "toxicity")
    share = class_share(labels, label) or 0.1
    sizes = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    clean_weight = (1 - share) / share * sizes.get(1, 0) / max(sizes.get(0, 0), 1)
    found = Voters(mine_terms(sample, clean_weight, voters))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = found.features(b.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array([r.tobytes() for r in x], pa.binary())], names=["y", "signature", "x"])

    got = sample.select("text", "y", "signature").mapInArrow(vote, "y int, signature long, x binary").collect()
    got.sort(key=lambda r: (r["signature"], r["y"], bytes(r["x"])))  # sums then don't depend on how rows were dealt
    width = len(found.terms) + len(PATTERNS) + 3
    x = np.frombuffer(b"".join(bytes(r["x"]) for r in got), dtype=np.float32).reshape(-1, width)
    y = np.array([r["y"] for r in got], dtype=np.float64)
    coef = np.zeros(width + 1)
    if len(found.terms) and len(y):
        votes = x[:, : -3].astype(np.float64)
        prior = y.mean()
        start = np.clip(votes[:, : len(found.terms)].sum(axis=1) * 0.4 + 0.05, 0, 0.95)
        model = fit_label_model(votes, prior, start)
        coef = fit_linear(x, model.posterior, np.where(y == 1, 1.0, clean_weight if clean_weight > 0 else 1.0))
    else:
        coef[-1] = np.log(share / (1 - share)) if 0 < share < 1 else 0.0

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = found.features(b.column(len(keep)).to_pylist()) @ coef[:-1] + coef[-1]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))), pa.float64())], names=[*keep, "score"])

    every = docs.select(*keep, F.col("text").alias("_text"))
    return every.mapInArrow(score, ", ".join(f"`{c}` {t}" for c, t in every.dtypes[:-1]) + ", score double")
