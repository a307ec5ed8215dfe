"""Quality classifier: histogram gradient-boosted trees over statistics of a document's text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.llm.labelled import class_share, training_sample
from keepsake.llm.staging import staged

FEATURES = (
    "log_words", "log_bytes", "word_bytes", "word_bytes_sd", "long_words", "lines_per_word", "unique_words", "repeats", "upper", "lower",
    "digit", "space", "other_ascii", "beyond_ascii", "exclaim", "pipe", "marks", "stops", "commas", "upper_words", "title_words", "top_byte",
)
#: Byte classes whose shares of the text are features.
_CLASSES = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": (9, 10, 11, 12, 13, 32),
    "other_ascii": [c for c in range(33, 127) if not chr(c).isalnum()], "beyond_ascii": range(128, 256),
    "exclaim": b"!?", "pipe": b"|", "marks": b"#$%&*@~^+=<>{}[]\\/_", "stops": b".;:", "commas": b",",
}
_SHARES = np.zeros((256, len(_CLASSES)))
for _k, _codes in enumerate(_CLASSES.values()):
    _SHARES[list(_codes), _k] = 1


def text_features(text: str | None) -> np.ndarray:
    """The statistics named in FEATURES, over the whole text; null and empty texts give zeros."""
    out = np.zeros(len(FEATURES), dtype=np.float32)
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return out
    n, sizes = len(words), np.fromiter(map(len, words), dtype=np.int64)
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    share = dict(zip(_CLASSES, counts @ _SHARES / len(raw), strict=True))
    out[:8] = np.log1p(n), np.log1p(len(raw)), sizes.mean(), sizes.std(), (sizes > 15).mean(), counts[10] / n, len(set(words)) / n, sum(map(eq, words, words[1:])) / n
    out[8:19] = [share[k] for k in ("upper", "lower", "digit", "space", "other_ascii", "beyond_ascii", "exclaim", "pipe", "marks", "stops", "commas")]
    out[19:] = sum(map(bytes.isupper, words)) / n, sum(map(bytes.istitle, words)) / n, counts.max() / len(raw)
    return out


@dataclass
class Trees:
    """Boosted trees as arrays: row t has tree t's inner nodes in level order, node i's children are 2i+1 and 2i+2."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row: all rows go down all trees together, a level at a time."""
        trees, inner = self.feature.shape
        at = np.zeros((len(x), trees), dtype=np.int64)
        t, rows = np.arange(trees)[None, :], np.arange(len(x))[:, None]
        for _ in range((inner + 1).bit_length() - 1):
            at = 2 * at + 1 + (x[rows, self.feature[t, at]] > self.threshold[t, at])
        return 1 / (1 + np.exp(-(self.base + self.leaf[t, at - inner].sum(axis=1))))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, least: int = 20, l2: float = 1.0, weight: np.ndarray | None = None) -> Trees:
    """Histogram gradient boosting of the log loss with second-order gains.

    Features are cut at quantiles into ``bins`` codes; each level sums gradients by (node, feature, code)
    and takes the best cut of every node. A node without an admissible cut sends all rows left.
    """
    n, f = x.shape
    weight = np.ones(n) if weight is None else weight
    inner = 2**depth - 1
    mean = min(max(np.average(y, weights=weight), 1e-3), 1 - 1e-3) if n else 0.5
    model = Trees(np.zeros((trees, inner), dtype=np.int64), np.full((trees, inner), np.inf, dtype=np.float32), np.zeros((trees, inner + 1)), float(np.log(mean / (1 - mean))))
    if not n or y.min() == y.max():
        return model
    cuts = np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], axis=0).astype(np.float32)
    codes = np.stack([np.searchsorted(cuts[:, j], x[:, j], side="left") for j in range(f)], axis=1)
    margin = np.full(n, model.base)
    cell = np.arange(f)[None, :] * bins + codes
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = weight * (y - p), weight * p * (1 - p)
        at = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first, nodes = 2**level - 1, 2**level
            where = ((at - first)[:, None] * (f * bins) + cell).ravel()
            sums = [np.bincount(where, np.repeat(v, f), nodes * f * bins).reshape(nodes, f, bins).cumsum(axis=2) for v in (g, h, np.ones(n))]
            (gl, hl, nl), (ga, ha, na) = sums, [s[:, :, -1:] for s in sums]
            gain = gl**2 / (hl + l2) + (ga - gl) ** 2 / (ha - hl + l2) - ga**2 / (ha + l2)
            gain[(nl < least) | (na - nl < least)] = 0
            best = gain[:, :, :-1].reshape(nodes, -1).argmax(axis=1)
            split = np.take_along_axis(gain[:, :, :-1].reshape(nodes, -1), best[:, None], 1)[:, 0] > 1e-6
            feat, code = best // (bins - 1), best % (bins - 1)
            model.feature[t, first : first + nodes] = feat
            model.threshold[t, first : first + nodes] = np.where(split, cuts[code, feat], np.inf)
            own = at - first
            at = 2 * at + 1 + (x[np.arange(n), feat[own]] > model.threshold[t, at])
        end = at - inner
        model.leaf[t] = rate * np.bincount(end, g, inner + 1) / (np.bincount(end, h, inner + 1) + l2)
        margin += model.leaf[t, end]
    return model


def feature_table(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and an array column ``features``, one row for each document, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [text_features(t) for t in b.column(len(keep)).to_pylist()]
            flat = np.concatenate(x) if x else np.zeros(0, dtype=np.float32)
            arrays = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(FEATURES), pa.int32()), pa.array(flat, pa.float32()))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], arrays], names=[*keep, "features"])

    small = docs.select(*keep, F.col(text).alias("_text"))
    return small.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in small.dtypes[:-1]) + ", features array<float>")


def fit_quality(table: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = 10_000) -> Trees:
    """Trees from at most ``per_class`` labelled rows of each class, none of them held out.

    Only the sample's ids are broadcast and only its features come to the driver: at most 2 x ``per_class``
    rows of 22 floats. Classes are weighted back to their shares among all labelled rows that are not held out.
    """
    sample = training_sample(labels, label, per_class)
    rows = table.join(F.broadcast(sample), "doc_id").select("doc_id", "y", "features").toPandas().sort_values("doc_id", kind="stable")
    y = rows["y"].to_numpy(dtype=np.float64)
    x = np.stack(rows["features"].to_numpy()).astype(np.float32) if len(rows) else np.zeros((0, len(FEATURES)), np.float32)
    totals = class_share(labels, label)
    weight = np.ones(len(y))
    if len(y) and 0 < y.mean() < 1 and totals:
        weight = np.where(y == 1, totals / y.mean(), (1 - totals) / (1 - y.mean()))
    return fit_trees(x, y, weight=weight)


def filter_quality(docs: DataFrame, labels: DataFrame, least: float = 0.3, per_class: int = 10_000) -> DataFrame:
    """The rows of ``docs``, unchanged, whose score is at least ``least``; one pass after fitting, no shuffle.

    Only the sample's documents are read for the fit. Rows with null or empty texts are scored as such.
    """
    sample = training_sample(labels, "quality", per_class)
    model = fit_quality(feature_table(docs.join(F.broadcast(sample.select("doc_id")), "doc_id", "left_semi")), labels, per_class=per_class)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.predict(np.stack([text_features(t) for t in texts])) if len(texts) else np.zeros(0))

    return docs.where(score(F.coalesce("text", F.lit(""))) >= least)


def score_quality(docs: DataFrame, labels: DataFrame, per_class: int = 10_000, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and ``score`` (0 to 1, higher: more likely of quality) for every document, over whole texts.

    Null and empty texts are scored by their zero statistics. Repeated rows are all kept and scored alike;
    without usable labels every score is one half. ``keep`` must hold doc_id. The statistics are computed
    once and written to the shared folder; nothing but the bounded sample leaves the executors.
    """
    written = staged(feature_table(docs, keep=keep), "quality")
    model = fit_quality(written, labels, per_class=per_class)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(len(keep)).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(model.predict(x))], names=[*keep, "score"])

    return written.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in written.dtypes[:-1]) + ", score double")
