"""Quality rules: fixed limits, then gradient-boosted trees over document statistics.

The trees are fitted on a bounded sample of labelled documents (``max_rows``, the
least by hash of the id, broadcast as ids), inside one task. Splits on the
features in ``DECREASING`` may only lower the score as the feature grows. The
fitted trees are flattened into node arrays, and every whole text is measured
and scored where it lies: no shuffle of texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import checked_broadcast, fresh

SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("log_words", "word_length", "symbols", "dup_lines", "repeats", "distinct", "upper", "digits", "punctuation", "non_ascii", "line_words")
#: More of these never makes a document better.
DECREASING = ("symbols", "dup_lines", "repeats")
_DIGITS, _UPPER = b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_PUNCTUATION = b".,;:!?\"'()-"
_HAS_WORD = re.compile(r"[^\x20\x09-\x0D]")


def _repeated_words(words: list[bytes]) -> tuple[int, int]:
    """Words that lie in a 3-word window found twice or more; distinct words."""
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    if len(ids) < 4 or len(seen) == len(ids):
        return 0, len(seen)
    _, pairs = np.unique(ids[:-1] * len(seen) + ids[1:], return_inverse=True)
    _, at, n = np.unique(pairs[:-1].astype(np.int64) * len(seen) + ids[2:], return_inverse=True, return_counts=True)
    hit, covered = n[at] >= 2, np.zeros(len(ids), bool)
    for d in range(3):
        covered[d : len(ids) - 2 + d] |= hit
    return int(covered.sum()), len(seen)


def measure(text: str | None) -> tuple[list[int], list[float]]:
    """The five counts and the features of one whole text."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    word_bytes = sum(map(len, words))
    without = lambda drop: len(raw) - len(raw.translate(None, drop))
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if line in seen:
            dup += 1
        elif _HAS_WORD.search(line):
            seen.add(line)
    n, symbols = len(words), without(SYMBOLS)
    repeats, distinct = _repeated_words(words)
    chars = len(text) - (len(raw) - word_bytes)
    some, size, busy = max(n, 1), max(word_bytes, 1), max(len(seen) + dup, 1)
    features = [np.log1p(n), chars / some, symbols / size, dup / busy, repeats / some, distinct / some, without(_UPPER) / size, without(_DIGITS) / size, without(_PUNCTUATION) / size, (len(raw) - len(text)) / size, n / busy]
    return [n, chars, symbols, dup, repeats], features


def base_failed(counts: np.ndarray, min_words: int = 50, max_repeat_percent: int = 50) -> np.ndarray:
    return (counts[:, 0] < min_words) | (100 * counts[:, 4] > max_repeat_percent * counts[:, 0])


# ------------------------------------------------------------------- boosting


class _Tree:
    """One tree under construction, on binned features."""

    def __init__(self, binned, grad, hess, signs, bins, depth, min_rows, l2):
        self.x, self.g, self.h, self.signs, self.bins = binned, grad, hess, signs, bins
        self.min_rows, self.l2, self.nodes = min_rows, l2, []
        self._grow(np.arange(len(grad)), depth, -np.inf, np.inf)

    def _value(self, g, h, low, high):
        return np.clip(-g / (h + self.l2), low, high)

    def _grow(self, rows: np.ndarray, depth: int, low: float, high: float) -> int:
        at = len(self.nodes)
        g, h = self.g[rows].sum(), self.h[rows].sum()
        self.nodes.append([0, 0, at, at, float(self._value(g, h, low, high))])
        split = self._best(rows, g, h, low, high) if depth and len(rows) >= 2 * self.min_rows else None
        if split is None:
            return at
        f, cut, left_value, right_value = split
        goes_left, middle = self.x[rows, f] <= cut, (left_value + right_value) / 2
        bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[int(self.signs[f])]
        left = self._grow(rows[goes_left], depth - 1, *bounds[0])
        right = self._grow(rows[~goes_left], depth - 1, *bounds[1])
        self.nodes[at][:4] = [f, cut, left, right]
        return at

    def _best(self, rows, g, h, low, high):
        best, found = 1e-6, None
        for f in range(self.x.shape[1]):
            b = self.x[rows, f]
            n = np.bincount(b, minlength=self.bins).cumsum()[:-1]
            gl = np.bincount(b, self.g[rows], self.bins).cumsum()[:-1]
            hl = np.bincount(b, self.h[rows], self.bins).cumsum()[:-1]
            vl, vr = self._value(gl, hl, low, high), self._value(g - gl, h - hl, low, high)
            ok = (n >= self.min_rows) & (len(rows) - n >= self.min_rows) & (self.signs[f] * (vr - vl) >= 0)
            loss = lambda g, h, v: g * v + 0.5 * (h + self.l2) * v * v
            gain = np.where(ok, loss(g, h, self._value(g, h, low, high)) - loss(gl, hl, vl) - loss(g - gl, h - hl, vr), 0)
            if len(gain) and gain.max() > best:
                best, cut = gain.max(), int(gain.argmax())
                found = (f, cut, vl[cut], vr[cut])
        return found


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 64, min_rows: int = 10, l2: float = 1.0) -> dict:
    """Node arrays of boosted trees for log-loss; an empty or one-sided sample gives the prior."""
    signs = np.array([-1 if f in DECREASING else 0 for f in FEATURES])
    rate_of_good = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.75
    start = float(np.log(rate_of_good / (1 - rate_of_good)))
    model = {"start": start, "feature": [0], "threshold": [0.0], "left": [0], "right": [0], "value": [0.0], "roots": [0], "depth": depth}
    if not len(y) or y.min() == y.max():
        return model
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    margin = np.full(len(y), start)
    for k in ("feature", "threshold", "left", "right", "value", "roots"):
        model[k] = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        tree = _Tree(binned, p - y, p * (1 - p), signs, bins + 1, depth, min_rows, l2)
        base = len(model["value"])
        model["roots"].append(base)
        for i, (f, cut, left, right, value) in enumerate(tree.nodes):
            leaf = left == i
            model["feature"].append(f)
            model["threshold"].append(np.inf if leaf else float(edges[f][cut]))
            model["left"].append(base + left)
            model["right"].append(base + right)
            model["value"].append(rate * value if leaf else 0.0)
        margin = raw_score({k: np.asarray(v) for k, v in model.items()}, x)
    return model


def raw_score(model: dict, x: np.ndarray) -> np.ndarray:
    """Margins of all rows at once: each step moves every row one level down every tree."""
    at = np.broadcast_to(np.asarray(model["roots"]), (len(x), len(model["roots"]))).copy()
    feature, threshold, left, right = (np.asarray(model[k]) for k in ("feature", "threshold", "left", "right"))
    rows = np.arange(len(x))[:, None]
    for _ in range(int(model["depth"])):
        at = np.where(x[rows, feature[at]] <= threshold[at], left[at], right[at])
    return float(model["start"]) + np.asarray(model["value"])[at].sum(axis=1)


MODEL = "start double, depth int, feature array<int>, threshold array<double>, left array<int>, right array<int>, value array<double>, roots array<int>"


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", max_rows: int = 20_000) -> dict:
    """Fit on at most ``max_rows`` labelled documents, the least by hash of their id.

    Defined cases: labels without an id or a value, or without a document, are not used;
    of labels that repeat an id the least value counts, of documents that repeat an id the
    one with the least hash of its text, so the fitting task has ``max_rows`` rows at most.
    """
    wanted = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).cast("long").alias("labelled")).agg(F.min(label).cast("int").alias("y"))
    sample = wanted.orderBy(F.xxhash64("labelled"), "labelled").limit(max_rows)
    texts = docs.select(F.col(doc_id).cast("long").alias("labelled"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("copy"), F.col(text).alias("body"))
    rows = texts.join(checked_broadcast(sample, 1 << 18), "labelled").select("labelled", "copy", "y", "body")

    def features(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame({"labelled": pdf["labelled"], "copy": pdf["copy"], "y": pdf["y"], "x": pd.Series([measure(t)[1] for t in pdf["body"]], index=pdf.index, dtype=object)})

    def fit_one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("labelled")
        model = fit(np.array(pdf["x"].tolist(), float), (pdf["y"] > 0).to_numpy(float))
        return pd.DataFrame([model])[[c.split()[0] for c in MODEL.split(", ")]]

    measured = rows.mapInPandas(features, "labelled long, copy long, y int, x array<double>").groupBy("labelled").agg(F.min_by(F.struct("y", "x"), "copy").alias("one"))
    measured = measured.select(F.lit(0).alias("sample"), "labelled", "one.y", "one.x")
    fitted = measured.groupBy("sample").applyInPandas(fit_one, MODEL).first()
    return {k: np.asarray(v) for k, v in fitted.asDict().items()} if fitted else {k: np.asarray(v) for k, v in fit(np.empty((0, len(FEATURES))), np.empty(0)).items()}


JUDGED = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, quality_score double, kept boolean"


def judge(docs: DataFrame, model: dict, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` with the five counts, ``base_failed``, ``quality_score`` and ``kept``.

    ``kept`` is false where the fixed limits fail, else whether the trees give at
    least ``threshold``. Columns of these names are replaced.

    Defined cases: a null or empty text has no words and fails; a text of any length is
    measured whole; without labels, or
    with labels of one kind, the score is the prior and only the limits decide;
    repeated rows are judged alike; a label repeated with other values counts as its
    least; an empty table stays empty.
    """
    @F.pandas_udf(JUDGED)
    def run(texts: pd.Series) -> pd.DataFrame:
        got = [measure(t) for t in texts]
        counts = np.array([c for c, _ in got], np.int64).reshape(-1, len(COUNTS))
        failed = base_failed(counts)
        score = 1 / (1 + np.exp(-raw_score(model, np.array([x for _, x in got], float).reshape(-1, len(FEATURES)))))
        out = pd.DataFrame(counts, columns=list(COUNTS))
        return out.assign(base_failed=failed, quality_score=score, kept=~failed & (score >= threshold))

    names = [c.split()[0] for c in JUDGED.split(", ")]
    held = fresh("judged", docs)
    rest = [c for c in docs.columns if c.lower() not in names]
    return docs.withColumn(held, run(F.col(text))).select(*rest, *(f"{held}.{n}" for n in names))


def keep_good(docs: DataFrame, labels: DataFrame, **limits) -> DataFrame:
    """The documents that the rules keep, with the columns of ``docs``, whatever their names; defined cases as for ``judge`` and ``train``."""
    row = fresh("row", docs)
    packed = docs.select("text", F.struct(*docs.columns).alias(row))
    return judge(packed, train(docs, labels), **limits).where("kept").select(f"{row}.*")
