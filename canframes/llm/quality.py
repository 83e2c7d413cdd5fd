"""Quality rules: whole-text counts, two fixed base limits, and a hashed word and character
n-gram logistic regression trained on labelled rows, calibrated, scored in Arrow batches
against a fixed probability threshold.

Bounds: the model is fitted on at most ``per_class`` labelled documents of each class (see
:func:`canframes.llm.linear.bounded_sample`); every fifth of them, by hash, is held out of
the fit and calibrates the probability (Platt), weighted back to the class shares of the
labels. Counts and scores cover whole texts."""

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canframes.llm.common import Shared, bounded_batches, map_batches
from canframes.llm.linear import Sample, bounded_sample, char_slots, fit_logistic, margins, platt, word_slots

DIMS = 1 << 16
SYMBOLS = b"#*$%&|<>"  # fixed by the rules
MIN_WORDS = 50
PER_CLASS = 800
MIN_PROBABILITY = 0.3


def feature_blocks(text: str | None) -> list[np.ndarray]:
    raw = (text or "").encode("utf-8")
    return [char_slots(raw, n, DIMS) for n in (2, 3, 4)] + word_slots(raw.split(), DIMS)


def base_counts(text: str | None) -> dict:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    raw = (text or "").encode("utf-8")
    words = raw.split()  # bytes split at exactly space and \\x09-\\x0D
    seen, dup_lines = set(), 0
    for line in raw.split(b"\n"):
        if line in seen:
            dup_lines += bool(line.split())
        else:
            seen.add(line)
    chars = len(b"".join(words).decode("utf-8", "replace"))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    return {"n_words": len(words), "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup_lines, "n_repeat_words": _repeat_words(words)}


def _repeat_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more in the text."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=n)
    _, pair = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)
    _, window, count = np.unique(pair[:-1].astype(np.int64) * len(number) + ids[2:], return_inverse=True, return_counts=True)
    twice = count[window] > 1
    inside = np.zeros(n, dtype=bool)
    for k in range(3):
        inside[k : n - 2 + k] |= twice
    return int(inside.sum())


@dataclass
class QualityModel:
    """Weights, bias and Platt calibration; ``weights`` None: nothing to learn from."""

    weights: np.ndarray | None
    bias: float = 0.0
    a: float = 1.0
    b: float = 0.0

    def probability(self, text: str | None) -> float:
        if self.weights is None:
            return 1.0
        m = margins(feature_blocks(text), self.weights[None, :], np.array([self.bias]))[0]
        return float(1 / (1 + np.exp(-np.clip(self.a * m + self.b, -30, 30))))


def fit_quality(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> QualityModel:
    """Fit on the rows of ``docs`` named by ``labels`` (doc_id, quality 0/1; repeated ids
    count once, the lower label wins). Without rows of both classes the model keeps all."""
    lab = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
    lab = lab.filter("label IN (0, 1)").groupBy("doc_id").agg(F.min("label").alias("label"))
    shares = {r["label"]: r["count"] for r in lab.groupBy("label").count().collect()}
    s = bounded_sample(docs, lab, per_class, feature_blocks, DIMS)
    return fit_on(s, shares)


def fit_on(s: Sample, shares: dict[int, int]) -> QualityModel:
    y = np.array([1 if x == "1" else -1 for x in s.labels])
    train, held = s.fold != 0, s.fold == 0
    if len(set(y[train].tolist())) < 2:
        return QualityModel(None)
    w, bias = fit_logistic(s.part(train), y[train])
    if len(set(y[held].tolist())) < 2:
        held = np.ones(len(y), dtype=bool)
    m = s.part(held).dot(w) + bias
    yh = y[held]
    weight = np.where(yh > 0, shares.get(1, 1) / max(1, (yh > 0).sum()), shares.get(0, 1) / max(1, (yh <= 0).sum()))
    a, b = platt(m, yh, weight / weight.sum())
    return QualityModel(w.astype(np.float32), bias, a, b)


def apply_quality(docs: DataFrame, model: QualityModel, min_probability: float = MIN_PROBABILITY) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words,
    word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, probability, kept.

    Defined cases: a null text counts as no words (base_failed); a null doc_id stays null;
    repeated rows give repeated results; an empty table gives no rows; other columns of
    ``docs`` are not looked at."""
    shared = Shared(docs.sparkSession, model)

    def run(rows):
        m = shared.value
        for r in rows:
            c = base_counts(r["text"])
            failed = c["n_words"] < MIN_WORDS or 100 * c["n_repeat_words"] > 50 * c["n_words"]
            p = m.probability(r["text"])
            yield {"doc_id": r["doc_id"], **c, "base_failed": failed, "probability": p, "kept": not failed and p >= min_probability}

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, probability double, kept boolean"
    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), schema, run, ["doc_id", "text"])


def keep_good(docs: DataFrame, model: QualityModel, min_probability: float = MIN_PROBABILITY) -> DataFrame:
    """The rows of ``docs`` (all its columns) that the rules keep; no shuffle."""
    bounded_batches(docs.sparkSession)
    shared = Shared(docs.sparkSession, model)

    @F.pandas_udf("boolean")
    def kept(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            c = base_counts(t)
            failed = c["n_words"] < MIN_WORDS or 100 * c["n_repeat_words"] > 50 * c["n_words"]
            out.append(not failed and shared.value.probability(t) >= min_probability)
        return pd.Series(out, dtype=bool)

    return docs.filter(kept(F.col("text")))
