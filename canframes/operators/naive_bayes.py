"""Closed-form classifiers fitted with one grouped aggregate each (class-wise counts, sums,
means, variances) and scored with literal column expressions: majority baseline,
Gaussian NB, Complement NB on ordinal bins, Bernoulli NB on binarized bins.

Scores are P(class 1) from the two joint log-likelihoods, computed as a numerically
safe logistic of their difference.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canframes.session import land
from canframes.schema import FEATURES, NB_ALPHA, NB_VAR_SMOOTHING

VAR_SMOOTHING = NB_VAR_SMOOTHING
ALPHA = NB_ALPHA


def prob_from_jll(jll0: Column, jll1: Column) -> Column:
    """P(class 1) = 1 / (1 + exp(jll0 - jll1)) without overflow."""
    d = jll0 - jll1
    e = F.exp(-F.abs(d))
    return F.when(d > 0, e / (F.lit(1.0) + e)).otherwise(F.lit(1.0) / (F.lit(1.0) + e))


@dataclass(frozen=True)
class Majority:
    label: int

    @classmethod
    def fit(cls, train: DataFrame) -> "Majority":
        # most frequent class, ties -> smaller label (two rows come back)
        rows = train.groupBy("label").count().orderBy(F.desc("count"), "label").limit(1).collect()
        return cls(int(rows[0]["label"]))

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("score", F.lit(float(self.label))).withColumn("pred", F.lit(self.label))


def gnb_params(train: DataFrame, features: list[str] | None = None) -> DataFrame:
    """(label, feature, n, prior, mean, var): class means and population variances plus
    eps = 1e-9 * the largest feature variance over all training rows."""
    features = features or FEATURES
    per_class = train.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"mu_{c}") for c in features], *[F.var_pop(c).alias(f"va_{c}") for c in features]
    )
    per_class = land(per_class, "gnb-classes")  # one row per class; the training rows are read once
    rows = per_class.collect()
    total = sum(r["n"] for r in rows)

    def variance(c: str) -> float:
        """Of all rows, from the moments of the classes."""
        mean = sum(r["n"] * r[f"mu_{c}"] for r in rows) / total
        return sum(r["n"] * (r[f"va_{c}"] + (r[f"mu_{c}"] - mean) ** 2) for r in rows) / total

    eps = max(variance(c) for c in features) * VAR_SMOOTHING if rows else 0.0
    stack = ", ".join(f"'{c}', `mu_{c}`, `va_{c}`" for c in features)
    long = per_class.select("label", "n", F.expr(f"stack({len(features)}, {stack}) AS (feature, mean, var0)"))
    return long.select("label", "feature", "n", (F.col("n") / F.lit(float(total))).alias("prior"), "mean", (F.col("var0") + F.lit(eps)).alias("var"))


@dataclass(frozen=True)
class GaussianNB:
    prior: dict[int, float]
    mean: dict[int, dict[str, float]]
    var: dict[int, dict[str, float]]

    @classmethod
    def fit(cls, train: DataFrame, features: list[str] | None = None) -> "GaussianNB":
        rows = gnb_params(train, features).collect()  # classes x features rows
        prior, mean, var = {}, {}, {}
        for r in rows:
            prior[r.label] = r.prior
            mean.setdefault(r.label, {})[r.feature] = r.mean
            var.setdefault(r.label, {})[r.feature] = r.var
        return cls(prior, mean, var)

    def jll(self, c: int) -> Column:
        out = F.lit(math.log(self.prior[c]))
        for f, mu in self.mean[c].items():
            v = self.var[c][f]
            out = out - F.lit(0.5 * math.log(2.0 * math.pi * v)) - F.lit(0.5) * (F.col(f) - F.lit(mu)) * (F.col(f) - F.lit(mu)) / F.lit(v)
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("score", prob_from_jll(self.jll(0), self.jll(1)))


def class_feature_sums(train: DataFrame, cols: list[str], binarize: bool = False) -> DataFrame:
    """(label, n, sum of each column) — or counts of values > 0 with ``binarize``."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for c in cols:
        v = (F.col(c) > 0).cast("long") if binarize else F.col(c).cast("double")
        aggs.append(F.sum(v).cast("double").alias(c))
    return train.groupBy("label").agg(*aggs)


@dataclass(frozen=True)
class ComplementNB:
    """Complement NB (alpha 1, no weight normalization): feature log-probabilities are
    minus the log share of each feature in the complement classes' counts."""

    flp: dict[int, dict[str, float]]

    @classmethod
    def fit(cls, train: DataFrame, cols: list[str]) -> "ComplementNB":
        rows = {r.label: r for r in class_feature_sums(train, cols).collect()}  # one row per class
        flp = {}
        for c in rows:
            comp = {f: sum(rows[o][f] for o in rows) - rows[c][f] + ALPHA for f in cols}
            tot = sum(comp.values())
            flp[c] = {f: -math.log(comp[f] / tot) for f in cols}
        return cls(flp)

    def jll(self, c: int) -> Column:
        out = F.lit(0.0)
        for f, w in self.flp[c].items():
            out = out + F.col(f).cast("double") * F.lit(w)
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("score", prob_from_jll(self.jll(0), self.jll(1)))


@dataclass(frozen=True)
class BernoulliNB:
    """Bernoulli NB on x > 0 (alpha 1 on features; class prior not smoothed)."""

    flp: dict[int, dict[str, float]]
    neg: dict[int, dict[str, float]]
    log_prior: dict[int, float]

    @classmethod
    def fit(cls, train: DataFrame, cols: list[str]) -> "BernoulliNB":
        rows = {r.label: r for r in class_feature_sums(train, cols, binarize=True).collect()}
        total = sum(r.n for r in rows.values())
        flp, neg, prior = {}, {}, {}
        for c, r in rows.items():
            flp[c] = {f: math.log(r[f] + ALPHA) - math.log(r.n + 2 * ALPHA) for f in cols}
            neg[c] = {f: math.log(1.0 - math.exp(flp[c][f])) for f in cols}
            prior[c] = math.log(r.n / total)
        return cls(flp, neg, prior)

    def jll(self, c: int) -> Column:
        out = F.lit(self.log_prior[c] + sum(self.neg[c].values()))
        for f in self.flp[c]:
            out = out + (F.col(f) > 0).cast("double") * F.lit(self.flp[c][f] - self.neg[c][f])
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("score", prob_from_jll(self.jll(0), self.jll(1)))
