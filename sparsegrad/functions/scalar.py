"""Scalar column expressions of the learners (JVM-side, no Python UDF).

Every function takes and returns ``Column`` objects so Catalyst can fold,
push and codegen them together with the surrounding projection."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    if isinstance(x, Column):
        return x
    if isinstance(x, str):
        return F.col(x)
    return F.lit(x)


def sigmoid(z) -> Column:
    """1 / (1 + e^-z)."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(z)))


def logistic_complement(z) -> Column:
    """g(z) = 1 / (1 + e^z). e^z overflows to +inf for large z, giving 0."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(_c(z)))


def gd_coefficient(y, score) -> Column:
    """Batch-gradient coefficient (sigma(y * score) - 1) * y."""
    y = _c(y)
    return (sigmoid(y * _c(score)) - F.lit(1.0)) * y


def primal_coefficient(y, score, scale=1.0) -> Column:
    """Primal coefficient y * g(y * score) / scale."""
    y = _c(y)
    coef = y * logistic_complement(y * _c(score))
    if isinstance(scale, (int, float)) and scale == 1.0:
        return coef
    return coef / _c(scale)


def clip(s, c) -> Column:
    """Symmetric clip of s to [-c, c]."""
    c = _c(c)
    return F.greatest(F.least(_c(s), c), -c)


def dual_factor(s, eta) -> Column:
    """Multiplicative dual factor 1 - eta*s + (eta*s)^2 (always >= 0.75)."""
    es = _c(eta) * _c(s)
    return F.lit(1.0) - es + es * es


def dual_estimate(x_j, norm_sq, w_j, b, y) -> Column:
    """Sampled score estimate x_j * |w|^2 / w_j + b*y.

    The feature term is dropped when w_j is 0 (only possible when |w| = 0,
    since a sampled feature always has a non-zero weight): the reference
    would produce 0/0 there."""
    w_j = _c(w_j)
    term = F.when(w_j != 0, _c(x_j) * _c(norm_sq) / w_j).otherwise(F.lit(0.0))
    return term + _c(b) * _c(y)


def sign(x) -> Column:
    """-1, 0 or 1 as a double."""
    return F.signum(_c(x))


def seeded_uniform(seed, key) -> Column:
    """Deterministic uniform in [0, 1) from (seed, key): the top 52 bits of
    md5('seed:key'). Independent of partitioning, unlike ``rand``; the same
    value is computable in any SQL engine with md5."""
    hexits = F.substring(F.md5(F.concat_ws(":", _c(seed).cast("string"),
                                           _c(key).cast("string"))), 1, 13)
    return F.conv(hexits, 16, 10).cast("double") / F.lit(float(2 ** 52))


def seeded_text(key: Column) -> Column:
    """The part of the text hashed by ``seeded_uniform`` that follows the seed."""
    return F.coalesce(F.concat(F.lit(":"), key.cast("string")), F.lit(""))


def hash_bound(u: Column) -> Column:
    """Text that the md5 in hex of no ``seeded_uniform`` up to ``u`` exceeds ('g'
    sorts after every hex digit); a little above ``u``, never below."""
    top = F.floor((u * (1 + 1e-9) + 2.0 ** -40) * F.lit(float(2 ** 52))).cast("bigint")
    return F.when(u < 0.999, F.concat(F.lpad(F.lower(F.hex(top)), 13, "0"), F.lit("g"))).otherwise(F.lit("g"))


def dense_dot(w, x) -> Column:
    """Dense dot product of two equally long double arrays."""
    return F.aggregate(F.zip_with(_c(w), _c(x), lambda a, b: a * b),
                       F.lit(0.0), lambda acc, v: acc + v)


def shifted_dense_score(w, x) -> Column:
    """Score of the two-dimensional trainer: w.x - w[1] - w[2]."""
    w = _c(w)
    return dense_dot(w, x) - w[0] - w[1]


def first_feature_value(features, j) -> Column:
    """Value of feature ``j`` in a sparse row; the first match wins (file
    order), 0.0 when the row lacks the feature."""
    hit = F.filter(_c(features), lambda f: f["idx"] == _c(j))
    return F.coalesce(F.get(hit, 0)["val"], F.lit(0.0))
