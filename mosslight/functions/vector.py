"""Vector measures and the similarity scale."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("cosine", "l2sq", "neg_ip")


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision; vectors of different lengths are an error."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), total).otherwise(F.when(a.isNotNull() & b.isNotNull(), F.raise_error(F.lit("vectors have different lengths")).cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a vector is zero."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.when(a.isNotNull() & b.isNotNull(), 0.0))


def euclidean(a: Column, b: Column) -> Column:
    total = F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(F.when(F.size(a) == F.size(b), total).otherwise(F.raise_error(F.lit("vectors have different lengths")).cast("double")))


def dot_literal(a: Column, b: list[float]) -> Column:
    """Inner product with a known vector, unrolled: stays inside generated code, without lambdas."""
    parts = [F.element_at(a, i + 1).cast("double") * F.lit(float(x)) for i, x in enumerate(b)]
    return functools.reduce(lambda x, y: x + y, parts)


def distance(a: Column, b: Column, metric: str = "cosine") -> Column:
    if metric == "cosine":
        return F.lit(1.0) - cosine(a, b)
    if metric == "l2sq":
        e = euclidean(a, b)
        return e * e
    if metric == "neg_ip":
        return -dot(a, b)
    raise ValueError(f"unknown metric {metric!r}; use one of {', '.join(METRICS)}")


def similarity(d: Column) -> Column:
    """Similarity of a distance: 0.5 where unknown; 1 - d/2 up to 2; 1/(1 + |d|) outside.

    The steps at 0 and 2 are kept as they are: the scale is defined that way.
    """
    known = F.when(d < 0, F.lit(1.0) / (F.lit(1.0) + F.abs(d))).when(d <= 2, F.greatest(F.lit(0.0), F.lit(1.0) - d / 2.0)).otherwise(F.lit(1.0) / (F.lit(1.0) + d))
    return F.when(d.isNull() | F.isnan(d), 0.5).otherwise(known)
