"""Vector expressions over array<double>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse(x: Column) -> Column:
    """JSON text -> vector; anything that is no list of numbers gives the empty vector."""
    return F.coalesce(F.from_json(x, "array<double>"), F.array().cast("array<double>"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 for missing, empty, zero or unequally long vectors."""
    usable = (F.size(a) > 0) & (F.size(a) == F.size(b)) & (norm(a) > 0) & (norm(b) > 0)
    return F.when(usable, dot(a, b) / (norm(a) * norm(b))).otherwise(0.0)


def unit(a: Column) -> Column:
    """The vector at length 1; a zero vector stays."""

    def divided(n: Column) -> Column:
        return F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))

    return F.element_at(F.transform(F.array(norm(a)), divided), 1)  # the norm is taken once, not for every component


def on_unit(q: Column, v: Column) -> Column:
    """Scalar product of q, at length 1, and v brought to length 1; 0 for a zero vector."""
    return F.element_at(F.transform(F.array(norm(v)), lambda n: F.when(n > 0, dot(q, v) / n).otherwise(0.0)), 1)
