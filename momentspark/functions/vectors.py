"""Vector expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision, added from left to right."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def readable(v: Column, like: Column | None = None) -> Column:
    """Whether a vector can be scored: there, not empty, every component finite, and as long as `like` if given."""
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & sound & (F.lit(True) if like is None else F.size(v) == F.size(like)), F.lit(False))
