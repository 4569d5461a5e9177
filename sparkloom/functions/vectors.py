"""Vector expressions. All stay in the JVM; vectors are arrays of double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine similarity; 0 for null, empty or unequally long vectors and zero norms. Norms may be given."""
    na, nb = norm_a if norm_a is not None else norm(a), norm_b if norm_b is not None else norm(b)
    usable = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (na > 0) & (nb > 0)
    return F.when(usable, dot(a, b) / (na * nb)).otherwise(F.lit(0.0))


def hotness(last_hit: Column, as_of: Column, alpha: float) -> Column:
    """exp(-alpha x days since the last hit), days at least 0; 0 where the time is missing."""
    days = F.greatest(F.timestamp_diff("MICROSECOND", last_hit, as_of) / F.lit(86_400_000_000.0), F.lit(0.0))
    return F.when(last_hit.isNull(), F.lit(0.0)).otherwise(F.exp(-F.lit(alpha) * days))


def boost(tier: Column, boosts: dict[str, float]) -> Column:
    out = F.lit(1.0)
    for k, v in boosts.items():
        out = F.when(tier == k, F.lit(v)).otherwise(out)
    return out
