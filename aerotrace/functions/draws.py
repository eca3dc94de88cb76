"""Seeded uniforms from hashes and the triangular draw built on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(v) -> Column:
    return v if isinstance(v, Column) else F.col(v)


def hash_uniforms(seed: int, *parts, count: int = 1) -> list[Column]:
    """Up to six uniforms in [0, 1), in steps of 2^-20, from one digest of the seed and the parts.

    The value depends only on the inputs, never on partitioning or row order.
    """
    if not 1 <= count <= 6:
        raise ValueError("one digest gives at most 6 uniforms")
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[_c(p).cast("string") for p in parts]))
    return [
        F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 10).cast("double") / F.lit(1048576.0)
        for i in range(count)
    ]


def triangular(u, q10, q50, q90) -> Column:
    """Inverse CDF of the triangle over the three quantiles, evaluated at ``u``.

    The bounds are sorted and the mode is clamped between them; a spread under 1e-9 is a point.
    """
    u, q10, q50, q90 = map(_c, (u, q10, q50, q90))
    lo, hi = F.least(q10, q50, q90), F.greatest(q10, q50, q90)
    span, left, right = hi - lo, q50 - lo, hi - q50
    rising = lo + F.sqrt(u * span * left)
    falling = hi - F.sqrt((1 - u) * span * right)
    return F.when(span < 1e-9, q50).when(u * span < left, rising).otherwise(falling)
