"""Seeded randomness as a keyed hash of identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unit_hash(seed, *keys) -> Column:
    """Uniform value in [0, 1) decided by ``seed`` and the key columns only."""
    parts = [seed if isinstance(seed, Column) else F.lit(str(seed))]
    parts += [k if isinstance(k, Column) else F.col(k) for k in keys]
    text = F.concat_ws(":", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
