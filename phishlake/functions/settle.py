"""Keep long column expressions from being repeated by the optimizer.

A filter (also one inferred from a join key or an explode) is pushed below the
projections it looks through, with every column replaced by its expression. For
columns built in many steps that copies large expressions, slows planning and
evaluates them twice. Columns that come out of a one-row ``inline`` are plain
attributes to everything above, so such filters stop there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def settled(df: DataFrame, names: list[str]) -> DataFrame:
    """Same rows and columns; ``names`` become outputs of a generator."""
    rest = [c for c in df.columns if c not in names]
    once = F.inline_outer(F.array(F.struct(*[F.col(n).alias(n) for n in names])))
    return df.select(*rest, once).select(*df.columns)
