"""B2 — flatten nested arrays (LEFT/CROSS JOIN UNNEST equivalents).

``explode_outer`` keeps the parent row (with NULL element) when the array is
NULL or empty — ``LEFT JOIN UNNEST``; ``explode`` drops it — ``CROSS JOIN
UNNEST``.  Both are narrow ``Generate`` operators: no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def flatten(df: DataFrame, path: str | Column, alias: str, outer: bool = True,
            prefix: str | None = None, position: str | None = None) -> DataFrame:
    """Explode ``path`` into one row per element.

    Struct elements are expanded to ``<prefix><field>`` columns when ``prefix`` is
    given, otherwise kept as one struct column ``alias``.  ``position`` names an
    optional 0-based element index column.
    """
    col = F.col(path) if isinstance(path, str) else path
    if position:
        gen = F.posexplode_outer(col) if outer else F.posexplode(col)
        out = df.select("*", gen.alias(position, alias))
    else:
        gen = F.explode_outer(col) if outer else F.explode(col)
        out = df.select("*", gen.alias(alias))
    if prefix is not None:
        dtype = out.schema[alias].dataType
        if isinstance(dtype, StructType):
            out = out.select(*[c for c in out.columns if c != alias],
                             *[F.col(f"{alias}.{f.name}").alias(f"{prefix}{f.name}") for f in dtype.fields])
    return out
