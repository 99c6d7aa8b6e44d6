"""Log transform, min-max scaling and weighted scores (PRJ2-7, AGG12-13, SCL5-10).

Min-max "fit" is a fixed-size summary (one min and one max per column):
without a scope it is one row, read back to the driver as literals the
way an MLlib estimator's ``fit`` is; with a scope it is one row per scope
joined on the scope keys.  The transform is then a plain projection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from encore.constants import DROPPED_FEATURES
from encore.operators.ranking import broadcast_if_small


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    """PRJ3: columns of numeric type (booleans are not numeric)."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def drop_features(df: DataFrame, cols=DROPPED_FEATURES) -> DataFrame:
    """PRJ2: drop named columns."""
    return df.drop(*cols)


def prefixed_columns(df: DataFrame, prefix: str, keep=()) -> DataFrame:
    """PRJ4: columns whose name starts with ``prefix``, then the key columns."""
    return df.select(*[c for c in df.columns if c.startswith(prefix)], *keep)


def add_log_columns(df: DataFrame, cols=None, prefix: str = "log_") -> DataFrame:
    """PRJ5 + SCL5: one ``log1p`` column per numeric column, in one projection."""
    cols = numeric_columns(df) if cols is None else list(cols)
    return df.withColumns({prefix + c: F.log1p(F.col(c).cast("double")) for c in cols})


def minmax_fit(df: DataFrame, cols, scope=()) -> DataFrame:
    """AGG13: per-column min and max (NULLs ignored), one row per scope."""
    aggs = []
    for c in cols:
        aggs += [F.min(c).cast("double").alias(f"_min_{c}"),
                 F.max(c).cast("double").alias(f"_max_{c}")]
    return df.groupBy(*scope).agg(*aggs)


def _scaled(c, lo, hi):
    # SCL6: (x - min) / (max - min); a constant column scales to 0; NULL stays NULL.
    rng = F.when(hi == lo, F.lit(1.0)).otherwise(hi - lo)
    return (F.col(c).cast("double") - lo) / rng


def minmax_scale(df: DataFrame, cols, scope=()) -> DataFrame:
    """SCL6: scale ``cols`` to [0, 1] in place."""
    cols = list(cols)
    stats = minmax_fit(df, cols, scope)
    if not scope:
        row = stats.first()
        return df.withColumns({c: _scaled(c, F.lit(row[f"_min_{c}"]).cast("double"),
                                          F.lit(row[f"_max_{c}"]).cast("double"))
                               for c in cols})
    joined = df.join(stats, list(scope), "left")
    out = joined.withColumns({c: _scaled(c, F.col(f"_min_{c}"), F.col(f"_max_{c}"))
                              for c in cols})
    return out.drop(*[x for c in cols for x in (f"_min_{c}", f"_max_{c}")])


def max_normalise(df: DataFrame, col: str, out: str, scope=()) -> DataFrame:
    """AGG12 + SCL12: ``x / max(x)`` (global, or per scope)."""
    stats = df.groupBy(*scope).agg(F.max(col).cast("double").alias("_max"))
    if not scope:
        m = stats.first()["_max"]
        return df.withColumn(out, F.try_divide(F.col(col).cast("double"), F.lit(m).cast("double")))
    return (df.join(broadcast_if_small(stats), list(scope), "left")
            .withColumn(out, F.try_divide(F.col(col).cast("double"), F.col("_max")))
            .drop("_max"))


def weighted_score(df: DataFrame, weights: dict[str, float], out: str) -> DataFrame:
    """SCL7-SCL10: NULL-propagating weighted sum of named columns."""
    expr = None
    for name, w in weights.items():
        term = F.lit(float(w)) * F.col(name)
        expr = term if expr is None else expr + term
    return df.withColumn(out, expr)
