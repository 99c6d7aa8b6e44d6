"""Table scans and previews (SRC2, SRC9) and the play-history JSON scan (SRC1, SET1, SET4)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from encore.constants import PLAY_COLUMNS
from encore.schemas import PLAY_SCHEMA


def read_table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """SRC2: scan a parquet table ``<base>/<name>.parquet`` (all columns;
    Catalyst prunes to what the query uses)."""
    return spark.read.parquet(f"{base.rstrip('/')}/{name}.parquet")


def preview(df: DataFrame, n: int = 5, order=None) -> DataFrame:
    """SRC9: the first ``n`` rows (by ``order`` when given, so it is repeatable)."""
    return (df.orderBy(*order) if order else df).limit(n)


def read_play_history(spark: SparkSession, paths, schema=PLAY_SCHEMA,
                      multi_line: bool = True, mode: str = "FAILFAST") -> DataFrame:
    """SRC1 + SET1: scan JSON-array export files with a declared schema.

    Columns missing from a file come back NULL and extra columns are
    dropped by the schema, which is ``union_by_name`` semantics without a
    per-file inference pass.  Timestamps with a ``Z`` suffix parse as UTC
    instants (``timestamp``, not ``timestamp_ntz``).  ``multi_line=True``
    reads files that each hold one JSON array (the export format);
    ``False`` reads JSON Lines.  A file that is not valid JSON fails the
    read; ``mode="PERMISSIVE"`` reads its broken records as all-NULL rows.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    return (spark.read.schema(schema).option("multiLine", multi_line)
            .option("mode", mode).json(paths)
            .select(*PLAY_COLUMNS))


def union_exports(frames, dedupe: bool = False) -> DataFrame:
    """SET1 + SET4: union export batches by column name, missing columns as NULL.

    No de-duplication by default (overlapping exports count twice, as in
    a plain glob scan); ``dedupe=True`` drops exact duplicate rows.
    """
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return out.dropDuplicates() if dedupe else out

