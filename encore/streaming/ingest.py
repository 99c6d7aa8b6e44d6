"""Incremental ingest of play-history exports (SRC1 as a file stream).

New export files arrive as a re-export next to the old ones; the weekly
run is a batch rerun.  As a Structured Streaming file source with a
declared schema and an ``availableNow`` trigger, each run picks up only
files it has not seen (tracked exactly-once in the stream checkpoint) and
appends them to a parquet play table partitioned by year and month, so
later feature runs prune by date and never re-parse old JSON.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from encore.constants import PLAY_COLUMNS
from encore.schemas import PLAY_SCHEMA
from encore.session import materialise


def append_new_plays(batch: DataFrame, table_path: str, keys) -> None:
    """Append the rows of ``batch`` (with year and month) that the table does not hold and
    that are not in the batch already; rows are equal if they are so in all ``keys``, NULLs
    included.  Only the table's months that the batch touches are read, and of them only the
    keys.  A batch that is tried again adds nothing twice."""
    spark, keys = batch.sparkSession, list(keys)
    new = materialise(batch.dropDuplicates(keys), "ingest-batch")
    months = new.select("year", "month").distinct().collect()  # one row for each month
    try:
        old = spark.read.schema(new.schema).parquet(table_path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        old = None
    if old is not None and months:
        touched = None
        for r in months:  # a filter on partition columns: other months are not listed
            one = F.col("year").eqNullSafe(r["year"]) & F.col("month").eqNullSafe(r["month"])
            touched = one if touched is None else touched | one
        old = old.where(touched).select(*[F.col(c).alias(f"_old_{c}") for c in keys]).withColumn(
            "_old", F.xxhash64(*[f"_old_{c}" for c in keys]))
        same = F.col("_new") == F.col("_old")
        for c in keys:
            same = same & F.col(c).eqNullSafe(F.col(f"_old_{c}"))
        new = new.withColumn("_new", F.xxhash64(*keys)).join(old, same, "left_anti").drop("_new")
    new.write.mode("append").partitionBy("year", "month").parquet(table_path)


def ingest_exports(spark: SparkSession, source_dir: str, table_path: str,
                   checkpoint_location: str, schema=PLAY_SCHEMA, multi_line: bool = True,
                   max_files_per_trigger: int | None = None, scope=(), dedupe: bool = False) -> int:
    """Append the not-yet-seen export files under ``source_dir`` to the play
    table at ``table_path``; returns the number of micro-batches run.

    ``checkpoint_location`` belongs to the table: every run must name the
    same one, or the sink takes the run's batches for ones it has.  Columns
    of ``schema`` that ``scope`` names (the listener) are kept beside the
    play columns.  A file that is not valid JSON fails the run.

    SET4: exports that overlap count twice, as in a scan of all files; with ``dedupe``
    each play (equal in all columns) is added once, whichever export brings it.  A table
    is ingested with ``dedupe`` from its first run or never: the plain file sink keeps a log
    of its own files."""
    reader = (spark.readStream.schema(schema).option("multiLine", multi_line)
              .option("mode", "FAILFAST"))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    plays = (reader.json(source_dir).select(*scope, *PLAY_COLUMNS)
             .withColumn("year", F.year("ts")).withColumn("month", F.month("ts")))
    if dedupe:
        q = (plays.writeStream.outputMode("append").option("checkpointLocation", checkpoint_location)
             .foreachBatch(lambda batch, _: append_new_plays(batch, table_path, [*scope, *PLAY_COLUMNS]))
             .trigger(availableNow=True).start())
        q.awaitTermination()
        return len(q.recentProgress)
    q = (plays.writeStream.format("parquet").outputMode("append")
         .option("path", table_path).option("checkpointLocation", checkpoint_location)
         .partitionBy("year", "month").trigger(availableNow=True).start())
    q.awaitTermination()
    return len(q.recentProgress)
