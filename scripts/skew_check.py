"""Hot-key check: one artist holds a third of all plays.

usage: python scripts/skew_check.py [sf_dir]

Builds the stand-in plays, re-labels every third play to one artist
("HOT"), runs PIPE1 (features) and WIN1 (previous play) from the library,
the rank primitives (average rank, exact quartiles) on a value shared by a
third of the rows, and - for contrast - a plain ``lag`` window
partitioned by artist over the raw plays.  Spark's event log is written to a fresh
scratch folder and parsed afterwards: for every stage with shuffle input
it reports the records read by the largest task as a share of the stage's
records (partition coalescing and size-based broadcast conversion are off
for this run, so shares compare and joins run as on large data).
A share near 1/3 or above means one task got the hot artist's raw rows;
an even spread over 16 partitions is about 6%.
"""

from __future__ import annotations

import glob
import json
import os
import sys
import tempfile
from collections import defaultdict

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import Window  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from encore.constants import ARTIST  # noqa: E402
from encore.operators import features as feat  # noqa: E402
from encore.operators.explore import describe  # noqa: E402
from encore.operators import ranking  # noqa: E402
from encore.operators.ranking import average_rank  # noqa: E402
from encore.plans import stand_in  # noqa: E402
from encore.session import get_session  # noqa: E402


def salted(build):
    """Build with the per-value broadcast disabled, forcing the salted join."""
    saved = ranking.BROADCAST_ROWS
    ranking.BROADCAST_ROWS = 0
    try:
        return build()
    finally:
        ranking.BROADCAST_ROWS = saved


def main():
    base = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    logdir = tempfile.mkdtemp(prefix="run-skew-")
    spark = get_session(extra={"spark.eventLog.enabled": "true", "spark.eventLog.dir": logdir,
                               "spark.eventLog.compress": "false",
                               # keep every shuffle at its full partition count so
                               # the per-task shares are comparable
                               "spark.sql.adaptive.coalescePartitions.enabled": "false",
                               # joins stay sort-merge as they would be on data too
                               # big to broadcast; explicit bounded broadcasts remain
                               "spark.sql.autoBroadcastJoinThreshold": "-1",
                               "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"})
    sc = spark.sparkContext
    plays = stand_in.plays(spark, base)
    hot = (plays.withColumn("_k", F.monotonically_increasing_id())
           .withColumn(ARTIST, F.when(F.col("_k") % 3 == 0, F.lit("HOT"))
                       .otherwise(F.col(ARTIST))).drop("_k"))
    hot = hot.checkpoint(eager=True)   # fixed input for all three jobs
    n_hot = hot.where(F.col(ARTIST) == "HOT").count()
    n_all = hot.count()
    # a value shared by a third of the rows, for the rank primitives
    vals = (hot.withColumn("_k", F.monotonically_increasing_id())
            .select(F.when(F.col("_k") % 3 == 0, F.lit(0.0))
                    .otherwise(F.col("ms_played").cast("double")).alias("v"),
                    F.col("ms_played").cast("double").alias("w")))
    jobs = {
        "features": lambda: feat.features(hot),
        "average_rank": lambda: average_rank(vals, "v", out="r"),
        "average_rank_salted": lambda: salted(lambda: average_rank(vals, "v", out="r")),
        "describe": lambda: describe(vals, ["v", "w"]),
        "previous_play": lambda: feat.previous_play(hot),
        "naive_window_lag": lambda: feat.drop_podcasts(hot).select(
            ARTIST, "ts", F.lag("ts").over(Window.partitionBy(ARTIST).orderBy("ts")).alias("p")),
    }
    for name, build in jobs.items():
        sc.setJobGroup(name, name)
        build().write.format("noop").mode("overwrite").save()
    spark.stop()

    stage_job = {}
    task_records = defaultdict(list)
    for path in glob.glob(os.path.join(logdir, "**", "*"), recursive=True):
        if os.path.isdir(path) or "appstatus" in os.path.basename(path):
            continue
        for line in open(path):
            ev = json.loads(line)
            kind = ev.get("Event")
            if kind == "SparkListenerJobStart":
                grp = (ev.get("Properties") or {}).get("spark.jobGroup.id")
                for sid in ev.get("Stage IDs", []):
                    stage_job[sid] = grp
            elif kind == "SparkListenerTaskEnd":
                m = ev.get("Task Metrics") or {}
                sr = (m.get("Shuffle Read Metrics") or {}).get("Total Records Read", 0)
                if sr:
                    task_records[ev["Stage ID"]].append(sr)
    print(f"plays: {n_all}, hot artist: {n_hot} ({n_hot / n_all:.0%})")
    worst = defaultdict(float)
    for sid, recs in task_records.items():
        grp = stage_job.get(sid)
        total = sum(recs)
        if grp and total >= 1000 and len(recs) > 1:
            worst[grp] = max(worst[grp], max(recs) / total)
    for grp in jobs:
        print(f"{grp:18s} largest task share of a shuffle stage's records: {worst.get(grp, 0):.1%}")


if __name__ == "__main__":
    main()
