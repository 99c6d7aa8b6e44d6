"""Regression guard on all plans that the main pipelines execute, checkpoints included."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"
FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"]
NAMES = ["top2_top50_by_rank", "pipe1_features", "pipe2_superfan_scores", "pipe5_match_events",
         "jn6_fuzzy_keyword_match", "agg21_spearman", "win1_previous_play", "jn7_nation_centres",
         "agg18_describe", "scoped_pipe5_listener_centres"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data missing")
def test_no_quadratic_joins_or_python():
    out = subprocess.run([sys.executable, os.path.join(ROOT, "scripts", "plan_audit.py"), SF, *NAMES],
                         capture_output=True, text=True, timeout=900, env=os.environ | {"ENCORE_DRIVER_MEMORY": "2g"})
    lines = [x for x in out.stdout.splitlines() if "plans=" in x]
    assert {x.split()[0] for x in lines} >= set(NAMES), out.stderr[-2000:]
    assert all(int(x.split("plans=")[1].split()[0]) >= 1 for x in lines)
    assert not [x for x in lines if any(op in x for op in FORBIDDEN)]
