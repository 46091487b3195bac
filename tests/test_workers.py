"""Worker functions must run where the package is not installed."""

import os
import subprocess
import sys
import textwrap


def test_worker_functions_travel_with_the_job(tmp_path):
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
        import sys
        sys.path.insert(0, {repo!r})
        from __spark_entry__ import queries
        from seriesloom import build_session
        spark = build_session(master="local[2]", **{{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2"}})
        for name in ("linear_coefficients", "user_model", "calendar_udtf"):
            assert queries()[name](spark, "/root/testdata/sf0.001").count() > 0
        spark.stop()
    """
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
