"""Tables in the shared folder."""

from __future__ import annotations

import os
import subprocess
import sys

SCRIPT = """
from millrace.session import build_session
from millrace.sources.tables import materialize, shared_dir
spark = build_session(1, 1, "1g")
assert not spark.conf.get("spark.checkpoint.dir", None)
folder = shared_dir(spark)
assert shared_dir(spark) == folder and materialize(spark.range(3), "t").count() == 3
assert materialize(spark.range(0), "empty").count() == 0
print("made", folder)
"""


def test_own_folder_where_none_is_set(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "TMPDIR": str(tmp_path), "PYTHONPATH": root}
    done = subprocess.run([sys.executable, "-c", SCRIPT], env=env, capture_output=True, text=True, timeout=120)
    assert f"made file://{tmp_path}" in done.stdout, done.stderr[-2000:]


def test_set_folder_is_used(spark, tmp_path):
    from millrace.sources.tables import shared_dir

    named = spark.conf.get("spark.checkpoint.dir", None)
    assert named is None or shared_dir(spark) == named
