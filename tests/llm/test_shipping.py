"""Operators work on any DataFrame, in a process whose workers don't find the package on their own."""

import os
import subprocess
import sys

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from millrace.llm import {module}
docs = spark.createDataFrame([(1, "the cat sat on the mat and the dog"), (2, None)], "doc_id long, text string")
print("rows", {call}.count())
"""


def run(module, call):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(root=root, module=module, call=call)], cwd="/", env=env, capture_output=True, text=True, timeout=300)
    assert "rows 2" in done.stdout, done.stderr[-2000:]


def test_media():
    run("media", "media.read(media.write(docs))")


def test_secrets():
    run("secrets", "secrets.scan(docs)")


def test_simhash():
    run("simhash", "simhash.components(docs)")
