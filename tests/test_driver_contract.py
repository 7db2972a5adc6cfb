"""The driver imports __spark_entry__ from elsewhere with its own plain session."""

import os
import subprocess
import sys
import tempfile

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import sys
sys.path.insert(0, {REPO!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
import __spark_entry__ as E
df = E.entry(spark)
print("ENTRY", df.schema.simpleString(), df.count())
print("PYSTAGE", E.queries()["complete_batch"](spark, "/root/testdata/sf0.001").count())
from quire.plans.catalog import QUERIES
print("KEYS", len(E.queries()), len(E.oracle_sql()), len(set(QUERIES) - set(E.oracle_sql())))
"""


def test_entry_and_python_stage_from_another_directory():
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tempfile.mkdtemp(), capture_output=True, text=True,
                         timeout=600)
    lines = {ln.split(" ", 1)[0]: ln for ln in out.stdout.splitlines() if ln.split(" ", 1)[0] in
             ("ENTRY", "PYSTAGE", "KEYS")}
    assert "ENTRY" in lines, out.stderr[-2000:]
    assert lines["ENTRY"].endswith(" 6") and "route:string,language:string" in lines["ENTRY"]
    assert lines["PYSTAGE"] == "PYSTAGE 200"
    keys, oracles, without = map(int, lines["KEYS"].split()[1:])
    assert keys >= oracles and without == 0
