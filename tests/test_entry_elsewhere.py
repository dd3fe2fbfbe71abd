"""Every registered query must run when the job starts in another folder."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
JOB = """
import importlib.util, sys
from pyspark.sql import SparkSession
spec = importlib.util.spec_from_file_location("__spark_entry__", sys.argv[1] + "/__spark_entry__.py")
made = importlib.util.module_from_spec(spec)
spec.loader.exec_module(made)
spark = SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").config("spark.checkpoint.dir", sys.argv[2]).getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
for name, query in made.queries().items():
    if any(name.startswith(p) for p in sys.argv[3].split(",")):
        query(spark, "/root/testdata/sf0.001").write.mode("overwrite").format("noop").save()
        print("ran", name, flush=True)
"""


def test_queries_run_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    script = tmp_path / "job.py"
    script.write_text(JOB)
    shared = tmp_path / "shared"
    shared.mkdir()
    done = subprocess.run([sys.executable, str(script), REPO, str(shared), "op,pipeline,audit_,dedupe_contained"], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=1200)
    assert done.returncode == 0, done.stderr[-3000:]
    assert "ran audit_anchor" in done.stdout and "ran dedupe_contained" in done.stdout
