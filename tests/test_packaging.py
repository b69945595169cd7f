"""The package reaches the workers from wherever the entry file is loaded."""

import os
import subprocess
import sys
from pathlib import Path

PROGRAM = """
import importlib.util, sys
from pyspark.sql import SparkSession
spec = importlib.util.spec_from_file_location("entry_file", sys.argv[1])
module = importlib.util.module_from_spec(spec)
spec.loader.exec_module(module)
spark = (SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2")
         .config("spark.ui.enabled", "false").config("spark.checkpoint.dir", sys.argv[2]).getOrCreate())
print("rows", module.queries()["m19_model_per_group"](spark, "/root/testdata/sf0.001").count())
"""


def test_grouped_models_run_from_another_folder(tmp_path):
    entry = Path(__file__).parents[1] / "__spark_entry__.py"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", PROGRAM, str(entry), str(tmp_path / "shared")], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert done.returncode == 0, done.stderr[-2000:]
    assert int(done.stdout.split("rows")[1]) > 0
