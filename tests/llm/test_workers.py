"""Workers that cannot import the library from a path get it from Spark."""

import os
import subprocess
import sys
import textwrap

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

CODE = """
import sys
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2")
         .config("spark.checkpoint.dir", sys.argv[2]).getOrCreate())
spark.range(4).mapInPandas(lambda b: b, "id long").count()  # workers start before the driver knows the library
sys.path.insert(0, sys.argv[1])
from pullscan.llm import fill_in_middle, hash_forest, packing
t = spark.createDataFrame([(i, [1.0, i / 7, 2.0]) for i in range(60)], "vec_id long, embedding array<double>")
assert hash_forest.nearest(t).count() == 10
d = spark.createDataFrame([(1, "some words here"), (2, None)], "doc_id long, text string")
assert fill_in_middle.fill_in_middle(d).count() == 2 and packing.pack(d).count() >= 1
spark.stop()
"""


def test_modules_reach_workers(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    script = tmp_path / "job.py"
    script.write_text(textwrap.dedent(CODE))
    done = subprocess.run([sys.executable, str(script), REPO, str(tmp_path / "shared")], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]
