"""Every query as the first one of an application whose workers find nothing but what the operators ship."""

import os
import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
import __spark_entry__ as entry

queries = {n: q for n, q in entry.queries().items() if n[:2] == "op" and n[2].isdigit() or n == "pipeline"}
assert len(queries) == 11
for name, query in queries.items():
    spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", sys.argv[3]).config("spark.sql.warehouse.dir", sys.argv[3]).getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    print("DONE", name, len(query(spark, sys.argv[2]).collect()), flush=True)
    spark.stop()
"""


def test_first_queries(spark, words, tmp_path):
    docs = [(100 * i, words(20 + i, i) + " " + words(40, 99), "en", "a") for i in range(12)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, f"http://h.com/de/{i}", words(9, i)) for i in range(9)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(100 * i, 1, 0) for i in range(9)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    (tmp_path / "else").mkdir()
    repo = str(Path(__file__).resolve().parents[2])
    env = {k: v for k, v in os.environ.items() if k not in ("PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    # Installed packages may be found by it, this one not.
    env["PYTHONPATH"] = os.pathsep.join(p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p and os.path.realpath(p) != os.path.realpath(repo))
    got = subprocess.run([sys.executable, "-c", SCRIPT, repo, str(tmp_path), f"{tmp_path}/shared"], cwd=tmp_path / "else", env=env, capture_output=True, text=True, timeout=600)
    assert got.stdout.count("DONE") == 11, got.stdout + got.stderr[-3000:]
