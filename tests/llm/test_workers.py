"""All corpus queries from a folder and with workers that have no path to this repository."""

import json
import os
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[2])
SCRIPT = """
import json, os, sys, tempfile
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
         .config("spark.driver.memory", "4g").config("spark.checkpoint.dir", tempfile.mkdtemp()).getOrCreate())
spark.sparkContext.setLogLevel("OFF")
blocked = spark.range(4).repartition(2).mapInArrow(lambda b: [__import__("scorelake")] and b, "id long")
try:
    blocked.collect()
    print("RESULT", json.dumps({"blocked": False}))
    sys.exit()
except Exception:
    pass
sys.path.insert(0, sys.argv[1])
import __spark_entry__ as entry
out = {"blocked": True}
for name, q in entry.queries().items():
    if name in sys.argv[3:]:
        try:
            out[name] = q(spark, sys.argv[2]).count()
        except Exception as e:
            out[name] = repr(e)[-300:]
print("RESULT", json.dumps(out))
"""
NAMES = ["op1_secret_scan", "op2_mix_sources", "op3_ngram_join", "op4_html_text", "op5_nearest", "op6_chat_format", "op7_decontaminate", "op8_toxicity",
         "op9_line_dedup", "op10_quality", "op11_periodic_runs", "op12_source_divergence", "op13_minhash_dedup", "pipeline"]


@pytest.fixture(scope="module")
def counts(data, tmp_path_factory):
    folder = tmp_path_factory.mktemp("elsewhere")
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    said = subprocess.run([sys.executable, "-c", SCRIPT, ROOT, data, *NAMES], cwd=folder, env=env, capture_output=True, text=True, timeout=900)
    assert "RESULT" in said.stdout, said.stderr[-2000:]
    return json.loads(said.stdout.rpartition("RESULT")[2])


def test_all_queries_run_without_a_path_to_the_package(counts):
    assert counts.pop("blocked"), "the workers of this test can import the package"
    assert set(counts) == set(NAMES)
    assert {k: v for k, v in counts.items() if not isinstance(v, int) or not v} == {}
