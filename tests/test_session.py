"""Python operators on executors that share nothing with the driver but the checkpoint folder."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = str(Path(__file__).resolve().parents[1])
JOB = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
s = (SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2")
     .config("spark.checkpoint.dir", {shared!r}).config("spark.executorEnv.PYTHONPATH", "").getOrCreate())
{body}
s.stop()
"""


def run_on_cluster(tmp_path, body: str) -> str:
    """What a job prints that runs on two executors of their own, which don't have the package."""
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "SPARK_LOCAL_DIRS")} | {"SPARK_LOCAL_IP": "127.0.0.1"}
    job = JOB.format(root=ROOT, shared=str(tmp_path / "shared"), body=body)
    got = subprocess.run([sys.executable, "-c", job], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert got.returncode == 0, got.stderr[-3000:]
    return got.stdout


def test_workers_get_the_package_whenever_they_start(tmp_path):
    body = """
from skein.operators import edges
docs = s.createDataFrame([(i, [1, 2, 3, i]) for i in range(9)], "doc_id long, h array<long>").repartition(4)
print("keys", edges.band_keys(docs).count())
from skein.session import ship
ship(s)
print("again", edges.band_keys(docs.filter("doc_id < 3")).count())
"""
    out = run_on_cluster(tmp_path, body)
    assert "keys 144" in out and "again 48" in out


def test_a_cluster_needs_a_shared_folder():
    import pytest

    from skein import session

    class Context:
        master = "spark://somewhere:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="checkpoint"):
        session.shared_folder(Session())
    assert session.one_machine("local[8]") and session.one_machine("local") and not session.one_machine("local-cluster[2,1,512]")
