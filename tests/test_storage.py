import json
import os
import subprocess
import sys
from pathlib import Path

import pytest

from gaugeworks import storage

ROOT = Path(__file__).resolve().parent.parent


def test_release(spark):
    first = storage.mark()
    a = storage.materialize(spark.range(3), "a")
    path = storage._made[-1]
    b = storage.materialize(spark.range(4), "b")
    kept = storage._made[-1]
    assert a.count() == 3
    storage.release(spark, first, keep=kept)
    assert not Path(path.removeprefix("file://")).exists()
    assert b.count() == 4 and storage._made[first:] == [kept]
    storage.release(spark, first)
    assert storage.mark() == first


def in_own_session(body: str, tmp_path: Path, **conf: str) -> dict:
    """What a script prints as JSON, in a session of its own without any Spark configuration but `conf`."""
    (tmp_path / "empty").mkdir(exist_ok=True)
    script = f"""
import json
from pathlib import Path
from pyspark.sql import SparkSession
from gaugeworks import storage
spark = SparkSession.builder.config(map={conf | {"spark.ui.enabled": "false", "spark.master": "local[1]"}!r}).getOrCreate()
{body}
"""
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path / "empty"), "PYTHONPATH": str(ROOT)}
    done = subprocess.run([sys.executable, "-c", script], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    return json.loads(done.stdout.strip().splitlines()[-1])


WRITES = """
df = storage.materialize(spark.range(3), "a")
path = storage._made[-1]
print(json.dumps({"rows": df.count(), "path": path, "there": Path(path.removeprefix("file://")).exists(), "same": storage.shared_dir(spark) == storage.shared_dir(spark)}))
"""


def test_session_without_a_folder(tmp_path):
    got = in_own_session(WRITES, tmp_path)
    assert got["rows"] == 3 and got["there"] and got["same"] and got["path"].startswith("file:///")


def test_folder_without_a_scheme(tmp_path):
    """It is on Spark's default file system, for all readers."""
    got = in_own_session(WRITES, tmp_path, **{"spark.checkpoint.dir": f"{tmp_path}/shared"})
    assert got["path"].startswith(f"file://{tmp_path}/shared/a-") and got["there"]
    got = in_own_session('print(json.dumps(storage.shared_dir(spark)))', tmp_path, **{"spark.checkpoint.dir": "/shared", "spark.hadoop.fs.defaultFS": "viewfs://store/", "spark.hadoop.fs.viewfs.mounttable.store.link./shared": f"file://{tmp_path}/shared"})
    assert got == "viewfs://store/shared"


def test_what_workers_reach(tmp_path):
    assert storage.for_workers(f"file://{tmp_path}") == f"file://{tmp_path}"
    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        storage.for_workers("dbfs:/shared")
