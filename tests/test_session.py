"""Scratch folders: shared on a cluster, removed at the end; the package reaches the workers."""

import os
import subprocess
import sys
import time
from types import SimpleNamespace

import pytest

from cuadro.session import checkpoint_dir
from tests.conftest import ROOT


def _session(master: str):
    nothing = SimpleNamespace(get=lambda *a: None)
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: None, getConf=lambda: nothing)
    return SimpleNamespace(sparkContext=context, conf=nothing)


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "k8s://x", "local-cluster[2,1,1024]"])
def test_no_machine_local_scratch_on_a_cluster(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_dir(_session(master))


SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from cuadro.session import get_spark, materialise
spark = get_spark("local[1]", shuffle_partitions=1)
spark.sparkContext.setCheckpointDir({folder!r})

def run(batches):
    import cuadro.functions.text            # importable in a worker started from another folder
    yield from batches

print("ROWS", materialise(spark.range(5).mapInArrow(run, "id long"), "x").count())
spark.stop()
"""


def test_scratch_goes_with_the_session_and_workers_get_the_package(tmp_path):
    folder = tmp_path / "ckpt"
    code = SCRIPT.format(root=ROOT, folder=str(folder))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert "ROWS 5" in out.stdout, out.stderr[-2000:]
    for _ in range(100):                                              # the JVM ends a little after Python
        left = [f for _, _, files in os.walk(folder) for f in files]
        if not left:
            break
        time.sleep(0.2)
    assert not left


def test_release_of_the_newest_scratch(spark, tmp_dir):
    from cuadro import session
    first = session.materialise(spark.range(3), "kept")
    before = session.scratch_count()
    session.materialise(spark.range(4), "passing")
    last = session.materialise(spark.range(5), "last")
    session.release_scratch(before, keep_last=True)
    assert session.scratch_count() == before + 1 and first.count() == 3 and last.count() == 5
    session.release_scratch(before)
    assert session.scratch_count() == before and first.count() == 3
