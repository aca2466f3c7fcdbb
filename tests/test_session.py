"""Submitted settings survive, and no local folder stands in on a cluster."""

import os
import subprocess
import sys

import pytest

from mensura import session

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_submitted_settings_survive(tmp_path):
    code = ("from mensura.session import get_session; s = get_session();"
            "print('GOT', s.conf.get('spark.sql.shuffle.partitions'), s.conf.get('spark.driver.memory'), s.sparkContext.master)")
    env = os.environ | {"PYTHONPATH": ROOT, "PYSPARK_SUBMIT_ARGS":
                        "--master local[2] --driver-memory 1g --conf spark.sql.shuffle.partitions=777 pyspark-shell"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert "GOT 777 1g local[2]" in out.stdout, out.stderr[-500:]


def test_model_query_runs_from_another_folder(tmp_path):
    """With the package on the path (installed, or shipped with --py-files) Python workers find it."""
    code = ("from mensura.session import get_session; from mensura.plans.registry import QUERIES, load_all; load_all();"
            "print('ROWS', len(QUERIES['ml2_ridge_one_feature'](get_session('local[2]'), '/root/testdata/sf0.001').collect()))")
    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("driver tables not present")
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": ROOT},
                         capture_output=True, text=True, timeout=180)
    assert "ROWS 25" in out.stdout, out.stderr[-500:]


class _Cluster:
    """A session whose cluster names no shared folder."""

    class sparkContext:  # noqa: N801
        master = "yarn"

        @staticmethod
        def getCheckpointDir():
            return None

    class conf:  # noqa: N801
        @staticmethod
        def get(key, default=None):
            return default


def test_cluster_without_shared_folder_is_an_error():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(_Cluster())
    assert session._local("local[4]") and session._local("local") and not session._local("local-cluster[2,1,512]")
