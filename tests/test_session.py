"""Settings of the submitter are kept, and defaults fill the rest."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

import pytest

from fernweft import materialize
from fernweft.session import submitted

REPO = Path(__file__).resolve().parent.parent
CODE = """from fernweft.session import get_session
spark = get_session('mine', cpus=2)
keys = 'spark.sql.shuffle.partitions spark.driver.memory spark.sql.adaptive.enabled spark.master spark.app.name spark.sql.session.timeZone'
print('|'.join(spark.conf.get(k) for k in keys.split()))
"""


def started(**env):
    clean = {k: v for k, v in os.environ.items() if k not in ("PYSPARK_SUBMIT_ARGS", "SPARK_CONF_DIR", "PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    done = subprocess.run([sys.executable, "-c", CODE], cwd=REPO, env=clean | env, capture_output=True, text=True, timeout=120)
    return done.stdout.strip().splitlines()[-1].split("|")


def test_nothing_submitted():
    assert started() == ["8", "8g", "true", "local[2]", "mine", "UTC"]


def test_arguments_of_the_submit_script_win():
    got = started(PYSPARK_SUBMIT_ARGS="--master local[3] --driver-memory 1g --conf spark.sql.shuffle.partitions=777 --conf spark.sql.adaptive.enabled=false pyspark-shell")
    assert got == ["777", "1g", "false", "local[3]", "mine", "UTC"]


def test_the_defaults_file_wins(tmp_path):
    (tmp_path / "spark-defaults.conf").write_text("# ours\nspark.sql.shuffle.partitions 77\nspark.driver.memory=1g\n")
    assert started(SPARK_CONF_DIR=str(tmp_path))[:2] == ["77", "1g"]


def test_a_running_session_counts_as_submitted(spark):
    assert submitted()["spark.sql.shuffle.partitions"] == "4"


class Cluster:
    """What ``shared_root`` reads of a session, for a master of a cluster."""

    def __init__(self, **conf):
        self.settings = {k.replace("_", "."): v for k, v in conf.items()}
        self.conf, self.sparkContext, self.master, self.applicationId = self, self, "spark://head:7077", "x"

    def get(self, key, default=None):
        return self.settings.get(key, default)


def test_a_cluster_needs_a_shared_folder():
    assert materialize.shared_root(Cluster(spark_checkpoint_dir="hdfs://a/b/")) == "hdfs://a/b"
    assert materialize.shared_root(Cluster(spark_sql_warehouse_dir="hdfs://a/w")) == "hdfs://a/w/_fernweft"
    for warehouse in ("file:/tmp/w", "/tmp/w"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            materialize.shared_root(Cluster(spark_sql_warehouse_dir=warehouse))
