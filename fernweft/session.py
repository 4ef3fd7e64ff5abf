"""Session construction with the settings the operators are written for."""

from __future__ import annotations

import os
import shlex
from pathlib import Path

from pyspark import SparkConf, SparkContext
from pyspark.sql import SparkSession


def submitted() -> dict[str, str]:
    """Settings that the submitter has given: in the arguments of the submit
    script, in the defaults file, or to a JVM that is running already."""
    if "PYSPARK_GATEWAY_PORT" in os.environ or SparkContext._active_spark_context is not None:
        SparkContext._ensure_initialized()
        return dict(SparkConf().getAll()) | dict(getattr(SparkContext._active_spark_context, "_conf", SparkConf(False)).getAll())
    found: dict[str, str] = {}
    folder = os.environ.get("SPARK_CONF_DIR") or os.path.join(os.environ.get("SPARK_HOME", ""), "conf")
    defaults = Path(folder, "spark-defaults.conf")
    for line in defaults.read_text().splitlines() if defaults.is_file() else []:
        key, _, value = line.strip().replace("=", " ", 1).partition(" ")
        if key.startswith("spark."):
            found[key] = value.strip()
    args = shlex.split(os.environ.get("PYSPARK_SUBMIT_ARGS", ""))
    for option, value in zip(args, args[1:]):
        if option in ("--conf", "-c"):
            key, _, value = value.partition("=")
            found[key] = value
        elif option in ("--master", "--driver-memory", "--name"):
            found["spark.app.name" if option == "--name" else "spark." + option[2:].replace("-", ".")] = value
    return found


def get_session(app: str = "fernweft", cpus: int | None = None, **conf: object) -> SparkSession:
    """A session with what the operators rely on; the submitter's settings win.

    Settings of ``conf`` are set in any case, ``cpus`` only where no master is
    submitted. Defaults fill what nobody has set: those of SQL always, memory,
    shuffle partitions and the console only on a local master.

    Adaptive execution stays on: the operators rely on it to coalesce small
    shuffle partitions, to split skewed sort-merge joins and to turn a join
    into a broadcast only once the measured size of a side allows it.
    """
    given = submitted()
    master = given.get("spark.master") or (f"local[{cpus}]" if cpus is not None else "local[*]")
    settings = {
        "spark.app.name": app,
        "spark.master": master,
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    }
    if master.startswith("local") and not master.startswith("local-cluster"):
        settings |= {
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": os.environ.get("FERNWEFT_DRIVER_MEMORY", "8g"),
            "spark.sql.shuffle.partitions": str(max(8, cpus or 8)),
        }
    builder = SparkSession.builder
    for key, value in ({k: v for k, v in settings.items() if k not in given} | {k: str(v) for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def make_importable(spark: SparkSession) -> None:
    """Let Python workers import this package from the driver's folder.

    Where the package is installed or sent with the job, this changes nothing.
    """
    root = str(Path(__file__).resolve().parent.parent)
    paths = [p for p in spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *paths])
