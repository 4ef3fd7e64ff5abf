"""Tables written to the shared folder, to cut lineage and to fix row order.

A written table survives the loss of any executor, is read back without
recomputing what lies above it, and gives every later plan the same rows.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOTS: dict[str, str] = {}
#: Paths that each application has written and not deleted, in order.
_WRITTEN: dict[str, list[str]] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    ``spark.checkpoint.dir`` is read from the session. Where it is unset, a
    local master (driver and executors are one process) gets a temporary
    folder, and a cluster a folder below the warehouse if that is in a store
    which all machines reach. A cluster without either is refused, as tables
    written to one machine's disk are lost to the others.
    """
    root = spark.conf.get("spark.checkpoint.dir", "")
    if root:
        return root.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        if "://" not in warehouse or warehouse.startswith("file:"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        return warehouse + "/_fernweft"
    if sc.applicationId not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="fernweft-")
    return _LOCAL_ROOTS[sc.applicationId]


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of what was written."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    claim(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def claim(spark: SparkSession, path: str) -> None:
    """Count a path as written here, so that it may be deleted."""
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)


def clean_up(spark: SparkSession) -> None:
    """Delete all tables that this application has written and not deleted.

    Results of queries are scans of such tables, so call it once they are read
    or written elsewhere."""
    delete(spark, written(spark))


def written(spark: SparkSession) -> list[str]:
    """Paths that ``materialize`` wrote in this application and are still there."""
    return list(_WRITTEN.get(spark.sparkContext.applicationId, []))


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables that ``materialize`` wrote; nothing may read them later."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    own = _WRITTEN.get(spark.sparkContext.applicationId, [])
    for p in paths:
        if p in own:
            path = jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(conf).delete(path, True)
            own.remove(p)


def release(df: DataFrame) -> None:
    """Delete the files of a table that ``materialize`` returned."""
    files = {f.rpartition("/")[0].rpartition("/")[2] for f in df.inputFiles()}
    delete(df.sparkSession, [p for p in written(df.sparkSession) if p.rpartition("/")[2] in files])
