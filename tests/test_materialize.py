"""Tables in the shared folder."""

from __future__ import annotations

import os

from fernweft.materialize import clean_up, delete, materialize, new_path, release, shared_root, written


def test_tables_are_written_read_and_deleted(spark):
    first, second = materialize(spark.range(5), "one"), materialize(spark.range(0), "two")
    assert first.count() == 5 and second.count() == 0
    one, two = written(spark)[-2:]
    assert one.startswith(shared_root(spark)) and os.path.isdir(one.removeprefix("file://"))
    release(first)
    assert one not in written(spark) and not os.path.exists(one.removeprefix("file://"))
    delete(spark, [two, "/etc"])
    assert two not in written(spark) and os.path.isdir("/etc"), "only what was written here is deleted"


def test_paths_are_never_shared(spark):
    assert new_path(spark, "x") != new_path(spark, "x")


def test_clean_up_leaves_nothing(spark):
    path = materialize(spark.range(5), "three").inputFiles()[0].removeprefix("file://").rpartition("/")[0]
    assert os.path.isdir(path)
    clean_up(spark)
    assert written(spark) == [] and not os.path.exists(path)
