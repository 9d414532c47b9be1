"""Scratch tables and the shared folder."""

import os
from types import SimpleNamespace

import pytest

from epicell.session import scratch, settle, shared_dir, together


def test_scratch_is_removed_also_from_threads(spark):
    with scratch(spark):
        frames = together(lambda: settle(spark.range(3), "a"), lambda: settle(spark.range(4), "b"))
        assert [f.count() for f in frames] == [3, 4]
        files = [f.inputFiles()[0].removeprefix("file://") for f in frames]
        assert all(os.path.exists(f) for f in files)
    assert not any(os.path.exists(f) for f in files)
    kept = settle(spark.range(2), "c")
    assert kept.count() == 2


def test_scratch_is_removed_after_an_error(spark):
    with pytest.raises(RuntimeError), scratch(spark):
        path = settle(spark.range(3), "a").inputFiles()[0].removeprefix("file://")
        raise RuntimeError("job failed")
    assert not os.path.exists(path)


def named(master, folder):
    """Just enough of a session to ask for its shared folder."""
    get = lambda key, default: folder if key == "spark.checkpoint.dir" and folder else default
    return SimpleNamespace(conf=SimpleNamespace(get=get), sparkContext=SimpleNamespace(master=master))


def test_shared_folder_comes_from_the_session():
    assert shared_dir(named("yarn", "hdfs:///shared/"), "x").startswith("hdfs:///shared/x-")
    assert shared_dir(named("local[4]", "hdfs:///shared"), "x").startswith("hdfs:///shared/x-")


def test_no_machine_local_folder_on_a_cluster():
    with pytest.raises(ValueError):
        shared_dir(named("spark://host:7077", None), "x")
