from types import SimpleNamespace

import pytest

from tallyforge.scratch import saved, scratch_path, shared_dir


def test_local_sessions_keep_one_folder(spark):
    assert shared_dir(spark) == shared_dir(spark) and scratch_path(spark, "x") != scratch_path(spark, "x")
    assert saved(spark.range(3), "three").count() == 3


def test_a_cluster_without_a_shared_folder_is_an_error():
    context = SimpleNamespace(getConf=lambda: {}, master="spark://host:7077", applicationId="a")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(SimpleNamespace(sparkContext=context))
    context.getConf = lambda: {"spark.checkpoint.dir": "hdfs://x/y"}
    assert shared_dir(SimpleNamespace(sparkContext=context)) == "hdfs://x/y"
