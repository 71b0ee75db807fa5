import os

import pytest

from foliant.llm import runtime


def test_written_tables_and_clean_up(spark):
    df = runtime.materialise(spark.range(5), "numbers")
    assert sorted(r.id for r in df.collect()) == [0, 1, 2, 3, 4]
    folder = runtime._own_dir(spark).removeprefix("file://")
    assert os.path.isdir(folder) and runtime.fresh_path(spark, "x") != runtime.fresh_path(spark, "x")
    runtime.clean_up(spark)
    assert not os.path.exists(folder)


def test_a_cluster_needs_a_shared_folder():
    class Conf(dict):
        get = dict.get

    class Context:
        master = "spark://host:7077"
        getConf = lambda self: Conf()
        getCheckpointDir = lambda self: None

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        runtime.shared_dir(Session())
