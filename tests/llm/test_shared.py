import os

import pytest

from bullgauge.llm import shared


def test_tables_are_cleared(spark):
    t = shared.written(spark, spark.range(3).toDF("id"), "three")
    path = shared._MADE[-1].removeprefix("file://")
    assert t.count() == 3 and os.path.isdir(path)
    shared.clear(spark)
    assert not os.path.exists(path) and not shared._MADE


def test_a_cluster_must_name_its_folder():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(Session())
