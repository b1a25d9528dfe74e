import pytest

from corpusloom.sources import staging


class Conf(dict):
    get = dict.get


class Session:
    def __init__(self, **conf):
        self.conf = Conf({k.replace("_", "."): v for k, v in conf.items()})


def test_a_cluster_needs_a_shared_folder():
    assert staging.shared_dir(Session(spark_checkpoint_dir="hdfs://x/y/", spark_master="yarn")) == "hdfs://x/y"
    for master in ("yarn", "local-cluster[3,2,1024]", "spark://host:7077", "k8s://x"):
        with pytest.raises(RuntimeError, match="checkpoint"):
            staging.shared_dir(Session(spark_master=master))
    assert staging.shared_dir(Session(spark_master="local[4]")).startswith("file:")


def test_scopes_remove_what_they_staged(spark):
    there = lambda path: staging._file_system(spark, path)[0].exists(staging._file_system(spark, path)[1])
    with staging.scope(spark):
        with staging.scope(spark) as keep:
            gone, kept = staging.staged(spark.range(3), "a"), staging.staged(spark.range(4), "b")
            keep(kept._staged_path)
            assert gone.count() == 3
        assert not there(gone._staged_path) and kept.count() == 4
    assert not there(kept._staged_path)
    free = staging.staged(spark.range(2), "c")
    assert free.count() == 2
    staging.drop(free)
    assert not there(free._staged_path)
