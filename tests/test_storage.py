"""Where tables between steps go."""

from types import SimpleNamespace

import pytest

from proofgrid.storage import scratch_root


def session(master, folder=None):
    conf = SimpleNamespace(get=lambda key, default=None: folder)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, getConf=lambda: conf))


def test_a_shared_folder_is_asked_for_on_a_cluster():
    assert scratch_root(session("spark://a:7077", "s3://x/y/")) == "s3://x/y"
    assert scratch_root(session("local[8]")).startswith("file://")
    for master in ("yarn", "spark://a:7077", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError):
            scratch_root(session(master))


def test_discarded_tables_are_gone(spark):
    from proofgrid.storage import discard, stage

    df = stage(spark.range(5), "some table")
    assert df.count() == 5
    discard(df, spark.range(1))
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|FILE_NOT_EXIST"):
        spark.read.parquet(df.staged_path).count()
