from types import SimpleNamespace

import pytest

from jobtrails import session as S


class _Conf:
    def get(self, key, default=None):
        return default

    def set(self, key, value):
        raise AssertionError("no temporary folder may be registered on a cluster")


def test_cluster_without_checkpoint_dir_raises():
    cluster = SimpleNamespace(conf=_Conf(), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        S.checkpoint_dir(cluster)


def test_stage_paths_differ(spark):
    a, b = S.stage_path(spark, "x"), S.stage_path(spark, "x")
    assert a != b and len(a.rsplit("-", 1)[1]) == 32
