"""Shared-folder resolution: session setting, context setting, local fallback only."""

import pytest

from firmscope.session import shared_dir


class _Conf:
    def __init__(self, value):
        self.value = value

    def get(self, key, default=None):
        return self.value if key == "spark.checkpoint.dir" else default


class _Ctx:
    def __init__(self, master, current=None):
        self.master, self.current = master, current

    def getCheckpointDir(self):
        return self.current

    def setCheckpointDir(self, path):
        self.current = "file:" + path + "/uuid"


class _Spark:
    def __init__(self, conf_value, master, current=None):
        self.conf, self.sparkContext = _Conf(conf_value), _Ctx(master, current)


def test_session_setting_wins():
    assert shared_dir(_Spark("hdfs://nn/shared/", "yarn")) == "hdfs://nn/shared"


def test_context_checkpoint_dir_is_used():
    assert shared_dir(_Spark(None, "yarn", "s3a://bucket/ck")) == "s3a://bucket/ck"


def test_local_master_falls_back_to_a_private_folder():
    s = _Spark(None, "local[8]")
    path = shared_dir(s)
    assert path.startswith("file:/") and s.sparkContext.current == path


def test_cluster_without_shared_folder_is_refused():
    with pytest.raises(RuntimeError):
        shared_dir(_Spark(None, "spark://master:7077"))
