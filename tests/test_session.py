import pytest

from spoofscope import session


class _Context:
    def __init__(self, master):
        self.master, self.set_to = master, None

    def getCheckpointDir(self):
        return self.set_to

    def setCheckpointDir(self, d):
        self.set_to = d


class _Conf:
    def get(self, key, default=None):
        return default


class _Spark:
    def __init__(self, master):
        self.sparkContext, self.conf = _Context(master), _Conf()


def test_a_cluster_without_a_shared_folder_is_an_error():
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            session.ensure_checkpoint_dir(_Spark(master))
    assert session.ensure_checkpoint_dir(_Spark("local[2]"))
