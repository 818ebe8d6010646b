import pytest

from flowtree.session import shared_folder


class Fake:
    """As much of a session as the folder's choice reads."""

    def __init__(self, master, conf=None, made=None):
        self.master, self.made, self.set = master, made, []
        self.conf, self.sparkContext = self, self
        self.given = conf

    def get(self, name, default=None):
        return self.given or default

    def getCheckpointDir(self):
        return self.made

    def setCheckpointDir(self, folder):
        self.set.append(folder)


def test_the_folder_that_executors_share():
    assert shared_folder(Fake("yarn", conf="hdfs://x/y/")) == "hdfs://x/y"
    assert shared_folder(Fake("local-cluster[2,1,1024]", made="file:/z")) == "file:/z"
    own = Fake("local[4]")
    assert own.set == [shared_folder(own)]
    for master in ("yarn", "spark://h:7077", "k8s://h", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="checkpoint"):
            shared_folder(Fake(master))
