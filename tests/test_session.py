import pytest

from corpusbrief import session


class Context:
    def __init__(self, master):
        self.master = master

    def getCheckpointDir(self):
        return None

    def setCheckpointDir(self, path):
        self.path = path


class Session:
    def __init__(self, master, folder=None):
        self.sparkContext = Context(master)
        self.conf = {} if folder is None else {"spark.checkpoint.dir": folder}


@pytest.mark.parametrize("master", ["local-cluster[2,1,1024]", "spark://h:7077", "yarn", "k8s://x"])
def test_no_machine_local_folder_on_a_cluster(master):
    with pytest.raises(RuntimeError):
        session.shared_dir(Session(master))
    assert session.shared_dir(Session(master, "hdfs://x/y")) == "hdfs://x/y"


def test_local_masters_may_use_one():
    assert session.is_local("local") and session.is_local("local[8]") and session.shared_dir(Session("local[2]"))
