import pytest

from chaintrail import session


class Conf:
    def __init__(self, value):
        self.value = value

    def get(self, key, default=None):
        return self.value or default


class Context:
    applicationId = "app-1"

    def __init__(self, master):
        self.master = master


class Session:
    def __init__(self, master, folder=None):
        self.sparkContext, self.conf = Context(master), Conf(folder)


def test_scratch_folder_is_the_clusters():
    assert session.scratch_root(Session("spark://host:7077", "hdfs:///shared")) == "hdfs:///shared"
    assert session.new_scratch(Session("yarn", "hdfs:///shared"), "x").startswith("hdfs:///shared/chaintrail/app-1/x-")


def test_no_machine_local_folder_on_a_cluster():
    with pytest.raises(RuntimeError):
        session.scratch_root(Session("yarn"))


def test_local_master_keeps_one_temporary_folder():
    assert session.scratch_root(Session("local[2]")) == session.scratch_root(Session("local[2]"))


def test_discard_deletes_only_materialised_steps(spark):
    import os

    step = session.materialise(spark.range(3), "step")
    path = step._scratch_path.removeprefix("file:")
    assert step.count() == 3 and os.path.isdir(path)
    session.discard(spark.range(3), step)
    assert not os.path.exists(path)


def test_a_written_step_leaves_no_shuffle_files(spark):
    from glob import glob
    import os
    import time

    def files():
        folders = [spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()]
        return {f for folder in folders for d in folder for f in glob(os.path.join(d, "**", "shuffle_*"), recursive=True)}

    before, setting = files(), spark.conf.get(session.FREED, None)
    shuffled = spark.range(1000).repartition(3, "id")
    steps = [session.materialise(shuffled, "step"), session.bucketed(shuffled.groupBy("id").count(), ["id"], "step")]
    until = time.time() + 20
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before and spark.conf.get(session.FREED, None) == setting
    assert [step.count() for step in steps] == [1000, 1000]
    session.discard(*steps)
