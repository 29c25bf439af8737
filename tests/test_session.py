import pytest

from tillscope import session


def test_the_named_folder_is_used():
    class Conf:
        def get(self, key, default=None):
            return "hdfs://shared/ckpt/" if key == "spark.checkpoint.dir" else default

    class Session:
        conf = Conf()

    assert session.stage_path(Session(), "t").startswith("hdfs://shared/ckpt/tillscope/")


def test_cluster_without_a_shared_folder_is_refused():
    class Conf:
        def get(self, key, default=None):
            return "spark://host:7077" if key == "spark.master" else default

    class Context:
        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        session.shared_dir(Session())


@pytest.mark.parametrize("shared", ["false", "true"])
def test_a_folder_of_one_machine_is_refused_on_a_cluster(shared):
    class Conf:
        def get(self, key, default=None):
            given = {"spark.master": "spark://h:7077", "spark.checkpoint.dir": "file:/mnt/x", "spark.tillscope.sharedMount": shared}
            return given.get(key, default)

    class Session:
        conf = Conf()

    if shared == "true":
        assert session.shared_dir(Session()) == "file:/mnt/x"
    else:
        with pytest.raises(RuntimeError):
            session.shared_dir(Session())


def test_release_removes_what_was_staged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_dir", lambda spark: str(tmp_path))
    assert session.stage(spark.range(3), "t").count() == 3
    assert list((tmp_path / "tillscope").iterdir())
    session.release(spark)
    assert not list((tmp_path / "tillscope").iterdir())


def test_staged_result_is_broadcast_by_its_size(spark):
    small = session.stage(spark.range(5), "small")
    plan = spark.range(10_000_000).join(small, "id")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


def test_a_task_reads_no_more_than_it_can_hold():
    """Larger sizes are lowered, in whatever unit they are given; smaller ones are the cluster's and stay."""

    class Conf(dict):
        set = dict.__setitem__

    class Session:
        conf = Conf({"spark.sql.files.maxPartitionBytes": "134217728b", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64MB"})

    session.configure(Session())
    assert {k: Session.conf[k] for k in session.TASK_SIZES} == session.TASK_SIZES
    small = {"spark.sql.files.maxPartitionBytes": "8m", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1048576"}
    Session.conf.update(small)
    session.configure(Session())
    assert {k: Session.conf[k] for k in small} == small
