"""Checkpoint-directory rule: the session's setting wins; only local mode may
fall back to a scratch folder; a cluster without a setting is an error."""

import pytest

from tidemark.session import ensure_checkpoint_dir


class _Conf:
    def __init__(self, value):
        self.value = value

    def get(self, key, default=None):
        return self.value if key == "spark.checkpoint.dir" else default


class _Context:
    def __init__(self, master, current=None, configured=None):
        self.master, self.current, self.conf, self.set_to = master, current, _Conf(configured), None

    def getCheckpointDir(self):
        return self.current

    def getConf(self):
        return self.conf

    def setCheckpointDir(self, path):
        self.set_to = self.current = path


class _Session:
    def __init__(self, context):
        self.sparkContext = context


def test_existing_setting_wins():
    ctx = _Context("yarn", current="hdfs://shared/ckpt")
    assert ensure_checkpoint_dir(_Session(ctx)) == "hdfs://shared/ckpt" and ctx.set_to is None


def test_configured_dir_is_applied():
    ctx = _Context("k8s://api", configured="s3a://bucket/ckpt")
    assert ensure_checkpoint_dir(_Session(ctx)) == "s3a://bucket/ckpt"


def test_cluster_without_setting_is_an_error():
    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(_Session(_Context("spark://master:7077")))


def test_local_mode_gets_a_scratch_folder():
    ctx = _Context("local[2]")
    path = ensure_checkpoint_dir(_Session(ctx))
    assert path and ctx.set_to == path


def test_local_cluster_is_a_cluster():
    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(_Session(_Context("local-cluster[2,1,1024]")))
