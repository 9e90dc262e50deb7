"""Session settings: sizing, the master, the shared folder."""

from __future__ import annotations

import pytest

from paylens import session
from paylens.session import checkpoint_dir, scale_settings


def test_scale_settings_size_partitions_from_shuffle_volume():
    tb = 1024**4
    conf = scale_settings(20 * tb, cores=8000)
    assert int(conf["spark.sql.shuffle.partitions"]) == 20 * tb // (256 * 1024**2)
    assert scale_settings(1024, cores=8)["spark.sql.shuffle.partitions"] == "16"


class _Builder:
    """Records what ``build_session`` sets; stands in for the session as well."""

    def __init__(self):
        self.set, self.sparkContext = {}, self

    def appName(self, name):
        return self

    def master(self, master):
        return self.config("master", master)

    def config(self, key, value):
        self.set[key] = value
        return self

    def getOrCreate(self):
        return self

    def setLogLevel(self, level):
        pass


@pytest.mark.parametrize("master", [None, "local[3]"])
def test_master_is_set_only_when_given(monkeypatch, master):
    class Session:
        builder = _Builder()

    monkeypatch.setattr(session, "SparkSession", Session)
    made = session.build_session(master=master)
    assert made.set.get("master") == master
    assert ("spark.driver.memory" in made.set) == (master is not None)


def test_an_unset_shared_folder_is_an_error(spark):
    class Conf:
        def get(self, key, default):
            return default

    class Bare:
        conf = Conf()

    with pytest.raises(RuntimeError):
        checkpoint_dir(Bare())
    if spark.conf.get("spark.checkpoint.dir", None):
        assert checkpoint_dir(spark) == spark.conf.get("spark.checkpoint.dir")
