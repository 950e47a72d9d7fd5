"""Where intermediates are written."""

from types import SimpleNamespace

import pytest

from tokenledger.session import run_dir


def session(master, **settings):
    conf = SimpleNamespace(get=lambda key, *default: settings.get(key, *default) if default else settings[key])
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, applicationId="app"))


def test_the_run_folder_is_shared():
    checkpoint, warehouse = "spark.checkpoint.dir", "spark.sql.warehouse.dir"
    shared = {checkpoint: "file:/mnt/shared/", warehouse: "file:/home/me/warehouse"}
    assert run_dir(session("yarn", **shared)) == "file:/mnt/shared/tokenledger/app"
    assert run_dir(session("spark://host:7077", **{warehouse: "s3a://b/w"})) == "s3a://b/w/tokenledger/app"
    for master in ("local", "local[8]"):
        assert run_dir(session(master, **{warehouse: "file:/w"})) == "file:/w/tokenledger/app"
    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,1024]"):
        for folder in ("file:/w", "/w"):
            with pytest.raises(Exception, match="checkpoint.dir"):
                run_dir(session(master, **{warehouse: folder}))
