import os
from types import SimpleNamespace

import pytest

from cairnflow.llm import common


def test_intermediates_are_deleted(spark, monkeypatch):
    monkeypatch.setattr(common, "_WRITTEN", [])
    rows = common.cut(spark.range(5), "some-rows")
    path = common._WRITTEN[0][1].removeprefix("file:")
    assert rows.count() == 5 and os.path.isdir(path)
    common.drop_intermediates()
    assert not os.path.exists(path) and common._WRITTEN == []


@pytest.mark.parametrize("master", ["local-cluster[2,1,900]", "spark://host:7077", "yarn", ""])
def test_a_cluster_needs_a_shared_folder(master):
    conf = {"spark.master": master}
    with pytest.raises(ValueError, match="share"):
        common.shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: conf.get(k, d))))
