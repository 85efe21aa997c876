import os

import pytest

from quarry.errors import InvalidData
from quarry.sources import staging


def test_written_leaves_settings_as_they_were(spark):
    before = spark.conf.get(staging.CLEAN_UP, None)
    out = staging.written(spark.range(10).groupBy("id").count(), "t")
    assert out.count() == 10 and spark.conf.get(staging.CLEAN_UP, None) == before


def test_an_area_is_deleted_at_its_end(spark):
    folder = staging.shared_dir(spark)
    with staging.staging_area(spark) as area:
        staging.written(spark.range(3), "t")
        assert os.listdir(area)
    assert not os.path.exists(area) and staging.shared_dir(spark) == folder


def test_a_cluster_needs_a_shared_folder():
    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: {"spark.master": "yarn"}.get(key, default))

    with pytest.raises(InvalidData):
        staging.shared_dir(Session)
