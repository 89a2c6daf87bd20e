"""Session helpers."""

import zipfile

from tickerloom.session import scratch, ship


def test_ship(spark):
    assert "tickerloom/schema.py" in zipfile.ZipFile(ship(spark)).namelist()


def test_scratch_is_in_the_shared_folder(spark):
    first, second = scratch(spark), scratch(spark)
    assert first != second and first.startswith(spark.conf.get("spark.checkpoint.dir"))
