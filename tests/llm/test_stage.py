import os

import pytest

from ledgerloom.llm.common import Stage


@pytest.mark.parametrize("scheme", ["", "file:", "file://"])
def test_dropped_tables_are_gone(spark, tmp_path, monkeypatch, scheme):
    monkeypatch.setattr("ledgerloom.llm.common.shared_dir", lambda _: f"{scheme}{tmp_path}")
    stage = Stage(spark, "x")
    kept, gone = stage.write(spark.range(3), "kept"), stage.write(spark.range(3), "gone")
    stage.drop(gone, spark.range(1))
    left = os.listdir(stage.root.removeprefix(scheme))
    assert kept.count() == 3 and len(left) == 1 and left[0].startswith("kept")
