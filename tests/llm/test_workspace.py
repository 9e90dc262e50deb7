from __future__ import annotations

import os

from paylens.llm import content_sort_dedup, workspace
from tests.llm.conftest import make


def folders(spark):
    top = f"{workspace.shared_folder(spark)}/paylens-llm/{spark.sparkContext.applicationId}".removeprefix("file://")
    return set(os.listdir(top)) if os.path.isdir(top) else set()


def test_tables_of_an_operator_can_be_dropped_when_its_result_is_written(spark, tmp_path):
    before, point = folders(spark), workspace.mark()
    content_sort_dedup.exact_groups(make(spark, [(1, "a", "en", "s"), (2, "a", "en", "s")])).write.parquet(str(tmp_path / "out"))
    assert folders(spark) > before
    workspace.drop_since(spark, point)
    assert folders(spark) == before and spark.read.parquet(str(tmp_path / "out")).count() == 2
