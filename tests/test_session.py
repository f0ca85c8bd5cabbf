"""The scratch folder and the domain cache."""

from types import SimpleNamespace

import pytest

from leaserisk import session
from leaserisk.sources.driver import domain


def test_a_cluster_without_a_shared_folder_raises():
    sc = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None, applicationId="x")
    spark = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: default), sparkContext=sc)
    with pytest.raises(ValueError):
        session.checkpoint_dir(spark)
    sc.master = "local-cluster[2,1,1024]"
    with pytest.raises(ValueError):
        session.checkpoint_dir(spark)


def test_scratch_paths_are_fresh_and_under_the_shared_folder(spark):
    a, b = session.scratch_path(spark, "t"), session.scratch_path(spark, "t")
    assert a != b and a.startswith(session.checkpoint_dir(spark))


def test_files_added_later_are_read(spark, tmp_path):
    rows = spark.createDataFrame([(1, "click")], "event_id long, event_type string")
    rows.write.parquet(f"{tmp_path}/events.parquet")
    first = domain(spark, str(tmp_path))
    assert first.raw("events").count() == 1 and domain(spark, str(tmp_path)) is first
    rows.write.mode("append").parquet(f"{tmp_path}/events.parquet")
    assert domain(spark, str(tmp_path)).raw("events").count() == 2
