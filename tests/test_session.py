"""The folder of intermediate tables."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark.session import job, new_folder, shared_dir, written


def tables(spark):
    return sorted(p.name for p in Path(shared_dir(spark)).iterdir() if p.name.startswith(("one-", "two-", "job-")))


def test_a_job_leaves_its_result_alone(spark, tmp_path):
    before = tables(spark)
    with job(spark) as folder:
        one = written(spark.range(5).withColumn("x", F.col("id") * 2), "one")
        with job(spark) as inner:
            written(one, "two", compression="zstd")
            assert new_folder(spark, "y").startswith(f"{inner}/y-")
        assert Path(folder).exists() and not Path(inner).exists()
        one.write.parquet(str(tmp_path / "out"))
    assert tables(spark) == before and not Path(folder).exists()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5
    assert not new_folder(spark, "z").startswith(folder)


def test_a_job_that_fails_leaves_nothing(spark):
    before = tables(spark)
    with pytest.raises(ZeroDivisionError), job(spark):
        written(spark.range(1), "one")
        raise ZeroDivisionError
    assert tables(spark) == before
