"""The session, and the folder that all machines of a cluster share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "tidemark", **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow; ``conf`` adds settings, with dots as double underscores."""
    builder = SparkSession.builder.appName(name)
    settings = {"spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    for key, value in {**settings, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset, which is allowed on one machine alone, one made once."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        place = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place


#: The setting that names the folder of the job that runs, if there is one.
_JOB = "tidemark.job"


def new_folder(spark: SparkSession, name: str) -> str:
    """The path of a new folder below the shared one, or below that of the ``job`` that runs."""
    return f"{spark.conf.get(_JOB, None) or shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def job(spark: SparkSession) -> Iterator[str]:
    """Gives a folder below which all intermediate tables are written that are made inside, and removes it at the end. Results
    that are wanted later must have been written elsewhere by then, as they read these tables when they run."""
    before, folder = spark.conf.get(_JOB, None), f"{shared_dir(spark)}/job-{uuid.uuid4().hex}"
    spark.conf.set(_JOB, folder)
    try:
        yield folder
    finally:
        if before is None:
            spark.conf.unset(_JOB)
        else:
            spark.conf.set(_JOB, before)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: what several branches of a plan need is computed once,
    and lost executors cost no more than what they were at."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of an Arrow batch that goes to Python: rows differ in size by orders of magnitude, so a count of rows bounds nothing.
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def bounded_batches(spark: SparkSession) -> None:
    """Sets the session's limit on the bytes of Arrow batches, unless one is set."""
    key, most = BATCH_BYTES
    if spark.conf.get(key, None) in (None, str((1 << 31) - 1)):
        spark.conf.set(key, most)
