"""Session set-up and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SCRATCH_CONF = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benches; clusters bring their own settings."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("corpus_spark")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A folder set on the context counts too. Only a local session may fall back
    to a temporary folder of this machine.
    """
    context = spark.sparkContext
    root = spark.conf.get(SCRATCH_CONF, None) or context.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not (context.master == "local" or context.master.startswith("local[")):
        raise RuntimeError(f"set {SCRATCH_CONF} to a folder that every executor can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="corpus_spark-"))
    return context.getCheckpointDir()


def _scratch_folder(spark: SparkSession) -> str:
    return f"{scratch_root(spark)}/corpus_spark/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    path = f"{_scratch_folder(spark)}/{label}-{uuid.uuid4().hex}"
    for made in _scopes:
        made.append(path)
    return path


_scopes: list[list[str]] = []


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Delete the scratch tables made inside, at the end; nothing built on them may be used later."""
    made: list[str] = []
    _scopes.append(made)
    try:
        yield
    finally:
        _scopes.remove(made)
        for path in made:
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def drop_scratch(spark: SparkSession) -> bool:
    """Delete what this application wrote below the shared folder.

    Call it at the end of a job, when no table built on it is needed any more.
    """
    return _delete(spark, _scratch_folder(spark))


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage, so that later jobs neither recompute the input nor depend
    on an executor that held it.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
