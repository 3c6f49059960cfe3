"""Session settings and the staging folder for cutting lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and the bench; a cluster brings its own settings."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("barsift")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        # Wide projections compile to methods too large for the JIT; split them instead.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def staging_root(spark: SparkSession) -> str:
    """Shared folder named by ``spark.checkpoint.dir``; a temporary one where it is unset and Spark runs locally."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def _stages(spark: SparkSession) -> str:
    return f"{staging_root(spark)}/stages-{spark.sparkContext.applicationId}"


#: Folders of the tables staged while ``settled`` makes its own.
_passing: ContextVar[list[str] | None] = ContextVar("_passing", default=None)


def staged(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where several branches of one plan must see the same rows: the upstream
    work runs once, and a lost executor never has to recompute it. The tables of a session lie in
    one folder, which ``drop_stages`` removes once their results are written.
    """
    path = f"{_stages(df.sparkSession)}/{uuid.uuid4().hex}"
    if (passing := _passing.get()) is not None:
        passing.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(make: Callable[[], DataFrame]) -> DataFrame:
    """``make()``, staged; the tables that it staged on its way are removed then, so nothing else may read them."""
    passed: list[str] = []
    token = _passing.set(passed)
    try:
        df = make()
    finally:
        _passing.reset(token)
    out = staged(df)
    for path in passed:
        _remove(df.sparkSession, path)
    return out


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_stages(spark: SparkSession) -> None:
    """Remove every table that this session has staged; results that still read them must be written before."""
    _remove(spark, _stages(spark))
