"""Session, table access and lineage cuts shared by all operators."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "lodeweave", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine expects.

    Explicit settings win; sizes (memory, cores, shuffle partitions) are left
    to the cluster unless given.
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    return builder.config(map=settings).getOrCreate()


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data directory (a file or a folder of part files)."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Only in local mode, as in tests, is a temporary one made where that is
    unset; on a cluster a machine-local folder would lose data, so that raises.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and context.master.partition("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="lodeweave-"))
    return context.getCheckpointDir()


@contextmanager
def dropping_shuffles(spark: SparkSession):
    """Shuffle files of what is run inside are dropped as soon as its result is there."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder; reliable checkpoints survive the loss of executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder, for what is read by columns or more than once.

    Shuffle files that it took are dropped. ``forget`` removes the table again.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    with dropping_shuffles(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def forget(table: DataFrame) -> None:
    """Remove a table made by ``written`` that nothing will read any more."""
    jvm = table.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(table._written_at)
    path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
