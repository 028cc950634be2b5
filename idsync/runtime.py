"""Session plumbing shared by every operator: checkpoint folder, code shipping, scratch paths."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def checkpoint_dir(spark: SparkSession) -> str:
    """Folder that all executors share.

    The cluster names it in ``spark.checkpoint.dir``; only a local session without
    that setting (tests, the bench) falls back to a temporary folder of this machine.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
        where = "file://" + tempfile.mkdtemp(prefix="idsync-")
        spark.conf.set("spark.checkpoint.dir", where)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(where)
    return where


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder for a table that one run writes and reads again."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _file(spark: SparkSession, path: str):
    """A path and its file system, as the JVM sees them."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, files = _file(spark, path)
    return files.exists(where)


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes of a file or of all files of a folder."""
    where, files = _file(spark, path)
    return files.getContentSummary(where).getLength()


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written to the shared folder and read again, and its path, to be removed when it is no longer read."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that is no longer read."""
    where, files = _file(spark, path)
    files.delete(where, True)


def tasks(spark: SparkSession) -> int:
    """A number of partitions for work that is heavier than its bytes show."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers that don't share the driver's path, by way of the shared folder."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root, packed = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    target = f"{scratch(spark, 'code')}/idsync_code.zip"
    path, files = _file(spark, target)
    out = files.create(path)
    out.write(packed.getvalue())
    out.close()
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(app)
