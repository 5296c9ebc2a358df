"""Session helpers: shared folder, materialised tables and table reading."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    It is the cluster's ``spark.checkpoint.dir``. Only where that is unset (tests, a single machine) a temporary
    folder is made and set.
    """
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if set_dir:
        return set_dir.rstrip("/")
    known = getattr(spark.sparkContext, "_parleylake_dir", None)
    if known is None:
        known = "file://" + tempfile.mkdtemp(prefix="parleylake-")
        spark.sparkContext._parleylake_dir = known
    return known


def new_path(spark: SparkSession, name: str) -> str:
    """A path not used before under the shared folder, in a folder of this session."""
    context = spark.sparkContext
    if not hasattr(context, "_parleylake_session"):
        context._parleylake_session = f"{shared_dir(spark)}/parleylake/{context.applicationId}-{uuid.uuid4().hex[:8]}"
    return f"{context._parleylake_session}/{name}-{uuid.uuid4().hex}"


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once a session, as an archive in the shared folder.

    Python workers only find what lies on their own path, which need not be the driver's.
    """
    context = spark.sparkContext
    if getattr(context, "_parleylake_shipped", False):
        return
    here, packed = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, str(f.relative_to(here.parent)))
    target = f"{shared_dir(spark)}/parleylake-code/{uuid.uuid4().hex}/parleylake.zip"
    at = context._jvm.org.apache.hadoop.fs.Path(target)
    out = at.getFileSystem(context._jsc.hadoopConfiguration()).create(at)
    out.write(bytearray(packed.getvalue()))
    out.close()
    context.addPyFile(target)
    context._parleylake_shipped = True


def clear(spark: SparkSession) -> None:
    """Delete the tables this session has written to the shared folder; results not yet read from them are lost."""
    made = getattr(spark.sparkContext, "_parleylake_session", None)
    if made:
        remove(spark, made)


def materialise(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage, survives the loss of executors and keeps columns prunable, which ``checkpoint()`` does not.
    """
    path = new_path(df.sparkSession, name)
    writer = df.write.mode("errorifexists").option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path) if not partition_by else df.sparkSession.read.parquet(path)


def input_bytes(df: DataFrame) -> int:
    """The bytes that the sources of ``df`` hold, by the optimizer's statistics; sources of unknown size count as 0."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = (int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    return sum(x for x in sizes if x < 1 << 60)


def parts_for(df: DataFrame, bytes_per_part: int = 64 << 20) -> int:
    """A number of partitions for ``df`` that grows with its sources, at least ``spark.sql.shuffle.partitions``.

    For the places where the number is fixed when the plan is made, which adaptive execution may not change.
    """
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-input_bytes(df) // bytes_per_part))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path written by this library."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small new file; one that is there already raises an error, so of two writers only one succeeds."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, False)
    out.write(bytearray(text.encode()))
    out.close()


def names_in(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, in order; none where there is no folder."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
