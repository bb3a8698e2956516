"""What the operators share: tables, shared storage, rows packed against name clashes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset a local session gets one of its own; on a cluster that would lose data, so it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "local")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return found.rstrip("/")


def stored(df: DataFrame, name: str, scratch: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors.

    ``scratch`` collects the paths of tables that nothing needs once the result is written (see ``discard``).
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if scratch is not None:
        scratch.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, scratch: list[str]) -> None:
    """Delete stored tables by Hadoop's file system, whatever store the shared folder is in."""
    for name in scratch:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    scratch.clear()


def packed(df: DataFrame, **columns: Column) -> DataFrame:
    """The whole row as one struct ``row`` beside named working columns, so no column of the user's can clash."""
    return df.select(F.struct("*").alias("row"), *(c.alias(k) for k, c in columns.items()))


def held_out(id_col: str | Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text falls into the fold kept from training; a null id counts as empty text."""
    ids = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(ids.cast("string"), F.lit("")).cast("binary")) % folds == fold


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores appended until no column of ``df`` has it (whatever the case of its letters)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
