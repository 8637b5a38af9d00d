"""Session helpers: reliable checkpoints, sizing, checked broadcasts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructType

#: Rows up to which a dimension may be broadcast; beyond it joins shuffle.
BROADCAST_ROWS = 200_000
#: Bytes of all their values together, up to which they may be.
BROADCAST_BYTES = 32 << 20


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder for reliable checkpoints.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master may
    fall back to a temporary folder, because no other machine has to read it.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="plenaria-checkpoint-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    context.setCheckpointDir(named)
    return named


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` in the shared folder; its partitions stay as they are."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the checkpoint folder, removed when the application ends."""
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the checkpoint folder: lineage is cut, and later passes read the columns they need.

    The table is removed when the application ends.
    """
    path = scratch(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(scan: DataFrame) -> DataFrame:
    """The rows of a scan over as many partitions as a shuffle has, where its files give fewer than half as many.

    A small file is one partition, and work on its texts would be one task; a large table has partitions enough and stays as it
    is. For plain scans only: the number is asked of the plan, which must not have to run.
    """
    parts = shuffle_partitions(scan.sparkSession)
    return scan.repartition(parts) if 2 * scan.rdd.getNumPartitions() < parts else scan


def _bytes(df: DataFrame) -> Column:
    """About how many bytes a row's values take."""
    sizes = F.lit(0)
    for field in df.schema.fields:
        own = F.col(f"`{field.name}`")
        kind = field.dataType
        if isinstance(kind, (StringType, BinaryType)):
            size = F.octet_length(own)
        elif isinstance(kind, (ArrayType, MapType, StructType)):
            size = F.octet_length(F.to_json(F.struct(own)))
        else:
            size = F.lit(8)
        sizes = sizes + F.coalesce(size, F.lit(0))
    return sizes.cast("long")


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint only where it is proven to have at most ``limit`` rows and ``most_bytes``.

    The proof reads ``limit + 1`` rows at most. A larger side is returned without
    a hint: the join then shuffles, and adaptive execution splits skewed keys.
    """
    found = df.select(_bytes(df).alias("b")).limit(limit + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("b"), F.lit(0)).alias("b")).first()
    return F.broadcast(df) if found["n"] <= limit and found["b"] <= most_bytes else df
