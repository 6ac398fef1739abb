"""Tables in the folder that driver and executors share, and broadcasts of tables whose size is known."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_stored_at: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where that is unset, a local session gets a folder of its own; a cluster needs the setting.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tallyhouse-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stored(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: later steps neither
    recompute it nor depend on the executors that made it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    found = spark.read.schema(df.schema).parquet(path)
    _stored_at[found] = path
    return found


def discard(*tables: DataFrame) -> None:
    """Delete what ``stored`` wrote for ``tables``; nothing that is still to run may read them."""
    for df in tables:
        if path := _stored_at.pop(df, None):
            context = df.sparkSession.sparkContext
            place = context._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def small(df: DataFrame, most_bytes: int = 16 << 20, row_bytes: int = 64) -> DataFrame:
    """``df`` (cheap to count, as it was stored) with a broadcast hint if its rows take at most
    ``most_bytes``; beyond that the same join shuffles."""
    return F.broadcast(df) if df.count() * row_bytes <= most_bytes else df
