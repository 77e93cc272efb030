"""Intermediate tables in the folder that driver and executors share.

A cut ends the lineage: what follows reads files that outlive any executor, and no task recomputes the steps before.
"""

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Setting of the session that holds the folder made where spark.checkpoint.dir is unset.
OWN_DIR = "spark.marlstone.scratch"
#: Attribute of a frame that :func:`cut` returns: where its files lie.
PATH = "_marlstone_scratch"
#: Begins the names of tables that :func:`cut` makes of frames with a key.
TABLE = "marlstone_scratch_"
_written: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where that is unset, a temporary folder if all runs on one machine, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(OWN_DIR, None)
    if not found:
        master = spark.conf.get("spark.master", "local")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='marlstone-')}"
        spark.conf.set(OWN_DIR, found)
    return found.rstrip("/")


def cut(df: DataFrame, name: str = "cut", key: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet below :func:`shared_dir` and read it back. Files go with :func:`free`, :func:`clear` or the driver.

    With ``key`` it is a table in buckets by that column: joins on it move the other side alone.
    """
    spark, mark = df.sparkSession, uuid.uuid4().hex
    path = f"{shared_dir(spark)}/{name}-{mark}"
    if key is None:
        df.write.parquet(path)
        frame = spark.read.schema(df.schema).parquet(path)
    else:
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        df.write.format("parquet").bucketBy(buckets, key).option("path", path).saveAsTable(TABLE + mark)
        frame = spark.table(TABLE + mark)
    _written[path] = spark
    setattr(frame, PATH, path)
    return frame


def delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        spark.sql(f"DROP TABLE IF EXISTS {TABLE}{path.rsplit('-', 1)[1]}")
    with contextlib.suppress(Exception):
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def free(*frames: DataFrame | None) -> None:
    """Delete the files of cut frames that nothing reads any more; other frames and None are left alone."""
    for frame in frames:
        path = getattr(frame, PATH, None)
        if path in _written:
            delete(_written.pop(path), path)


def clear() -> None:
    """Delete all that :func:`cut` has written in this process; frames that read it can't be used any more."""
    while _written:
        path, spark = _written.popitem()
        delete(spark, path)


atexit.register(clear)
