"""Session helpers shared by every module."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors can read: spark.checkpoint.dir, which a cluster sets, or the context's checkpoint folder.

    Only where neither is set and one machine runs everything a folder of this user is taken; a cluster without a
    shared folder is refused, since each executor would write to its own disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = given.get() if given.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + os.path.join(os.path.expanduser("~"), ".cache", "scanloom-checkpoints")
    return base.rstrip("/")


def settle(df: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later stages start from files that survive executors.

    The files are removed by ``release``, at the latest when the application ends.
    """
    spark = spark or df.sparkSession
    path = f"{shared_dir(spark)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    back = spark.read.schema(df.schema).parquet(path)
    back._settled = path
    return back


def release(df: DataFrame) -> None:
    """Remove the files of a settled table that nothing reads any more; other frames are left alone."""
    path = getattr(df, "_settled", None)
    if path:
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: Bytes of a side that is broadcast, measured as JSON.
BROADCAST_BYTES = 64 << 20


def fixed_side(df: DataFrame, max_rows: int, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast ``df`` if it is measured to have at most ``max_rows`` rows and ``max_bytes`` bytes; otherwise leave the join to shuffle."""
    from pyspark.sql import functions as F

    size = df.limit(max_rows + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0)).alias("b")).first()
    return F.broadcast(df) if size["n"] <= max_rows and size["b"] <= max_bytes else df


def once(df: DataFrame, key: str, most: int = 2_000_000) -> DataFrame:
    """``df`` with one row a key (a null is a key), for tables of which few rows come again: only these are shuffled.

    Keys that come twice are found on the key alone and broadcast if they are measured to be few; all other rows stay
    where they are.  Where many come again, all rows are shuffled by key.
    """
    from pyspark.sql import functions as F

    again = settle(df.groupBy(F.col(key).alias("__again")).agg(F.count("*").alias("n")).where("n > 1").select("__again"))
    side = fixed_side(again, most)
    if side is again:
        return df.dropDuplicates([key])
    same = F.col(key).eqNullSafe(F.col("__again"))
    return df.join(side, same, "left_anti").unionByName(df.join(side, same, "left_semi").dropDuplicates([key]))


_SHIPPED = "scanloom.shipped"
#: Rows of an Arrow batch, where the session has Spark's default: texts are long, and a worker holds a batch at once.
BATCH_ROWS = "2000"


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers: where they don't find it, it is added to the session as a zip.

    One small job a session asks the workers.  A cluster that installs the package, or shares its folder, gets nothing.
    """
    import tempfile
    import zipfile

    if spark.conf.get(_SHIPPED, "") == "yes":
        return
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)

    def ask(batches):
        import importlib.util

        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([importlib.util.find_spec("scanloom") is not None] * b.num_rows)], names=["there"])

    ask.__module__ = "__main__"  # sent as code, since the workers may not have this module
    answers = spark.range(0, 8, 1, 4).mapInArrow(ask, "there boolean").collect()
    if not all(r["there"] for r in answers):
        root = os.path.dirname(os.path.abspath(__file__))
        path = os.path.join(tempfile.mkdtemp(), "scanloom.zip")  # read by the driver alone, which serves it to the executors
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, names in os.walk(root):
                for n in names:
                    if n.endswith(".py"):
                        full = os.path.join(folder, n)
                        z.write(full, os.path.relpath(full, os.path.dirname(root)))
        spark.sparkContext.addPyFile(path)
    spark.conf.set(_SHIPPED, "yes")
