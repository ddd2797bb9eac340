"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a session on one machine gets a temporary folder; on a cluster that is an error.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not sc._jsc.sc().getCheckpointDir().isDefined():
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="scorelake-"))
        base = sc._jsc.sc().getCheckpointDir().get()
    return base.rstrip("/")


def materialize(df: DataFrame, batch_bytes: int | None = None) -> DataFrame:
    """``df`` written as Parquet under :func:`shared_dir` and read back.

    For what several branches of a plan read: Python runs once, and a lost executor
    takes nothing along. With ``batch_bytes``, rows reach Python in batches bounded by bytes.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    if batch_bytes:
        spark.conf.set(name, str(batch_bytes))
    try:
        df.write.parquet(path)
    finally:
        if batch_bytes:
            spark.conf.unset(name) if before is None else spark.conf.set(name, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._table_path = path
    return out


def remove(*tables: DataFrame) -> None:
    """Deletes tables of :func:`materialize` that nothing reads any more: what was made of them has been written."""
    for df in tables:
        spark, path = df.sparkSession, df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._table_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
