"""Tables and small files in a folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where none is set, a temporary one if all executors are in this process (tests), else an error."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="vellumflow-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def new_path(spark: SparkSession, hint: str) -> str:
    return f"{shared_dir(spark)}/vf-{hint}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, hint: str = "t") -> DataFrame:
    """df, written and read back: later stages don't depend on executors' shuffle files."""
    path = new_path(df.sparkSession, hint)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder holds, sorted; none if there is no such folder."""
    where, fs = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def delete(spark: SparkSession, path: str) -> None:
    where, fs = _at(spark, path)
    fs.delete(where, True)


def create_file(spark: SparkSession, path: str, text: str) -> bool:
    """Creates a small file; False if there is one of this name already. Creation without overwriting is atomic on HDFS and local disks."""
    where, fs = _at(spark, path)
    try:
        out = fs.create(where, False)
    except Py4JJavaError:
        if fs.exists(where):
            return False
        raise
    try:
        out.write(bytearray(text, "utf-8"))
    finally:
        out.close()
    return True


def read_file(spark: SparkSession, path: str) -> str:
    """A small file's text."""
    return spark.read.text(path, wholetext=True).first()[0]
