"""Tables in the folder that driver and executors share, for cutting lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Paths of the tables that write_table has made and drop_tables has not deleted, oldest first.
_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where none is set, a temporary one if all executors are in this process (tests), else an error."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="vellumflow-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def with_small_batches(df: DataFrame) -> DataFrame:
    """df, after bounding the Arrow batches of its session (for good, as plans read the settings when they run): texts may be long, and each worker and its JVM hold some batches outside the heap."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "2m")
    return df


def write_table(df: DataFrame, hint: str = "t", codec: str = "snappy") -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: later stages then no longer depend on executors' shuffle files."""
    path = f"{shared_dir(df.sparkSession)}/vf-{hint}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    df.write.parquet(path, compression=codec)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._vf_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
    if path in _WRITTEN:
        _WRITTEN.remove(path)


def drop_table(df: DataFrame) -> None:
    """Delete a table made by write_table that no later plan reads."""
    if path := getattr(df, "_vf_path", None):
        _delete(df.sparkSession, path)


def written() -> list[str]:
    """The tables that there are now; what an operator returns may read those that it made."""
    return list(_WRITTEN)


def drop_tables(spark: SparkSession, before: list[str], but: DataFrame) -> None:
    """Delete the tables made since `before` was taken, but for one: for when a result that read them is written itself."""
    for path in written():
        if path not in before and path != getattr(but, "_vf_path", None):
            _delete(spark, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
