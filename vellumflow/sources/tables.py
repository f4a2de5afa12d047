"""Sources and sinks: encounters, gold facts, aliases, files, chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T

SPLITS = ("train", "validation", "test")
ENCOUNTERS = "encounter_id string, dataset string, dialogue string, note string, augmented_note string"
EVIDENCE = "struct<utt_ids:array<int>,spans:array<struct<text:string,start:int,end:int>>>"
GOLD = "encounter_id string, source_type string, gold struct<demographics:map<string,string>, meds:array<struct<name_norm:string,assertion:string,dose:string,freq:string>>, allergies:array<struct<substance_norm:string,assertion:string,reaction:string>>, vitals:array<struct<kind:string,value:string>>>"


def encounters(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Encounters as Parquet partitioned by split; with a split only its files are read. Missing texts become empty, a missing id `unknown`."""
    df = spark.read.parquet(path)
    df = df if split is None else df.filter(F.col("split") == split)
    if "augmented note" in df.columns:
        df = df.withColumnRenamed("augmented note", "augmented_note")
    return df.withColumns({c: F.coalesce(c, F.lit("unknown" if c == "encounter_id" else "")) for c in df.columns if df.schema[c].dataType.simpleString() == "string" and c != "split"})


def dialogues(df: DataFrame, most: int | None = None, notes: bool = False) -> DataFrame:
    out = df.select("encounter_id", "dialogue", "dataset", *(("note", "augmented_note") if notes else ()))
    return out.orderBy("encounter_id").limit(most) if most else out


def encounter(df: DataFrame, encounter_id: str) -> DataFrame:
    """One encounter, sought in test, then validation, then train."""
    rank = F.when(F.col("split") == "test", 0).when(F.col("split") == "validation", 1).otherwise(2)
    return df.filter(F.col("encounter_id") == encounter_id).orderBy(rank).limit(1)


def gold(spark: SparkSession, path: str) -> DataFrame:
    """Gold facts from JSON lines, one column for each part; malformed and blank lines are left out."""
    df = spark.read.schema(GOLD).option("mode", "DROPMALFORMED").json(path)
    return df.select("encounter_id", "source_type", "gold.*")


def malformed_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines that gold() leaves out."""
    df = spark.read.text(path).filter(T.strip(F.col("value")) != "")
    return df.filter(F.try_parse_json("value").isNull())


def aliases(spark: SparkSession, path: str) -> DataFrame:
    """Headerless TSV of (name, code, generic); names in lower case; of repeated names the last line holds."""
    lines = spark.read.text(path).select(F.split("value", "\t").alias("p"), F.monotonically_increasing_id().alias("ord"))
    rows = lines.filter(F.size("p") >= 3).select(T.strip(F.lower(F.get("p", F.lit(0)))).alias("name"), F.get("p", F.lit(1)).alias("rxcui"), T.strip(F.get("p", F.lit(2))).alias("generic"), "ord").filter("name != ''")
    last = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("ord")))
    return rows.withColumn("_r", last).filter("_r = 1").drop("_r", "ord")


def files(spark: SparkSession, path: str, endings: tuple[str, ...] = ("pdf", "epub")) -> DataFrame:
    """(path, corpus, title, sha256, content) of files below a folder; the corpus is the name of the file's folder."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    df = df.filter(F.lower("path").rlike(r"\.(" + "|".join(endings) + ")$"))
    return df.select("path", F.element_at(F.split("path", "/"), -2).alias("corpus"), F.translate(F.regexp_extract("path", r"([^/]+)\.[^.]+$", 1), "_", " ").alias("title"), F.sha2("content", 256).alias("sha256"), "content")


def parsed(df: DataFrame, parse, schema: str) -> DataFrame:
    """Runs a parser over binary content: parse(bytes) gives rows; for PDF text, audio transcripts and the like."""

    def run(frames):
        import pandas as pd

        for frame in frames:
            yield pd.DataFrame([(path, *row) for path, content in zip(frame["path"], frame["content"], strict=True) for row in parse(content)], columns=["path", *[p.split()[0] for p in schema.split(",")]])

    return df.select("path", "content").mapInPandas(run, f"path string, {schema}")


def write_json(df: DataFrame, path: str, by: str | None = None) -> None:
    """JSON lines; with by, a folder for each of its values."""
    (df.write.partitionBy(by) if by else df.write).mode("overwrite").json(path)


def write_chunks(df: DataFrame, path: str) -> None:
    """The chunk table with idx, each row's place in its corpus by doc_id and position, partitioned by corpus.

    Rows are sorted by range over all tasks; a row's place is that in its task plus the number of the corpus's rows in tasks before, so
    that no corpus has to pass through one task. The counts are as many as tasks and corpora.
    """
    order = ["corpus", "doc_id", "position"]
    sorted_path = path.rstrip("/") + ".sorted"
    numbered = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_task", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    # Written, as the numbers of tasks hold for one run of them only.
    numbered.write.mode("overwrite").parquet(sorted_path)
    rows = df.sparkSession.read.parquet(sorted_path)
    counts = rows.groupBy("corpus", "_task").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("corpus").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(counts.withColumn("_before", before).select("corpus", "_task", "_first", "_before"))  # a row for each task and corpus
    out = rows.join(starts, ["corpus", "_task"]).withColumn("idx", F.col("_at") - F.col("_first") + F.col("_before"))
    out.drop("_task", "_at", "_first", "_before").write.partitionBy("corpus").mode("overwrite").parquet(path)
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(sorted_path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def write_split(df: DataFrame, path: str, split: str) -> None:
    """JSON lines of one split's results, which name it."""
    write_json(df.withColumn("dataset_split", F.lit(split)), path)


def write_texts(df: DataFrame, path: str, key: str = "encounter_id", text: str = "text") -> None:
    """Texts, a folder for each key."""
    df.select(key, text).write.partitionBy(key).mode("overwrite").text(path)


def stream(df: DataFrame):
    """Rows one after the other, of one task at a time: the driver holds two tasks' rows at most."""
    return df.toLocalIterator(prefetchPartitions=True)


CHUNK = "idx long, corpus string, doc_id string, position int, title string, heading_path string, text string, sha256 string"


def chunk_lines(spark: SparkSession, path: str, schema: str = CHUNK) -> DataFrame:
    """Chunks or their metadata from JSON lines; idx, the row's place, is a column of the lines. Blank and malformed lines are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def write_index(df: DataFrame, path: str, embed) -> None:
    """The chunk table with a vector for each chunk, embed(text column); one table in place of separate files for vectors, metadata and chunks."""
    write_chunks(df.withColumn("embedding", embed(F.substring("text", 1, 5000))), path)


def read_index(spark: SparkSession, path: str, corpus: str | None = None) -> DataFrame:
    """A written index; of one corpus only its files are read."""
    df = spark.read.parquet(path)
    return df if corpus is None else df.filter(F.col("corpus") == corpus)


def report(df: DataFrame) -> DataFrame:
    """Counts of rows with and without an error."""
    return df.groupBy(F.col("error").isNotNull().alias("failed")).count()
