"""Queries whose work goes through streams with state and through tables that are kept, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..operators.calls import call_once
from ..operators.providers import Echo
from ..sources import ingest as I
from ..sources.shared import names_in, new_path
from ..streaming import live
from ..streaming.events import read_stream
from .queries import _DOC_SCORE, _TURNS, _turns, query, read
from .reply_queries import _ASKED, _said


def _streamed(spark: SparkSession, turns: DataFrame, what, mode: str) -> DataFrame:
    """turns as files with the ends of their conversations in later ones, run through a stream; what it wrote."""
    at = F.timestamp_seconds(F.unix_seconds(F.lit("2024-01-01 00:00:00").cast("timestamp")) + 60 * F.col("utt_id"))
    rows = turns.select(F.col("encounter_id").cast("string").alias("encounter_id"), F.col("utt_id").cast("long").alias("utt_id"), "speaker", "role", "text", at.alias("ts"), F.lit(False).alias("ended"))
    none = lambda c: F.lit(None).cast(rows.schema[c].dataType).alias(c)
    ends = rows.groupBy("encounter_id").agg(F.max("ts").alias("ts")).select("encounter_id", none("utt_id"), none("speaker"), none("role"), none("text"), "ts", F.lit(True).alias("ended"))
    path = new_path(spark, "turns")
    rows.write.parquet(path)
    ends.write.mode("append").parquet(path)
    out = new_path(spark, "live")
    # As late as any turn may come: files of a long conversation are read in any order.
    span = spark.read.schema(rows.schema).parquet(path).agg(F.max(F.unix_seconds("ts")) - F.min(F.unix_seconds("ts"))).first()[0] or 0
    stream = what(read_stream(spark, path, live.TURN, per_trigger=64), late=f"{span + 60} seconds")
    live.run(stream, f"{out}/rows", f"{out}/checkpoint", mode)
    schema = StructType([*stream.schema.fields, StructField("trigger", IntegerType())])
    return spark.read.schema(schema).parquet(f"{out}/rows") if names_in(spark, f"{out}/rows") else spark.createDataFrame([], schema)


@query(f"WITH {_TURNS}, r AS (SELECT encounter_id, speaker, sum({_DOC_SCORE}) AS score, count(*) AS turns, row_number() OVER (PARTITION BY encounter_id ORDER BY sum({_DOC_SCORE}) DESC, min(utt_id), speaker) AS k FROM t GROUP BY encounter_id, speaker) SELECT encounter_id, speaker, CASE WHEN k = 1 THEN 'DOCTOR' WHEN k = 2 THEN 'PATIENT' ELSE 'OTHER_' || (k - 2) END AS role, CAST(score AS BIGINT) AS score, turns FROM r")
def live_roles(spark, sf_dir):
    """Roles as the stream knows them when all conversations are over."""
    rows = _streamed(spark, _turns(spark, sf_dir), live.live_roles, "update")
    last = rows.groupBy("encounter_id", "speaker").agg(F.max_by(F.struct("role", "score", "turns"), "trigger").alias("r"))
    return last.select(F.col("encounter_id").cast("long").alias("encounter_id"), "speaker", "r.role", "r.score", "r.turns")


@query(f"WITH {_ASKED} SELECT p.encounter_id, p.utt_id AS question_utt, part, CASE part WHEN 0 THEN 'How are you?' ELSE 'Since when?' END AS question, answer_utt, b.text AS answer FROM p JOIN b ON b.encounter_id = p.encounter_id AND b.utt_id = answer_utt, (VALUES (0), (1)) v(part) WHERE b.skips - p.skips < 3")
def live_answers(spark, sf_dir):
    """Questions and answers as the stream settles them; turns of two questions each, with backchannels among the replies."""
    said = F.when(F.col("role") == "DOCTOR", "How are you? Since when?").when(F.col("role") == "PATIENT", F.when(F.floor(F.col("utt_id") / 2) % 3 != 0, "okay").otherwise(_said("a", F.col("text")))).otherwise(F.col("text"))
    rows = _streamed(spark, _turns(spark, sf_dir).withColumn("text", said), live.live_answers, "append")
    return rows.select(F.col("encounter_id").cast("long").alias("encounter_id"), "question_utt", "part", "question", "answer_utt", "answer")


@query("WITH d AS (SELECT doc_id, CASE WHEN lang = 'en' THEN 'revised' || chr(10) || text ELSE text END AS text FROM documents WHERE source != 'src0'), l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM d), x AS (SELECT doc_id, unnest(range(0, len(ls))) AS i, ls FROM l) SELECT doc_id, CAST(i AS INTEGER) AS position, md5(ls[i + 1]) AS digest FROM x WHERE ls[i + 1] != ''")
def incremental_chunks(spark, sf_dir):
    """Lines of documents as a chunk store holds them after three ingests: all documents; those of one language revised and those of one source removed; nothing new."""
    docs = read(spark, sf_dir, "documents")
    revised = F.when(F.col("lang") == "en", F.concat(F.lit("revised\n"), "text")).otherwise(F.col("text"))
    sources = lambda df, stamp, text: df.select(F.col("doc_id").cast("string").alias("path"), stamp.alias("stamp"), text.alias("content"))
    lines = lambda df: df.select("path", F.posexplode(F.split("content", "\n", -1)).alias("position", "text")).filter("text != ''")
    store = new_path(spark, "store")
    I.ingest(sources(docs, F.lit(1), F.col("text")), store, lines)
    now = sources(docs.filter("source != 'src0'"), F.when(F.col("lang") == "en", 2).otherwise(1), revised)
    held = I.ingest(now, store, lines)
    if I.ingest(now, store, lines) != held:
        raise AssertionError("an ingest of what is there has written something")
    rows = I.read_chunks(spark, store, columns=("position", F.md5("text").alias("digest")))
    return rows.select(F.col("path").cast("long").alias("doc_id"), "position", "digest")


@query("SELECT conv_id, turn, '[m] ' || substr('Say: ' || text, 1, 100) AS reply, CAST(1 AS INTEGER) AS attempts FROM conversations")
def cached_replies(spark, sf_dir):
    """Replies of the stand-in model to all turns, read from the table of results: the second run, which this is, makes no call."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("Say: "), "text").alias("prompt"))
    store = new_path(spark, "replies")
    call_once(turns, store, Echo, "m")

    def none():
        raise AssertionError("a reply was asked for twice")

    return call_once(turns, store, none, "m").select("conv_id", "turn", "reply", "attempts")
