"""The corpus pipeline: language ID, near-dedup, substring dedup, benchmark decontamination and SentencePiece coding, in this order.

Each stage gets what its predecessor kept, as written and reread; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumflow.llm.decontaminate import contaminated
from vellumflow.llm.language_id import predict, train
from vellumflow.llm.minhash_dedup import minhash_groups
from vellumflow.llm.sentencepieces import encode
from vellumflow.llm.store import drop_tables, table, write_table, written
from vellumflow.llm.substring_dedup import substring_dedup

#: Ids are broadcast up to this number (16 bytes each), and joined by shuffling beyond it.
MOST_BROADCAST = 500_000


def _without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """docs whose values of rows' columns are not among rows (a written table)."""
    return docs.join(F.broadcast(rows) if rows.count() <= MOST_BROADCAST else rows, rows.columns, "left_anti")


def _free(docs: DataFrame, name: str) -> str:
    """name, with underscores before it until docs has no such column."""
    while name.lower() in (c.lower() for c in docs.columns):
        name = f"_{name}"
    return name


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, and those whose most probable language has a posterior below 0.6; a missing lang is filled in."""
    lang, score = _free(docs, "_lang"), _free(docs, "_score")
    out = predict(docs, train(docs), names=(lang, score)).filter((F.col(lang) != "und") & (F.col(score) >= 0.6))
    return out.withColumn("lang", F.coalesce("lang", lang)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group, of smallest doc_id; similarity 0.8 or more of sets of five-word shingles. Rows that repeat a doc_id are judged by their own texts: each text that is no copy stays, and of rows with equal id and text one. Rows without doc_id stay."""
    groups = write_table(minhash_groups(docs, size=5, percent=80).select("doc_id", "row_hash", "group_id"), "groups")
    least = write_table(groups.filter("group_id is not null").groupBy("group_id").agg(F.min(F.struct("doc_id", "row_hash")).alias("least")), "least")
    copies = groups.join(least, "group_id").filter("doc_id != least.doc_id or row_hash != least.row_hash").select("doc_id", "row_hash").distinct()
    mark = _free(docs, "_row_hash")
    kept = _without(docs.withColumn(mark, F.xxhash64("text")), write_table(copies.withColumnRenamed("row_hash", mark), "copies"))
    ids = groups.filter("doc_id is not null").agg(F.count("doc_id").alias("n"), F.count_distinct("doc_id").alias("d")).first()
    if ids["n"] != ids["d"]:
        kept = kept.filter("doc_id is not null").dropDuplicates(["doc_id", mark]).union(kept.filter("doc_id is null"))
    return kept.select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes words of 20-word passages that occur earlier, and documents of which nothing is left."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    out = substring_dedup(docs.select("doc_id", "text", F.struct(*others).alias("others")), also=["others"], as_is=True).filter("n_removed < n_words or n_words = 0")
    made = {"doc_id": F.col("doc_id"), "text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return out.select(*[made.get(c, F.col("others").getField(c)).alias(c) for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, at similarity 0.8 or more of its five-word shingles."""
    found = contaminated(docs, table(spark, sf_dir, "benchmark"))
    return _without(docs, write_table(found.select("doc_id").distinct(), "leaks")).select(*docs.columns)


def sentencepieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus as piece ids, with the text that they decode to."""
    out = encode(docs, also_decoded=True)
    return out.select("doc_id", "lang", "source", F.col("decoded").alias("text"), "ids", F.size("ids").cast("long").alias("n_pieces"))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", repeated_passages),
    ("decontamination", decontamination),
    ("sentencepieces", sentencepieces),
]

#: The stages' models and codes are beyond SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's table; tables that a stage needed for itself, and those of the stages before, are deleted once its own is written."""
    before = written()
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = write_table(stage(spark, docs, sf_dir), name)
        drop_tables(spark, before, docs)
    return docs
