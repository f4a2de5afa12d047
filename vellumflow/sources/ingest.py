"""Incremental ingest: sources to chunks, with a manifest of content hashes and snapshots that are committed as a whole.

A chunk store is a folder:

* `chunks/data=<id>/`: the chunks of the sources that one ingest parsed;
* `manifests/<id>/`: a snapshot's sources, each with its stamp, its hash and the data folder that holds its chunks;
* `commits/<number>`: a snapshot, naming its manifest and the data folders that this refers to.

An ingest compares paths and stamps (say, time and length of a file) with the last snapshot's, reads the content only of sources whose
stamp is new, and parses only those whose hash is new too. What it writes counts from the moment its commit file is created; creation fails
if another ingest has committed meanwhile, and an ingest that dies before leaves folders that no snapshot refers to. An ingest that finds
nothing new, changed or removed writes nothing. Readers see one snapshot; older ones stay readable until vacuum().

Results: sources without path are left out; two sources of one path raise an error; null content counts as empty. A source that yields
no chunks stays in the manifest, so it isn't parsed again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sizes import broadcast_if_small
from .shared import create_file, delete, names_in, read_file

MANIFEST = "path string, stamp string, sha256 string, data string, n_chunks long"

# Bytes of the paths of changed sources that are sent to all tasks.
MOST_BROADCAST = 64 << 20


@dataclass(frozen=True)
class Snapshot:
    """A committed state: its number, the manifest's folder, and the data folders it refers to."""

    number: int
    manifest: str
    data: tuple[str, ...]


def snapshots(spark: SparkSession, store: str) -> list[int]:
    return [int(n) for n in names_in(spark, f"{store}/commits") if n.isdigit()]


def snapshot(spark: SparkSession, store: str, number: int | None = None) -> Snapshot | None:
    """A snapshot, the last one if none is named; None if there is none."""
    known = snapshots(spark, store)
    if not known or (number is not None and number not in known):
        return None
    number = max(known) if number is None else number
    found = json.loads(read_file(spark, f"{store}/commits/{number:010}"))
    return Snapshot(number, found["manifest"], tuple(found["data"]))


def manifest(spark: SparkSession, store: str, of: Snapshot | None) -> DataFrame:
    """path, stamp, sha256, data and n_chunks of a snapshot's sources."""
    if of is None:
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(f"{store}/manifests/{of.manifest}")


def read_chunks(spark: SparkSession, store: str, number: int | None = None, columns: Sequence[Column | str] = ("*",)) -> DataFrame:
    """A snapshot's chunks: path and what the parser gave (or columns of that), and sha256 of the source. Data folders that it doesn't refer to are not read. Columns are worked out before the chunks meet the manifest, so texts that aren't asked for aren't shuffled."""
    at = snapshot(spark, store, number)
    if at is None:
        raise ValueError(f"no such snapshot in {store}")
    rows = manifest(spark, store, at).select("path", "sha256", "data")
    folders = [f"{store}/chunks/data={d}" for d in at.data]
    chunks = spark.read.option("basePath", f"{store}/chunks").option("mergeSchema", len(folders) > 1).parquet(*folders)
    held = chunks.withColumn("data", F.col("data").cast("string"))
    held = held if tuple(columns) == ("*",) else held.select("path", "data", *columns)
    return held.join(rows, ["path", "data"]).drop("data")


def _commit(spark: SparkSession, store: str, after: Snapshot | None, rows: DataFrame) -> Snapshot:
    """Writes the manifest and makes it the next snapshot."""
    name = uuid.uuid4().hex
    rows.select(*[c.split()[0] for c in MANIFEST.split(", ")]).write.parquet(f"{store}/manifests/{name}")
    # As many as ingests since the last compaction.
    data = sorted(r[0] for r in spark.read.schema(MANIFEST).parquet(f"{store}/manifests/{name}").select("data").distinct().collect())
    new = Snapshot((after.number if after else 0) + 1, name, tuple(data))
    if not create_file(spark, f"{store}/commits/{new.number:010}", json.dumps({"manifest": name, "data": data})):
        raise RuntimeError(f"another ingest has committed snapshot {new.number}")
    return new


def ingest(sources: DataFrame, store: str, parse: Callable[[DataFrame], DataFrame]) -> Snapshot | None:
    """Brings a store up to date with sources (path, stamp, content and whatever parse needs; stamp is compared as text). parse gets the rows of new and changed sources and returns their chunks, with the column path. Returns the snapshot that holds then, a new one only if something changed (None: an empty store and no sources)."""
    spark = sources.sparkSession
    before = snapshot(spark, store)
    known = manifest(spark, store, before)
    sources = sources.filter("path is not null")
    listed = sources.select("path", F.col("stamp").cast("string").alias("stamp"))
    if not listed.groupBy("path").count().filter("count > 1").isEmpty():
        raise ValueError("two sources have one path")

    held = known.select("path", F.col("stamp").alias("old_stamp"), F.col("sha256").alias("old_sha256"), F.lit(True).alias("known"))
    touched = listed.join(held, "path", "left").filter("known is null or not stamp <=> old_stamp")
    bytes_of = F.coalesce(F.col("content").cast("binary"), F.lit(b""))
    data = uuid.uuid4().hex
    work = f"{store}/work/{data}"
    hashed = sources.select("path", F.sha2(bytes_of, 256).alias("sha256")).join(touched, "path")
    hashed.write.parquet(work)
    try:
        hashed = spark.read.schema(hashed.schema).parquet(work)
        changed = hashed.filter("known is null or sha256 != old_sha256")
        removed = known.join(listed, "path", "left_anti")
        n_new, n_gone, n_touched = changed.count(), removed.count(), hashed.count()
        if not (n_new or n_gone or n_touched):
            return before
        rows = known.join(listed.select("path"), "path", "left_semi").join(hashed.select("path"), "path", "left_anti")
        same = hashed.filter("known and sha256 = old_sha256").select("path", "stamp").join(known.drop("stamp"), "path")
        rows = rows.unionByName(same)
        if n_new:
            # Contents are shuffled only if some sources, but too many to be broadcast, have changed.
            every = n_new == listed.count()
            found = parse(sources if every else sources.join(broadcast_if_small(changed.select("path"), MOST_BROADCAST), "path", "left_semi"))
            found.write.parquet(f"{store}/chunks/data={data}")
            counts = spark.read.schema(found.schema).parquet(f"{store}/chunks/data={data}").groupBy("path").agg(F.count("*").alias("n_chunks"))
            fresh = changed.select("path", "stamp", "sha256", F.lit(data).alias("data")).join(counts, "path", "left")
            rows = rows.unionByName(fresh.withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0))))
        return _commit(spark, store, before, rows)
    finally:
        delete(spark, work)


def compact(spark: SparkSession, store: str) -> Snapshot | None:
    """Puts the chunks of the last snapshot into one data folder, as a new snapshot."""
    before = snapshot(spark, store)
    if before is None or len(before.data) < 2:
        return before
    data = uuid.uuid4().hex
    read_chunks(spark, store).drop("sha256").write.parquet(f"{store}/chunks/data={data}")
    return _commit(spark, store, before, manifest(spark, store, before).withColumn("data", F.lit(data)))


def vacuum(spark: SparkSession, store: str, keep: int = 1) -> int:
    """Deletes all but the last `keep` snapshots and the folders that these don't refer to; not while an ingest runs. Returns how many folders it deleted."""
    kept = snapshots(spark, store)[-keep:] if keep > 0 else []
    if not kept:
        raise ValueError("at least one snapshot has to stay")
    held = [snapshot(spark, store, n) for n in kept]
    for n in snapshots(spark, store):
        if n not in kept:
            delete(spark, f"{store}/commits/{n:010}")
    data, manifests = {d for s in held for d in s.data}, {s.manifest for s in held}
    gone = [f"chunks/{n}" for n in names_in(spark, f"{store}/chunks") if n.removeprefix("data=") not in data]
    gone += [f"manifests/{n}" for n in names_in(spark, f"{store}/manifests") if n not in manifests]
    for name in gone:
        delete(spark, f"{store}/{name}")
    return len(gone)


def file_sources(spark: SparkSession, path: str, endings: tuple[str, ...] = ("pdf", "epub")) -> DataFrame:
    """Files below a folder as sources: path, stamp (time and length), content, corpus, title. Content is read only where it is used."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    df = df.filter(F.lower("path").rlike(r"\.(" + "|".join(endings) + ")$"))
    stamp = F.concat_ws("/", F.unix_micros("modificationTime").cast("string"), F.col("length").cast("string"))
    return df.select("path", stamp.alias("stamp"), "content", F.element_at(F.split("path", "/"), -2).alias("corpus"), F.translate(F.regexp_extract("path", r"([^/]+)\.[^.]+$", 1), "_", " ").alias("title"))
