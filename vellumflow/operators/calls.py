"""Model calls that are made once: replies are kept in a table, addressed by a hash of model, prompt and settings.

Before a call, requests are held against the table by an anti join; equal requests are one. What is left is asked in blocks of about
`block_rows`, each of which is written when it is done, so a run that dies repeats one block at most, and a rerun makes no call. Within a
task up to `workers` calls run at a time; a call that fails is made again after a pause that doubles each time.

Results: a request that failed has a null reply and its error, stays in the table with them, and is made again by the next run; a reply that
accept() refuses to the end is given as it is, but counts as failed too. A null prompt is an empty one.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import delete, names_in
from .providers import ask

RESULTS = "key string, reply string, attempts int, error string, accepted boolean, run long"


def request_key(prompt: str, model: str, system: str | None = None, stricter: str = "", temperature: float = 0.0) -> Column:
    """The hash that addresses a request's reply."""
    parts = {"prompt": F.coalesce(F.col(prompt), F.lit("")), "model": F.lit(model), "system": F.lit(system or ""), "stricter": F.lit(stricter), "temperature": F.lit(float(temperature))}
    return F.sha2(F.to_json(F.struct(*[c.alias(n) for n, c in parts.items()])), 256)


def results(spark: SparkSession, store: str) -> DataFrame:
    """The table: a row for each request in each run that made it."""
    folders = [f"{store}/{n}" for n in names_in(spark, store) if n.startswith("block-")]
    # A block counts once its writer has committed it.
    done = [f for f in folders if "_SUCCESS" in names_in(spark, f)]
    return spark.read.schema(RESULTS).parquet(*done) if done else spark.createDataFrame([], RESULTS)


def _best(rows: DataFrame) -> DataFrame:
    """One result of each key: an accepted one if there is any, else the last."""
    return rows.groupBy("key").agg(F.max_by(F.struct("reply", "attempts", "error", "accepted"), F.struct("accepted", "run")).alias("r")).select("key", "r.*")


def call_once(df: DataFrame, store: str, make_client: Callable[[], object], model: str, prompt: str = "prompt", retries: int = 2, accept: Callable[[str], bool] = bool, system: str | None = None, stricter: str = "", temperature: float = 0.0, workers: int = 8, pause: float = 1.0, block_rows: int = 10_000) -> DataFrame:
    """df with reply, attempts and error, from the table of results in the folder store, which first gets those that it hasn't."""
    spark, others = df.sparkSession, [c for c in df.columns if c not in ("reply", "attempts", "error")]
    keyed = df.select(*others, request_key(prompt, model, system, stricter, temperature).alias("_key"))
    known = results(spark, store).filter("accepted").select("key").distinct()
    todo = keyed.select(F.col("_key").alias("key"), F.coalesce(F.col(prompt), F.lit("")).alias("prompt")).dropDuplicates(["key"]).join(known, "key", "left_anti")
    work = f"{store}/work-{uuid.uuid4().hex}"
    todo.write.parquet(work)
    todo, run = spark.read.schema(todo.schema).parquet(work), time.time_ns()

    def asked(frames):
        import pandas as pd

        client = make_client()
        with ThreadPoolExecutor(workers) as pool:
            for frame in frames:
                made = list(pool.map(lambda text: ask(client, model, text, retries, accept, system, stricter, temperature, pause), frame["prompt"]))
                rows = [(key, reply, tried, error, error is None and reply is not None and bool(accept(reply)), run) for key, (reply, tried, error) in zip(frame["key"], made, strict=True)]
                yield pd.DataFrame(rows, columns=["key", "reply", "attempts", "error", "accepted", "run"])

    blocks = -(-todo.count() // block_rows)
    for block in range(blocks):
        rows = todo.filter(F.pmod(F.xxhash64("key"), F.lit(blocks)) == block)
        rows.repartition("key").mapInPandas(asked, RESULTS).write.parquet(f"{store}/block-{run}-{block}")
    delete(spark, work)
    return keyed.join(_best(results(spark, store)), keyed["_key"] == F.col("key"), "left").select(*others, "reply", "attempts", "error")
