"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A grade is one of 0 to G. The model gives a text a score s = w.x with weights shared by all grades, and ordered thresholds t_1 < ... < t_G:
P(grade >= g) = logistic(s - t_g). Features are the hashed words that a text has (letters and digits in lower case), for the buckets that
occur in `least` documents of the sample or more and whose documents' mean grade is `strong` standard errors or more from that of all, and
a few shares and lengths. (Without this choice, chance weights of many rare words outweigh a few telling ones in long texts.) The expected grade is the sum of the tail probabilities.

The fit uses about `sample` labelled documents, chosen by a hash of their ids (a parameter), with their whole texts. Which buckets are
telling is found by grouping; only these reach the driver. Every text is scored whole.

Results: null text, and text without any letter or digit, has expected grade 0 and tail probabilities 0. Without labelled rows all scores
are null and every row is kept. Repeated rows get equal scores; expected_grade and tails replace columns of these names. A tail
probability of exactly one half keeps.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .language_id import fold
from .sentencepieces import add_columns
from .store import table, with_small_batches, write_table
from .wordhash import PLAIN, Words, as_list, release_memory, slices

_BITS = 24
_UPPER, _DIGIT, _MARK, _LINE = (np.zeros(256, np.int64) for _ in range(4))
_UPPER[65:91] = 1
_DIGIT[48:58] = 1
_MARK[[b for b in range(33, 127) if not chr(b).isalnum()]] = 1
_LINE[10] = 1
_CASED = np.zeros(256, np.int64)
_CASED[65:91] = _CASED[97:123] = 1


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket) of each distinct word, and dense features by row."""
    n = len(column)
    raw = Words(column)
    total = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags[raw.data[: raw.bounds[-1]]])])[raw.bounds]).astype(float)
    size = np.maximum(1, np.diff(raw.bounds))
    upper, digit, mark, line, cased = (total(f) for f in (_UPPER, _DIGIT, _MARK, _LINE, _CASED))
    w = Words(column, bytes_map=PLAIN)
    bucket = (w.hashes() >> np.uint64(64 - _BITS)).astype(np.int64)
    key = np.sort(w.row << _BITS | bucket)
    key = key[np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]]
    row, bucket = key >> _BITS, key & ((1 << _BITS) - 1)
    distinct, words = np.bincount(row, minlength=n), np.maximum(1, w.counts)
    bare = np.bincount(w.row[np.concatenate([[False], (w.row[1:] == w.row[:-1]) & (w.hashes()[1:] == w.hashes()[:-1])])[: len(w.row)]], minlength=n) / words
    dense = np.stack([upper / np.maximum(1, cased), digit / size, mark / size, mark / words, np.minimum(line / words, 1), distinct / words / np.maximum(1, 2 - np.log10(words + 1) / 3), bare, np.log(words) / 10, raw.counts / words, size / words / 10], axis=1)
    return row, bucket, dense


_DENSE = 10


def _sampled(batches):
    for b in batches:
        for i, j in slices(b.column(1)):
            part = b.slice(i, j - i)
            row, bucket, dense = features(part.column(1))
            yield pa.record_batch([part.column(0), as_list(bucket, np.bincount(row, minlength=j - i), pa.int64()), as_list(dense.ravel(), np.full(j - i, _DENSE), pa.float64())], ["grade", "buckets", "dense"])
    release_memory()


def _only(known: np.ndarray):
    """Rows: grade, buckets, dense. Keeps the known buckets, as their numbers."""

    def run(batches):
        for b in batches:
            lists = b.column(1)
            flat, row = lists.flatten().to_numpy(), np.repeat(np.arange(b.num_rows), lists.value_lengths().to_numpy())
            at = np.minimum(np.searchsorted(known, flat), max(0, len(known) - 1))
            mine = known[at] == flat if len(known) else np.zeros(len(flat), bool)
            yield pa.record_batch([b.column(0), as_list(at[mine], np.bincount(row[mine], minlength=b.num_rows), pa.int64()), b.column(2)], ["grade", "buckets", "dense"])

    return run


def fit(grade: np.ndarray, row: np.ndarray, column: np.ndarray, n_columns: int, dense: np.ndarray, top: int, rounds: int = 250, decay: float = 2e-4, rate: float = 0.05):
    """(word weights, dense weights, thresholds) by full-batch Adam on the ordinal likelihood."""
    n = len(grade)
    order = np.argsort(column, kind="stable")
    by_row, by_column = np.cumsum(np.bincount(row, minlength=n)), np.cumsum(np.bincount(column, minlength=n_columns))
    sums = lambda x, ends: np.diff(np.concatenate([[0], np.concatenate([[0], np.cumsum(x)])[ends]]))
    share = np.array([(np.sum(grade >= g) + 1) / (n + 2) for g in range(1, top + 1)])
    cut = -np.log(share / (1 - share))
    theta = np.concatenate([np.zeros(n_columns + dense.shape[1]), [cut[0]], np.log(np.maximum(np.diff(cut), 1e-2))])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    k, d = n_columns, dense.shape[1]
    logistic = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    for step in range(1, rounds + 1):
        gaps = np.exp(theta[k + d + 1 :])
        cut = theta[k + d] + np.concatenate([[0], np.cumsum(gaps)])
        s = sums(theta[:k][column], by_row) + dense @ theta[k : k + d]
        tail = np.concatenate([np.ones((n, 1)), logistic(s[:, None] - cut), np.zeros((n, 1))], axis=1)
        upper, lower = tail[np.arange(n), grade], tail[np.arange(n), grade + 1]
        p = np.maximum(upper - lower, 1e-9)
        du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
        ds = -(du - dl) / n
        dcut = np.zeros((top + 2,))
        np.add.at(dcut, grade, du / n)
        np.add.at(dcut, grade + 1, -dl / n)
        dcut = dcut[1:-1]
        back = np.cumsum(dcut[::-1])[::-1]
        g = np.concatenate([sums(ds[row][order], by_column), dense.T @ ds, [back[0]], back[1:] * gaps])
        g[:k] += decay * theta[:k]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta[:k], theta[k : k + d], theta[k + d] + np.concatenate([[0], np.cumsum(np.exp(theta[k + d + 1 :]))])


def train(docs: DataFrame, ratings: DataFrame, doc_id: str = "doc_id", text: str = "text", grade: str = "grade", sample: int = 12_000, least: int = 4, strong: float = 3.5):
    """Learns from the ratings (doc_id, grade from 0) of documents; None if there are none."""
    rated = ratings.select(F.col(doc_id).alias("doc_id"), F.col(grade).cast("int").alias("grade")).filter("doc_id is not null and grade >= 0")
    n = rated.count()
    if not n:
        return None
    chosen = rated.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < min(1.0, sample / n) * 1_000_003).dropDuplicates(["doc_id"])
    joined = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).filter("text is not null").join(F.broadcast(chosen), "doc_id")
    sampled = write_table(with_small_batches(joined.select("grade", "text")).mapInArrow(_sampled, "grade int, buckets array<long>, dense array<double>"), "sampled")
    of = sampled.agg(F.avg("grade").alias("mean"), F.stddev_pop("grade").alias("spread")).first()
    if of["mean"] is None:
        return None
    buckets = sampled.select("grade", F.explode("buckets").alias("b")).groupBy("b").agg(F.count("*").alias("n"), F.avg("grade").alias("g")).filter(F.col("n") >= least)
    telling = buckets.filter(F.abs(F.col("g") - of["mean"]) * F.sqrt("n") >= strong * max(of["spread"], 1e-9))
    known = np.sort(np.array([r["b"] for r in telling.select("b").collect()], np.int64))
    # Of the sample's size; in one order, so that every fit of it sums alike.
    got = sampled.mapInArrow(_only(known), sampled.schema).withColumn("h", F.xxhash64("buckets", "dense")).toArrow().sort_by([("grade", "ascending"), ("h", "ascending")])
    y = got.column("grade").to_numpy().astype(np.int64)
    lists = got.column("buckets").combine_chunks()
    column, row = lists.flatten().to_numpy(), np.repeat(np.arange(len(y)), lists.value_lengths().to_numpy())
    dense = got.column("dense").combine_chunks().flatten().to_numpy().reshape(-1, _DENSE)
    mean, spread = dense.mean(0), dense.std(0) + 1e-6
    weights, own, cuts = fit(y, row, column, len(known), np.clip((dense - mean) / spread, -6, 6), max(1, int(y.max())))
    return known, weights, own, cuts, mean, spread


def _scored(shared, at: int, drop: bool):
    def run(batches):
        known, weights, own, cuts, mean, spread = shared.value
        held = np.zeros(1 << _BITS, bool)
        held[known] = True
        for b in batches:
            for i, j in slices(b.column(at)):
                part = b.slice(i, j - i)
                row, bucket, dense = features(part.column(at))
                part = part.drop_columns(part.schema.names[at]) if drop else part
                some = np.bincount(row, minlength=j - i) > 0
                mine = held[bucket]
                s = np.bincount(row[mine], weights[np.searchsorted(known, bucket[mine])], j - i) + np.clip((dense - mean) / spread, -6, 6) @ own
                tail = np.where(some[:, None], 1 / (1 + np.exp(-np.clip(s[:, None] - cuts, -40, 40))), 0.0)
                yield pa.record_batch([*part.columns, pa.array(tail.sum(1)), as_list(tail.ravel(), np.full(j - i, len(cuts)), pa.float64())], [*part.schema.names, "expected_grade", "tails"])
        release_memory()

    return run


def score(docs: DataFrame, model, text: str = "text") -> DataFrame:
    """docs with expected_grade and tails (P(grade >= 1), P(grade >= 2), ...), which replace columns of those names."""
    others = [c for c in docs.columns if c not in ("expected_grade", "tails")]
    if model is None:
        return docs.select(*others, F.lit(None).cast("double").alias("expected_grade"), F.lit(None).cast("array<double>").alias("tails"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return add_columns(docs, text, {"expected_grade": "double", "tails": "array<double>"}, lambda at, drop: _scored(shared, at, drop))


def grades(labels: DataFrame) -> DataFrame:
    """Ratings of the labels table: 0 for toxic, 1 for low quality, 2 for the rest; of repeated rows the lowest."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2)
    return labels.filter("quality is not null or toxic is not null").groupBy("doc_id").agg(F.min(grade).alias("grade"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trained on three of four folds of the labelled documents; keep: the tail probability of the top grade is at least one half."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, grades(table(spark, sf_dir, "labels")).filter(fold() != 2))
    out = score(docs.withColumn("held_out", fold() == 2), model)
    p1, p2 = F.get("tails", F.lit(0)), F.coalesce(F.get("tails", F.lit(1)), F.get("tails", F.lit(0)))
    return out.select("doc_id", "held_out", "expected_grade", p1.alias("p_not_toxic"), p2.alias("p_good"), F.coalesce(p2 >= 0.5, F.lit(True)).alias("keep"))
