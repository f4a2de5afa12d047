"""Ranked lexical search: Fagin's threshold algorithm over impact-sorted lists, with random lookups in a forward index.

Terms are maximal runs of ASCII letters and digits and of all characters beyond ASCII; A-Z is lower-cased. One pass over the documents
makes the forward index: each document's length and its counts of the terms that are asked for. It is written, and the corpus' statistics
(documents, terms, and documents that hold a term) are sums over it. Then it is read in shards of bounded size, each dealt to one task.
A shard sorts its own impact lists; for each item, equal depths are read from the lists in turn, each document met is looked up in the
forward index and scored in full, and reading stops when the threshold (the sum of the impacts at the depth reached) falls strictly
below the k-th best score. A task carries its k best from shard to shard, so later shards stop earlier; the tasks' best meet in two
levels. A term that all documents hold is spread over all shards.

Impacts are integers: a term weighs floor(1000 ln((2N+2)/(2df+1))), and counts tf times in a document of length measure m as
(10**9 tf) div (1000 tf + 8 m), where m = 100 - b + (b n N) div L with b = 75.

Items are asked in blocks of about `block_bytes` of text, so that what is broadcast has a bound; each row of the items is an item of its own.

Results: null and empty texts, and those without a term, are no documents and no items; an item whose terms no document holds has no rows.
Equal scores come by ascending id; rows that repeat an id are ranked as documents of their own; rows without an id count in the statistics
and come after equal scores. Ids keep their type. Terms are known by 64 bits of hash. Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import table, with_small_batches, write_table
from .wordhash import PLAIN, Words, as_list, release_memory, slices


def _terms(column: pa.Array) -> tuple[np.ndarray, Words]:
    w = Words(column, bytes_map=PLAIN)
    return w.hashes(), w


class Items:
    """The items of a block: terms (ascending hashes of all), and of item i the entries first[i] to first[i + 1] of term (an index of terms) and times."""

    def __init__(self, texts: pa.Array):
        h, w = _terms(texts)
        self.terms, at = np.unique(h, return_inverse=True)
        key, self.times = np.unique(w.row.astype(np.int64) << 32 | at, return_counts=True)
        self.term = key & 0xFFFFFFFF
        self.first = np.searchsorted(key >> 32, np.arange(len(texts) + 1))


def _forward(shared):
    """Rows: doc_id, text. Of each document with a term: its length, and the terms asked for with their counts."""

    def run(batches):
        terms = shared.value
        for b in batches:
            for i, j in slices(b.column(1)):
                part = b.slice(i, j - i)
                h, w = _terms(part.column(1))
                at = np.minimum(np.searchsorted(terms, h), len(terms) - 1)
                hit = np.flatnonzero(terms[at] == h)
                key, times = np.unique(w.row[hit].astype(np.int64) << 32 | at[hit], return_counts=True)
                counts = np.bincount(key >> 32, minlength=j - i)
                lists = [as_list(x.astype(np.int32), counts, pa.int32()) for x in (key & 0xFFFFFFFF, times)]
                some = pa.array(w.counts > 0)
                yield pa.record_batch([part.column(0), pa.array(w.counts.astype(np.int64)), *lists], ["doc_id", "n", "terms", "times"]).filter(some)
        release_memory()

    return run


def _holders(n_terms: int):
    """Rows: terms. How many of a task's documents hold each term."""

    def run(batches):
        total = np.zeros(n_terms, np.int64)
        for b in batches:
            total += np.bincount(b.column(0).flatten().to_numpy(), minlength=n_terms)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some.astype(np.int32)), pa.array(total[some])], ["term", "df"])

    return run


def length_measure(n: np.ndarray, n_docs: int, n_terms: int, b: int) -> np.ndarray:
    """100 - b + (b n N) div L; beyond 64 bits with Python's integers."""
    if len(n) and int(n.max()) * b * n_docs >= 2**63:
        return np.array([100 - b + b * x * n_docs // n_terms for x in n.tolist()], np.int64)
    return 100 - b + b * n * n_docs // n_terms


class Shard:
    """Some documents: forward index (entries first[d] to first[d + 1] of term and part) and impact lists (entries start[t] to start[t + 1] of doc and impact, the highest first). part: what a term counts for in a document, without its weight."""

    def __init__(self, n: np.ndarray, counts: np.ndarray, term: np.ndarray, times: np.ndarray, stats: tuple[int, int, int], n_terms: int):
        self.first = np.concatenate([[0], np.cumsum(counts)])
        self.term = term
        times = times.astype(np.int64)
        doc = np.repeat(np.arange(len(n)), counts)
        self.part = 1_000_000_000 * times // (1000 * times + 8 * length_measure(n, *stats)[doc])
        order = np.lexsort((-self.part, term))
        self.doc, self.impact = doc[order], self.part[order]
        self.start = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=n_terms))])
        self.seen = np.zeros(len(n), bool)

    def lookup(self, docs: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Full scores of documents (each holds a term), from the forward index."""
        size = self.first[docs + 1] - self.first[docs]
        edge = np.cumsum(size) - size
        at = np.repeat(self.first[docs] - edge, size) + np.arange(size.sum())
        return np.add.reduceat(weight[self.term[at]] * self.part[at], edge)

    def best(self, term: np.ndarray, value: np.ndarray, weight: np.ndarray, rank: np.ndarray, k: int, floor: int = 0, depth: int = 32) -> tuple[np.ndarray, np.ndarray, int]:
        """(documents, scores, number looked up): the k best of scores of at least `floor` and above 0. term, value: the item's terms and weights; weight: those of all terms; rank: the documents' order of ids."""
        start, end = self.start[term], self.start[term + 1]
        use = (end > start) & (value > 0)
        start, end, value = start[use], end[use], value[use]
        docs, scores, looked = np.zeros(0, np.int64), np.zeros(0, np.int64), []
        while len(start):
            stop = np.minimum(start + depth, end)
            size = stop - start
            at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
            met = self.doc[at]
            met = np.unique(met[~self.seen[met]])
            self.seen[met] = True
            looked.append(met)
            if len(met):
                found = self.lookup(met, weight)
                keep = found >= max(floor, 1)
                docs, scores = np.append(docs, met[keep]), np.append(scores, found[keep])
                top = np.lexsort((rank[docs], -scores))[:k]
                docs, scores = docs[top], scores[top]
            more = stop < end
            start, end, value = stop[more], end[more], value[more]
            least = max(floor, int(scores[-1]) if len(scores) == k else 0)
            if len(start) and int((value * self.impact[start]).sum()) < max(least, 1):
                break
            depth *= 2
        for met in looked:
            self.seen[met] = False
        return docs, scores, sum(map(len, looked))


def _search(shared, stats: tuple[int, int, int], k: int, shard_entries: int, kind: pa.DataType):
    """Rows: doc_id, n, terms, times. The k best documents of each item among a task's."""

    def shards(batches):
        held, size = [], 0
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                held.append(part)
                size += len(part.column(2).flatten())
                if size >= shard_entries:
                    yield pa.Table.from_batches(held)
                    held, size = [], 0
        if held:
            yield pa.Table.from_batches(held)

    def run(batches):
        items, weights = shared.value
        best: list[list] = [[] for _ in range(len(items.first) - 1)]
        dense = np.zeros(len(items.terms), np.int64)
        for t in shards(batches):
            flat = [t.column(c).combine_chunks() for c in range(4)]
            counts = flat[2].value_lengths().to_numpy(zero_copy_only=False)
            shard = Shard(flat[1].to_numpy(), counts, flat[2].flatten().to_numpy(), flat[3].flatten().to_numpy(), stats, len(items.terms))
            order = pc.sort_indices(flat[0]).to_numpy()
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            for i, old in enumerate(best):
                mine = slice(items.first[i], items.first[i + 1])
                term = items.term[mine]
                value = items.times[mine] * weights[term]
                dense[term] = value
                docs, scores, _ = shard.best(term, value, dense, rank, k, old[-1][0] if len(old) == k else 0)
                dense[term] = 0
                new = zip(scores.tolist(), flat[0].take(pa.array(docs)).to_pylist(), strict=True)
                best[i] = sorted([*old, *new], key=lambda x: (-x[0], x[1] is None, x[1] if x[1] is not None else 0))[:k]
        rows = [(i, score, doc) for i, found in enumerate(best) for score, doc in found]
        yield pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[2] for r in rows], kind), pa.array([r[1] for r in rows], pa.int64())], ["item", "doc_id", "score"])
        release_memory()

    return run


def _best(rows: DataFrame, k: int, *by: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 10, b: int = 75, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = 8_000_000, shard_entries: int = 2_000_000, salts: int = 64) -> DataFrame:
    """Each item's k highest-scoring documents with a score above 0: item_id, rank (from 1), doc_id, score."""
    spark = docs.sparkSession
    rows = with_small_batches(docs).select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    asked = items.select(F.col(item_id).alias("item_id"), F.col(item_text).cast("string").alias("text")).filter("text is not null")
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // block_bytes)
    out = None
    for block in range(blocks):
        held = asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).toArrow()
        if held.num_rows:
            found = _search_block(spark, rows, held.column("text").combine_chunks(), k, b, shard_entries, salts)
            if found is not None:
                names = spark.createDataFrame(pa.table({"item": pa.array(range(held.num_rows), pa.int32()), "item_id": held.column("item_id")}), f"item int, item_id {items.schema[item_id].dataType.simpleString()}")
                found = found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
                out = found if out is None else out.union(found)
    kinds = [f"{x} {s.schema[c].dataType.simpleString()}" for x, s, c in (("item_id", items, item_id), ("doc_id", docs, doc_id))]
    return spark.createDataFrame([], f"{kinds[0]}, rank int, {kinds[1]}, score long") if out is None else out


def _search_block(spark: SparkSession, rows: DataFrame, texts: pa.Array, k: int, b: int, shard_entries: int, salts: int) -> DataFrame | None:
    """item (row number in texts), rank, doc_id, score."""
    items = Items(texts)
    if not len(items.terms):
        return None
    kind = rows.schema["doc_id"].dataType
    terms = spark.sparkContext.broadcast(items.terms)
    forward = write_table(rows.mapInArrow(_forward(terms), f"doc_id {kind.simpleString()}, n long, terms array<int>, times array<int>"), "forward")
    n_docs, n_terms = forward.agg(F.count("*"), F.sum("n")).first()
    if not n_docs:
        return None
    held = forward.select("terms").mapInArrow(_holders(len(items.terms)), "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    weights = np.zeros(len(items.terms), np.int64)
    for term, df in zip(held.column("term").to_pylist(), held.column("df").to_pylist(), strict=True):
        weights[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
    shared = spark.sparkContext.broadcast((items, weights))
    arrow_kind = forward.select("doc_id").limit(0).toArrow().schema.field(0).type
    best = forward.mapInArrow(_search(shared, (n_docs, n_terms, b), k, shard_entries, arrow_kind), f"item int, doc_id {kind.simpleString()}, score long")
    # In two levels, so that no task gets what all tasks have found for an item.
    best = _best(best.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts))), k, "item", "salt").select("item", "doc_id", "score")
    return _best(best, k, "item").select("item", "rank", "doc_id", "score")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
stats AS (SELECT count(*) AS n_docs, CAST(sum(len(ts)) AS BIGINT) AS n_terms FROM d WHERE len(ts) > 0),
flat AS (SELECT doc_id, len(ts) AS n, unnest(ts) AS t FROM d),
tf AS MATERIALIZED (SELECT doc_id, n, t, count(*) AS tf FROM flat GROUP BY ALL),
q AS (SELECT item_id, t, count(*) AS c FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark) GROUP BY ALL),
w AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * any_value(n_docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tf, stats GROUP BY t),
scores AS (SELECT q.item_id, tf.doc_id, CAST(sum(q.c * w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (100 - 75 + (75 * tf.n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM q JOIN w USING (t) JOIN tf ON tf.t = q.t, stats GROUP BY q.item_id, tf.doc_id),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
