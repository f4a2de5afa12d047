"""Exact top-k search by norm-sorted inner products.

Vectors are packed into blocks in order of descending length. The axes are rotated onto the singular vectors of all vectors (from their
Gram matrix), so that the leading coordinates carry most of an inner product. In each pair of a query block and a candidate block,
candidates go by in descending length; a query stops once its length times theirs falls below its k-th best score so far, and a
candidate is dropped if the product of leading coordinates plus the product of what both have left (Cauchy-Schwarz) does. The others get
the exact integer product. Every query starts from the k-th best score over a bounded number of the longest vectors.

The range of lengths is cut at quantiles of all vectors, and a candidate block belongs to the class of its longest vector. Query blocks are
of queries of like length, and go only to the classes that can still beat the least of their starting scores. A class is dealt out by a
salt, so work spreads whatever the vectors are; a task holds two blocks, and best scores of the queries that it has met.

Results: a vector that is null or has a null or non-finite component, or no id, takes no part; shorter vectors count as padded with
zeros; no vectors or no queries give no rows. Rows that repeat a query's id are asked together, and the id gets the highest scores over all
of them; as candidates of others each row counts. Vectors whose squared length is 2**53 or more raise an error, since products must be exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import table, write_table
from .wordhash import release_memory


def integers(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", factor: int = 256) -> DataFrame:
    """(vec_id, ints, norm2) of the vectors that take part; each component becomes floor(factor * x)."""
    ok = F.col(vec_id).try_cast("long").isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    out = df.filter(ok).select(F.col(vec_id).try_cast("long").alias("vec_id"), F.transform(vector, lambda x: F.floor(factor * x.cast("double")).cast("long")).alias("ints"))
    return out.withColumn("norm2", F.aggregate("ints", F.lit(0.0), lambda a, x: a + x.cast("double") * x))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    n = column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), d), np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    at = np.repeat(np.cumsum(n) - n, n)
    out[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - at] = flat
    return out


def _gram(d: int):
    def run(batches):
        total = np.zeros((d, d))
        for b in batches:
            x = _matrix(b.column(0), d).astype(float)
            total += x.T @ x
        i, j = np.nonzero(total)
        yield pa.record_batch([pa.array(i), pa.array(j), pa.array(total[i, j])], ["i", "j", "x"])

    return run


def _best(row: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's k best scores, ties to the smaller id."""
    order = np.lexsort((ids, -score, row))
    row, score, ids = row[order], score[order], ids[order]
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])[: len(row)])
    rank = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
    return row[rank < k], score[rank < k], ids[rank < k]


def _packed(d: int, size: int, seeds=None, k: int = 0):
    """Packs rows (vec_id, ints), sorted by descending length, into blocks with their greatest length; queries also get the k-th best score over the seeds, and the least length that a candidate needs."""

    def block(ids: list, ints: list) -> pa.RecordBatch:
        i, x = np.concatenate(ids), np.concatenate(ints)
        floor, length = np.full(len(i), -np.inf), np.sqrt((x.astype(float) ** 2).sum(1))
        if seeds is not None:
            seed_ids, seed = seeds.value
            if len(seed_ids) > k:
                score = x.astype(float) @ seed.T.astype(float)
                score[i[:, None] == seed_ids[None, :]] = -np.inf
                floor = np.sort(score, axis=1)[:, -k]
        need = np.where(floor > 0, floor / np.maximum(length, 1e-300), 0.0).min() * (1 - 1e-6) - 1e-6
        return pa.record_batch([pa.array([float(length.max())]), pa.array([float(need)]), pa.array([i.tobytes()]), pa.array([x.tobytes()]), pa.array([floor.tobytes()])], ["longest", "need", "ids", "ints", "floor"])

    def run(batches):
        ids, ints, n = [], [], 0
        for b in batches:
            for a in range(0, b.num_rows, size):
                part = b.slice(a, size)
                ids.append(part.column(0).to_numpy())
                ints.append(_matrix(part.column(1), d))
                n += part.num_rows
                if n >= size:
                    yield block(ids, ints)
                    ids, ints, n = [], [], 0
        if n:
            yield block(ids, ints)
        release_memory()

    return run


def search(q_ids, q, floor, c_ids, c, rotation, lead: int, k: int, step: int = 512):
    """Top k of each query among candidates sorted by descending length: (query row, score, id)."""
    qr, cr = q @ rotation, c @ rotation
    q_len, c_len = np.sqrt((q.astype(float) ** 2).sum(1)), np.sqrt((c.astype(float) ** 2).sum(1))
    rest = lambda x: np.sqrt((x[:, lead:] ** 2).sum(1))
    q_rest, c_rest = rest(qr), rest(cr)
    least = floor.copy()
    row, score, ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    for a in range(0, len(c), step):
        slack = 1e-6 * (1 + q_len * c_len[a])
        on = np.flatnonzero(q_len * c_len[a] + slack >= least)
        if not len(on):
            break
        z = slice(a, a + step)
        bound = qr[on, :lead] @ cr[z, :lead].T + q_rest[on, None] * c_rest[None, z] + slack[on, None]
        r, j = np.nonzero((bound >= least[on, None]) & (q_ids[on, None] != c_ids[None, z]))
        r, j = on[r], j + a
        new = np.concatenate([np.einsum("ij,ij->i", q[r[x : x + 100_000]], c[j[x : x + 100_000]]) for x in range(0, len(r), 100_000)] or [np.zeros(0, np.int64)])
        good = new >= least[r]
        row, score, ids = _best(np.concatenate([row, r[good]]), np.concatenate([score, new[good]]), np.concatenate([ids, c_ids[j[good]]]), k)
        at = np.flatnonzero(np.bincount(row, minlength=len(q)) == k)
        last = np.searchsorted(row, at, side="right") - 1
        least[at] = np.maximum(least[at], score[last])
    return row, score, ids


def _pairs(shared, d: int, k: int, most: int = 500_000):
    """Scores of block pairs; what a task has found is cut to the k best of each query whenever it has `most` rows, and given out if that is not enough."""

    def run(batches):
        rotation, lead = shared.value
        held = [np.zeros(0, np.int64)] * 3

        def out(held):
            return pa.record_batch([pa.array(x) for x in (held[0], held[2], held[1])], ["query_id", "vec_id", "score"])

        for b in batches:
            for x in b.to_pylist():
                q_ids, c_ids = np.frombuffer(x["q_ids"], np.int64), np.frombuffer(x["c_ids"], np.int64)
                q, c = np.frombuffer(x["q_ints"], np.int64).reshape(-1, d), np.frombuffer(x["c_ints"], np.int64).reshape(-1, d)
                row, score, ids = search(q_ids, q, np.frombuffer(x["floor"], np.float64), c_ids, c, rotation, lead, k)
                held = [np.concatenate([h, new]) for h, new in zip(held, (q_ids[row], score, ids), strict=True)]
                if len(held[0]) > most:
                    held = list(_best(*held, k))
                    if len(held[0]) > most / 2:
                        yield out(held)
                        held = [x[:0] for x in held]
        yield out(_best(*held, k))
        release_memory()

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = 2048, seed_rows: int = 1024, classes: int = 32, salts: int = 4, energy: float = 0.9) -> DataFrame:
    """vectors, queries: (vec_id, ints, norm2). Returns (query_id, rank, vec_id, score): each query's k highest inner products with vectors of other ids, ties to the smaller id."""
    spark = vectors.sparkSession
    steps = F.percentile_approx("norm2", F.array(*[F.lit(i / classes) for i in range(1, classes)]), 10_000)
    size = vectors.agg(F.max(F.size("ints")).alias("d"), F.count("*").alias("n"), F.max("norm2").alias("norm2"), steps.alias("steps")).first()
    n, d = size["n"], max(1, size["d"] or 0)
    if max(size["norm2"] or 0, queries.agg(F.max("norm2")).first()[0] or 0) >= 2**53:
        raise ArithmeticError("a vector's squared length is 2**53 or more")
    gram = np.zeros((d, d))
    for r in vectors.select("ints").mapInArrow(_gram(d), "i long, j long, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).collect():
        gram[r["i"], r["j"]] = r["x"]
    weight, axes = np.linalg.eigh(gram)
    weight, axes = weight[::-1].clip(0), axes[:, ::-1]
    lead = min(d, 1 + int(np.searchsorted(np.cumsum(weight) / max(weight.sum(), 1e-300), energy)))
    order = [F.desc("norm2"), "vec_id"]
    longest = vectors.orderBy(*order).limit(seed_rows).select("vec_id", "ints").collect()
    seed = np.zeros((len(longest), d), np.int64)
    for i, r in enumerate(longest):
        seed[i, : len(r["ints"])] = r["ints"]
    seeds = spark.sparkContext.broadcast((np.array([r["vec_id"] for r in longest], np.int64), seed))
    shared = spark.sparkContext.broadcast((np.ascontiguousarray(axes), lead))
    kind = "longest double, need double, ids binary, ints binary, floor binary"

    def packed(df: DataFrame, n: int, *more) -> DataFrame:
        ranged = df.repartitionByRange(max(1, -(-n // block)), *order).sortWithinPartitions(*order).select("vec_id", "ints")
        return ranged.mapInArrow(_packed(d, block, *more), kind)

    cuts = sorted({float(np.sqrt(x)) for x in size["steps"] or []})
    # Of a length, the number of cuts that it reaches.
    class_of = lambda x: sum((F.when(x >= F.lit(c), 1).otherwise(0) for c in cuts), F.lit(0))
    salt = F.pmod(F.xxhash64("ids"), F.lit(salts)).cast("int")
    candidates = write_table(packed(vectors, n).select(F.col("ids").alias("c_ids"), F.col("ints").alias("c_ints"), class_of(F.col("longest")).alias("class"), salt.alias("salt")), "vectors")
    asked = write_table(packed(queries, queries.count(), seeds, k).select(F.col("ids").alias("q_ids"), F.col("ints").alias("q_ints"), "floor", class_of(F.col("need")).alias("least")), "queries")
    asked = asked.withColumn("class", F.explode(F.sequence(F.col("least"), F.lit(len(cuts))))).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    pairs = asked.hint("merge").join(candidates, ["class", "salt"]).select("q_ids", "q_ints", "floor", "c_ids", "c_ints")
    found = pairs.mapInArrow(_pairs(shared, d, k), "query_id long, vec_id long, score long")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", best).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = integers(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.filter("vec_id % 50 = 0"))


OP2_SQL = """
WITH v AS (SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([q.e[i] * c.e[i] for i in range(1, len(q.e) + 1)]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id != c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
