"""Vector retrieval and linkage of claims to evidence."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def hashed_embedding(c: Column, dim: int = 64) -> Column:
    """Offline embedding: word counts in hashed places, of length one."""
    words = F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    places = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(dim)).cast("int"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(places, lambda p: p == i)).cast("double"))
    length = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(counts, lambda x: x / F.greatest(length, F.lit(1e-12)))


#: Bytes of queries that are broadcast; beyond it their blocks are shuffled.
MOST_BROADCAST = 64 << 20


def _in_blocks(rows: int, numbers: int):
    """Rows: id, vector, others. Packs vectors of one length into blocks of at most so many rows and numbers, in order of id."""

    def run(batches):
        for b in batches:
            b = b.sort_by(b.schema.names[0])
            lengths = b.column(1).value_lengths().to_numpy(zero_copy_only=False)
            for d in np.unique(lengths):
                some, step = b.filter(pa.array(lengths == d)), max(1, min(rows, numbers // max(1, d)))
                for i in range(0, some.num_rows, step):
                    part = some.slice(i, step)
                    values = [part.column(0), part.column(1).flatten(), *part.columns[2:]]
                    yield pa.record_batch([pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in values], b.schema.names)

    return run


def _best_of_pairs(k: int, digits: int):
    """Rows: query ids, their vectors, ids, their vectors, others. The k best hits of each query in each pair of blocks."""

    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                queries, q, ids, m, keep = (b.column(c)[r].values for c in range(5))
                if len(q) * len(ids) != len(m) * len(queries):
                    continue
                q, m = (x.to_numpy(zero_copy_only=False).astype(float).reshape(n, -1) if len(x) else np.zeros((n, 0)) for x, n in ((q, len(queries)), (m, len(ids))))
                score = np.round(q @ m.T, digits) + 0.0
                top = min(k, len(ids))
                floor = -np.partition(-score, top - 1, axis=1)[:, top - 1]
                row, at = np.nonzero(score >= floor[:, None])
                order = np.lexsort((at, -score[row, at], row))
                row, at = row[order], at[order]
                use = np.arange(len(row)) - np.searchsorted(row, row) < top
                row, at = row[use], at[use]
                yield pa.record_batch([queries.take(pa.array(row)), ids.take(pa.array(at)), pa.array(score[row, at]), keep.take(pa.array(at))], ["query_id", "idx", "score", "_keep"])

    return run


def top_k(queries: DataFrame, chunks: DataFrame, k: int = 5, fetch: int | None = None, keep: Column | None = None, digits: int = 6) -> DataFrame:
    """(query_id, rank, idx, score): the k best inner products of each query (query_id, embedding), ties to the smaller idx.

    keep filters after `fetch` candidates were ranked, so fewer than k may be left; without fetch it filters before. Queries are a given
    set, held against all chunks as blocks of vectors, of which each pair gives k hits a query. A vector that is null or holds a null or
    non-finite number, and one of another length than the query's, is no hit.
    """
    rows = chunks if keep is None or fetch else chunks.filter(keep)
    whole = F.forall("embedding", lambda x: F.abs(x) < float("inf"))
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    asked = queries.filter(whole).select("query_id", F.col("embedding").alias("_q"))
    numbers = asked.agg(F.sum(F.size("_q"))).first()[0] or 0
    asked = asked.mapInArrow(_in_blocks(512, 1 << 18), f"query_id array<{kind(asked, 'query_id')}>, _q {kind(asked, '_q')}")
    held = rows.filter(whole).select("idx", "embedding", F.coalesce(keep if fetch and keep is not None else F.lit(True), F.lit(False)).alias("_keep"))
    held = held.mapInArrow(_in_blocks(2048, 1 << 20), f"idx array<{kind(held, 'idx')}>, embedding {kind(held, 'embedding')}, _keep array<boolean>")
    pairs = held.crossJoin(F.broadcast(asked) if numbers * 8 <= MOST_BROADCAST else asked).select("query_id", "_q", "idx", "embedding", "_keep")
    scored = pairs.mapInArrow(_best_of_pairs(fetch or k, digits), f"query_id {kind(queries, 'query_id')}, idx {kind(chunks, 'idx')}, score double, _keep boolean")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "idx")
    ranked = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= (fetch or k))
    if fetch and keep is not None:
        ranked = ranked.filter("_keep").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "idx", "score")


#: Claims of a group that go to one place, and places of a group at most.
_CLAIMS, _PLACES = 2048, 16


def _in_group_blocks(rows: int = 1024, size: int = 1 << 20):
    """Rows: group, place, id, text, vector. Packs vectors of one group, place and length into blocks of at most so many rows and about so many bytes, in order of id."""

    def run(batches):
        for b in batches:
            names = b.schema.names
            b = b.append_column("_n", pc.list_value_length(b.column(4))).sort_by([(names[0], "ascending"), (names[1], "ascending"), ("_n", "ascending"), (names[2], "ascending")])
            new = np.zeros(b.num_rows, bool)
            new[:1] = True
            for c in (0, 1, 5):
                new[1:] |= pc.not_equal(b.column(c).slice(1), b.column(c).slice(0, max(0, b.num_rows - 1))).to_numpy(zero_copy_only=False)
            ends = [*np.flatnonzero(new), b.num_rows]
            step = max(1, min(rows, size * b.num_rows // max(1, b.nbytes)))
            for start, end in zip(ends, ends[1:], strict=False):
                for i in range(start, end, step):
                    part = b.slice(i, min(step, end - i))
                    values = [part.column(2), part.column(3), part.column(4).flatten()]
                    yield pa.record_batch([part.column(0).slice(0, 1), part.column(1).slice(0, 1), *[pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in values]], names[:5])

    return run


def _best_of_groups(k: int, digits: int):
    """Rows: group, ids of claims, their texts and vectors, ids of sentences, their texts and vectors. The k best sentences of each claim of a block in the blocks that follow each other in rows with it."""
    names = ["group", "claim_id", "claim", "idx", "sentence", "score"]

    def rounded(x):
        with np.errstate(invalid="ignore", over="ignore"):
            return np.trunc(x * 10.0**digits + np.copysign(0.5, x)) / 10.0**digits + 0.0

    def best(row, score, later):
        """The places of the k best of each row, ties to the later; NaN is above all, as in Spark."""
        nan = np.isnan(score)
        order = np.lexsort((-later, -np.where(nan, np.inf, score), ~nan, row))
        row = row[order]
        return order[np.arange(len(row)) - np.searchsorted(row, row) < k]

    def found(q, m):
        """(row, place, score) of the k best of each row of q among m, by strips of rows."""
        for i in range(0, len(q), 256):
            score = q[i : i + 256] @ m.T
            if score.shape[1] > k:
                # The k-th best of the maxima of parts is not above the k-th best of all; rounding moves it by a unit at most.
                n = min(score.shape[1], max(k, 64))
                most = np.fmax.reduceat(score, np.linspace(0, score.shape[1], n, endpoint=False).astype(int), axis=1)
                floor = np.partition(np.where(np.isnan(most), -np.inf, most), n - k, axis=1)[:, n - k] - 2 * 10.0**-digits
                row, at = np.nonzero(~(score < floor[:, None]))
            else:
                row, at = (x.ravel() for x in np.indices(score.shape))
            value = rounded(score[row, at])
            use = best(row, value, at)
            yield row[use] + i, at[use], value[use]

    def run(batches):
        # The block of claims at hand, as columns and as vectors, and its best: row, score, idx, sentence.
        block, q, held = None, None, None

        def given():
            row, score, idx, sentence = held
            group, ids, texts, _ = block
            return pa.record_batch([pa.array([group.as_py()] * len(row), group.type), ids.take(pa.array(row)), texts.take(pa.array(row)), idx, sentence, pa.array(score)], names)

        for b in batches:
            for r in range(b.num_rows):
                now = (b.column(0)[r], *(b.column(c)[r].values for c in (1, 2, 3)))
                ids, texts, m = (b.column(c)[r].values for c in (4, 5, 6))
                if block is None or not all(x.equals(y) for x, y in zip(block, now, strict=True)):
                    if held is not None:
                        yield given()
                    block, held = now, None
                    q = now[3].to_numpy(zero_copy_only=False).astype(float).reshape(len(now[1]), -1) if len(now[3]) else np.zeros((len(now[1]), 0))
                m = m.to_numpy(zero_copy_only=False).astype(float).reshape(len(ids), -1) if len(m) else np.zeros((len(ids), 0))
                if q.shape[1] != m.shape[1]:
                    continue
                row, at, score = (np.concatenate(x) for x in zip(*found(q, m), strict=True))
                idx, sentence = ids.take(pa.array(at)), texts.take(pa.array(at))
                if held is not None:
                    row, score = np.concatenate([held[0], row]), np.concatenate([held[1], score])
                    idx, sentence = pa.concat_arrays([held[2], idx]), pa.concat_arrays([held[3], sentence])
                    use = best(row, score, pc.rank(idx, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64))
                    row, score, idx, sentence = row[use], score[use], idx.take(pa.array(use)), sentence.take(pa.array(use))
                held = (row, score, idx, sentence)
        if held is not None:
            yield given()

    return run


def link_claims(claims: DataFrame, sentences: DataFrame, group: str = "encounter_id", k: int = 3, least: float = 0.3, digits: int = 6) -> DataFrame:
    """(group, claim_id, claim, evidence, has_sentences): each claim's up to k most similar sentences of its group, ties to the higher idx; claims without any stay.

    Vectors go in blocks, each block of claims against all blocks of its group's sentences; claims of a large group are dealt to several
    places, to which its sentences are copied. Vectors that are null or hold nulls, and pairs of other lengths, have no similarity.
    """
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    whole = F.forall("embedding", lambda x: x.isNotNull()) & F.col(group).isNotNull()
    places = claims.filter(whole).groupBy(group).agg(F.least(F.lit(_PLACES), F.ceil(F.count("*") / _CLAIMS)).cast("int").alias("_places"))
    asked = claims.filter(whole).join(places, group).select(F.col(group).alias("group"), F.pmod(F.xxhash64("claim_id"), "_places").cast("int").alias("place"), "claim_id", F.col("text").alias("claim"), F.col("embedding").alias("_c"))
    told = sentences.filter(whole).join(places, group).select(F.col(group).alias("group"), F.explode(F.sequence(F.lit(0), F.col("_places") - 1)).alias("place"), "idx", F.col("text").alias("sentence"), F.col("embedding").alias("_s"))

    def blocks(df: DataFrame) -> DataFrame:
        a, b, c = df.columns[2:]
        rows = df.repartition("group", "place").sortWithinPartitions("group", "place")
        return rows.mapInArrow(_in_group_blocks(), f"group {kind(df, 'group')}, place int, {a} array<{kind(df, a)}>, {b} array<{kind(df, b)}>, {c} {kind(df, c)}")

    pairs = blocks(asked).join(blocks(told).hint("shuffle_merge"), ["group", "place"]).select("group", "claim_id", "claim", "_c", "idx", "sentence", "_s")
    hits = pairs.mapInArrow(_best_of_groups(k, digits), f"group {kind(claims, group)}, claim_id {kind(claims, 'claim_id')}, claim {kind(claims, 'text')}, idx {kind(sentences, 'idx')}, sentence {kind(sentences, 'text')}, score double")
    order = Window.partitionBy("group", "claim_id").orderBy(F.desc("score"), F.desc("idx"))
    top = hits.withColumn("rank", F.row_number().over(order)).filter((F.col("rank") <= k) & (F.col("score") >= least))
    top = top.groupBy(F.col("group").alias("_g"), F.col("claim_id").alias("_i"), F.col("claim").alias("_t")).agg(F.array_sort(F.collect_list(F.struct("rank", "idx", "score", "sentence"))).alias("evidence"))
    all_claims = claims.select(group, "claim_id", F.col("text").alias("claim")).distinct()
    some = sentences.filter("idx is not null").select(F.col(group).alias("_g")).distinct().withColumn("has", F.lit(True))
    out = all_claims.join(top, F.col(group).eqNullSafe(F.col("_g")) & F.col("claim_id").eqNullSafe(F.col("_i")) & F.col("claim").eqNullSafe(F.col("_t")), "left").drop("_g", "_i", "_t")
    none = F.array().cast(top.schema["evidence"].dataType)
    out = out.join(some, F.col(group) == F.col("_g"), "left")
    return out.select(group, "claim_id", "claim", F.coalesce("evidence", none).alias("evidence"), F.coalesce("has", F.lit(False)).alias("has_sentences"))


# Words that negate.
CLAIM_NEGATIONS = ("no ", "denies", "negative", "absent", "without")
SENTENCE_NEGATIONS = ("no ", "denies", "don't", "doesn't", "negative")


def verdicts(links: DataFrame) -> DataFrame:
    """Adds verdict and confidence: contradicted by the first evidence over 0.5 whose negation differs, else entailed over 0.6, or over 0.4 with less confidence, else unsupported."""
    negated = T.contains_any(F.lower("claim"), CLAIM_NEGATIONS)
    clash = F.get(F.filter("evidence", lambda e: (e["score"] > 0.5) & (T.contains_any(F.lower(e["sentence"]), SENTENCE_NEGATIONS) != negated)), F.lit(0))
    best = F.coalesce(F.array_max(F.transform("evidence", lambda e: e["score"])), F.lit(0.0))
    none = F.size("evidence") == 0
    verdict = F.when(none, "unsupported").when(clash.isNotNull(), "contradicted").when(best > 0.4, "entailed").otherwise("unsupported")
    confidence = F.when(~F.col("has_sentences"), 1.0).when(none, 0.9).when(clash.isNotNull(), F.least(F.lit(0.9), clash["score"])).when(best > 0.6, best).when(best > 0.4, 0.8 * best).otherwise(1 - best)
    return links.withColumn("verdict", verdict).withColumn("confidence", F.least(F.greatest(confidence, F.lit(0.0)), F.lit(1.0)))


# What a model of inference says, as a verdict.
NLI_VERDICTS = {"entailment": "entailed", "contradiction": "contradicted", "neutral": "unsupported"}


def nli_verdicts(links: DataFrame, make_model: Callable[[], Callable[[str, str], tuple[str, float]]] | None = None) -> DataFrame:
    """Adds verdict and confidence by a model (premise, claim) -> (label, score), the premise being all evidence of the claim; where it fails the claim is unsupported at 0.5. Without a model as verdicts()."""
    if make_model is None:
        return verdicts(links)
    rows = links.withColumn("_premise", F.array_join(F.transform("evidence", lambda e: e["sentence"]), " "))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in links.schema)

    def run(batches):
        model = make_model()
        for b in batches:
            said = []
            for premise, claim in zip(b.column("_premise").to_pylist(), b.column("claim").to_pylist(), strict=True):
                try:
                    label, score = model(premise, claim)
                    said.append((NLI_VERDICTS.get(label, "unsupported"), float(score)))
                except Exception:  # a failed call is a row's verdict, not the job's end
                    said.append(("unsupported", 0.5))
            kept = b.drop_columns("_premise")
            yield pa.record_batch([*kept.columns, pa.array([v for v, _ in said], pa.string()), pa.array([c for _, c in said], pa.float64())], [*kept.schema.names, "verdict", "confidence"])

    return rows.mapInArrow(run, f"{schema}, verdict string, confidence double")


def embedded_text(c: Column, most: int = 5000) -> Column:
    """What of a chunk an embedder gets: its first characters (the limit is the embedder's; the chunk itself stays whole)."""
    return F.substring(c, 1, most)


def retrieval_query(facts: DataFrame) -> DataFrame:
    """Adds query: what a facts row says, as text for retrieval."""
    present = lambda c: F.filter(c, lambda x: x["assertion"] == "present")
    named = lambda c: F.transform(present(c), lambda x: F.coalesce(T.blank_to_null(x["name_norm"]), x["name_surface"]))
    part = lambda label, values: F.when(F.size(values) > 0, F.concat(F.lit(label + ": "), F.array_join(values, ", ")))
    parts = [
        F.when(T.strip(F.col("chief_complaint")) != "", F.concat(F.lit("Chief complaint: "), "chief_complaint")),
        part("Symptoms", F.slice(named("symptoms"), 1, 5)),
        part("Vitals", F.transform("vitals", lambda v: F.concat_ws("=", v["kind"], v["value"]))),
        part("Current medications", F.slice(named("meds"), 1, 5)),
        part("Risk factors", F.slice("risk_factors", 1, 5)),
        part("Allergies", F.transform(present("allergies"), lambda a: a["substance_surface"])),
    ]
    joined = F.concat_ws(". ", *parts)
    return facts.withColumn("query", F.when(joined == "", "clinical presentation").otherwise(joined))


def union_evidence(corpora: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Hits of several corpora, with evidence_id `source:idx`."""
    out = None
    for source, hits in corpora:
        one = hits.withColumn("source", F.lit(source)).withColumn("evidence_id", F.concat_ws(":", F.lit(source), F.col("idx").cast("string")))
        out = one if out is None else out.unionByName(one)
    return out
