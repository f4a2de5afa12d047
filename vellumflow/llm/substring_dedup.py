"""Substring dedup: Relative Lempel-Ziv parsing against an index of word blocks.

The reference of a document is everything before it (smaller doc_id, and its own earlier words). Blocks are runs of `length` words; the
index gives every block's first place (document and word). The parse goes left to right over the runs of blocks that have a place
before their own. A factor opens at the run's first block, and is laid out block by block, each of which begins where the one before it
ends; it goes on while their first places follow each other in the same source, and a new factor opens where they don't. The last block
of a run reaches back over the one before it, so that the factor's end is its own. All blocks over the boundary of two factors or of a
factor and other words are looked up too: they belong to the runs or end them. So each word of a factor is in a block that its source
holds at the stated place, and a word is in a factor exactly if some block over it occurs earlier. Factors, with their sources, are the
duplicate spans; their words are removed.

Only blocks that can recur are indexed. Winnowing picks, in each block, its `k`-word gram of least hash, so equal blocks pick equal grams;
a gram that is picked at one place only rules out all blocks over it. About two grams in length - k + 2 words are shuffled instead of
every word, and whole texts move compressed.

Blocks are known by 128 bits of hash of all their words: among 1e13 blocks any two different ones agree with probability below 1e-12.

Results: null text has no words; a text of fewer than `length` (2 or more) words, and a row without doc_id, loses nothing and is no
reference; ids keep their type, and earlier is what is smaller in its order; of several rows with one doc_id none is earlier than another at the same place, and exact repeats lose the same.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import table, with_small_batches, write_table
from .wordhash import Words, grams, release_memory, run_starts, slices


def _sliding(a: np.ndarray, n: int, best) -> np.ndarray:
    """best (np.minimum or np.maximum) over each n consecutive entries."""
    width = 1
    while width * 2 <= n:
        a = best(a[:-width], a[width:]) if len(a) > width else a[:0]
        width *= 2
    return best(a[: len(a) - (n - width)], a[n - width :]) if n > width else a


def _picked(h: np.ndarray, n: int) -> np.ndarray:
    """Which grams are the least of some n consecutive ones."""
    if len(h) < n:
        return np.zeros(len(h), bool)
    least = _sliding(h, n, np.minimum)
    pad = np.zeros(n - 1, np.uint64)
    return _sliding(np.concatenate([pad, least, pad]), n, np.maximum) == h


def _anchors(length: int, k: int):
    def run(batches):
        for b in batches:
            for i, j in slices(b.column(2)):
                part = b.slice(i, j - i)
                w = Words(part.column(2))
                if len(w.row) < length:
                    continue
                h = grams(w.hashes(), k)
                keep = np.flatnonzero(_picked(h, length - k + 1) & run_starts(w, k) & (w.counts[w.row[: len(h)]] >= length))
                row = w.row[keep]
                yield pa.record_batch([pa.array(h[keep].view(np.int64)), part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row)), pa.array((keep - w.first[row]).astype(np.int32))], ["gram", "doc_id", "_row", "pos"])
        release_memory()

    return run


def _packed(batches):
    z = zstandard.ZstdCompressor(level=1)
    for b in batches:
        yield pa.record_batch([b.column(0), b.column(1), pa.array([None if x is None else z.compress(x.encode()) for x in b.column(2).to_pylist()], pa.binary()), *b.columns[3:]], ["doc_id", "_row", "packed", *b.schema.names[3:]])
    release_memory()


def _unpacked(column: pa.Array):
    """Row ranges of half a MB of text, or of one longer row, each with its texts."""
    z, texts, i, size = zstandard.ZstdDecompressor(), [], 0, 0
    for j, x in enumerate(column.to_pylist(), 1):
        texts.append("" if x is None else z.decompress(x).decode())
        size += len(texts[-1])
        if size > 1 << 19 or j == len(column):
            yield i, j, pa.array(texts, pa.large_string())
            texts, i, size = [], j, 0


def _marked(w: Words, places: pa.Array) -> np.ndarray:
    """Marks words by each row's list of word positions."""
    out = np.zeros(len(w.row), bool)
    flat = places.flatten().to_numpy(zero_copy_only=False)
    if len(flat):
        counts = places.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        out[np.repeat(w.first[:-1], counts) + flat] = True
    return out


def _blocks_at(w: Words, anchors: np.ndarray, length: int, k: int) -> np.ndarray:
    """Starts of the blocks that hold a gram picked at several places."""
    reach = np.concatenate([[0], np.cumsum(anchors)])
    ok = run_starts(w, length)
    return np.flatnonzero(ok & (reach[length - k + 1 : length - k + 1 + len(ok)] > reach[: len(ok)]))


def _named(w: Words, at: np.ndarray, length: int, part: pa.RecordBatch) -> pa.RecordBatch:
    """The blocks that start at the given words: 128 bits of hash, and their place."""
    row = w.row[at]
    rows = pa.array(row)
    bits = [pa.array(grams(w.hashes(seed), length)[at].view(np.int64)) for seed in (0, 1)]
    return pa.record_batch([*bits, part.column(0).take(rows), part.column(1).take(rows), pa.array((at - w.first[row]).astype(np.int32))], ["b1", "b2", "doc_id", "_row", "pos"])


def _blocks(length: int, k: int):
    """Rows: doc_id, _row, packed, anchors. All blocks that may recur."""

    def run(batches):
        for b in batches:
            some = b.filter(b.column(3).is_valid())
            for i, j, texts in _unpacked(some.column(2)):
                part, w = some.slice(i, j - i), Words(texts)
                yield _named(w, _blocks_at(w, _marked(w, part.column(3)), length, k), length, part)
        release_memory()

    return run


def _laid_out(length: int, k: int):
    """Rows: doc_id, _row, packed, anchors, firsts. The blocks that cover the runs of blocks with an earlier place, end to end."""

    def run(batches):
        for b in batches:
            some = b.filter(b.column(3).is_valid())
            for i, j, texts in _unpacked(some.column(2)):
                part, w = some.slice(i, j - i), Words(texts)
                seen = np.zeros(len(w.row) + 1, bool)
                seen[_blocks_at(w, _marked(w, part.column(3)), length, k)] = True
                seen[:-1] &= ~_marked(w, part.column(4))
                at = np.flatnonzero(seen)
                opens = np.concatenate([[True], np.diff(at) > 1])[: len(at)]
                step = at - at[opens][np.cumsum(opens) - 1] if len(at) else at
                use = at[(step % length == 0) | ~seen[at + 1]]
                if len(use):
                    yield _named(w, use, length, part)
        release_memory()

    return run


def _factors(lists: pa.Array, length: int) -> tuple:
    """(row, start, end, source, source_start) of the factors, from each row's blocks (pos, source, at) with an earlier place."""
    counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = lists.flatten()
    ids = flat.field("source").dictionary_encode()
    pos, source, at = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in (flat.field("pos"), ids.indices, flat.field("at")))
    row = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((pos, row))
    row, pos, source, at = row[order], pos[order], source[order], at[order]
    on = (row[1:] == row[:-1]) & (source[1:] == source[:-1]) & (np.diff(at - pos) == 0) & (pos[1:] <= pos[:-1] + length)
    opens = np.flatnonzero(np.concatenate([[True], ~on])[: len(row)])
    closes = np.append(opens[1:], len(row))[: len(opens)] - 1
    end = pos[closes] + length
    start = pos[opens]
    before = np.concatenate([[0], np.where(row[opens[1:]] == row[opens[:-1]], end[:-1], 0)])[: len(opens)]
    late = np.maximum(start, before)
    return row[opens], late, end, ids.dictionary.take(pa.array(source[opens])), at[opens] + late - start


def _cut(length: int, as_is: bool):
    """Rows: doc_id, _row, packed, found (blocks with their sources), others."""

    def run(batches):
        for b in batches:
            for i, j, texts in _unpacked(b.column(2)):
                part, w = b.slice(i, j - i), Words(texts)
                row, start, end, source, source_start = _factors(part.column(3), length)
                step = np.zeros(len(w.row) + 1, np.int64)
                np.add.at(step, w.first[row] + start, 1)
                np.add.at(step, w.first[row] + end, -1)
                gone = np.cumsum(step[:-1]) > 0
                fields = {"start": start.astype(np.int32), "end": end.astype(np.int32), "source": source, "source_start": source_start.astype(np.int32)}
                spans = pa.StructArray.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in fields.values()], list(fields))
                spans = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=j - i))]), pa.int32()), spans)
                kept = np.flatnonzero(~gone)
                use = np.zeros(len(w.data) + 1, np.int32)
                np.add.at(use, w.start[kept], 1)
                np.add.at(use, w.end[kept], -1)
                use = np.cumsum(use[:-1]) > 0
                last = np.concatenate([w.row[kept][1:] != w.row[kept][:-1], [True]])[: len(kept)]
                gaps = w.end[kept[~last]]
                use[gaps] = True
                w.data[gaps] = 0x20
                ends = np.concatenate([[0], np.cumsum(use)])[w.bounds]
                text = pa.LargeStringArray.from_buffers(j - i, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(w.data[use].tobytes())).cast(pa.string())
                removed = np.bincount(w.row[gone], minlength=j - i)
                if as_is:
                    text = pc.if_else(pa.array(removed == 0), texts.cast(pa.string()), text)
                yield pa.record_batch([part.column(0), pa.array(w.counts.astype(np.int64)), pa.array(removed.astype(np.int64)), text, spans, *part.columns[4:]], ["doc_id", "n_words", "n_removed", "kept_text", "spans", *part.schema.names[4:]])
        release_memory()

    return run


def substring_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 20, k: int = 8, also: Sequence[str] = (), as_is: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_text (kept words, one space between), spans (start and end of each factor, its source and its start there, in words), and the columns named in also. With as_is, a text that loses nothing keeps its white space."""
    ids = docs.agg(F.count(doc_id).alias("n"), F.count_distinct(doc_id).alias("d")).first()
    unique = ids["n"] == ids["d"]
    # Tells apart the texts that share an id; without these a constant, which costs nothing to shuffle.
    row = F.lit(0).cast("long") if unique else F.xxhash64(text)
    others = [F.col(c).alias(f"_also{n}") for n, c in enumerate(also)]
    rows = with_small_batches(docs).select(F.col(doc_id).alias("doc_id"), row.alias("_row"), F.col(text).cast("string").alias("text"), *others)
    kinds = "".join(f", _also{n} {docs.schema[c].dataType.simpleString()}" for n, c in enumerate(also))
    kind = rows.schema["doc_id"].dataType.simpleString()
    place, key = f"doc_id {kind}, _row long, pos int", ["doc_id", "_row"]
    anchors = rows.select(*key, "text").filter("doc_id is not null").mapInArrow(_anchors(length, k), f"gram long, {place}")
    # Written, so that both sides of the join have exchanges of their own and AQE can split a very common gram.
    again = write_table(anchors.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1").select("gram"), "again")
    places = write_table(anchors.join(again, "gram").groupBy(*key).agg(F.collect_set("pos").alias("anchors")), "anchors")
    packed = rows.mapInArrow(_packed, f"doc_id {kind}, _row long, packed binary{kinds}")
    held = packed.join(places, key, "left")
    blocks = held.select(*key, "packed", "anchors").mapInArrow(_blocks(length, k), f"b1 long, b2 long, {place}")
    index = write_table(blocks.groupBy("b1", "b2").agg(F.min(F.struct("doc_id", "pos", "_row")).alias("first")).select("b1", "b2", "first.*"), "index")
    if unique:
        firsts = index
    else:
        # All rows of an id that have a block at its first place have it there first.
        firsts = blocks.join(index.select("b1", "b2", F.col("doc_id").alias("d"), F.col("pos").alias("p")), ["b1", "b2"]).filter("doc_id = d and pos = p")
    firsts = firsts.groupBy(*key).agg(F.collect_set("pos").alias("firsts"))
    found = held.join(firsts, key, "left").select(*key, "packed", "anchors", "firsts", *packed.columns[3:]).mapInArrow(_laid_out(length, k), f"b1 long, b2 long, {place}")
    sources = index.select("b1", "b2", F.col("doc_id").alias("source"), F.col("pos").alias("at"))
    found = found.join(sources, ["b1", "b2"]).groupBy(*key).agg(F.collect_set(F.struct("pos", "source", "at")).alias("found"))
    whole = packed.join(found, key, "left").select(*key, "packed", "found", *packed.columns[3:])
    out = whole.mapInArrow(_cut(length, as_is), f"doc_id {kind}, n_words long, n_removed long, kept_text string, spans array<struct<start:int,end:int,source:{kind},source_start:int>>{kinds}")
    return out.select("doc_id", "n_words", "n_removed", "kept_text", "spans", *[F.col(f"_also{n}").alias(c) for n, c in enumerate(also)])


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
starts AS (SELECT doc_id, ws, unnest(range(0, len(ws) - 19)) AS pos FROM w WHERE len(ws) >= 20),
blocks AS (SELECT doc_id, pos, array_to_string(list_slice(ws, pos + 1, pos + 20), ' ') AS block FROM starts),
ranked AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY block ORDER BY doc_id, pos) AS r FROM blocks),
gone AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 20)) AS i FROM ranked WHERE r > 1),
lists AS (SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string([ws[i + 1] for i in range(0, len(ws)) if NOT list_contains(coalesce(gone, []), i)], ' ')) AS kept_sha256
FROM w LEFT JOIN lists USING (doc_id)
"""
