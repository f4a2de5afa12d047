"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces with log scores.

A space is put before the text and spaces stand for the white-space marker; no other normalisation is done, so decoding returns exactly
the text. A character that is no piece is spelled in byte pieces, at ten below the least score; so is a marker character in the text.
No piece goes on after a space or over a line feed, so texts are cut there and each distinct part is segmented once per worker (a cache
of bounded size); the best path of the whole text is the best paths of its parts.

Results: null text has null ids and decodes to null; empty text has no ids.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .lattice import Lattice, groups
from .store import table, with_small_batches
from .vocabulary import PIECES, vocabulary
from .wordhash import as_list, kept_for, release_memory, slices


class Cache:
    """What a worker has computed for words, in two generations: when the young one is full it becomes the old one, and what is used again moves over."""

    def __init__(self, most: int = 80_000):
        self.young, self.old, self.most = {}, {}, most

    @classmethod
    def of(cls, key) -> Cache:
        """This worker's cache of that key."""
        return kept_for(key, cls)

    def look(self, words: set, compute) -> dict:
        """A dict that holds all of words; compute(list of words) gives values for new ones."""
        if len(self.young) + len(words) > self.most:
            self.old, self.young = self.young, {}
        young, old, new = self.young, self.old, []
        for w in words - young.keys():
            if (got := old.get(w)) is None:
                new.append(w)
            else:
                young[w] = got
        young.update(zip(new, compute(new), strict=True))
        return young


def cuts(surface: list[bytes]) -> str:
    """A pattern of the parts of a text that no piece reaches beyond."""
    if any(b" " in s.lstrip(b" ") for s in surface):
        raise ValueError("a piece goes on after a space")
    return r" *[^ \n]+| +|\n" if not any(b"\n" in s and len(s) > 1 for s in surface) else r" *[^ ]+| +"


def segment(trie, score: np.ndarray, byte_ids: np.ndarray, words: list[bytes]) -> list[bytes]:
    unknown = len(score)
    full = np.append(score, score[np.isfinite(score)].min(initial=0) - 10)
    result: list[bytes] = [b""] * len(words)
    for group in groups(words):
        found, odd = Lattice(trie, [words[i] for i in group], unknown).viterbi(full)
        for i, raw in zip(group, found, strict=True):
            result[i] = raw
        for x in np.flatnonzero(odd).tolist():
            result[group[x]] = _spelled(np.frombuffer(found[x], np.int32), words[group[x]], unknown, byte_ids, trie)
    return result


def _spelled(ids: np.ndarray, word: bytes, unknown: int, byte_ids: np.ndarray, trie) -> bytes:
    """Puts byte pieces in place of unknown characters."""
    out, at = [], 0
    for i in ids.tolist():
        if i == unknown:
            end = at + 1
            while end < len(word) and word[end] & 0xC0 == 0x80:
                end += 1
            out.extend(byte_ids[list(word[at:end])].tolist())
            at = end
        else:
            out.append(i)
            at += trie.lengths[i]
    return np.array(out, np.int32).tobytes()


def _spoken(surface: list[bytes], ids: np.ndarray) -> str:
    return b"".join(map(surface.__getitem__, ids.tolist()))[1:].decode("utf-8", "replace")


def _encoder(shared, key: str, also_decoded: bool, at: int, drop: bool):
    def run(batches):
        surface, score, byte_ids, trie = shared.value
        trie.lengths = [len(s) for s in surface]
        parts, cache = re.compile(cuts(surface)), Cache.of(("encode", key))
        for b in batches:
            for i, j in slices(b.column(at)):
                part = b.slice(i, j - i)
                texts = part.column(at).to_pylist()
                found = [parts.findall(" " + t) if t else [] for t in texts]
                known = cache.look(set().union(*found), lambda new: segment(trie, score, byte_ids, [w.encode() for w in new]))
                rows = [b"".join(map(known.__getitem__, ws)) for ws in found]
                del found
                ids = np.frombuffer(b"".join(rows), np.int32)
                lists = as_list(ids, np.fromiter(map(len, rows), np.int64, len(rows)) // 4, pa.int32())
                made = [pa.ListArray.from_arrays(lists.offsets, lists.values, mask=part.column(at).is_null())]
                if also_decoded:
                    made.append(pa.array([None if t is None else _spoken(surface, np.frombuffer(row, np.int32)) for t, row in zip(texts, rows, strict=True)], pa.string()))
                part = part.drop_columns(part.schema.names[at]) if drop else part
                yield pa.record_batch([*part.columns, *made], [*part.schema.names, *["ids", "decoded"][: len(made)]])
        release_memory(("encode", key))

    return run


def _decoder(shared, at: int, drop: bool):
    def run(batches):
        surface = shared.value[0]
        for b in batches:
            texts = [_spoken(surface, ids.values.to_numpy()) if ids.is_valid else None for ids in b.column(at)]
            b = b.drop_columns(b.schema.names[at]) if drop else b
            yield pa.record_batch([*b.columns, pa.array(texts, pa.string())], [*b.schema.names, "decoded"])

    return run


def _shared(spark: SparkSession, path: str):
    """Broadcasts the vocabulary; its size is that of the file, whatever the input."""
    v = vocabulary(path)
    return spark.sparkContext.broadcast((v.surface, v.score, v.byte_ids, v.trie))


def add_columns(df: DataFrame, source: str, made: dict[str, str], task) -> DataFrame:
    """df with the columns made (name and type), which replace those of these names. The source column goes to the workers once: task(at, drop) makes their function from its place and whether it has to leave."""
    kept = [c for c in df.columns if c not in made]
    drop = source not in kept
    sent = df.select(*kept, *([F.col(source).alias("_source")] if drop else []))
    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept] + [f"{c} {kind}" for c, kind in made.items()])
    return with_small_batches(sent).mapInArrow(task(sent.columns.index("_source" if drop else source), drop), schema)


def encode(docs: DataFrame, text: str = "text", path: str = PIECES, also_decoded: bool = False) -> DataFrame:
    """docs with a column ids (array<int>), which replaces one of that name; also_decoded adds what decode() makes of the ids, without another worker."""
    made = {"ids": "array<int>"} | ({"decoded": "string"} if also_decoded else {})
    shared = _shared(docs.sparkSession, path)
    return add_columns(docs, text, made, lambda at, drop: _encoder(shared, path, also_decoded, at, drop))


def decode(df: DataFrame, ids: str = "ids", path: str = PIECES) -> DataFrame:
    """df with a column decoded, which replaces one of that name."""
    shared = _shared(df.sparkSession, path)
    return add_columns(df, ids, {"decoded": "string"}, lambda at, drop: _decoder(shared, at, drop))


def op9_sentencepieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: number of pieces, of byte pieces, a hash of the ids, and whether decoding them gives back the text. The file is that of a merge model, so its log scores are not learned: they follow the ranks of the pieces by Zipf's law."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lowest, highest = int(vocabulary().byte_ids.min()), int(vocabulary().byte_ids.max())
    out = encode(docs, also_decoded=True)
    n_bytes = F.size(F.filter("ids", lambda x: (x >= lowest) & (x <= highest)))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), n_bytes.cast("long").alias("n_byte_pieces"), F.xxhash64("ids").alias("ids_hash"), F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))
