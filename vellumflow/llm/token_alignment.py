"""Cross-tokenizer alignment: an event sweep over the ends of two tokenizers' tokens.

A text is encoded by a byte-level BPE (A) and by a piece model (B), both over a space and the text, without special tokens. Each token
has bytes, and so an end. The ends are events: runs of up to `run` tokens of one side, with the byte at which the run begins. Events of
both sides are united, dealt out by document and sorted by byte within the partition; a sweep over them closes a group of tokens wherever
both sides have an end, and links the two tokens that end there. Between events it holds the tokens of the one group that is open; what a
document's row returns is gathered until the document is over.

Counts of linked id pairs are taken over all documents: summed up within tasks, then by pair. Up to `broadcast_pairs` different pairs, all
tasks get the counts; beyond, links are joined with them.

Results: null and empty texts, and those whose tokens' bytes aren't a space and the text, have zeros, no groups and no links. Rows are told
apart by their place in the input, so rows that repeat a doc_id or lack one are documents of their own; docs should be a written table, whose
rows keep their places when a lost task is run again. Ids keep their type; other columns are not read.
"""

from __future__ import annotations

import functools
import json
import os
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import table, with_small_batches, write_table
from .vocabulary import PIECES, vocabulary
from .wordhash import as_list, release_memory, slices

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"

@dataclass(frozen=True)
class Side:
    """A vocabulary: each id's bytes (None if no plain text gives it) and their number."""

    surface: list[bytes | None]
    lengths: np.ndarray


def _side(surface: list[bytes | None]) -> Side:
    return Side(surface, np.array([len(s or b"") for s in surface], np.int64))


def _byte_of() -> dict[str, int]:
    """The bytes that byte-level vocabularies write as characters: printable ones as themselves, the others, in order, as those from U+0100."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


@functools.lru_cache(maxsize=2)
def byte_level(path: str = BYTE_BPE) -> Side:
    """The vocabulary of a byte-level tokenizer file; tokens added to it are special."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    byte_of = _byte_of()
    special = {t["id"] for t in found.get("added_tokens", [])}
    surface: list[bytes | None] = [None] * (max(found["model"]["vocab"].values()) + 1)
    for name, i in found["model"]["vocab"].items():
        if i not in special:
            surface[i] = bytes(byte_of[c] for c in name)
    return _side(surface)


@functools.lru_cache(maxsize=2)
def piece_level(path: str = PIECES) -> Side:
    """The vocabulary of a piece model; the marker character is a space."""
    return _side([s or None for s in vocabulary(path).surface])


@functools.lru_cache(maxsize=1)
def _coders(a_path: str, b_path: str):
    """Encoders of A and of B, and a faster one of A if its file allows: ids in the order of merges, cut by the usual pattern."""
    import public_tokenizers
    import sentencepiece
    import tiktoken
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    a = Tokenizer.from_file(a_path)
    a.encode_special_tokens = True
    with open(a_path, encoding="utf-8") as f:
        found = json.load(f)
    cut, vocab = found.get("pre_tokenizer") or {}, found["model"]["vocab"]
    merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in found["model"]["merges"]]
    usual = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and not found.get("normalizer")
    fast = None
    if usual and sorted(vocab[c] for c in _byte_of()) == list(range(256)) and [vocab[m] for m in merged] == list(range(256, 256 + len(merged))):
        ranks = {s: i for i, s in enumerate(byte_level(a_path).surface) if s is not None}
        fast = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return a, sentencepiece.SentencePieceProcessor(model_file=b_path), fast


def encode_texts(texts: list[str], a_path: str = BYTE_BPE, b_path: str = PIECES) -> list[list[np.ndarray]]:
    """Ids of A and of B of each text, a space and the text being encoded (B puts the space there itself); none if the bytes of either are others."""
    a, b, fast = _coders(a_path, b_path)
    sides, out = (byte_level(a_path), piece_level(b_path)), []
    for text, right in zip(texts, b.encode(texts, num_threads=1), strict=True):
        whole = " " + text
        left = fast.encode_ordinary(whole) if fast else a.encode(whole, add_special_tokens=False).ids
        fine = text != "" and all(_bytes_of(side.surface, ids) == whole.encode() for side, ids in zip(sides, (left, right), strict=True))
        out.append([np.array(ids if fine else (), np.int64) for ids in (left, right)])
    return out


def _bytes_of(surface: list[bytes | None], ids) -> bytes | None:
    try:
        return b"".join(map(surface.__getitem__, ids))
    except TypeError:  # an id that no plain text gives
        return None


def _events(a_path: str, b_path: str, run_length: int):
    """Rows: _row, doc_id, text. Events: _row, begin (byte), side, doc_id, packed ids; a document without tokens has one of side -1."""

    def run(batches):
        sides, z = (byte_level(a_path), piece_level(b_path)), zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for i, j in slices(batch.column(2)):
                part = batch.slice(i, j - i)
                at, begin, side, packed = [], [], [], []
                for k, ids in enumerate(encode_texts([t or "" for t in part.column(2).to_pylist()], a_path, b_path)):
                    if not len(ids[0]):
                        at.append(k), begin.append(0), side.append(-1), packed.append(b"")
                    for which, (vocab, x) in enumerate(zip(sides, ids, strict=True)):
                        starts = np.concatenate([[0], np.cumsum(vocab.lengths[x])])[: len(x) : run_length]
                        for c, first in enumerate(starts.tolist()):
                            at.append(k), begin.append(first), side.append(which), packed.append(z.compress(_narrow(x[c * run_length : (c + 1) * run_length])))
                rows = pa.array(at, pa.int64())
                yield pa.record_batch([part.column(0).take(rows), pa.array(begin, pa.int64()), pa.array(side, pa.int8()), part.column(1).take(rows), pa.array(packed, pa.binary())], ["_row", "begin", "side", "doc_id", "packed"])
        release_memory()

    return run


def _narrow(ids: np.ndarray) -> bytes:
    """Ids in two bytes each if they fit, else in four; the first byte tells."""
    return b"\x02" + ids.astype(np.uint16).tobytes() if ids.max(initial=0) < 1 << 16 else b"\x04" + ids.astype(np.uint32).tobytes()


def _wide(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw[1:], np.uint16 if raw[0] == 2 else np.uint32).astype(np.int64)


class Written:
    """Ids as decimal digits and one character behind each, as bytes."""

    def __init__(self, n_ids: int):
        digits = len(str(max(n_ids - 1, 0)))
        ids = np.arange(n_ids)
        table = np.zeros((n_ids, digits), np.uint8)
        for c in range(digits):
            table[:, c] = 48 + ids // 10 ** (digits - 1 - c) % 10
        self.table = np.concatenate([table, np.zeros((n_ids, 1), np.uint8)], 1)
        self.used = np.concatenate([np.arange(digits) >= (digits - 1 - np.floor(np.log10(np.maximum(ids, 1))).astype(int))[:, None], np.ones((n_ids, 1), bool)], 1)

    def join(self, ids: np.ndarray, behind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, number of bytes of each id with what is behind it)."""
        chars, used = self.table[ids], self.used[ids]
        chars[:, -1] = behind
        return chars[used], used.sum(1)


class Sweep:
    """The state of the sweep: the document that is open, its tokens since the last end that both sides have, and what it has given so far. step() takes the next events; what it returns are rows of documents that are over."""

    def __init__(self, sides: tuple[Side, Side]):
        self.sides = sides
        self.written = Written(max(len(s.surface) for s in sides))
        self.open = None
        self.ends, self.tokens = [np.zeros(0, np.int64)] * 2, [np.zeros(0, np.int64)] * 2
        self.past, self.text, self.links = [0, 0], [], []
        self.counts = [0, 0]

    def step(self, rows: np.ndarray, sides: np.ndarray, packed: list[bytes]) -> tuple[np.ndarray, list]:
        """Events in order. Returns (document of each finished row, [n_a, n_b, groups, link ids of A, of B])."""
        z, shift = zstandard.ZstdDecompressor(), 40
        new = np.concatenate([[self.open is None or rows[0] != self.open], rows[1:] != rows[:-1]])
        doc = np.cumsum(new) if self.open is not None else np.cumsum(new) - 1
        names = np.concatenate([[] if self.open is None else [self.open], rows[new]]).astype(np.int64)
        n = len(names)
        ends, tokens = [], []
        total = []
        for s in (0, 1):
            pick = np.flatnonzero(sides == s)
            lists = [_wide(z.decompress(packed[i])) for i in pick.tolist()]
            size = np.fromiter(map(len, lists), np.int64, len(lists))
            ids = np.concatenate([np.zeros(0, np.int64), *lists])
            of = np.repeat(doc[pick], size)
            end = np.cumsum(self.sides[s].lengths[ids])
            opens = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])[: len(of)])
            base = np.zeros(n, np.int64)
            base[of[opens]] = np.concatenate([[0], end])[opens]
            carried = self.open is not None
            base[0] -= self.past[s] if carried else 0
            ends.append(np.concatenate([self.ends[s], of << shift | end - base[of]]))
            tokens.append(np.concatenate([self.tokens[s], ids]))
            total.append(np.bincount(of, minlength=n))
            last = np.flatnonzero(of == n - 1)
            self.past[s] = int(end[last[-1]] - base[n - 1]) if len(last) else (self.past[s] if n == 1 and carried else 0)
        at = np.searchsorted(ends[1], ends[0])
        both = np.flatnonzero(ends[1][np.minimum(at, len(ends[1]) - 1)] == ends[0]) if len(ends[1]) else np.zeros(0, np.int64)
        cut = [both, at[both]]
        group_doc = ends[0][both] >> shift
        # The text of all closed groups: A's tokens of a group, then B's; each token is written with what stands behind it.
        order, behind = [], []
        for s, (inner, final) in enumerate(((44, 124), (44, 59))):
            closed = int(cut[s][-1]) + 1 if len(cut[s]) else 0
            group = np.searchsorted(cut[s], np.arange(closed))
            order.append(2 * group + s)
            mark = np.full(closed, inner, np.uint8)
            mark[cut[s]] = final
            behind.append(mark)
        where = np.argsort(np.concatenate(order), kind="stable")
        ids = np.concatenate([tokens[s][: len(order[s])] for s in (0, 1)])[where]
        chars, size = self.written.join(ids, np.concatenate(behind)[where])
        doc_of = group_doc[np.concatenate(order)[where] >> 1] if len(where) else where
        edge = np.concatenate([[0], np.cumsum(np.bincount(doc_of, weights=size, minlength=n).astype(np.int64))])
        links = [tokens[s][cut[s]] for s in (0, 1)]
        link_edge = np.searchsorted(group_doc, np.arange(n + 1))
        raw = chars.tobytes()
        made = []
        for d in range(n):
            first = d == 0 and self.open is not None
            text = [*(self.text if first else []), raw[edge[d] : edge[d + 1]]]
            pairs = [x[link_edge[d] : link_edge[d + 1]] for x in links]
            pairs = [np.concatenate([*(p[s] for p in self.links), pairs[s]]) for s in (0, 1)] if first and self.links else pairs
            counts = [int(total[s][d]) + (self.counts[s] if first else 0) for s in (0, 1)]
            made.append([*counts, text, *pairs])
        rest = made.pop()
        self.open, self.counts, self.text, self.links = int(names[-1]), rest[:2], rest[2], [rest[3:]]
        for s in (0, 1):
            start = int(cut[s][-1]) + 1 if len(cut[s]) else 0
            start = max(start, int(np.searchsorted(ends[s], (n - 1) << shift)))
            self.ends[s], self.tokens[s] = ends[s][start:] - ((n - 1) << shift), tokens[s][start:]
        return names[:-1], [self._closed(x) for x in made]

    @staticmethod
    def _closed(row: list) -> list:
        return [*row[:2], b"".join(row[2])[:-1].decode(), *row[3:]]

    def finish(self) -> tuple[np.ndarray, list]:
        """The document that is open at the end."""
        if self.open is None:
            return np.zeros(0, np.int64), []
        rows, self.open = np.array([self.open]), None
        return rows, [self._closed([*self.counts, self.text, *self.links[0]])]


_ALIGNED = "n_a long, n_b long, n_groups long, n_links long, groups string, links array<struct<a:int,b:int>>"


def _aligned(a_path: str, b_path: str):
    """Rows: _row, side, doc_id, packed; by document and byte."""

    def rows_of(ids: pa.Array, made: list) -> pa.RecordBatch:
        counts = np.array([len(x[3]) for x in made], np.int64)
        flat = [np.concatenate([np.zeros(0, np.int64), *(x[c] for x in made)]).astype(np.int32) for c in (3, 4)]
        pairs = pa.StructArray.from_arrays([pa.array(x) for x in flat], ["a", "b"])
        lists = pa.ListArray.from_arrays(as_list(flat[0], counts, pa.int32()).offsets, pairs)
        numbers = [pa.array(x, pa.int64()) for x in ([x[0] for x in made], [x[1] for x in made], counts, counts)]
        return pa.record_batch([ids, *numbers, pa.array([x[2] for x in made], pa.string()), lists], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "links"])

    def run(batches):
        sweep = Sweep((byte_level(a_path), piece_level(b_path)))
        open_id = None
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                b = batch.slice(i, 256)
                rows = b.column(0).to_numpy()
                ids = b.column(2)
                changes = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
                seen = ids.take(pa.array(changes))
                if open_id is not None and sweep.open == rows[0]:
                    seen = seen.slice(1)
                names = seen if open_id is None else pa.concat_arrays([open_id, seen])
                _, made = sweep.step(rows, b.column(1).to_numpy(), b.column(3).to_pylist())
                if made:
                    yield rows_of(names.slice(0, len(made)), made)
                open_id = names.slice(len(names) - 1)
        if open_id is not None:
            yield rows_of(open_id, sweep.finish()[1])
        release_memory()

    return run


def align(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", a_path: str = BYTE_BPE, b_path: str = PIECES, run: int = 4096) -> DataFrame:
    """One row per row of docs: doc_id, n_a and n_b (tokens), n_groups, n_links, groups (`a1,a2|b1;a3|b2,b3`: ids of A and of B of each group) and links (the ids of the tokens that end together, in order)."""
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = with_small_batches(docs).select(F.monotonically_increasing_id().alias("_row"), F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    events = rows.mapInArrow(_events(a_path, b_path, run), f"_row long, begin long, side byte, doc_id {kind}, packed binary")
    events = events.repartition("_row").sortWithinPartitions("_row", "begin", "side")
    return events.select("_row", "side", "doc_id", "packed").mapInArrow(_aligned(a_path, b_path), f"doc_id {kind}, {_ALIGNED}")


def _pairs_of(links: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(pairs as a * 2**32 + b, each row's number)."""
    flat = links.flatten()
    pair = flat.field("a").to_numpy(zero_copy_only=False).astype(np.int64) << 32 | flat.field("b").to_numpy(zero_copy_only=False).astype(np.int64)
    return pair, links.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)


def _summed(most: int):
    """Rows: links. Pairs and their numbers, summed up in the task (given out when it holds `most` pairs)."""

    def run(batches):
        pair, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in batches:
            new, m = np.unique(_pairs_of(b.column(0))[0], return_counts=True)
            both, at = np.unique(np.concatenate([pair, new]), return_inverse=True)
            total = np.zeros(len(both), np.int64)
            np.add.at(total, at, np.concatenate([n, m]))
            pair, n = both, total
            if len(pair) >= most:
                yield pa.record_batch([pa.array(pair), pa.array(n)], ["pair", "n"])
                pair, n = pair[:0], n[:0]
        yield pa.record_batch([pa.array(pair), pa.array(n)], ["pair", "n"])

    return run


def pair_counts(aligned: DataFrame, most: int = 500_000) -> DataFrame:
    """pair (a * 2**32 + b), n (links that hold it, over all rows)."""
    return aligned.select("links").mapInArrow(_summed(most), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def _scored(shared):
    """Adds n_best and count_sum, from all pairs' counts; links is the last column, and goes."""

    def run(batches):
        pairs, counts, best = shared.value
        for b in batches:
            pair, size = _pairs_of(b.columns[-1])
            at = np.searchsorted(pairs, pair)
            row = np.repeat(np.arange(b.num_rows), size)
            n_best, count_sum = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            if len(pair):
                np.add.at(n_best, row, best[at])
                np.add.at(count_sum, row, counts[at])
            yield pa.record_batch([*b.columns[:-1], pa.array(n_best), pa.array(count_sum)], [*b.schema.names[:-1], "n_best", "count_sum"])

    return run


def with_counts(aligned: DataFrame, broadcast_pairs: int = 2_000_000) -> DataFrame:
    """aligned (a written table with a column links) without links, with n_best (links whose pair has the highest count of its B id, ties included) and count_sum (sum of its links' counts)."""
    spark, others = aligned.sparkSession, [c for c in aligned.columns if c not in ("links", "n_best", "count_sum")]
    counts = write_table(pair_counts(aligned), "pairs")
    kinds = ", ".join(f"`{c}` {aligned.schema[c].dataType.simpleString()}" for c in others)
    if counts.count() <= broadcast_pairs:
        held = counts.toArrow()
        pair, n = (held.column(c).to_numpy() for c in ("pair", "n"))
        order = np.argsort(pair)
        pair, n = pair[order], n[order]
        _, b = np.unique(pair & 0xFFFFFFFF, return_inverse=True)
        top = np.zeros(b.max(initial=-1) + 1, np.int64)
        np.maximum.at(top, b, n)
        shared = spark.sparkContext.broadcast((pair, n, (n == top[b]).astype(np.int64)))
        return aligned.select(*others, "links").mapInArrow(_scored(shared), f"{kinds}, n_best long, count_sum long")
    b = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    top = write_table(counts.groupBy(b.alias("b")).agg(F.max("n").alias("top")), "tops")
    judged = write_table(counts.withColumn("b", b).join(top, "b").select("pair", "n", (F.col("n") == F.col("top")).cast("long").alias("best")), "judged")
    held = write_table(aligned.withColumn("_at", F.monotonically_increasing_id()), "held")
    links = held.select("_at", F.explode("links").alias("l")).select("_at", (F.shiftleft(F.col("l.a").cast("long"), 32) + F.col("l.b")).alias("pair")).groupBy("_at", "pair").agg(F.count("*").alias("times"))
    sums = links.join(judged, "pair").groupBy("_at").agg(F.sum(F.col("times") * F.col("best")).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    return held.select("_at", *others).join(sums, "_at", "left").select(*others, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")])


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = align(table(spark, sf_dir, "documents"))
    digest = F.when(F.col("n_groups") == 0, "").otherwise(F.sha2("groups", 256))
    aligned = write_table(found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", digest.alias("groups_sha256"), "links"), "aligned", "zstd")
    return with_counts(aligned)
