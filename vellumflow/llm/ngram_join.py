"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

Documents with equal n-gram sets form one class; classes are joined. A set of n that is linked with another shares at least
o(n) = ceil(percent n / 100) n-grams with it. Two prefixes come out of this:

* By hash, the first n - o(n) + l(n) n-grams of a set are indexed, where l grows with n. Two linked sets share at least l(min(n, m)) of
  them, so each has d(n) = l(o(n)) or more that other sets have indexed too; sets with fewer are skipped. This is done twice: with a
  short index (l = 1 + n / 20) of all sets, which leaves a small part of a corpus, and with a longer one (1 + n / 4) of that part.
* What is left of a set's indexed n-grams is ordered rare-first, by the number of sets that have it indexed. Two linked sets share d or more
  of them, so they share one of the first |left| - d(n) + 1. These prefix n-grams are posted and joined on.

A pair that meets under an n-gram is dropped by length (100 min < percent max), by position (the n-grams after this one can't make up
l(min(n, m))), and by suffix: sets are cut at 256 fixed pivots of the hash order, and the sum of the differences of corresponding sizes
is at most the symmetric difference, which a link bounds. Then the indexed n-grams are merged and counted.

For groups, a posting list's members meet its first member; lists that this leaves in several parts are compared in blocks, inside tasks
that return spanning edges only. Clusters are connected by these candidates, and full sets are compared within a cluster: all with its
first, those that this doesn't link with a few that it does, and what is still apart with all, in blocks. So a group of n copies of one text takes n comparisons, and
no link between different texts is lost. For pairs, all classes of a cluster are compared, in pairs of blocks, each pair once.

Results: null text, and text without words, has an empty set and is linked with nothing; a row without an id is linked with nothing;
rows that repeat an id are judged by their own texts. Ids keep their type. Other columns are not read. N-grams are compared by 52-bit
hashes, whole sets by 128 bits more.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import _contract, connected_components, forest
from .minhash_dedup import Overlaps, _edges, _flat, _groups, _in_block_pairs, _set_hash, _small_slices, _spanning, cluster_members, confirmed_groups, shingle_sets
from .store import drop_table, table, with_small_batches, write_table
from .wordhash import as_list, release_memory

_PIVOTS = 256
_PIVOT_SHIFT = np.uint64(52 - 8)
_CHUNK = 1024
#: One in so many of a set's n-grams are asked for in common: of all sets, and of those that this leaves.
_WIDE, _CLOSE = 20, 4
_SMALL = 256


def least_shared(n, percent: int):
    """o(n): the least number of n-grams that a set of n shares with a linked one. Numbers or columns."""
    return (percent * n + 99) // 100


def indexed_shared(n, percent: int, one_in: int = _CLOSE):
    """l(n): how many of their indexed n-grams two linked sets share at least, the smaller one having n."""
    return np.minimum(1 + n // one_in, least_shared(n, percent))


def _heads(size: int, percent: int, one_in: int, with_parts: bool):
    """Rows: doc_id, text, row_hash. Of each set: its size, its hash, the indexed n-grams, and the sizes between pivots."""

    def run(batches):
        for b in batches:
            for i, j in _small_slices(b.column(1)):
                part = b.slice(i, j - i)
                sets, n = shingle_sets(part.column(1), size)
                some = np.flatnonzero(n)
                s1, s2 = np.zeros(j - i, np.int64), np.zeros(j - i, np.int64)
                first = np.cumsum(n) - n
                if len(some):
                    s1[some], s2[some] = _set_hash(sets, first[some])
                length = np.where(n > 0, n - least_shared(n, percent) + indexed_shared(n, percent, one_in), 0)
                at = np.repeat(first - (np.cumsum(length) - length), length) + np.arange(length.sum())
                heads = as_list(sets[at].view(np.int64), length, pa.int64())
                made = {"doc_id": part.column(0), "row_hash": part.column(2), "n": pa.array(n), "s1": pa.array(s1), "s2": pa.array(s2), "head": heads}
                if with_parts:
                    place = np.repeat(np.arange(j - i), n) * _PIVOTS + (sets >> _PIVOT_SHIFT).astype(np.int64)
                    parts = np.minimum(np.bincount(place, minlength=(j - i) * _PIVOTS), 255).astype(np.uint8).reshape(-1, _PIVOTS)
                    made["parts"] = pa.array([x.tobytes() for x in parts], pa.binary())
                yield pa.record_batch(list(made.values()), list(made))
        release_memory()

    return run


def _parts(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, _PIVOTS).astype(np.int16)


def _most_apart(n, m, percent: int):
    """The largest symmetric difference of linked sets of n and m."""
    return n + m - 2 * ((percent * (n + m) + 99 + percent) // (100 + percent))


def _may_link(n, m, shared, apart, percent: int):
    """The filters by length, suffix (apart: a lower bound of the symmetric difference) and count of shared indexed n-grams."""
    low, high = np.minimum(n, m), np.maximum(n, m)
    return (100 * low >= percent * high) & (apart <= _most_apart(n, m, percent)) & (shared >= indexed_shared(low, percent))


def _shared_marks(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """How many values the sets of each row of two ragged arrays (values, counts) share; up to 4096 rows."""
    (mine, c), (its, d) = one, two
    row = np.concatenate([np.repeat(np.arange(len(c)), c), np.repeat(np.arange(len(d)), d)]).astype(np.uint64)
    key = np.sort(row << np.uint64(52) | np.concatenate([mine, its]))
    return np.bincount((key[1:][key[1:] == key[:-1]] >> np.uint64(52)).astype(np.int64), minlength=len(c))


def _met(percent: int):
    """Rows: node, hub, then n, marks (left of the indexed n-grams) and parts of both. The pairs that may be linked."""

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, _CHUNK):
                t = b.slice(i, _CHUNK)
                n, m = t.column(2).to_numpy(), t.column(5).to_numpy()
                apart = np.abs(_parts(t.column(4)) - _parts(t.column(7))).sum(1, dtype=np.int64)
                shared = _shared_marks(_flat(t.column(3)), _flat(t.column(6)))
                hit = pa.array(_may_link(n, m, shared, apart, percent))
                yield pa.record_batch([t.column(0).filter(hit), t.column(1).filter(hit)], ["u", "v"])
        release_memory()

    return run


def _whole_groups(batches, n_keys: int):
    """The rows, sorted by the first n_keys columns, as tables of whole groups, with the groups' first rows (and the number of rows at the end)."""
    rest = None
    for b in batches:
        t = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
        if t.num_rows:
            keys = np.stack([t.column(c).to_numpy() for c in range(n_keys)])
            cuts = np.concatenate([[0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1])
            if cuts[-1]:
                yield t.slice(0, int(cuts[-1])), cuts
            rest = t.slice(int(cuts[-1]))
    if rest is not None and rest.num_rows:
        yield rest, np.array([0, rest.num_rows])


def _pairs_in(cuts: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows of the groups to use."""
    size = np.diff(cuts)[use]
    row = np.repeat(cuts[:-1][use] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    later = np.repeat(cuts[1:][use], size) - row - 1
    i = np.repeat(row, later)
    return i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(later) - later, later)


def _compared(percent: int):
    """Rows: key, bi, bj, node, block, part, n, m, pos, marks, parts. Edges that span what may be linked and is not in one part; rows of one block are compared in the group of that block alone. Small groups go many at a time, by pairs."""

    def by_pairs(t: pa.Table, cuts: np.ndarray, small: np.ndarray):
        bi, bj, ids, block, part, n, m, pos = (t.column(c).to_numpy() for c in range(1, 9))
        i, j = _pairs_in(cuts, small)
        low = np.minimum(n[i], n[j])
        keep = (part[i] != part[j]) & ((block[i] != block[j]) | (bi[i] == bj[i])) & (100 * low >= percent * np.maximum(n[i], n[j]))
        keep &= np.minimum(m[i] - pos[i], m[j] - pos[j]) >= indexed_shared(low, percent)
        i, j = i[keep], j[keep]
        if not len(i):
            return
        _, code = np.unique(ids, return_inverse=True)
        pair = np.minimum(code[i], code[j]) * len(ids) + np.maximum(code[i], code[j])
        first = np.unique(pair, return_index=True)[1]
        i, j = i[first], j[first]
        values, counts = _flat(t.column(9).combine_chunks())
        first, sizes = np.cumsum(counts) - counts, _parts(t.column(10).combine_chunks())

        def marks(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            c = counts[rows]
            return values[np.repeat(first[rows] - (np.cumsum(c) - c), c) + np.arange(c.sum())], c

        for k in range(0, len(i), _CHUNK):
            x, y = i[k : k + _CHUNK], j[k : k + _CHUNK]
            apart = np.abs(sizes[x] - sizes[y]).sum(1, dtype=np.int64)
            near = apart <= _most_apart(n[x], n[y], percent)
            x, y, apart = x[near], y[near], apart[near]
            hit = _may_link(n[x], n[y], _shared_marks(marks(x), marks(y)), apart, percent)
            if hit.any():
                u, v = forest(ids[x[hit]], ids[y[hit]])
                yield pa.record_batch([pa.array(u), pa.array(v)], ["u", "v"])

    def by_rows(t: pa.Table):
        ids, block, part, n = (t.column(c).to_numpy() for c in (3, 4, 5, 6))
        overlaps = Overlaps(*_flat(t.column(9).combine_chunks()))
        sizes = _parts(t.column(10).combine_chunks())
        both = t.column(1)[0] != t.column(2)[0]

        def linked(i, other):
            other = other & ((block != block[i]) | (not both))
            at = np.flatnonzero(other)
            apart = np.abs(sizes[at] - sizes[i]).sum(1, dtype=np.int64)
            out = np.zeros(len(ids), bool)
            out[at] = _may_link(n[at], n[i], overlaps.of(i)[at], apart, percent)
            return out

        return _edges(_spanning(ids, part, np.ones(len(ids), bool), linked))

    def found(batches):
        for t, cuts in _whole_groups(batches, 3):
            small = np.diff(cuts) <= _SMALL
            yield from by_pairs(t, cuts, small)
            for g in np.flatnonzero(~small).tolist():
                yield by_rows(t.slice(int(cuts[g]), int(cuts[g + 1] - cuts[g])))

    def run(batches):
        # Lists of one group find the same links again and again; a task gives each part's spanning edges once.
        yield from _contract(found(batches))
        release_memory()

    return run


def _columns(n: Column, percent: int, one_in: int = _CLOSE) -> tuple[Column, Column]:
    """o(n) and l(n)."""
    o = F.floor((percent * n + 99) / 100).cast("long")
    return o, F.least(1 + F.floor(n / one_in), o).cast("long")


def _shared_by_others(sets: DataFrame, percent: int, one_in: int) -> DataFrame:
    """node, d(n) and left (the indexed n-grams that other sets have too, rarest first) of the sets (node, n, head) that have d(n) of them."""
    indexed = sets.select("node", F.explode("head").alias("key"))
    # Written, so that both sides of the join have exchanges of their own and AQE can split a very common n-gram.
    df = write_table(indexed.groupBy("key").agg(F.count("*").alias("df")).filter("df > 1"), "df")
    left = indexed.join(df, "key").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "key"))).alias("left"))
    demand = _columns(_columns(F.col("n"), percent, one_in)[0], percent, one_in)[1]
    return left.join(sets.select("node", demand.alias("d")), "node").filter(F.size("left") >= F.col("d")).select("node", "d", "left.key").withColumnRenamed("key", "left")


def _star(posted: DataFrame, info: DataFrame, first: Column, percent: int) -> DataFrame:
    """Edges (u, v) of the pairs that may be linked, of a list's members with the one that is least by `first`."""
    hubs = write_table(posted.groupBy("key").agg(F.min_by(F.struct("node", "n", "m", "pos"), first).alias("hub")), "hubs")
    low = F.least("n", "hub.n")
    by_length = 100 * low >= percent * F.greatest("n", "hub.n")
    by_position = F.least(F.col("m") - F.col("pos"), F.col("hub.m") - F.col("hub.pos")) >= _columns(low, percent)[1]
    pairs = posted.join(hubs, "key").filter(F.col("node") != F.col("hub.node")).filter(by_length & by_position)
    pairs = pairs.select("node", F.col("hub.node").alias("hub")).distinct()
    pairs = pairs.join(info, "node").join(info.select(*[F.col(c).alias(f"hub_{c}") for c in info.columns]).withColumnRenamed("hub_node", "hub"), "hub")
    return pairs.select("node", "hub", "n", "marks", "parts", "hub_n", "hub_marks", "hub_parts").mapInArrow(_met(percent), "u long, v long")


def _candidates(docs: DataFrame, doc_id: str, text: str, size: int, percent: int, block_rows: int, most_rows: int, broadcast_rows: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """rows, signed and classes as confirmed_groups takes them, and edges (u, v) that connect all classes that are linked."""
    rows = with_small_batches(docs).select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("row_hash", F.xxhash64("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, row_hash long, n long, s1 long, s2 long, head array<long>"
    heads = write_table(rows.mapInArrow(_heads(size, percent, _WIDE, False), schema), "heads")
    signed = write_table(heads.drop("head"), "signed")
    wide = heads.filter("n > 0 and doc_id is not null").groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep"), F.first("head").alias("head"))
    wide = write_table(wide.withColumn("node", F.monotonically_increasing_id()), "wide")
    drop_table(heads)
    classes = write_table(wide.drop("head"), "classes")
    some = write_table(_shared_by_others(wide, percent, _WIDE).select("node").join(classes, "node"), "some")
    drop_table(wide)
    wanted = some.select(F.col("rep").alias("doc_id")).distinct()
    held = rows.join(F.broadcast(wanted) if some.count() <= broadcast_rows else wanted, "doc_id", "left_semi")
    close = held.mapInArrow(_heads(size, percent, _CLOSE, True), schema + ", parts binary").select(F.col("doc_id").alias("rep"), "s1", "head", "parts").dropDuplicates(["rep", "s1"])
    close = write_table(some.join(close, ["rep", "s1"]).select("node", "n", "head", "parts"), "close")
    left = write_table(_shared_by_others(close, percent, _CLOSE).join(close.drop("head"), "node"), "left")
    posted = left.select("node", "n", F.size("left").alias("m"), F.posexplode(F.slice("left", F.lit(1), (F.size("left") - F.col("d") + 1).cast("int"))).alias("pos", "key"))
    posted = write_table(posted, "posted")

    info = left.select("node", "n", F.array_sort("left").alias("marks"), "parts")
    # The first member of every list, and, of one list in eight, another member each.
    stars = [_star(posted, info, F.col("node"), percent), _star(posted.filter(F.pmod(F.xxhash64("key"), F.lit(8)) == 0), info, F.xxhash64("node", "key"), percent)]
    star = write_table(stars[0].union(stars[1]), "star")

    parts = connected_components(star).withColumnRenamed("component", "part")
    labelled = write_table(posted.select("key", "node", "m", "pos").join(parts, "node", "left").withColumn("part", F.coalesce("part", "node")), "labelled")
    split = write_table(labelled.groupBy("key").agg(F.min("part").alias("a"), F.max("part").alias("z")).filter("a != z").select("key"), "split")
    rest = _in_block_pairs(labelled.join(split, "key").join(info, "node"), "key", "node", block_rows, most_rows)
    rest = rest.select("key", "bi", "bj", "node", "block", "part", "n", F.col("m").cast("long").alias("m"), F.col("pos").cast("long").alias("pos"), "marks", "parts")
    more = rest.repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj").mapInArrow(_compared(percent), "u long, v long")
    return rows, signed, classes, star.union(more)


def ngram_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 4, percent: int = 85, block_rows: int = 128, most_rows: int = 4096, broadcast_rows: int = 250_000) -> DataFrame:
    """One row per row of docs: doc_id, row_hash (of the text), n_shingles, class_id (smallest doc_id with this set), component_id (smallest doc_id reachable by links) and group_id (the group itself, as groups of rows that repeat an id may have one smallest; null for what is linked with nothing)."""
    rows, signed, classes, edges = _candidates(docs, doc_id, text, size, percent, block_rows, most_rows, broadcast_rows)
    return confirmed_groups(rows, signed, classes, edges, size, percent, block_rows, most_rows, broadcast_rows)


def _all_links(percent: int):
    """Rows: component, bi, bj, node, block, set. All links, each where its two blocks meet."""

    def run(batches):
        for t in _groups(batches, 3):
            ids, block = t.column(3).to_numpy(), t.column(4).to_numpy()
            flat, n = _flat(t.column(5).combine_chunks())
            overlaps, both = Overlaps(flat, n), t.column(1)[0] != t.column(2)[0]
            u, v, common = [], [], []
            for i in range(len(ids)):
                shared = overlaps.of(i)
                hit = np.flatnonzero((ids > ids[i]) & ((block != block[i]) | (not both)) & (100 * shared >= percent * (n + n[i] - shared)))
                u.append(np.full(len(hit), ids[i])), v.append(ids[hit]), common.append(shared[hit])
                if sum(map(len, u)) > 100_000 or i == len(ids) - 1:
                    yield pa.record_batch([pa.array(np.concatenate(x).astype(np.int64)) for x in (u, v, common)], ["u", "v", "common"])
                    u, v, common = [], [], []
        release_memory()

    return run


def ngram_pairs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 4, percent: int = 85, block_rows: int = 1024, most_rows: int = 4096, broadcast_rows: int = 250_000) -> DataFrame:
    """All links between classes, each once: id_a < id_b (the smallest doc_id of each class), n_a and n_b (sizes of the sets) and n_common. ngram_groups() has the members of classes; a class that is linked with many others takes a row for each."""
    rows, _, classes, edges = _candidates(docs, doc_id, text, size, percent, block_rows, most_rows, broadcast_rows)
    members = cluster_members(rows, classes, edges, size, broadcast_rows)
    dealt = _in_block_pairs(members, "component", "node", block_rows, most_rows).select("component", "bi", "bj", "node", "block", "set")
    links = dealt.repartition("component", "bi", "bj").sortWithinPartitions("component", "bi", "bj").mapInArrow(_all_links(percent), "u long, v long, common long")
    of = lambda side, node: classes.select(F.col("node").alias(node), F.struct("rep", "n").alias(side))
    both = links.join(of("a", "u"), "u").join(of("b", "v"), "v").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "common")
    return both.select(F.col("a.rep").alias("id_a"), F.col("b.rep").alias("id_b"), F.col("a.n").alias("n_a"), F.col("b.n").alias("n_b"), F.col("common").alias("n_common"))


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_groups(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


OP12_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct([array_to_string(list_slice(ws, i, i + 3), ' ') for i in range(1, len(ws) - 2)]) END AS s FROM w),
classes AS (SELECT list_sort(s) AS s, min(doc_id) AS rep, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY list_sort(s), len(s)),
flat AS MATERIALIZED (SELECT rep, n, unnest(s) AS x FROM classes),
inter AS (SELECT a.rep AS a, b.rep AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS common
  FROM flat a JOIN flat b ON a.x = b.x AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY a.rep, b.rep),
links AS MATERIALIZED (SELECT a, b FROM inter WHERE 100 * common >= 85 * (na + nb - common)),
edges AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(node, dest) AS (SELECT rep, rep FROM classes UNION SELECT r.node, e.b FROM reach r JOIN edges e ON r.dest = e.a),
comp AS (SELECT node, min(dest) AS component FROM reach GROUP BY node)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(comp.component, s.doc_id) AS component_id
FROM sets s LEFT JOIN classes c ON list_sort(s.s) = c.s LEFT JOIN comp ON comp.node = c.rep
"""
