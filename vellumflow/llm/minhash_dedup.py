"""MinHash near-dedup: inverted join over signature coordinates.

Documents with equal shingle sets form one class; the rest works on classes, each a node of its own. A class has k MinHash coordinates and
is posted under coordinate-value pairs. Two classes that agree in c coordinates agree in one of each class's k - c + 1 rarest ones, so only
this prefix is posted, and a class fewer than c of whose pairs occur elsewhere is skipped. In each posting list, members are compared with
the list's first member; agreements are counted over whole signatures. Lists that this leaves in several parts are compared member by
member, in blocks, inside tasks that return spanning edges only. Classes that are connected by counts of c or more form a cluster.

Links are confirmed on full shingle sets. Within a cluster all members are held against its first member; those that this doesn't link are
held against a few that it does, and what is still apart against all members, in blocks of both; all others need no more. So a cluster of n
copies of one text takes n comparisons, and one with m members apart n * m, each in a task of bounded size. Connected components of the confirmed links are the groups.

With k = 48 and c = 25, a pair of similarity 0.8 is missed with probability 3.3e-6, and one of 0.9 below 1e-13; no link is made that full
sets don't confirm.

Results: null text, and text without words, has no shingles and is linked with nothing; a row without doc_id is linked with nothing and
kept; rows that repeat a doc_id are judged by their own texts. Ids keep their type and order. Shingles are compared by 52-bit hashes, whole
sets by 128 bits more.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components, forest
from .store import table, with_small_batches, write_table
from .wordhash import Words, as_list, grams, mix, release_memory, run_starts, slices

_ROWS = 4096
#: Before apart members are compared with all, they are compared with this many others, so many times.
_SOME, _TURNS = 16, 2
_ROW_BITS, _HASH_SHIFT = np.uint64(52), np.uint64(12)


def shingle_sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts): each row's distinct shingles in ascending order; at most 4096 rows."""
    w = Words(column, lower=True)
    h = w.hashes()
    full = grams(h, size)
    at = np.flatnonzero(run_starts(w, size))
    row, out = [w.row[at]], [full[at]]
    for m in range(1, size):
        few = np.flatnonzero(w.counts == m)
        if len(few):
            out.append(grams(h, m)[w.first[few]])
            row.append(few)
    key = np.concatenate(row).astype(np.uint64) << _ROW_BITS | np.concatenate(out) >> _HASH_SHIFT
    key = np.sort(key)
    key = key[np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]]
    return key & ((np.uint64(1) << _ROW_BITS) - np.uint64(1)), np.bincount((key >> _ROW_BITS).astype(np.int64), minlength=len(column))


def _small_slices(column: pa.Array):
    for i, j in slices(column):
        for a in range(i, j, _ROWS):
            yield a, min(j, a + _ROWS)


def _set_hash(sets: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    one, two = mix(sets), mix(sets ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    return np.add.reduceat(one, edge).view(np.int64), np.add.reduceat(two, edge).view(np.int64)


def _signatures(size: int, k: int):
    times = mix(np.arange(1, k + 1, dtype=np.uint64)) | np.uint64(1)

    def run(batches):
        for b in batches:
            for i, j in _small_slices(b.column(1)):
                part = b.slice(i, j - i)
                sets, counts = shingle_sets(part.column(1), size)
                some = np.flatnonzero(counts)
                s1, s2 = np.zeros(j - i, np.int64), np.zeros(j - i, np.int64)
                sig = np.zeros((j - i, k), np.uint32)
                if len(some):
                    edge = np.cumsum(counts)[some] - counts[some]
                    s1[some], s2[some] = _set_hash(sets, edge)
                    spread = mix(sets)
                    for c in range(k):
                        sig[some, c] = (np.minimum.reduceat(spread * times[c], edge) >> np.uint64(32)).astype(np.uint32)
                yield pa.record_batch([part.column(0), part.column(2), pa.array(counts), pa.array(s1), pa.array(s2), pa.array([x.tobytes() for x in sig], pa.binary())], ["doc_id", "row_hash", "n", "s1", "s2", "sig"])
        release_memory()

    return run


def _sig(column: pa.Array, k: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, k)


def _coordinates(k: int):
    high = np.arange(k, dtype=np.int64) << 32

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, _ROWS):
                part = b.slice(i, _ROWS)
                key = high + _sig(part.column(1), k).astype(np.int64)
                yield pa.record_batch([pa.array(key.ravel()), pa.array(np.repeat(part.column(0).to_numpy(), k))], ["key", "node"])

    return run


def _agreeing(k: int, c: int):
    def run(batches):
        for b in batches:
            if b.num_rows:
                hit = (_sig(b.column(2), k) == _sig(b.column(3), k)).sum(1) >= c
                yield pa.record_batch([b.column(0).filter(pa.array(hit)), b.column(1).filter(pa.array(hit))], ["u", "v"])

    return run


def _groups(batches, n_keys: int):
    """Consecutive rows with equal values in the first n_keys columns, as tables; the input is sorted by them."""
    rest = None
    for b in batches:
        t = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
        if not t.num_rows:
            continue
        keys = np.stack([t.column(c).to_numpy() for c in range(n_keys)])
        cuts = np.concatenate([[0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1])
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            yield t.slice(a, z - a)
        rest = t.slice(int(cuts[-1]))
    if rest is not None and rest.num_rows:
        yield rest


def _spanning(ids: np.ndarray, part: np.ndarray, seek: np.ndarray, linked):
    """Edges that join what `linked` links and is not joined yet. part: what belongs together already; seek: the rows to compare with others. linked(i, other): which of the rows of the mask other are linked with row i."""
    label = part.copy()
    for i in np.flatnonzero(seek):
        other = label != label[i]
        if not other.any():
            continue
        hit = np.flatnonzero(linked(i, other))
        for x in np.unique(label[hit]):
            j = hit[label[hit] == x][0]
            yield ids[i], ids[j]
        for x in np.unique(label[hit]):
            label[label == x] = label[i]


def _edges(found) -> pa.RecordBatch:
    found = list(found)
    return pa.record_batch([pa.array([int(x) for x, _ in found], pa.int64()), pa.array([int(x) for _, x in found], pa.int64())], ["u", "v"])


def _counted(k: int, c: int):
    """Rows: key, bi, bj, node, block, part, sig. Rows of one block are compared in the group of that block alone."""

    def run(batches):
        for t in _groups(batches, 3):
            sig = _sig(t.column(6).combine_chunks(), k)
            ids, block, part = (t.column(x).to_numpy() for x in (3, 4, 5))
            both = t.column(1)[0] != t.column(2)[0]

            def linked(i, other, sig=sig, block=block, both=both):
                return other & ((block != block[i]) | (not both)) & ((sig == sig[i]).sum(1) >= c)

            yield _edges(_spanning(ids, part, np.ones(len(ids), bool), linked))

    return run


def _flat(sets: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all values, each row's number of them)."""
    return sets.flatten().to_numpy(zero_copy_only=False).astype(np.uint64), sets.value_lengths().to_numpy(zero_copy_only=False)


class Overlaps:
    """Sizes of intersections of the rows' sets, by an inverted list of their values."""

    def __init__(self, flat: np.ndarray, n: np.ndarray):
        self.rows = len(n)
        _, self.word = np.unique(flat, return_inverse=True)
        self.holders = np.repeat(np.arange(len(n)), n)[np.argsort(self.word, kind="stable")]
        self.edge = np.concatenate([[0], np.cumsum(np.bincount(self.word))])
        self.at = np.concatenate([[0], np.cumsum(n)])

    def of(self, i: int) -> np.ndarray:
        """Of row i with each row."""
        ws = self.word[self.at[i] : self.at[i + 1]]
        size = self.edge[ws + 1] - self.edge[ws]
        pick = np.repeat(self.edge[ws] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return np.bincount(self.holders[pick], minlength=self.rows)


def _near_first(percent: int):
    """Rows: node, component, set, first_set. Whether a member is linked with its cluster's first."""

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, _ROWS):
                part = b.slice(i, _ROWS)
                (mine, n), (its, m) = _flat(part.column(2)), _flat(part.column(3))
                row = np.concatenate([np.repeat(np.arange(part.num_rows), x) for x in (n, m)]).astype(np.uint64)
                key = np.sort(row << _ROW_BITS | np.concatenate([mine, its]))
                both = np.bincount((key[1:][key[1:] == key[:-1]] >> _ROW_BITS).astype(np.int64), minlength=part.num_rows)
                yield pa.record_batch([part.column(0), part.column(1), pa.array(100 * both >= percent * (n + m - both))], ["node", "component", "near"])
        release_memory()

    return run


def _confirmed(percent: int):
    """Rows: component, a, b, node, part, seeks, set. Links of the seeking rows with the others; two rows that both seek are compared where the smaller one does."""

    def run(batches):
        for t in _groups(batches, 3):
            flat, n = _flat(t.column(6).combine_chunks())
            overlaps = Overlaps(flat, n)
            ids, part = t.column(3).to_numpy(), t.column(4).to_numpy()
            seeks = t.column(5).to_numpy(zero_copy_only=False).astype(bool)
            apart = part != t.column(0)[0].as_py()

            def linked(i, other, overlaps=overlaps, n=n, ids=ids, seeks=seeks, apart=apart):
                shared = overlaps.of(i)
                return other & ~seeks & ~(apart & (ids < ids[i])) & (100 * shared >= percent * (n + n[i] - shared))

            yield _edges(_spanning(ids, part, seeks, linked))
        release_memory()

    return run


def _sets(size: int):
    def run(batches):
        for b in batches:
            for i, j in _small_slices(b.column(1)):
                part = b.slice(i, j - i)
                sets, counts = shingle_sets(part.column(1), size)
                some = np.flatnonzero(counts)
                s1 = np.zeros(j - i, np.int64)
                if len(some):
                    s1[some], _ = _set_hash(sets, np.cumsum(counts)[some] - counts[some])
                yield pa.record_batch([part.column(0), pa.array(s1), as_list(sets.view(np.int64), counts, pa.int64())], ["doc_id", "s1", "set"])
        release_memory()

    return run


def _block_counts(rows: DataFrame, key: str, least: int, most: int) -> DataFrame:
    """(key, blocks): the number of blocks of each group. One up to `least` rows; blocks grow until a group has 64, and then up to `most` rows."""
    n = rows.groupBy(key).agg(F.count("*").alias("n"))
    return n.select(key, F.greatest(F.least(F.ceil(F.col("n") / least), F.lit(64)), F.ceil(F.col("n") / most)).cast("int").alias("blocks"))


def _block(member: str, blocks: str):
    return F.pmod(F.xxhash64(member), F.col(blocks)).cast("int")


def _in_block_pairs(rows: DataFrame, key: str, member: str, least: int, most: int) -> DataFrame:
    """Deals each group's rows into blocks and repeats them for each pair of blocks (bi <= bj)."""
    counts = write_table(_block_counts(rows, key, least, most).filter("blocks > 1"), "blocks")
    out = rows.join(counts, key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    out = out.withColumn("block", _block(member, "blocks")).withColumn("_b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return out.withColumn("bi", F.least("block", "_b")).withColumn("bj", F.greatest("block", "_b")).drop("blocks", "_b")


def _against_all(members: DataFrame, near: DataFrame, least: int, most: int) -> DataFrame:
    """Members of the clusters that have members apart (near is false), dealt into blocks for the comparison of these with all: component, a (block of seeking rows), b (block of all rows), node, part, seeks, set."""
    apart = near.filter("not near").select("component", "node")
    counts = _block_counts(apart, "component", least, most).withColumnRenamed("blocks", "na")
    split = apart.select("component").distinct()
    all_counts = _block_counts(members.select("component", "node").join(split, "component"), "component", least, most).withColumnRenamed("blocks", "nb")
    counts = write_table(counts.join(all_counts, "component"), "blocks")
    rows = members.join(counts, "component").join(apart.select("node", F.lit(True).alias("seeks")), "node", "left")
    rows = rows.withColumn("seeks", F.coalesce("seeks", F.lit(False))).withColumn("part", F.when(F.col("seeks"), F.col("node")).otherwise(F.col("component")))
    sought = rows.withColumn("b", _block("node", "nb")).withColumn("a", F.explode(F.sequence(F.lit(0), F.col("na") - 1))).withColumn("seeks", F.lit(False))
    seeking = rows.filter("seeks").withColumn("a", _block("node", "na")).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    columns = ["component", "a", "b", "node", "part", "seeks", "set"]
    return sought.select(*columns).union(seeking.select(*columns))


def _against_some(members: DataFrame, near: DataFrame, turn: int, most: int) -> DataFrame:
    """Members that are apart, for the comparison with a few of those linked with their cluster's first, others at each turn; columns as in _against_all."""
    apart = near.filter("not near").select("component", "node")
    counts = write_table(_block_counts(apart, "component", most, most).withColumnRenamed("blocks", "na"), "blocks")
    some = near.filter("near").groupBy("component", F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(_SOME)).alias("h")).agg(F.min_by("node", F.xxhash64("node", F.lit(turn))).alias("node"))
    sought = some.join(counts, "component").select("node", "na", F.lit(False).alias("seeks"))
    rows = sought.union(apart.join(counts, "component").select("node", "na", F.lit(True).alias("seeks"))).join(members, "node")
    a = F.when(F.col("seeks"), F.array(_block("node", "na"))).otherwise(F.sequence(F.lit(0), F.col("na") - 1))
    part = F.when(F.col("seeks"), F.col("node")).otherwise(F.col("component"))
    return rows.select("component", F.explode(a).alias("a"), F.lit(0).alias("b"), "node", part.alias("part"), "seeks", "set")


def cluster_members(rows: DataFrame, classes: DataFrame, candidates: DataFrame, size: int, broadcast_rows: int) -> DataFrame:
    """component, node and set of the classes that candidates (u, v) connect with others; a written table."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    clusters = write_table(connected_components(candidates).join(classes.select("node", "rep", "s1"), "node"), "clusters")
    wanted = clusters.select(F.col("rep").alias("doc_id")).distinct()
    held = rows.join(F.broadcast(wanted) if clusters.count() <= broadcast_rows else wanted, "doc_id", "left_semi")
    sets = held.mapInArrow(_sets(size), f"doc_id {kind}, s1 long, set array<long>").withColumnRenamed("doc_id", "rep").dropDuplicates(["rep", "s1"])
    return write_table(clusters.join(sets, ["rep", "s1"]).select("component", "node", "set"), "members")


def confirmed_groups(rows: DataFrame, signed: DataFrame, classes: DataFrame, candidates: DataFrame, size: int, percent: int, block_rows: int, most_rows: int, broadcast_rows: int) -> DataFrame:
    """The groups of classes (node, rep, n, s1, s2) by links of full sets, sought among what candidates (u, v) connect; a row for each of signed (doc_id, row_hash, n, s1, s2). rows: doc_id and text."""
    members = cluster_members(rows, classes, candidates, size, broadcast_rows)
    firsts = members.filter("node = component").select("component", F.col("set").alias("first_set"))
    near = members.filter("node != component").join(firsts, "component").select("node", "component", "set", "first_set")
    near = write_table(near.mapInArrow(_near_first(percent), "node long, component long, near boolean"), "near")
    links = near.filter("near").select(F.col("node").alias("u"), F.col("component").alias("v"))
    for turn in range(_TURNS):
        more = _against_some(members, near, turn, most_rows)
        more = write_table(more.repartition("component", "a").sortWithinPartitions("component", "a", "b").mapInArrow(_confirmed(percent), "u long, v long"), "more")
        links = links.union(more)
        reached = more.select(F.col("u").alias("node"), F.lit(True).alias("reached")).distinct()
        near = write_table(near.join(reached, "node", "left").select("node", "component", (F.col("near") | F.coalesce("reached", F.lit(False))).alias("near")), "near")
    apart = _against_all(members, near, block_rows, most_rows)
    links = links.union(apart.repartition("component", "a", "b").sortWithinPartitions("component", "a", "b").mapInArrow(_confirmed(percent), "u long, v long"))

    groups = write_table(connected_components(links).join(classes.select("node", "rep"), "node"), "groups")
    least = write_table(groups.groupBy("component").agg(F.min("rep").alias("least")), "least")
    named = groups.select("node", "component").join(least, "component")
    named = classes.select("s1", "s2", "n", "rep", "node").join(named, "node", "left")
    named = named.select("s1", "s2", "n", F.col("rep").alias("class_id"), F.coalesce("component", "node").alias("group_id"), F.coalesce("least", "rep").alias("component_id"))
    out = signed.select("doc_id", "row_hash", "n", "s1", "s2").join(named, ["s1", "s2", "n"], "left")
    alone = F.col("doc_id").isNull() | (F.col("n") == 0)
    return out.select("doc_id", "row_hash", F.col("n").alias("n_shingles"), *[F.when(alone, F.col("doc_id")).otherwise(F.col(x)).alias(x) for x in ("class_id", "component_id")], F.when(~alone, F.col("group_id")).alias("group_id"))


def minhash_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 2, percent: int = 80, k: int = 48, c: int = 25, block_rows: int = 128, most_rows: int = 4096, broadcast_rows: int = 250_000) -> DataFrame:
    """One row per row of docs: doc_id, row_hash (of the text), n_shingles, class_id (smallest doc_id with this shingle set), component_id (smallest doc_id of the group) and group_id (the group itself, as groups of rows that repeat an id may have one smallest; null for what is linked with nothing)."""
    rows = with_small_batches(docs).select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    signed = write_table(rows.withColumn("row_hash", F.xxhash64("text")).mapInArrow(_signatures(size, k), f"doc_id {kind}, row_hash long, n long, s1 long, s2 long, sig binary"), "signed")
    classes = signed.filter("n > 0 and doc_id is not null").groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"))
    classes = write_table(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    coordinates = classes.select("node", "sig").mapInArrow(_coordinates(k), "key long, node long")
    # This and other small sides are written, so that both sides of a join have exchanges of their own and AQE can split a very common key.
    shared = write_table(coordinates.groupBy("key").agg(F.count("*").alias("df")).filter("df > 1"), "shared")
    picked = coordinates.join(shared, "key").groupBy("node").agg(F.collect_list(F.struct("df", "key")).alias("keys")).filter(F.size("keys") >= c)
    picked = picked.select("node", F.slice(F.array_sort("keys"), F.lit(1), F.size("keys") - (c - 1)).alias("keys"))
    posted = write_table(picked.select("node", F.explode("keys.key").alias("key")), "posted")
    smallest = write_table(posted.groupBy("key").agg(F.min("node").alias("hub")), "hubs")
    star = posted.join(smallest, "key").filter("node != hub").select("node", "hub").distinct()
    sigs = classes.select("node", "sig")
    star = star.join(sigs, "node").join(sigs.select(F.col("node").alias("hub"), F.col("sig").alias("hub_sig")), "hub")
    star = write_table(star.select("node", "hub", "sig", "hub_sig").mapInArrow(_agreeing(k, c), "u long, v long"), "star")
    parts = connected_components(star).withColumnRenamed("component", "part")
    labelled = write_table(posted.join(parts, "node", "left").withColumn("part", F.coalesce("part", "node")), "labelled")
    split = write_table(labelled.groupBy("key").agg(F.min("part").alias("a"), F.max("part").alias("z")).filter("a != z").select("key"), "split")
    rest = _in_block_pairs(labelled.join(split, "key").join(sigs, "node"), "key", "node", block_rows, most_rows).select("key", "bi", "bj", "node", "block", "part", "sig")
    more = rest.repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj").mapInArrow(_counted(k, c), "u long, v long")
    return confirmed_groups(rows, signed, classes, star.union(more), size, percent, block_rows, most_rows, broadcast_rows)


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = minhash_groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN [ws[1]]
    ELSE list_distinct([ws[i] || ' ' || ws[i + 1] for i in range(1, len(ws))]) END AS s FROM w),
classes AS (SELECT list_sort(s) AS s, min(doc_id) AS rep, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY list_sort(s), len(s)),
flat AS MATERIALIZED (SELECT rep, n, unnest(s) AS x FROM classes),
inter AS (SELECT a.rep AS a, b.rep AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS common
  FROM flat a JOIN flat b ON a.x = b.x AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY a.rep, b.rep),
links AS MATERIALIZED (SELECT a, b FROM inter WHERE 100 * common >= 80 * (na + nb - common)),
edges AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(node, dest) AS (SELECT rep, rep FROM classes UNION SELECT r.node, e.b FROM reach r JOIN edges e ON r.dest = e.a),
comp AS (SELECT node, min(dest) AS component FROM reach GROUP BY node)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(comp.component, s.doc_id) AS component_id, s.doc_id = coalesce(comp.component, s.doc_id) AS kept
FROM sets s LEFT JOIN classes c ON list_sort(s.s) = c.s LEFT JOIN comp ON comp.node = c.rep
"""
