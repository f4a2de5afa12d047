"""Benchmark decontamination by SimHash of item-sized windows, in DataFrame operations only.

Words are runs of letters and digits in lower case; shingles are `size` consecutive words, as 64-bit hashes. A window of a document has as
many words as the item it is held against (the whole text, if that is shorter). A window without any shingle of an item has similarity
zero; more than that, a similarity of `percent` takes percent / (100 + percent) of the shingles of both (8/9 of the item's by default).
So all windows that have that many places with shingles of one item are looked at, in whatever order these stand.

Each window and each item has a 64-bit SimHash of its shingles, weighted by their number. The fingerprint is cut into radius + 1 blocks:
two fingerprints within the radius agree in one of them, so joining on (item, block, its bits) finds all pairs of a window and an item that
it shares shingles with within the radius. Candidates are then compared exactly: the sum of the smaller counts of each shingle over the sum
of the larger ones.

With the default radius of 24 of 64 bits, a window of similarity 0.8 (expected distance 9.7, standard deviation 2.9) is missed with
probability 2.9e-6; a copy has distance 0. No smaller radius has that recall, and blocks of a radius so large pass most pairs: it is the
fingerprints' distance that removes candidates, and README says how many.

Items are joined by broadcast while they have at most `broadcast_shingles` shingles, else by shuffling.

Results: null and empty texts, and items and documents of fewer than `size` words, match nothing. Repeated rows of one
document count as one; an item_id with several texts stands for all of them, and its best window counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import table, write_table


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def with_shingles(df: DataFrame, source: str, size: int) -> DataFrame:
    """Adds `_sh`: hashes of the runs of `size` words of the array column source, put together from shorter runs."""
    df = df.withColumn("_g1", F.coalesce(F.transform(source, lambda w: F.xxhash64(w)), F.expr("array()").cast("array<long>")))

    def run(df: DataFrame, n: int) -> DataFrame:
        if f"_g{n}" in df.columns:
            return df
        a, b = n - n // 2, n // 2
        df = run(run(df, a), b)
        length = F.greatest(F.size("_g1") - (n - 1), F.lit(0))
        return df.withColumn(f"_g{n}", F.zip_with(F.slice(f"_g{a}", F.lit(1), length), F.slice(f"_g{b}", F.lit(a + 1), length), lambda x, y: F.xxhash64(x, y)))

    df = run(df, size)
    return df.withColumn("_sh", F.col(f"_g{size}")).drop(*[c for c in df.columns if c.startswith("_g")])


def simhash(shingles: str) -> Column:
    """64 bits: each is set if more than half of the shingles (counted as often as they occur) have it."""
    bit = f"aggregate({shingles}, 0, (n, h) -> n + cast(shiftrightunsigned(h, b) & 1L as int))"
    return F.expr(f"aggregate(sequence(0, 63), 0L, (fp, b) -> fp | if(2 * {bit} > size({shingles}), shiftleft(1L, b), 0L))")


def block_bits(radius: int, bits: int = 64) -> list[tuple[int, int]]:
    """(offset, width) of each of radius + 1 blocks."""
    n, out, at = radius + 1, [], 0
    for i in range(n):
        width = bits // n + (i < bits % n)
        out.append((at, width))
        at += width
    return out


def blocks(fingerprint: str, radius: int) -> Column:
    """An array of the fingerprint's blocks, each with its number in the low bits."""
    return F.array(*[F.shiftleft(F.shiftrightunsigned(F.col(fingerprint), at).bitwiseAND(F.lit((1 << width) - 1)), 8).bitwiseOR(F.lit(i)) for i, (at, width) in enumerate(block_bits(radius))])


def shared_shingles(a: str, b: str) -> Column:
    """The sum over shingles of the smaller count. If either side has no shingle twice, that is the size of the intersection."""
    counted = f"aggregate(array_distinct({a}), 0, (n, x) -> n + least(size(filter({a}, y -> y = x)), size(filter({b}, y -> y = x))))"
    return F.expr(f"if(size(array_distinct({a})) = size({a}) or size(array_distinct({b})) = size({b}), size(array_intersect({a}, {b})), {counted})")


def window_starts(at: str, shingles: str, m: str, percent: int) -> Column:
    """Starts of the windows of m shingles that hold enough of the places `at` for a similarity of `percent`, each once, whatever the order of the item's shingles in them."""
    size = F.size(shingles)
    need = F.floor((percent * (F.least(size, F.col(m)) + F.col(m)) + (99 + percent)) / (100 + percent)).cast("int")

    def starts(p: Column) -> Column:
        def of(k: Column) -> Column:
            # Windows that hold the places from k to k + need - 1 and begin after place k - 1.
            low = F.greatest(F.get(p, k + need - 1) - F.col(m) + 1, F.coalesce(F.get(p, k - 1) + 1, F.lit(0)), F.lit(0))
            high = F.least(F.get(p, k), F.greatest(size - F.col(m), F.lit(0)))
            return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

        return F.when(F.size(p) >= need, F.flatten(F.transform(F.sequence(F.lit(0), F.size(p) - need), of)))

    # As a lambda's variable the sorted places are worked out once.
    return F.element_at(F.transform(F.array(F.array_sort(at)), starts), 1)


def contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = 5, percent: int = 80, radius: int = 24, broadcast_shingles: int = 500_000) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, similarity): for each document and item with a window of at least `percent` hundredths, the first of its best windows."""
    known = with_shingles(items.select(F.col(item_id).alias("item_id"), words(F.col(item_text).cast("string")).alias("_w")), "_w", size)
    known = known.filter(F.size("_sh") > 0).select("item_id", F.size("_w").alias("n_words"), F.col("_sh").alias("item_sh"))
    # Each distinct text is sought once, under a hash, for all ids that have it; an id may have several texts.
    known = known.withColumn("item", F.xxhash64("item_sh")).dropDuplicates(["item_id", "item"])
    named = write_table(known.select("item", "item_id"), "named")
    known = known.drop("item_id").dropDuplicates(["item"])
    known = write_table(known.withColumn("item_fp", simhash("item_sh")), "items")
    small = (known.agg(F.sum(F.size("item_sh"))).first()[0] or 0) <= broadcast_shingles
    hint = F.broadcast if small else (lambda df: df)
    # A similarity of percent takes that share of the item's shingles, however short the text.
    enough = 100 * F.size("at") >= percent * F.col("m")
    posts = known.select(F.explode("item_sh").alias("h"), "item", F.size("item_sh").alias("m")).distinct()

    rows = docs.select(F.col(doc_id).alias("doc_id"), words(F.col(text).cast("string")).alias("_w")).filter("doc_id is not null")
    rows = with_shingles(rows, "_w", size).select("doc_id", "_sh")
    # The outer form, since an inner one has Spark filter by size(_sh) below the projections, which works out all shingles several times over.
    if small:
        hits = rows.select("doc_id", "_sh", F.posexplode_outer("_sh").alias("i", "h")).join(F.broadcast(posts), "h")
        hits = hits.groupBy("doc_id", "_sh", "item", "m").agg(F.collect_set("i").alias("at"))
    else:
        rows = rows.withColumn("_row", F.xxhash64("_sh"))
        places = rows.select("doc_id", "_row", F.posexplode_outer("_sh").alias("i", "h")).join(posts, "h")
        places = places.groupBy("doc_id", "_row", "item", "m").agg(F.collect_set("i").alias("at"))
        hits = places.filter(enough).join(rows.dropDuplicates(["doc_id", "_row"]), ["doc_id", "_row"])
    windows = hits.filter(enough).select("doc_id", "item", "m", "_sh", F.explode(window_starts("at", "_sh", "m", percent)).alias("start"))
    # The shuffle spreads documents with many hits; what follows is costly per window.
    windows = windows.select("doc_id", "item", "start", F.slice("_sh", F.col("start") + 1, F.col("m")).alias("win")).distinct()
    windows = write_table(windows.withColumn("fp", simhash("win")), "windows")

    # A window is held against the item that it shares shingles with, and no other of that length.
    left = windows.select("doc_id", "item", "start", "fp", F.explode(blocks("fp", radius)).alias("block"))
    right = known.select("item", "item_fp", F.explode(blocks("item_fp", radius)).alias("block"))
    pairs = left.join(hint(right), ["item", "block"]).filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius)
    pairs = pairs.select("doc_id", "item", "start").distinct().join(windows.select("doc_id", "item", "start", "win"), ["doc_id", "item", "start"])
    pairs = pairs.join(hint(known.select("item", "n_words", "item_sh")), "item")
    # As a generated column it is worked out once, however often it is used.
    pairs = pairs.withColumn("common", F.explode_outer(F.array(shared_shingles("win", "item_sh"))))
    union = F.size("win") + F.size("item_sh") - F.col("common")
    pairs = pairs.filter(100 * F.col("common") >= percent * union)
    pairs = pairs.select("doc_id", "item", "n_words", "start", (F.col("common") / union).alias("similarity"))
    best = pairs.join(hint(named), "item").groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"), "n_words")).alias("b"))
    return best.select("doc_id", "item_id", (-F.col("b.back")).cast("long").alias("start_word"), F.col("b.n_words").cast("long").alias("n_words"), F.col("b.similarity").alias("similarity"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w != '') AS ws FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w != '') AS ws FROM benchmark WHERE text IS NOT NULL),
dh AS MATERIALIZED (SELECT doc_id, [array_to_string(list_slice(ws, k, k + 4), ' ') for k in range(1, len(ws) - 3)] AS h FROM d WHERE len(ws) >= 5),
ih AS MATERIALIZED (SELECT item_id, len(ws) AS n_words, [array_to_string(list_slice(ws, k, k + 4), ' ') for k in range(1, len(ws) - 3)] AS h FROM i WHERE len(ws) >= 5),
ix AS MATERIALIZED (SELECT item_id, unnest(h) AS x FROM ih),
pairs AS (SELECT DISTINCT doc_id, item_id FROM (SELECT doc_id, unnest(h) AS x FROM dh) JOIN ix USING (x)),
win AS (SELECT doc_id, item_id, dh.h, len(ih.h) AS m, unnest(range(0, greatest(len(dh.h) - len(ih.h), 0) + 1)) AS s FROM pairs JOIN dh USING (doc_id) JOIN ih USING (item_id)),
c AS (SELECT doc_id, item_id, s, x, count(*) AS n FROM (SELECT doc_id, item_id, s, unnest(list_slice(h, s + 1, s + m)) AS x FROM win) GROUP BY ALL),
ic AS (SELECT item_id, x, count(*) AS n FROM ix GROUP BY ALL),
b AS (SELECT c.doc_id, c.item_id, c.s, sum(least(c.n, ic.n)) AS common FROM c JOIN ic USING (item_id, x) GROUP BY ALL),
j AS (SELECT b.doc_id, b.item_id, b.s, ih.n_words, common, least(len(dh.h), len(ih.h)) + len(ih.h) - common AS u FROM b JOIN dh USING (doc_id) JOIN ih USING (item_id)),
r AS (SELECT *, common / u AS sim, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY common / u DESC, s) AS k FROM j WHERE 100 * common >= 80 * u)
SELECT doc_id, item_id, CAST(s AS BIGINT) AS start_word, CAST(n_words AS BIGINT) AS n_words, CAST(sim AS DOUBLE) AS similarity FROM r WHERE k = 1
"""
