"""Fuzzy joins of names: an inverted index of q-grams with length, prefix and count filters, then the exact measure.

Strings are compared as multisets of q-grams (a gram that occurs n times gives n tokens). If two strings are as similar as asked, they
share at least a number of tokens that follows from their lengths alone:

* Indel (100 * 2 * LCS / summed length): with least LCS L and distance d = la + lb - 2 L, L - (q - 1) (d + 1) tokens;
* Levenshtein (100 * (1 - distance / longer length)): with largest distance k, longer length - q + 1 - k q tokens.

A pair takes the largest q up to 3 for which that number is 3 or more, else q = 1, for which it is 1 or more. Tokens are ordered rare-first by the right
side's counts. Of a string's n tokens only the first n - t + 1 are joined on, t being the least number over all lengths that a partner
may have; a pair is kept at the first prefix token that both have, so it comes once, and only with as many common tokens as it needs. No
pair is compared that shares no prefix token. Joins are plain equi-joins on tokens: AQE broadcasts a side that turns out small, and
splits a token that is very common.

Short strings under a high Indel cutoff have few such tokens, which select little. They go through an index of deletions instead: a pair
is as similar as asked if some string is left of both after i and j deletions, 200 * (its length) / summed length being the cutoff or more.
All strings that deletions leave are few then (for a cutoff of 92 at most 211, up to 20 characters); pairs with a longer string go by tokens.

Results: null and empty strings match nothing; equal strings match at 100. Tokens are 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_Q = (3, 2, 1)
#: Tokens to share at least, for a q above 1 to be taken: fewer select too little.
_LEAST = 3
_SLACK = 1e-9
#: Deletions are indexed for strings of which they leave at most so many others for each character, and for these cutoffs and lengths.
_LEFT, _LEAST_CUTOFF, _LONGEST = 32, 80, 64


class Measure:
    """A similarity of two strings from 0 to 100 and what it says about their lengths and tokens."""

    def __init__(self, cutoff: float, of: Callable[[Column, Column], Column], least_ratio: float, shared: Callable[[Column, Column, int], Column], short: int = 0):
        self.cutoff, self.of, self.least_ratio, self.shared = cutoff, of, least_ratio, shared
        #: Up to this length of both, pairs are found by deletions.
        self.short = short

    def least_length(self, n: Column) -> Column:
        return F.greatest(F.ceil(n * self.least_ratio - _SLACK), F.lit(1)).cast("int")

    def most_length(self, n: Column) -> Column:
        return F.floor(n / self.least_ratio + _SLACK).cast("int")

    def need(self, la: Column, lb: Column) -> Column:
        """(q, need) of a pair of these lengths."""
        of = lambda q: F.struct(F.lit(q).alias("q"), self.shared(la, lb, q).alias("need"))
        out = of(_Q[-1])
        for q in reversed(_Q[:-1]):
            out = F.when(self.shared(la, lb, q) >= _LEAST, of(q)).otherwise(out)
        return out


def _deletions(n: int, ratio: float) -> int:
    """Deletions at most from a string of n characters."""
    return n - max(1, math.ceil(n * ratio - _SLACK))


def indel(cutoff: float, of: Callable[[Column, Column], Column]) -> Measure:
    def shared(la: Column, lb: Column, q: int) -> Column:
        common = F.ceil(cutoff * (la + lb) / 200 - _SLACK)
        return (common - (q - 1) * (la + lb - 2 * common + 1)).cast("int")

    ratio, short = cutoff / (200 - cutoff), 0
    while cutoff >= _LEAST_CUTOFF and short < _LONGEST and sum(math.comb(short + 1, i) for i in range(_deletions(short + 1, ratio) + 1)) <= _LEFT * (short + 1):
        short += 1
    return Measure(cutoff, of, ratio, shared, short)


def levenshtein(cutoff: float) -> Measure:
    def shared(la: Column, lb: Column, q: int) -> Column:
        longer = F.greatest(la, lb)
        return (longer - q + 1 - q * F.floor((1 - cutoff / 100) * longer + _SLACK)).cast("int")

    return Measure(cutoff, lambda a, b: 100 * (1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))), cutoff / 100, shared)


def _tokens(strings: DataFrame, measure: Measure) -> DataFrame:
    """s, n (its length), q, need (the least number of tokens to share at this q), token; strings: distinct s."""
    n = F.length("s")
    lengths = F.sequence(measure.least_length(n), F.greatest(measure.most_length(n), measure.least_length(n)))
    needs = strings.select("s", n.alias("n"), F.transform(lengths, lambda m: measure.need(n, m)).alias("needs"))
    levels = F.expr("explode(transform(array_distinct(transform(needs, x -> x.q)), q -> named_struct('q', q, 'need', array_min(transform(filter(needs, x -> x.q = q), x -> x.need)))))")
    rows = needs.select("s", "n", levels.alias("l")).select("s", "n", "l.q", "l.need")
    rows = rows.filter(F.col("n") >= F.col("q"))
    grams = F.transform(F.sequence(F.lit(1), F.col("n") - F.col("q") + 1), lambda i: F.substring(F.col("s"), i, F.col("q")))
    counted = rows.select("s", "n", "q", "need", F.explode(grams).alias("gram")).groupBy("s", "n", "q", "need", "gram").agg(F.count("*").cast("int").alias("times"))
    return counted.select("s", "n", "q", "need", F.explode(F.sequence(F.lit(1), "times")).alias("k"), "gram").select("s", "n", "q", "need", F.xxhash64("q", "gram", "k").alias("token"))


def _indexed(tokens: DataFrame, df: DataFrame) -> DataFrame:
    """s, n, q, tokens (rarest first), prefix, token (each of the prefix)."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "token"))), lambda x: x["token"])
    rows = tokens.join(df, "token", "left").groupBy("s", "n", "q", "need").agg(ordered.alias("tokens")).filter(F.size("tokens") >= F.col("need"))
    rows = rows.withColumn("prefix", F.slice("tokens", F.lit(1), F.size("tokens") - F.col("need") + 1))
    return rows.select("s", "n", "q", "tokens", "prefix", F.explode("prefix").alias("token"))


def _left_over(strings: DataFrame, measure: Measure) -> DataFrame:
    """s, n (its length), i, left: hashes of the different strings that i deletions leave, for all i that a partner may ask for."""
    cut = lambda x: F.when(x["p"] <= F.length(x["v"]), F.transform(F.sequence(x["p"], F.length(x["v"])), lambda p: F.struct(F.concat(F.substring(x["v"], F.lit(1), p - 1), F.substring(x["v"], p + 1, F.length(x["v"]))).alias("v"), p.alias("p")))).otherwise(F.array().cast("array<struct<v:string,p:int>>"))
    levels = [F.array(F.struct(F.col("s").alias("v"), F.lit(1).alias("p")))]
    for _ in range(max(_deletions(n, measure.least_ratio) for n in range(1, measure.short + 1))):
        # The next deletion is not before the last one.
        levels.append(F.flatten(F.transform(levels[-1], cut)))
    most = F.length("s") - measure.least_length(F.length("s"))
    none = F.array().cast("array<struct<i:int,left:bigint>>")

    def hashed(i: int, level: Column) -> Column:
        return F.when(most >= i, F.transform(F.array_distinct(F.transform(level, lambda x: x["v"])), lambda v: F.struct(F.lit(i).alias("i"), F.xxhash64(v).alias("left")))).otherwise(none)

    return strings.select("s", F.length("s").alias("n"), F.inline(F.concat(*[hashed(i, x) for i, x in enumerate(levels)])))


def _by_deletions(left: DataFrame, right: DataFrame, measure: Measure) -> DataFrame:
    """(a, b): candidates among strings s of at most measure.short characters; none as similar as asked is lost."""
    x = _left_over(left, measure).select(F.col("s").alias("a"), F.col("n").alias("la"), "i", "left")
    y = _left_over(right, measure).select(F.col("s").alias("b"), F.col("n").alias("lb"), F.col("i").alias("j"), "left")
    near = (F.col("la") - F.col("i") == F.col("lb") - F.col("j")) & (200 * (F.col("la") - F.col("i")) >= measure.cutoff * (F.col("la") + F.col("lb")) - _SLACK)
    return x.join(y, "left").filter(near).select("a", "b").distinct()


def _by_tokens(left: DataFrame, right: DataFrame, measure: Measure) -> DataFrame:
    """(a, b): candidates of which one at least is longer than measure.short; none as similar as asked is lost."""
    # Shorter ones than a partner of such a string can be are not needed.
    sides = [_tokens(df.filter(F.length("s") >= measure.least_length(F.lit(measure.short + 1))), measure) for df in (left, right)]
    df = sides[1].groupBy("token").agg(F.count("*").alias("df"))
    x, y = (_indexed(side, df) for side in sides)
    y = y.select("token", *[F.col(c).alias(f"r_{c}") for c in ("s", "n", "tokens", "prefix")])
    met = x.join(y, "token").filter(F.get(F.array_intersect("prefix", "r_prefix"), F.lit(0)) == F.col("token"))
    met = met.filter((F.col("r_n") >= measure.least_length(F.col("n"))) & (F.col("r_n") <= measure.most_length(F.col("n"))) & (F.greatest("n", "r_n") > measure.short))
    met = met.withColumn("of", measure.need(F.col("n"), F.col("r_n"))).filter((F.col("of.q") == F.col("q")) & (F.size(F.array_intersect("tokens", "r_tokens")) >= F.col("of.need")))
    return met.select(F.col("s").alias("a"), F.col("r_s").alias("b"))


def fuzzy_pairs(left: DataFrame, right: DataFrame, measure: Measure, a: str = "a", b: str = "b") -> DataFrame:
    """(a, b, score) of all pairs of distinct strings of left and right whose similarity is at least the measure's cutoff (above 0)."""
    if not 0 < measure.cutoff <= 100:
        raise ValueError("the cutoff has to be above 0 and at most 100")
    strings = [df.select(F.col(c).alias("s")).filter("s != ''").distinct() for df, c in ((left, a), (right, b))]
    out = _by_tokens(*strings, measure)
    if measure.short:
        out = out.union(_by_deletions(*[df.filter(F.length("s") <= measure.short) for df in strings], measure))
    return out.withColumn("score", measure.of(F.col("a"), F.col("b"))).filter(F.col("score") >= measure.cutoff)
