"""Fuzzy joins against all pairs: both measures, cutoffs from low to 100, repeated letters, odd strings; words of whole tables."""

import random

import pytest

from vellumflow.operators import fuzzy
from vellumflow.operators import merge as M
from vellumflow.plans.registry import QUERIES


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


MEASURES = {
    "indel": (lambda cutoff: fuzzy.indel(cutoff, M.indel_similarity), lambda a, b: 200 * lcs(a, b) / (len(a) + len(b))),
    "levenshtein": (fuzzy.levenshtein, lambda a, b: 100 * (1 - distance(a, b) / max(len(a), len(b)))),
}


@pytest.mark.parametrize("cutoff", [20.0, 66.7, 85.0, 92.0, 100.0])
@pytest.mark.parametrize("kind", list(MEASURES))
def test_pairs_against_all_pairs(spark, kind, cutoff):
    rng = random.Random(int(cutoff))
    parts = ["th", "an", "er", "in", "aaa", "e", "é", "中", " ", "x"]
    words = sorted({"".join(rng.choice(parts) for _ in range(rng.randrange(1, 9))) for _ in range(70)} | {"a", "aa", "aaaaaaaaaaaa", "ab" * 20})
    edited = [w[:i] + rng.choice("aeq") + w[i + rng.randrange(2) :] for w in words for i in [rng.randrange(len(w) + 1)]]
    left, right = [*edited, *words[:20], "", None], [*words, *words[:5], "", None]
    make, plain = MEASURES[kind]
    got = fuzzy.fuzzy_pairs(spark.createDataFrame([(w,) for w in left], "name string"), spark.createDataFrame([(w,) for w in right], "alias string"), make(cutoff), "name", "alias").collect()
    want = {(a, b): plain(a, b) for a in {*left} for b in {*right} if a and b and plain(a, b) >= cutoff}
    assert len(got) == len({(r["a"], r["b"]) for r in got})
    assert {(r["a"], r["b"]): round(r["score"], 9) for r in got} == {k: round(v, 9) for k, v in want.items()} and want


def test_cutoffs_that_select_nothing(spark):
    df = spark.createDataFrame([("a",)], "a string")
    with pytest.raises(ValueError, match="cutoff"):
        fuzzy.fuzzy_pairs(df, df.toDF("b"), fuzzy.levenshtein(0.0))
    assert fuzzy.fuzzy_pairs(df.limit(0), df.toDF("b"), fuzzy.levenshtein(50.0)).collect() == []


def test_no_pair_without_a_common_token(spark):
    df = spark.createDataFrame([("abcdefghij",), ("klmnopqrst",)], "a string")
    pairs = fuzzy.fuzzy_pairs(df, df.toDF("b"), fuzzy.indel(92.0, M.indel_similarity))
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan and "Join Inner, true" not in plan and "(token" in plan and pairs.count() == 2


def test_near_words_of_small_tables(spark, tmp_path):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice(["th", "er", "on", "ti", "ed", "a"]) for _ in range(rng.randrange(1, 8)))
    docs = [(i, " ".join(word() for _ in range(20)) + ". Été!") for i in range(40)] + [(90, None), (91, "")]
    said = [(i, " ".join(word() for _ in range(20)) + ", été?") for i in range(20)] + [(11, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(said, "conv_id long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    split = lambda t: {w for w in "".join(c if c.isalpha() else " " for c in (t or "").lower()).split()}
    names, known = set().union(*(split(t) for _, t in said)), set().union(*(split(t) for _, t in docs))
    want = set()
    for name in names:
        near = [(-200 * lcs(name, w) / (len(name) + len(w)), w) for w in known]
        score, alias = min(near)
        if -score >= 92:
            want.add((name, alias, str(sum(alias in split(t) for _, t in docs)), int(-score)))
    assert {tuple(r) for r in QUERIES["near_words"](spark, str(tmp_path)).collect()} == want and len(want) > 15 and any(r[3] < 100 for r in want)


def test_short_words_meet_only_near_ones(spark):
    """Words of the same few syllables share most of their tokens; by deletions hardly a pair is compared that isn't near enough."""
    rng = random.Random(7)
    words = sorted({"".join(rng.choice(("lor", "mis", "tan", "ver", "quo", "be", "di")) for _ in range(rng.randrange(2, 8))) for _ in range(300)})
    measure = fuzzy.indel(92.0, M.indel_similarity)
    assert measure.short == 20 and fuzzy.indel(30.0, M.indel_similarity).short == 0 and fuzzy.indel(100.0, M.indel_similarity).short == 64
    left = sorted({w[:i] + rng.choice(("", "x", "lo")) + w[i + 1 :] for w in words[::3] for i in (rng.randrange(len(w)),)})
    a, b = (spark.createDataFrame([(w,) for w in ws], "s string") for ws in (left, words))
    want = {(x, y) for x in left for y in words if abs(len(x) - len(y)) < 5 and 200 * lcs(x, y) >= 92 * (len(x) + len(y)) - 1e-9}
    short = {p for p in want if max(map(len, p)) <= 20}
    pairs = sorted(tuple(r) for r in fuzzy._by_deletions(*[df.filter("length(s) <= 20") for df in (a, b)], measure).collect())
    assert pairs == sorted(short) and len(short) > 20
