"""The n-gram join against all pairs: groups, pairs, odd rows, ids of other types, small blocks; and near-dedup of text ids."""

import random

import numpy as np
import pytest
from test_methods import corpus, edited

from vellumflow.llm import minhash_dedup, ngram_join

ODD = ["", None, "  \n\t ", "one", "One", "one two", "ONE  two", "a b c", "a b c d", "a b c e", "x " * 3000]


def gram_set(text, size):
    ws = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(ws[i : i + size]) for i in range(len(ws) - size + 1)} if len(ws) >= size else ({tuple(ws)} if ws else set())


def linked(rows, size, percent):
    """(component of each row, all links between different sets as pairs of smallest ids)."""
    sets = [frozenset(gram_set(t, size)) for _, t in rows]
    label = list(range(len(rows)))
    rep = {}
    for (d, _), s in zip(rows, sets, strict=True):
        if s and d is not None:
            rep[s] = min(rep.get(s, d), d)
    pairs = set()
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            both = len(a & b)
            if a and b and None not in (rows[i][0], rows[j][0]) and 100 * both >= percent * (len(a) + len(b) - both):
                if a != b:
                    x, y = sorted(((rep[a], len(a)), (rep[b], len(b))))
                    pairs.add((x[0], y[0], x[1], y[1], both))
                if label[i] != label[j]:
                    p, q = sorted((label[i], label[j]))
                    label = [p if x == q else x for x in label]
    ids = [d for d, _ in rows]
    return [None if ids[i] is None else min(ids[j] for j in range(len(rows)) if label[j] == label[i]) for i in range(len(rows))], pairs, sets


def near_copies(rng):
    base = corpus(rng, 12, 90) + corpus(rng, 3, 500) + corpus(rng, 6, 7)
    docs = base + [edited(rng, b, rng.randrange(6)) for b in base for _ in range(5)] + [edited(rng, base[0], rng.randrange(5)) for _ in range(40)]
    # A chain: each is near the next one only.
    link = corpus(rng, 1, 120)[0]
    for _ in range(25):
        link = edited(rng, link, 2)
        docs.append(link)
    # Many share a passage, and copies of other lengths contain each other.
    passage = corpus(rng, 1, 60)[0]
    docs += [[*b[:20], *passage, *b[20:]] for b in base[:12]] + [base[3][:k] for k in (90, 85, 80, 76, 70)]
    rng.shuffle(docs)
    return [" ".join(d) for d in docs]


@pytest.mark.parametrize(("size", "percent", "block_rows"), [(4, 85, 128), (1, 60, 16)])
def test_groups_and_pairs_against_all_pairs(spark, size, percent, block_rows):
    rng = random.Random(block_rows + size)
    rows = list(enumerate(near_copies(rng))) + [(10_000 + i, t) for i, t in enumerate(ODD * 2)]
    rows += [(None, rows[0][1]), (None, "one")]
    want, pairs, sets = linked(rows, size, percent)
    docs = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, n int, node string").repartition(3)
    got = ngram_join.ngram_groups(docs, size=size, percent=percent, block_rows=block_rows).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=key) == sorted(((d, len(s), c) for (d, _), s, c in zip(rows, sets, want, strict=True)), key=key)
    assert len(set(want)) < len(rows) - 60 and len(pairs) > 60
    found = ngram_join.ngram_pairs(docs, size=size, percent=percent, block_rows=block_rows).collect()
    assert len(found) == len(pairs) and {tuple(r) for r in found} == pairs


def test_indexed_ngrams_of_linked_sets():
    """Linked sets share as many of their indexed n-grams as the filters ask for, at every size."""
    rng = np.random.default_rng(4)
    for n in [*range(1, 60), 100, 333, 1000]:
        for percent in (50, 80, 85, 99, 100):
            for m in {n, *(int(x) for x in rng.integers(1, 2 * n + 1, 4))}:
                least = -(-percent * (n + m) // (100 + percent))
                if least > min(n, m):
                    continue
                # The common n-grams as late in the order as they can be.
                place = {n: np.sort(rng.choice(n, least, replace=False)), m: np.sort(rng.choice(m, least, replace=False))}
                if rng.random() < 0.5:
                    place = {x: np.arange(x - least, x) for x in (n, m)}
                for one_in in (ngram_join._WIDE, ngram_join._CLOSE):
                    l = lambda x, one_in=one_in: int(ngram_join.indexed_shared(x, percent, one_in))  # noqa: E731, E741
                    length = {x: x - ngram_join.least_shared(x, percent) + l(x) for x in (n, m)}
                    shared = int(((place[n] < length[n]) & (place[m] < length[m])).sum())
                    assert shared >= l(min(n, m)) >= max(l(ngram_join.least_shared(x, percent)) for x in (n, m))
                assert n + m - 2 * least <= ngram_join._most_apart(n, m, percent)


def test_text_ids(spark):
    rng = random.Random(9)
    rows = [(f"u-{i:03}", t) for i, t in enumerate(near_copies(rng))] + [("b2", "same words here now"), ("a1", "Same words here now"), ("", "other"), (None, "other")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    for run, size, percent in ((ngram_join.ngram_groups, 4, 85), (minhash_dedup.minhash_groups, 2, 80)):
        want, _, _ = linked(rows, size, percent)
        got = run(docs).collect()
        assert sorted((r["doc_id"] or "~", r["component_id"] or "~") for r in got) == sorted((d or "~", (c if c is not None else "~") or "~") for (d, _), c in zip(rows, want, strict=True))
        assert {r["doc_id"]: r["class_id"] for r in got}["b2"] == "a1"
    assert {tuple(r) for r in ngram_join.ngram_pairs(docs).collect()} == linked(rows, 4, 85)[1]


def test_join_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id string, text string")
    assert ngram_join.ngram_groups(empty).collect() == [] and ngram_join.ngram_pairs(empty).collect() == []
    alone = spark.createDataFrame([(1, None), (2, "")], "doc_id int, text string")
    assert sorted(tuple(r)[:1] + (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_groups(alone).collect()) == [(1, 0, 1), (2, 0, 2)]
