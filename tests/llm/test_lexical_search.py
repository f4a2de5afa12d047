"""Ranked search against scores of all documents, with odd rows, ties, ids of other types and small shards."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from test_entry import DIR, needs_data

from vellumflow.llm import lexical_search
from vellumflow.llm.registry import QUERIES

LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items, k=10):
    bags = [(d, Counter(terms(t))) for d, t in docs if terms(t)]
    n_docs, n_terms = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for d, bag in bags:
            n = sum(bag.values())
            m = 100 - 75 + (75 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * bag[t]) // (1000 * bag[t] + 8 * m)) for t in terms(text) if t in bag)
            if score > 0:
                scored.append((-score, d is None, d if d is not None else 0, score))
        out += [(item, r, None if none else d, s) for r, (_, none, d, s) in enumerate(sorted(scored)[:k], 1)]
    return Counter(out)


ODD = ["", None, "?!", "é É é", "a a a A", "\x00a\x7fb", "ẞ ß", "tab\tnew\nline", "word " * 5000]


@pytest.mark.parametrize("text_ids", [False, True])
@pytest.mark.parametrize("entries", [40, 2_000_000])
def test_search_against_all_scores(spark, text_ids, entries):
    rng = random.Random(5)
    word = lambda: f"w{min(rng.randrange(1, 60), rng.randrange(1, 60))}"
    texts = [" ".join(word() for _ in range(rng.randrange(1, 40))) for _ in range(120)] + ODD
    texts += texts[:15] * 2
    docs = [(f"d{i:04}" if text_ids else i, t) for i, t in enumerate(texts)] + [(None, texts[0]), ("d0003" if text_ids else 3, texts[5])]
    items = [(i, " ".join(word() for _ in range(rng.randrange(1, 12)))) for i in range(12)] + [(20, "w1 w1 W1 w2"), (21, ""), (22, None), (23, "never seen"), (24, "é a WORD"), (20, "w3"), (None, "w4 w5")]
    kind = "string" if text_ids else "long"
    frame = spark.createDataFrame([(d, t, -1, "x") for d, t in docs], f"doc_id {kind}, text string, score int, rank string").repartition(3)
    asked = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")
    for block_bytes in (8_000_000, 150):
        got = lexical_search.search(frame, asked, shard_entries=entries, block_bytes=block_bytes)
        assert got.columns == ["item_id", "rank", "doc_id", "score"] and got.schema["doc_id"].dataType.simpleString() == ("string" if text_ids else "bigint")
        assert Counter(map(tuple, got.collect())) == brute(docs, items)


def test_search_of_nothing(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id int, text string")
    assert lexical_search.search(docs.limit(0), items).collect() == [] and lexical_search.search(docs, items.limit(0)).collect() == []
    assert lexical_search.search(docs, items.selectExpr("item_id", "'.' as text")).collect() == []
    assert lexical_search.search(docs, items).collect() == [(1, 1, 1, lexical_search.search(docs, items).first()["score"])]


def test_reading_stops_early_and_only_strictly_below():
    rng = np.random.default_rng(3)
    counts = rng.integers(1, 6, 4000)
    term = np.concatenate([rng.choice(50, c, replace=False) for c in counts]).astype(np.int32)
    n = rng.integers(5, 500, 4000)
    shard = lexical_search.Shard(n, counts, term, np.ones(len(term), np.int32), (4000, int(n.sum()), 75), 50)
    weight = np.zeros(50, np.int64)
    weight[[3, 7]] = [5000, 4000]
    rank = np.arange(4000)
    docs, scores, looked = shard.best(np.array([3, 7]), weight[[3, 7]], weight, rank, 10)
    all_docs = np.arange(4000)
    full = shard.lookup(all_docs, weight)
    top = np.lexsort((rank, -full))[:10]
    assert docs.tolist() == top.tolist() and scores.tolist() == full[top].tolist()
    holders = len(np.unique(shard.doc[np.concatenate([np.arange(shard.start[t], shard.start[t + 1]) for t in (3, 7)])]))
    assert looked < holders
    floor = shard.best(np.array([3, 7]), weight[[3, 7]], weight, rank, 10, floor=int(scores[-1]))
    assert floor[0].tolist() == top.tolist() and not shard.seen.any()
    # Equal impacts everywhere: no threshold is strictly below, so the smallest ids win.
    same = lexical_search.Shard(np.full(300, 10), np.ones(300, int), np.zeros(300, np.int32), np.ones(300, np.int32), (300, 3000, 75), 1)
    assert same.best(np.array([0]), np.array([7]), np.array([7]), np.arange(300)[::-1], 3)[0].tolist() == [299, 298, 297]


def test_length_measures_beyond_64_bits():
    n = np.array([10**9, 3])
    assert lexical_search.length_measure(n, 10**9, 10**18, 75).tolist() == [25 + 75 * x * 10**9 // 10**18 for x in (10**9, 3)]


@needs_data
def test_query_against_all_scores(spark):
    import pyarrow.parquet as pq

    docs, items = (list(zip(*pq.read_table(f"{DIR}/{t}.parquet").select(c).to_pydict().values(), strict=True)) for t, c in (("documents", ["doc_id", "text"]), ("benchmark", ["item_id", "text"])))
    assert Counter(map(tuple, QUERIES["op11_lexical_search"](spark, DIR).collect())) == brute(docs, items)


def test_terms_of_items():
    items = lexical_search.Items(pa.array(["b a b", None, "a"]))
    assert items.first.tolist() == [0, 2, 2, 3] and sorted(items.times[:2].tolist()) == [1, 2]
