"""Ids that are texts keep their values and dedupe as integers of the same order do; columns named as the pipeline's own stay."""

import random

import corpus_pipeline as P

from vellumflow.llm import decontaminate, substring_dedup


def texts(rng, n=40):
    passage = [" ".join(f"p{k}w{i}" for i in range(45)) for k in range(3)]
    out = [" ".join([*(f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(60))), *rng.sample(passage, rng.randrange(3)), *(f"v{rng.randrange(10**6)}" for _ in range(rng.randrange(60)))]) for _ in range(n)]
    return [*out, out[3], out[5], "", None]


def test_substring_dedup_of_text_ids(spark):
    rows = list(enumerate(texts(random.Random(4))))
    name = lambda i: None if i is None else f"url://{i:04}"
    plain = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    named = substring_dedup.substring_dedup(spark.createDataFrame([(name(i), t) for i, t in rows], "doc_id string, text string"))
    assert named.schema["doc_id"].dataType.simpleString() == "string" and "source:string" in named.schema["spans"].dataType.simpleString()
    of = lambda r, f: (f(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_text"], [(s["start"], s["end"], f(s["source"]), s["source_start"]) for s in r["spans"]])
    assert sorted(of(r, lambda x: x) for r in named.collect()) == sorted(of(r, name) for r in plain)
    assert sum(r["n_removed"] > 0 for r in plain) > 10
    twice = substring_dedup.substring_dedup(spark.createDataFrame([("a1", rows[0][1] + " x" * 30), ("b2", rows[0][1] + " x" * 30)], "doc_id string, text string")).collect()
    assert {r["doc_id"]: (r["n_words"] - r["n_removed"]) > 0 for r in twice} == {"a1": True, "b2": False}


def test_decontamination_of_text_ids(spark):
    item = " ".join(f"i{k}" for k in range(20))
    docs = spark.createDataFrame([("u1", f"before it {item} after"), ("u2", "nothing here of the kind at all")], "doc_id string, text string")
    got = decontaminate.contaminated(docs, spark.createDataFrame([("q", item)], "item_id string, text string")).collect()
    assert [(r["doc_id"], r["item_id"], r["start_word"]) for r in got] == [("u1", "q", 2)]


def test_pipeline_of_text_ids(spark, tmp_path):
    rng = random.Random(6)
    words = [a + b for a in ("the", "of", "ing", "er") for b in ("ly", "ed", "ion", "est", "al")]
    text = lambda n: " ".join(rng.choice(words) + rng.choice("abcdefgh") for _ in range(n))
    docs = {f"id-{c}": text(100) for c in "bcdefgh"}
    docs |= {"id-a": docs["id-c"], "id-z": docs["id-d"] + " end", "id-x": "12 34"}
    own = ["_lang", "_score", "_row_hash", "_source"]
    df = spark.createDataFrame([(k, t, "en", "s", 0, 1, 2, 3, 4) for k, t in docs.items()], "doc_id string, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in own))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "no such words")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = df
    for _, stage in P.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == df.columns
    rows = {r["doc_id"]: r for r in kept.collect()}
    assert set(rows) == {"id-a", "id-b", "id-d", "id-e", "id-f", "id-g", "id-h"} and all([r[c] for c in own] == [1, 2, 3, 4] for r in rows.values())
    assert {r["doc_id"]: r["text"] for r in P.run(spark, str(tmp_path)).collect()} == {k: docs[k] for k in rows}
