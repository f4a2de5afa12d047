"""run() against a brute-force version on a small corpus, and each stage's effect."""

import random

import corpus_pipeline as P


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_run(spark, tmp_path):
    rng = random.Random(10)
    words = [f"{a}{b}" for a in ("the", "of", "ing", "ation", "er", "and") for b in ("ly", "ed", "ion", "est", "ness", "or", "al", "ous")]
    text = lambda n: " ".join(rng.choice(words) + rng.choice("abcdefgh") for _ in range(n))
    item, passage = text(40), text(60)
    docs = {i: text(120) for i in range(20)}
    docs[20] = docs[3]
    docs[21] = docs[4].rsplit(" ", 1)[0] + " changed"
    docs[22] = text(50) + " " + passage + " " + text(50)
    docs[23] = text(50) + " " + passage + " " + text(40)
    docs[24] = text(30) + " " + item + " " + text(30)
    docs[25], docs[26] = "123 !!", None
    rows = [(i, t, "en" if i % 2 else None, "s", len(t or "")) for i, t in docs.items()]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    kept = {i: t for i, t in docs.items() if t and any(c.isalpha() for c in t)}
    for i in sorted(kept):
        if any(j < i and len(shingles(kept[i]) & shingles(kept[j])) >= 0.8 * len(shingles(kept[i]) | shingles(kept[j])) for j in kept):
            del kept[i]
    seen = set()
    for i in sorted(kept):
        w, gone = kept[i].split(), set()
        for s in range(len(w) - 19):
            block = tuple(w[s : s + 20])
            if block in seen:
                gone |= set(range(s, s + 20))
            seen.add(block)
        kept[i] = " ".join(x for k, x in enumerate(w) if k not in gone)
    kept = {i: t for i, t in kept.items() if item not in t}

    out = P.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"]: r["text"] for r in out} == kept
    assert set(docs) - set(kept) == {20, 21, 24, 25, 26} and len(kept[23]) < len(docs[23]) - 300
    assert {r["lang"] for r in out} == {"en"} and all(r["n_pieces"] == len(r["ids"]) > 0 for r in out)


def test_stages_return_the_columns_of_documents(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = empty
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == empty.columns and docs.count() == 0
    assert P.run(spark, str(tmp_path)).count() == 0


def test_repeated_rows(spark):
    text = " ".join(f"word{i}" for i in range(30))
    own = " ".join(f"other{i}" for i in range(30))
    rows = [(1, text), (1, text), (2, text), (None, text), (5, text + " more"), (5, own), (5, own), (4, "single words " + own)]
    df = spark.createDataFrame([(i, t, "en", "s", 9) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r["doc_id"] or 0, r["text"]) for r in P.near_dedup(spark, df, "").collect())
    assert got == [(0, text), (1, text), (4, "single words " + own)]
    alone = df.filter("doc_id != 4")
    assert sorted((r["doc_id"] or 0, r["text"]) for r in P.near_dedup(spark, alone, "").collect()) == [(1, text), (5, own)]


def test_odd_rows_and_columns_through_all_stages(spark, tmp_path):
    """Null ids and texts, a very long text and columns with names that the operators use."""
    rng = random.Random(15)
    words = [a + b for a in ("the", "of", "ing", "er") for b in ("ly", "ed", "ion", "est", "al")]
    long = " ".join(rng.choice(words) + rng.choice("abcdefgh") for _ in range(60_000))
    texts = [(1, long), (2, None), (3, ""), (None, "the words of a row without an id"), (4, "plain words of the fourth row")]
    names = ["lang_pred", "lang_score", "kept_text", "ids", "decoded", "row_hash", "others", "component_id", "_row", "h"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in names)
    df = spark.createDataFrame([(i, t, "en", "s", 0, *range(len(names))) for i, t in texts], schema)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "no such words")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = df
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == df.columns
    assert [tuple(r[c] for c in names) for r in docs.collect()] == [tuple(range(len(names)))] * 3
    got = {r["doc_id"]: r["text"] for r in P.run(spark, str(tmp_path)).collect()}
    assert set(got) == {1, 4, None} and got[4] == texts[4][1]
