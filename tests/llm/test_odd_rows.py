"""Every training-data operator on null, empty, very long, repeated and no rows, and beside clashing columns."""

import pytest
from pyspark.sql import functions as F

from vellumflow.llm import decontaminate, html_text, language_id, license_scan, minhash_dedup, quality, sentencepieces, substring_dedup, topk_search, url_filter

LONG = "one two three four five six seven " * 20_000
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row int, kept_text int, ids int, h int"


@pytest.fixture(scope="module")
def docs(spark):
    texts = [(1, "the quick brown fox jumps over the lazy dog"), (2, None), (3, ""), (4, LONG), (4, LONG), (5, " \n "), (6, "123 456 !!"), (None, "a row without id"), (7, "the quick brown fox jumps over the lazy dog")]
    return spark.createDataFrame([(i, t, "en", "s", 0, 0, 0, 0, 0) for i, t in texts], SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_language(docs, nothing):
    model = language_id.train(docs)
    got = {(r["doc_id"], r["lang_pred"]) for r in language_id.predict(docs, model).collect()}
    assert got == {(1, "en"), (2, "und"), (3, "und"), (4, "en"), (5, "und"), (6, "und"), (None, "en"), (7, "en")}
    assert language_id.train(nothing) is None and language_id.predict(nothing, None).count() == 0
    assert {(r["lang_pred"], r["lang_score"]) for r in language_id.predict(docs, None).collect()} == {("und", 0.0)}


def test_topk(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 0.5], 0), (2, [0.5, 0.5], 0), (3, [nan, 1.0], 0), (4, None, 0), (5, [None, 1.0], 0), (6, [inf, 0.0], 0), (None, [1.0, 1.0], 0), (7, [-0.001, 0.25], 0), (8, [], 0), (2, [0.25, 0.0], 0)]
    v = topk_search.integers(spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int"))
    assert sorted(r["vec_id"] for r in v.collect()) == [1, 2, 2, 7, 8]
    assert {tuple(r["ints"]) for r in v.filter("vec_id = 7").collect()} == {(-1, 64)}
    got = [tuple(r) for r in topk_search.top_k(v, v.filter("vec_id in (1, 2)"), k=2).orderBy("query_id", "rank").collect()]
    # Id 2 has two rows, which are asked together.
    assert got == [(1, 1, 2, 2 * 128 * 128), (1, 2, 2, 64 * 128), (2, 1, 1, 2 * 128 * 128), (2, 2, 1, 64 * 128)]
    large = topk_search.integers(spark.createDataFrame([(1, [3e9]), (2, [3e9])], "vec_id long, embedding array<double>"))
    with pytest.raises(ArithmeticError):
        topk_search.top_k(large, large)
    none = v.filter("vec_id = 99")
    assert topk_search.top_k(none, none).count() == 0 and topk_search.top_k(v, none).count() == 0


def test_decontaminate(spark, docs, nothing):
    items = spark.createDataFrame([(1, "The quick brown fox jumps over the lazy dog!", 0), (1, "The quick brown fox jumps over the lazy dog!", 0), (2, None, 0), (3, "", 0), (4, "too short", 0)], "item_id long, text string, doc_id int")
    got = {tuple(r) for r in decontaminate.contaminated(docs, items).collect()}
    assert got == {(1, 1, 0, 9, 1.0), (7, 1, 0, 9, 1.0)}
    for small in (500_000, 0):
        assert decontaminate.contaminated(docs, items, broadcast_shingles=small).count() == 2
    assert decontaminate.contaminated(nothing, items).count() == 0 and decontaminate.contaminated(docs, items.limit(0)).count() == 0


def test_license(docs, nothing, spark):
    r = {x["doc_id"]: x for x in license_scan.scan(docs).collect()}
    assert (r[2]["n_words"], r[2]["score"], r[2]["labels"]) == (0, 0.0, []) and r[4]["n_words"] == 140_000
    assert license_scan.scan(nothing).count() == 0
    many = spark.createDataFrame([(1, "MIT License.\n" * 300, "x")], "doc_id long, text string, labels string")
    one = license_scan.scan(many).first()
    assert (one["n_base"], one["first_word"], one["last_word"], one["labels"]) == (300, 0, 598, ["mit"])


def test_html(spark):
    pages = spark.createDataFrame([(1, None, "t"), (2, "", "t"), (3, "<p>" + LONG, "t"), (4, "<div><nav>menu", "t")], "page_id long, html string, main_text string")
    got = {r["page_id"]: r["main_text"] for r in html_text.extract(pages).collect()}
    assert got == {1: "", 2: "", 3: LONG.strip(), 4: ""} and html_text.extract(pages.limit(0)).count() == 0


def test_substring(docs, nothing):
    got = sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in substring_dedup.substring_dedup(docs).collect())
    assert got == [(0, 4, 0), (1, 9, 0), (2, 0, 0), (3, 0, 0), (4, 140_000, 139_993 - 0), (4, 140_000, 139_993 - 0), (5, 0, 0), (6, 3, 0), (7, 9, 0)]
    assert substring_dedup.substring_dedup(nothing).count() == 0


def test_minhash(docs, nothing):
    got = sorted(((r["doc_id"] or 0), r["n_shingles"], r["component_id"]) for r in minhash_dedup.minhash_groups(docs).collect())
    assert got == [(0, 3, None), (1, 8, 1), (2, 0, 2), (3, 0, 3), (4, 7, 4), (4, 7, 4), (5, 0, 5), (6, 2, 6), (7, 8, 1)]
    assert minhash_dedup.minhash_groups(nothing).count() == 0


def test_urls(spark):
    pages = spark.createDataFrame([(1, None, "x"), (2, "no scheme", "x"), (3, "http://a.net", "x"), (4, "HTTP://A.NET/", "x"), (4, "HTTP://A.NET/", "x"), (5, "ftp://net/" + "y" * 100_000, "x")], "page_id long, url string, verdict string")
    links = spark.createDataFrame([(None, "http://a.net/")], "a string, b string")
    got = sorted((r["page_id"], r["host"][:6], r["rule"], r["verdict"]) for r in url_filter.url_verdicts(pages, links).select("page_id", "host", F.coalesce("rule", F.lit("")).alias("rule"), "verdict").collect())
    # Page 3 has no path, so that no rule fits it; it is page 4's url but for the slash, whose block reaches it.
    assert got == [(1, "", "", "allow"), (2, "", "", "allow"), (3, "a.net", "", "block"), (4, "a.net", "net/", "block"), (4, "a.net", "net/", "block"), (5, "net", "net/", "block")]
    assert url_filter.url_verdicts(pages.limit(0), links).count() == 0


def test_pieces(docs, nothing):
    got = sentencepieces.decode(sentencepieces.encode(docs)).collect()
    assert all(r["decoded"] == r["text"] for r in got) and {r["ids"] is None for r in got if r["text"] is None} == {True}
    assert sentencepieces.encode(nothing, also_decoded=True).count() == 0


def test_quality(spark, docs, nothing):
    ratings = spark.createDataFrame([(1, 2), (1, 2), (4, 0), (7, 2), (None, 1)], "doc_id long, grade int")
    model = quality.train(docs, ratings, least=1, strong=0)
    got = {r["doc_id"]: r["expected_grade"] for r in quality.score(docs, model).collect()}
    assert got[2] == got[3] == got[5] == 0.0 and got[1] > got[4]
    assert quality.train(docs, ratings.limit(0)) is None and quality.score(nothing, model).count() == 0
    assert {r["expected_grade"] for r in quality.score(docs, None).collect()} == {None}


def test_text_ids(spark):
    text = "one two three four five six " * 5
    df = spark.createDataFrame([("7", text), ("x", text), ("9", text)], "doc_id string, text string")
    assert sorted((r["doc_id"] or 0, r["n_removed"] > 0) for r in substring_dedup.substring_dedup(df, length=8).collect()) == [(0, False), (7, True), (9, True)]
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in minhash_dedup.minhash_groups(df).collect()) == [(0, 0), (7, 7), (9, 7)]
