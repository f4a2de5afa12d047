"""The whole job where less was done before: rows, windows, links, labels and languages that were left out."""

import math
import random

import pyarrow as pa
import pytest
from test_entry import DIR, needs_data
from test_methods import corpus, edited

from vellumflow.llm import decontaminate, html_text, language_id, license_scan, quality, sentencepieces, url_filter


def test_decontamination_of_reordered_passages(spark):
    rng = random.Random(11)
    items = corpus(rng, 4, 59) + corpus(rng, 2, 41) + [["x", "y"] * 20]
    docs = corpus(rng, 24, 100) + [items[0][:50], items[6] * 2]
    for k in range(24):
        piece = edited(rng, items[k % 6], rng.randrange(2))
        cut = rng.randrange(15, 30)
        piece = piece[cut:] + piece[:cut] if k % 4 else piece
        docs[k][20 : 20 + len(piece)] = piece
    grams5 = lambda ws: [tuple(ws[i : i + 5]) for i in range(len(ws) - 4)]
    want, swapped = {}, 0
    for d, doc in enumerate(docs):
        for i, item in enumerate(items):
            a, b = grams5(doc), grams5(item)
            for s in range(max(len(a) - len(b), 0) + 1):
                win = a[s : s + len(b)]
                both = sum(min(win.count(x), b.count(x)) for x in set(b))
                union = len(win) + len(b) - both
                if 100 * both >= 80 * union and both / union > want.get((d, i), (0, 0))[0]:
                    want[d, i] = (both / union, s)
            swapped += (d, i) in want and d < 24 and d % 4 > 0
    to_df = lambda rows, key: spark.createDataFrame([(i, " ".join(r)) for i, r in enumerate(rows)], f"{key} long, text string")
    for most in (500_000, 0):
        got = decontaminate.contaminated(to_df(docs, "doc_id"), to_df(items, "item_id"), broadcast_shingles=most).collect()
        assert {(r["doc_id"], r["item_id"]): (r["similarity"], r["start_word"]) for r in got} == want
    assert swapped > 5


def test_links_in_mixed_case(spark):
    pages = [("http://a/1", '<LINK Rel="Canonical" HREF="http://b/1">'), ("http://a/2", '<meta http-equiv="Refresh" content="0; URL=http://b/2">'), ("http://a/3", '<meta HTTP-EQUIV=reFresh content="0;url=http://b/3">'), ("http://a/4", "<p>none</p>"), ("http://a/5", None)]
    got = url_filter.html_links(spark.createDataFrame(pages, "url string, html string"))
    assert sorted(map(tuple, got.collect())) == [(f"http://a/{i}", f"http://b/{i}") for i in (1, 2, 3)]


def scanned(spark, texts):
    rows = license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).orderBy("doc_id").collect()
    return [(r["labels"], r["score"]) for r in rows]


def test_no_gate_but_the_keywords(spark):
    got = scanned(spark, ["Released under the MIT terms.", "It is available under MIT", "commit to a limit", "", None])
    assert got == [(["mit"], 0.85), (["mit"], 0.85), ([], 0.0), ([], 0.0), ([], 0.0)]


def test_each_language_keeps_its_words(spark):
    rng = random.Random(12)
    word = lambda lang: "".join(rng.choice(lang) for _ in range(5))
    rows = [(i, " ".join([word("abcdefg")] * 5), "aa") for i in range(60)] + [(100 + i, " ".join(word("qrstuvw") for _ in range(4)), "zz") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, p = language_id.train(docs, words=20)
    assert langs == ["aa", "zz"] and p.shape[1] == 2
    got = language_id.predict(spark.createDataFrame([(1, "qrst wvuts rrqst")], "doc_id int, text string"), (langs, p)).first()
    assert got["lang_pred"] == "zz"
    many = spark.createDataFrame([(i, f"w{chr(97 + i % 26)}", f"l{i:03}") for i in range(510)], "doc_id long, text string, lang string")
    assert len(language_id.train(many)[0]) == 510


def test_link_ends_that_are_no_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x"), (2, "http://b.org/x"), (3, "http://c.net/x"), (4, "http://d.org/x"), (5, "http://example.com/de")], "page_id int, url string")
    links = [("http://a.org/x", "http://gone.net/y"), ("http://b.org/x", "http://example.com/de/z"), ("http://out.org/x", "http://c.net/x"), ("http://d.org/x", "http://gone.net/q"), ("http://d.org/x", "http://example.net/en/q"), ("http://example.com/de", "http://www.example.com/de/")]
    got = url_filter.url_verdicts(pages, spark.createDataFrame(links, "source string, target string"))
    assert {r["page_id"]: r["verdict"] for r in got.collect()} == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "block"}
    one = url_filter.url_verdicts(pages, spark.createDataFrame(links[-1:], "source string, target string"))
    assert {r["page_id"]: r["verdict"] for r in one.collect()} == {1: "allow", 2: "allow", 3: "block", 4: "allow", 5: "block"}


def test_statements_over_lines(spark):
    bsd = "Redistribution and use in source and binary forms, with or without\n{}modification, are  permitted provided that"
    texts = [bsd.format(""), bsd.format(" * "), bsd.format("# ").replace("\n", "\r\n"), "the GNU Lesser General Public\n// License, version\n// 2.1 of it", "under the terms of the GNU General  Public\tLicense v3", "Creative Commons\nAttribution-\nShareAlike 4.0", "licensed under the GPL\n\n2. Next item", "the Apache License,\n2.0", "a modified / BSD thing"]
    got = [labels for labels, _ in scanned(spark, texts)]
    assert got[:3] == [["bsd"]] * 3 and "lgpl-2.1" in got[3] and "gpl-3.0" in got[4] and "cc-by-4.0" not in got[5]
    assert "gpl-2.0" not in got[6] and "gpl" in got[6] and "apache-2.0" in got[7] and "bsd-3-clause" not in got[8]


def test_items_that_share_an_id(spark):
    rng = random.Random(13)
    a, b, c = corpus(rng, 3, 30)
    items = spark.createDataFrame([(1, " ".join(a)), (1, " ".join(b)), (None, " ".join(c)), (2, " ".join(c)), (1, " ".join(a))], "item_id long, text string")
    docs = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate([["p", *a, "q"], ["p", *b, "q"], c])], "doc_id long, text string")
    got = decontaminate.contaminated(docs, items).collect()
    assert sorted((r["doc_id"], r["item_id"] or 0, r["similarity"]) for r in got) == [(0, 1, 1.0), (1, 1, 1.0), (2, 0, 1.0), (2, 2, 1.0)]


def test_letters_and_long_runs(spark):
    rng = random.Random(16)
    word = lambda letters, n=5: "".join(rng.choice(letters) for _ in range(n))
    rows = [(i, " ".join(word(x) for _ in range(30)), lang) for i in range(40) for lang, x in (("aa", "abcde"), ("zz", "vwxyz"))]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    texts = ["\u00bd \u00b2 \u2167 \u2460 42", word("vwxyz", 100), word("abcde", 20_000), word("\u4e00\u4e8c", 500), "\u0915\u094d\u0937", "\u0301"]
    got = language_id.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), model).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in got[:3]] == ["und", "zz", "aa"] and got[5]["lang_pred"] == "und"
    assert language_id.words_of(texts[4]) == [texts[4]] and len(language_id.words_of(texts[2])) == 1
    assert language_id.predict(spark.createDataFrame([(1, "\u4e00")], "doc_id int, text string"), (["bb", "aa"], model[1] * 0 + 1e-4)).first()["lang_pred"] == "bb"
    lattice = language_id.Lattice(language_id.vocabulary().trie, [b" " + texts[1].encode()], len(model[1]) - 1)
    big = model[1] ** 0.01
    assert abs(lattice.log_total(big)[0] - language_id.np.log(lattice.total(lattice.forward(big))[0])).max() < 1e-6


MALFORMED = [
    ("<html><head><meta charset=x><title>T</title><p>one<p>two", "one two"),
    ("<head><title>T</title>plain text that is long enough to be content of a page, surely.", "plain text that is long enough to be content of a page, surely."),
    ("<div data-x=it's><p>a first sentence of the text.</p></div><p>it's a second sentence.</p>", "a first sentence of the text. it's a second sentence."),
    ('<article class="post share-enabled has-sidebar"><p>kept text.</p></article>', "kept text."),
    ('<main><p>Main words come first here.</p><div class="legal"><p>A part about legal history, which is long and ends like a sentence.</p></div></main>', "Main words come first here. A part about legal history, which is long and ends like a sentence."),
    ('<main><p>Words.</p><div class="ad">Buy now</div><nav><a href=x>Next</a></nav><p>More words.</p></main>', "Words. More words."),
    ('<p title="a > b">greater than in a quote.</p><p title = \'x > y\'>and in another.</p>', "greater than in a quote. and in another."),
]


def test_malformed_pages():
    for page, text in MALFORMED:
        assert html_text.main_text(page) == text, page


@needs_data
def test_learned_costs_and_what_the_cut_changes(spark):
    """With all telling tags hidden, the cut must mend more labels than it spoils."""
    pages = spark.read.parquet(f"{DIR}/pages.parquet")
    weights = html_text.train(pages, sample=100)
    assert weights != list(html_text.PRIOR) and html_text.train(pages.limit(0)) == list(html_text.PRIOR)
    alone, cut, n = 0, 0, 0
    for r in pages.select("html").collect():
        found = html_text.blocks(r["html"])
        bare = [b._replace(features=(0.0,) * html_text._N_TAGS + b.features[html_text._N_TAGS :]) for b in found]
        gain = html_text.costs(bare, weights)
        sides = html_text.min_cut(gain, html_text.edges_of(bare, 0.4, 0.8))
        n += len(found)
        alone += sum((g > 0) == bool(b.told) for g, b in zip(gain, found, strict=True))
        cut += sum(bool(s) == bool(b.told) for s, b in zip(sides, found, strict=True))
    print("labels", n, "right by costs alone", alone, "by the cut", cut)
    assert n * 0.9 < alone <= cut


def test_links_relative_and_escaped(spark):
    base = "http://h.org/a/b.html?q=1"
    tag = '<link rel="alternate canonical" href="{}">'
    targets = {"/x": "http://h.org/x", "c.html": "http://h.org/a/c.html", "../d/./e": "http://h.org/d/e", "//o.net/z": "http://o.net/z", "?p=2&amp;r=3": "http://h.org/a/b.html?p=2&r=3", "mailto:a@b.c": None, "http:&#47;&#x2F;k.org/&amp;lt;": "http://k.org/&lt;", "../../..": "http://h.org/"}
    for target, want in targets.items():
        got = [r["target"] for r in url_filter.html_links(spark.createDataFrame([(base, tag.format(target))], "url string, html string")).collect()]
        assert got == ([want] if want else []), target
    several = tag.format("/one") + '<meta http-equiv=refresh content="3; url=/two?a=1&amp;b=2">' + tag.format("/three")
    got = {r["target"] for r in url_filter.html_links(spark.createDataFrame([(base, several)], "url string, html string")).collect()}
    assert got == {"http://h.org/one", "http://h.org/two?a=1&b=2", "http://h.org/three"}


def test_verdicts_over_links_against_brute_force(spark):
    """Refreshes, canonical links, chains and explicit allows, from html to verdict."""
    rng = random.Random(18)
    hosts = ["a.org", "b.org", "c.net", "example.com", "example.net", "www.d.org"]
    urls = sorted({f"http://{rng.choice(hosts)}/{rng.choice(['de', 'en', 'fr', 'x'])}/{rng.randrange(12)}" for _ in range(150)})
    ends: list[tuple[str, str]] = []
    pages = []
    for i, u in enumerate(urls):
        html = "<p>text</p>"
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            to = rng.choice(urls) if rng.random() < 0.8 else f"http://out.net/{i}"
            html += rng.choice(['<link rel="canonical" href="{}">', '<META HTTP-EQUIV="Refresh" CONTENT="0; URL={}">']).format(to)
            ends.append((u, to))
        pages.append((i, u, html))
    form = lambda u: u.replace("http://www.", "http://").rstrip("/")

    def explicit(u):
        host, path = u[7:].split("/", 1)
        fits = [(len(r), act) for r, act in url_filter.RULES for h, _, rest in [r.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith(rest)]
        return max(fits)[1] if fits else None

    label = {form(u): form(u) for e in [*ends, *[(u, u) for u in urls]] for u in e}
    for a, b in ends * 40:
        label[form(a)] = label[form(b)] = min(label[form(a)], label[form(b)])
    said: dict = {}
    for u in {u for e in ends for u in e} | set(urls):
        said.setdefault(label[form(u)], set()).add(explicit(u))
    want = {i: explicit(u) or ("block" if "block" in said[label[form(u)]] and "allow" not in said[label[form(u)]] else "allow") for i, u, _ in pages}
    df = spark.createDataFrame(pages, "page_id int, url string, html string")
    got = url_filter.url_verdicts(df.drop("html"), url_filter.html_links(df))
    assert {r["page_id"]: r["verdict"] for r in got.collect()} == want
    assert sum(want[i] == "block" and explicit(u) is None for i, u, _ in pages) > 3


def test_quality_of_whole_texts_and_clashing_columns(spark):
    """The telling word is the last of 30,000; sums, probabilities and thresholds against a plain count."""
    rng = random.Random(19)
    filler = [f"w{i}" for i in range(30_000)]
    rows = [(i, " ".join(rng.sample(filler, 60) if i else filler) + (" awful" if i % 2 == 0 else " fine"), i % 2) for i in range(80)]
    docs = spark.createDataFrame([(*r, 7, 8) for r in rows], "doc_id long, text string, grade int, tails int, expected_grade int")
    model = quality.train(docs, docs, least=3, strong=2)
    got = {r["doc_id"]: r for r in quality.score(docs, model).collect()}
    assert all((got[i]["tails"][0] >= 0.5) == (g == 1) for i, _, g in rows)
    known, weights, own, cuts, mean, spread = model
    for i, text, _ in rows[:5]:
        row, bucket, dense = quality.features(pa.array([text]))
        s = sum(weights[list(known).index(b)] for b in bucket if b in known) + float((((dense[0] - mean) / spread).clip(-6, 6) * own).sum())
        assert got[i]["tails"] == pytest.approx([1 / (1 + math.exp(c - s)) for c in cuts]) and got[i]["expected_grade"] == pytest.approx(sum(got[i]["tails"]))


def segmentations(surface, score, word: bytes, unknown: float):
    """Best path by a plain Viterbi over all pieces that fit, and the forward sums by language; bytes of unknown characters are one step."""
    pieces = {s: i for i, s in enumerate(surface) if s and score[i] > -math.inf}
    best: list = [(0.0, [])] + [None] * len(word)
    opens = [i for i in range(len(word) + 1) if i == len(word) or word[i] & 0xC0 != 0x80]
    for a, end in zip(opens, opens[1:]):
        if best[a] is None:
            continue
        steps = [(z, pieces[word[a:z]]) for z in opens if a < z <= a + 64 and word[a:z] in pieces]
        if word[a:end] not in pieces:
            steps.append((end, None))
        for z, piece in steps:
            value = best[a][0] + (unknown if piece is None else score[piece])
            # Of equal paths the one with the longer last piece.
            if best[z] is None or value > best[z][0] + 1e-9:
                best[z] = (value, [*best[a][1], *([("byte", b) for b in word[a:end]] if piece is None else [piece])])
    return best[-1]


def test_codes_and_languages_against_plain_sums(spark):
    v = sentencepieces.vocabulary()
    rng = random.Random(21)
    words = ["the", "Étude", "größer", "x\u4e00y", "\U0001f600", "a▁b", "tokenization", "  two", "line\nfeed", "unbelievably", "12,345.67"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 9))) for _ in range(60)] * 2
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    byte = {int(i): b for b, i in enumerate(v.byte_ids)}
    unknown = min(s for s in v.score if s > -math.inf) - 10
    for r in sentencepieces.encode(df).collect():
        value, want = segmentations(v.surface, v.score, (" " + r["text"]).encode(), unknown)
        got = [("byte", byte[i]) if i in byte else i for i in r["ids"]]
        # Equal values, since several paths may be best.
        cost = lambda ids: sum(v.score[i] for i in ids if not isinstance(i, tuple))
        assert [x for x in got if isinstance(x, tuple)] == [x for x in want if isinstance(x, tuple)] and abs(cost(got) - cost(want)) < 1e-6, r["text"]

    rows = [(i, " ".join(rng.choice(ws) for _ in range(20)), lang) for i in range(30) for lang, ws in (("aa", ["the", "token", "able"]), ("bb", ["größer", "étude", "den"]))]
    langs, p = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    pieces = {s: i for i, s in enumerate(v.surface) if s and v.score[i] > -math.inf}

    def forward(word: bytes, k: int) -> float:
        total = [1.0] + [0.0] * len(word)
        opens = [i for i in range(len(word) + 1) if i == len(word) or word[i] & 0xC0 != 0x80]
        for a, end in zip(opens, opens[1:]):
            for z in opens:
                if a < z <= a + 64 and word[a:z] in pieces:
                    total[z] += total[a] * p[pieces[word[a:z]], k]
            if word[a:end] not in pieces:
                total[end] += total[a] * p[-1, k]
        return math.log(total[-1])

    for r in language_id.predict(df, (langs, p)).collect():
        sums = [sum(forward(b" " + w.encode(), k) for w in language_id.words_of(r["text"])) for k in range(len(langs))]
        top = max(sums)
        if not language_id.words_of(r["text"]):
            assert (r["lang_pred"], r["lang_score"]) == ("und", 0.0)
        else:
            assert r["lang_pred"] == langs[sums.index(top)] and r["lang_score"] == pytest.approx(1 / sum(math.exp(s - top) for s in sums))
