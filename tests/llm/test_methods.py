"""Training-data operators against brute force, round trips and held-out rows."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_entry import DIR, needs_data, same

from vellumflow.llm import decontaminate, html_text, language_id, license_scan, minhash_dedup, quality, sentencepieces, substring_dedup, topk_search
from vellumflow.llm.components import connected_components, forest
from vellumflow.llm.lattice import DoubleArrayTrie, Lattice
from vellumflow.llm.registry import QUERIES, SQL
from vellumflow.llm.wordhash import Words, grams


@needs_data
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    same(QUERIES[name](spark, DIR), SQL[name])


def test_words_are_those_of_a_split():
    texts = ["a  bb\tccccccccc\n", "", None, "été 　x", "tail"]
    w = Words(pa.array(texts))
    want = [x.encode() for t in texts for x in (t or "").replace("　", "、").split()]
    assert [bytes(w.data[a:b]) for a, b in zip(w.start, w.end, strict=True)] == [x.replace("、".encode(), "　".encode()) for x in want]
    same_words = Words(pa.array(["x yy zzz x", "yy zzz"])).hashes()
    assert same_words[0] == same_words[3] and (grams(same_words, 2)[1] == grams(same_words, 2)[4])


PIECES = [b"a", b"b", b"ab", b"ba", b"aba", b" ", b" a", b"\xc3\xa9", b""]


def paths(word: bytes):
    """All segmentations of a word."""
    if not word:
        yield []
    for i, p in enumerate(PIECES):
        if p and word.startswith(p):
            for rest in paths(word[len(p) :]):
                yield [i, *rest]


@pytest.mark.parametrize("word", [b"ab", b"ababa", b" abba", b"aab\xc3\xa9", b"b"])
def test_lattice_against_all_segmentations(word):
    rng = np.random.default_rng(1)
    p = rng.random((len(PIECES) + 1, 2))
    trie = DoubleArrayTrie(PIECES)
    lattice = Lattice(trie, [b"a", word], len(PIECES))
    total = lattice.total(lattice.forward(p))[1]
    assert total == pytest.approx(sum(np.prod(p[x], axis=0) for x in paths(word)))
    best = max(paths(word), key=lambda x: np.log(p[x, 0]).sum())
    assert np.frombuffer(lattice.viterbi(np.log(p[:, 0]))[0][1], np.int32).tolist() == best
    uses = np.zeros_like(p)
    for x in paths(word):
        np.add.at(uses, x, np.prod(p[x], axis=0) / total)
    assert Lattice(trie, [word], len(PIECES)).expected(p, np.ones((1, 2))) == pytest.approx(uses)


def test_round_trip(spark):
    rng = random.Random(2)
    alphabet = "abc  ▁\n\té一\U0001f600<0x0A>\x00﷐z"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    assert sentencepieces.encode(df, also_decoded=True).filter(~F.col("text").eqNullSafe(F.col("decoded"))).count() == 0


@needs_data
def test_language_held_out(spark):
    out = QUERIES["op1_language_id"](spark, DIR).join(spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert out.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95


def test_quality_held_out(spark):
    rng = random.Random(3)
    common = [f"word{i}" for i in range(300)]
    rows = []
    for i in range(600):
        ws = [rng.choice(common) for _ in range(60)]
        grade = i % 3
        if grade == 0:
            ws[rng.randrange(60)] = "awful"
        if grade == 1:
            ws = [w.upper() + "!!" for w in ws]
        rows.append((i, " ".join(ws), grade))
    df = spark.createDataFrame(rows, "doc_id long, text string, grade int")
    model = quality.train(df.filter("doc_id < 450"), df.filter("doc_id < 450"))
    got = quality.score(df.filter("doc_id >= 450"), model).withColumn("g", F.round("expected_grade"))
    assert got.filter("g = grade").count() >= 140
    assert got.filter("tails[0] < tails[1]").count() == 0


def test_search_prunes_and_stays_exact():
    rng = np.random.default_rng(4)
    c, q = rng.integers(-50, 50, (3000, 8)), rng.integers(-50, 50, (40, 8))
    c[::7] = c[0]
    c = c[np.argsort(-(c**2).sum(1), kind="stable")]
    ids, q_ids = rng.permutation(3000), np.arange(40)
    _, axes = np.linalg.eigh(c.T @ c.astype(float))
    row, score, found = topk_search.search(q_ids, q, np.full(40, -np.inf), ids, c, axes[:, ::-1], 4, 5, 100)
    exact = q @ c.T
    for i in range(40):
        want = sorted((-exact[i, j], ids[j]) for j in range(3000) if ids[j] != i)[:5]
        assert [(-s, v) for s, v in zip(score[row == i], found[row == i], strict=True)] == want


@pytest.mark.parametrize("shape", ["flat", "steep", "same"])
def test_topk_of_many_blocks(spark, shape):
    rng = np.random.default_rng(17)
    x = rng.integers(-30, 30, (900, 6)) * (np.exp(rng.normal(0, 2, (900, 1))) if shape == "steep" else 1)
    x = np.floor(x).astype(float) if shape != "same" else np.full((900, 6), 3.0)
    v = topk_search.integers(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>"), factor=1)
    got = topk_search.top_k(v, v.filter("vec_id % 9 = 0"), block=32, seed_rows=40).collect()
    exact = x @ x.T
    for i in range(0, 900, 9):
        want = sorted((-exact[i, j], j) for j in range(900) if j != i)[:5]
        assert [(-r["score"], r["vec_id"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == i] == want


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(1000, 1000 + i) for i in range(1, 300)] + [(2000 + i, 2001 + i) for i in range(60)] + [(None, 1), (7, 7)]
    label = {}

    def root(x):
        while label.setdefault(x, x) != x:
            x = label[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((root(a), root(b)))
            label[b] = a
    want = {x: root(x) for x in label}
    got = connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert {r["node"]: r["component"] for r in got.collect()} == want and got.count() == len(want)
    u, v = forest(np.array([5, 3, 9]), np.array([3, 1, 8]))
    assert dict(zip(u.tolist(), v.tolist(), strict=True)) == {5: 1, 3: 1, 9: 8}


def corpus(rng, n, words=40):
    vocabulary = [f"w{i}" for i in range(2000)]
    return [[rng.choice(vocabulary) for _ in range(words)] for _ in range(n)]


def edited(rng, ws, times):
    ws = list(ws)
    for _ in range(times):
        ws[rng.randrange(len(ws))] = f"e{rng.randrange(10**6)}"
    return ws


@pytest.mark.parametrize("block_rows", [128, 8, 2])
def test_minhash_groups_against_all_pairs(spark, block_rows):
    rng = random.Random(6)
    base = corpus(rng, 25, 60)
    docs = base + [edited(rng, b, rng.randrange(5)) for b in base for _ in range(4)] + [edited(rng, base[0], rng.randrange(7)) for _ in range(60)]
    rng.shuffle(docs)
    sets = [set(zip(d, d[1:], strict=False)) for d in docs]
    label = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both) and label[i] != label[j]:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    df = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")
    got = minhash_dedup.minhash_groups(df, block_rows=block_rows).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == dict(enumerate(label))


def test_minhash_groups_of_repeated_ids(spark):
    rng = random.Random(14)
    a, b = corpus(rng, 2, 50)
    rows = [(1, a), (5, edited(rng, a, 1)), (5, b), (6, b), (5, b), (3, [*b, "more"]), (9, corpus(rng, 1)[0])]
    got = minhash_dedup.minhash_groups(spark.createDataFrame([(i, " ".join(x)) for i, x in rows], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["class_id"], r["component_id"]) for r in got) == [(1, 1, 1), (3, 3, 3), (5, 5, 1), (5, 5, 3), (5, 5, 3), (6, 5, 3), (9, 9, 9)]
    assert len({(r["group_id"], r["component_id"]) for r in got}) == 3


def test_substring_spans_against_brute_force(spark):
    rng = random.Random(7)
    docs = corpus(rng, 30, 50)
    for _ in range(20):
        a, b = rng.randrange(30), rng.randrange(30)
        n, at, to = rng.randrange(5, 45), rng.randrange(5), rng.randrange(30)
        docs[b][to : to + n] = docs[a][at : at + n]
    docs.append(["x"] * 60)
    docs += [list(docs[3]), docs[4][:20] + docs[5][5:30] + docs[6][10:40]]
    # Rows by id: two ids have several texts, of which some have one block at one place; one row is repeated.
    ids = [*range(31), 12, 30]
    docs[31] = docs[12][:10] + docs[31][10:]
    ids, docs = [*ids, 7], [*docs, list(docs[7])]
    first: dict = {}
    for d, ws in zip(ids, docs, strict=True):
        for i in range(len(ws) - 7):
            first[tuple(ws[i : i + 8])] = min(first.get(tuple(ws[i : i + 8]), (99, 0)), (d, i))
    want = []
    for d, ws in zip(ids, docs, strict=True):
        gone = set().union(*[range(i, i + 8) for i in range(len(ws) - 7) if first[tuple(ws[i : i + 8])] < (d, i)])
        want.append((d, " ".join(w for i, w in enumerate(ws) if i not in gone)))
    df = spark.createDataFrame([(i, " ".join(d), n) for n, (i, d) in enumerate(zip(ids, docs, strict=True))], "doc_id long, text string, n int")
    for rows in (df, df.filter("n <= 30")):
        got = substring_dedup.substring_dedup(rows, length=8, k=3, also=["n"]).collect()
        assert sorted((r["doc_id"], r["kept_text"]) for r in got) == sorted(want if len(got) > 31 else want[:31])
        longest = 0
        for r in got:
            end = 0
            for s in r["spans"]:
                assert s["start"] >= end and (s["source"], s["source_start"]) < (r["doc_id"], s["start"])
                end, longest = s["end"], max(longest, s["end"] - s["start"])
                words = docs[r["n"]][s["start"] : end]
                assert any(docs[n][s["source_start"] :][: len(words)] == words for n in range(len(docs)) if ids[n] == s["source"])
            assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"]
        assert longest > 20


def test_decontamination_against_all_windows(spark):
    rng = random.Random(8)
    items = corpus(rng, 6, 40)
    docs = corpus(rng, 30, 90)
    for k in range(24):
        piece = edited(rng, items[k % 6], rng.randrange(3))
        if k % 5 == 0:
            del piece[1]
        docs[k][10 : 10 + len(piece)] = piece
    grams5 = lambda ws: [tuple(ws[i : i + 5]) for i in range(len(ws) - 4)]
    want = set()
    for d, doc in enumerate(docs):
        for i, item in enumerate(items):
            a, b = grams5(doc), grams5(item)
            for s in range(len(a) - len(b) + 1):
                both = len(set(a[s : s + len(b)]) & set(b))
                if 100 * both >= 80 * (2 * len(b) - both):
                    want.add((d, i))
    to_df = lambda rows, key: spark.createDataFrame([(i, " ".join(r)) for i, r in enumerate(rows)], f"{key} long, text string")
    got = decontaminate.contaminated(to_df(docs, "doc_id"), to_df(items, "item_id"))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want and len(want) > 5


def test_min_cut_against_all_cuts():
    rng = random.Random(9)
    for _ in range(60):
        n = rng.randrange(1, 8)
        gain = [rng.uniform(-2, 2) for _ in range(n)]
        edges = [(rng.randrange(n), rng.randrange(n), rng.uniform(0, 1.5)) for _ in range(n)]
        edges = [e for e in edges if e[0] != e[1]]
        cost = lambda side: sum(max(g, 0) if not s else max(-g, 0) for g, s in zip(gain, side, strict=True)) + sum(c for u, v, c in edges if side[u] != side[v])
        least = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert cost(html_text.min_cut(gain, edges)) == pytest.approx(least)


def test_main_text_without_semantic_tags():
    page = """<html><head><title>T</title></head><body><header class="site-header"><h1>Site</h1><a href=x>Home</a></header><div class="cookieNotice"><p>We use cookies for many purposes that we could explain at length here.</p></div>
<div id="content"><h1>Real title</h1><p>First &amp; best paragraph with <a href="#">a link</a> and text&nbsp;enough.</p><p>Short.</p><ul><li>item one</li><li>item two</li></ul><div class="newsletter-signup"><p>Subscribe now</p></div><p>Last one.</p></div>
<div class="sidebar"><h3>Related</h3><a>one</a></div><section class="comments"><p>This comment is a long one with quite a lot of words in it, honest.</p></section><footer>c 2020</footer></body></html>"""
    assert html_text.main_text(page) == "Real title First & best paragraph with a link and text enough. Short. item one item two Last one."


def test_license_rules():
    rules = license_scan.RULES
    assert len(rules) > 600 and len({(r.pattern, r.label) for r in rules}) == len(rules) and all(r.keyword == r.keyword.lower() for r in rules)
    assert len(license_scan.TEXTS) > 150 and all(re.compile(license_scan.wrapped(r.pattern)) for r in rules)


def test_detections_against_brute_force(spark):
    """Few rules with much overlap, on random texts: all matches of the rules whose keyword occurs, less those that one before them covers."""
    rng = random.Random(20)
    parts = [("ab", "a+b", 1), ("b", "b[ab]*", 2), ("aab", "aab(?:ab)?", 1), ("c", "c ?a*", 3), ("ab", "(?:ab)+c?", 3), ("z", "[a-z]+", 1)]
    rules = [license_scan.Rule(n, k, "(?i)" + p, f"l{n}", priority, n / 10) for n, (k, p, priority) in enumerate(parts)]
    texts = ["".join(rng.choice("aabbcAB ") for _ in range(rng.randrange(30))) for _ in range(150)] + ["", "zoo ab"]
    rows = license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), rules=rules).collect()
    covered = 0
    for r in rows:
        text = texts[r["doc_id"]]
        found = [(q.priority, m.start(), m.start() - m.end(), q.number, m.end()) for q in rules if q.keyword in text.lower() for m in re.finditer(license_scan.wrapped(q.pattern), text)]
        kept = {d for d in found if not any(e < d and e[1] <= d[1] and e[4] >= d[4] for e in found)}
        covered += len(found) - len(kept)
        assert {(d["priority"], d["start"], d["back"], d["rule"], d["end"]) for d in r["detections"]} == kept, text
        assert r["labels"] == sorted({f"l{d[3]}" for d in kept}) and r["score"] == max((d[3] / 10 for d in kept), default=0.0)
    assert covered > 100


@pytest.mark.parametrize("row", license_scan.TEXTS, ids=lambda r: r[1][:40])
def test_keywords_are_in_all_matches(row):
    """Each alternative of a hand-written signature has its keyword: checked on the shortest and the longest of its readings."""
    keyword, pattern, *_ = row
    for text in readings(pattern):
        assert re.search("(?i)" + license_scan.wrapped(pattern), text), text
        assert keyword in text, (keyword, text)


def readings(pattern: str) -> list[str]:
    """Texts that a simple pattern matches: for each alternative and optional part, one with it and one without."""
    import re._parser as parser

    def of(items) -> list[str]:
        out = [""]
        for op, arg in items:
            out = [a + b for a in out for b in one(str(op), arg)][:400]
        return out

    def one(op, arg) -> list[str]:
        if op == "LITERAL":
            return [chr(arg)]
        if op == "IN":
            if str(arg[0][0]) == "NEGATE" or str(arg[0][0]) == "CATEGORY":
                return ["x"]
            return [chr(x if isinstance(x, int) else x[0]) for _, x in arg][:3]
        if op in ("MAX_REPEAT", "MIN_REPEAT"):
            least, _, sub = arg
            some = [x * max(1, least) for x in of(sub)]
            return some if least else ["", *some]
        if op == "SUBPATTERN":
            return of(arg[-1])
        if op == "BRANCH":
            return [x for branch in arg[1] for x in of(branch)]
        return [""] if op == "AT" else ["x"]

    return of(parser.parse(pattern))


def test_vocabulary_files_are_parameters(spark, tmp_path):
    """Another path gives the same codes and languages if it holds the same pieces, and is read for them."""
    path = str(tmp_path / "pieces.model")
    with open(path, "wb") as f, open(sentencepieces.PIECES, "rb") as g:
        f.write(g.read())
    df = spark.createDataFrame([(1, "some words of a text", "en"), (2, "quelques mots d'un texte", "fr")], "doc_id long, text string, lang string")
    codes = lambda **more: [r["ids"] for r in sentencepieces.encode(df, **more).orderBy("doc_id").collect()]
    assert codes(path=path) == codes()
    assert [r["decoded"] for r in sentencepieces.decode(sentencepieces.encode(df, path=path), path=path).orderBy("doc_id").collect()] == [r["text"] for r in df.orderBy("doc_id").collect()]
    model = language_id.train(df, path=path)
    assert [r["lang_pred"] for r in language_id.predict(df, model, path=path).orderBy("doc_id").collect()] == ["en", "fr"]
    with pytest.raises(Exception, match="missing"):
        codes(path=str(tmp_path / "missing"))
