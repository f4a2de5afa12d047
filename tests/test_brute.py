"""Queries that SQL does not express, against plain versions on the smallest tables."""

import random
import re
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F
from test_entry import DIR, needs_data

from vellumflow.operators import vectors
from vellumflow.plans.registry import QUERIES


def table(spark, name):
    return spark.read.parquet(f"{DIR}/{name}.parquet")


@needs_data
def test_alias_indel_join(spark):
    def similarity(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return 200 * row[-1] / (len(a) + len(b))

    words = lambda s: " ".join(sorted(s.strip().lower().split()))
    aliases = [r[0] for r in table(spark, "nation").select("n_name").union(table(spark, "region").select("r_name")).distinct().collect()]
    want = set()
    for (name,) in table(spark, "part").select("p_name").distinct().collect():
        best = max(((similarity(words(name), words(a)), a) for a in aliases), key=lambda x: (x[0], [-ord(c) for c in x[1]] + [1]))
        if best[0] >= 30:
            want.add((name, best[1], int(best[0])))
    assert {tuple(r) for r in QUERIES["alias_indel_join"](spark, DIR).collect()} == want and want


@needs_data
def test_heading_items(spark):
    class Items(HTMLParser):
        """Texts of p and li up to the next tag of the kind, under the headings so far."""

        def __init__(self):
            super().__init__(convert_charrefs=False)
            self.out, self.stack, self.tag, self.text = [], [], None, ""

        def close(self):
            text = re.sub(r"\s+", " ", self.text).strip()
            if self.tag and text:
                if self.tag[0] == "h":
                    self.stack = [*self.stack[: int(self.tag[1]) - 1], text]
                else:
                    self.out.append((" > ".join(self.stack) or None, text))
            self.tag, self.text = None, ""

        def handle_starttag(self, tag, attrs):
            if re.fullmatch("h[1-4]|p|li", tag):
                self.close()
                self.tag = tag

        def handle_endtag(self, tag):
            if re.fullmatch("h[1-4]|p|li", tag):
                self.close()

        def handle_data(self, data):
            self.text += data

        handle_entityref = lambda self, name: self.handle_data(f"&{name};")
        handle_charref = lambda self, name: self.handle_data(f"&#{name};")

    got = {}
    for r in QUERIES["heading_items"](spark, DIR).orderBy("page_id", "pos").collect():
        got.setdefault(r["page_id"], []).append((r["heading_path"], r["text"]))
    for r in table(spark, "pages").collect():
        p = Items()
        p.feed(r["html"])
        p.close()
        squeeze = lambda items: [(a, re.sub(r"[&;\s]", "", b)) for a, b in items]
        assert squeeze(got.get(r["page_id"], [])) == squeeze(p.out), r["page_id"]


@needs_data
def test_chunk_fold(spark):
    """Sentences of up to 120 words into chunks of 60 to 180 words, each of which begins with the last piece of the one before."""
    got: dict = {}
    for r in QUERIES["chunk_fold"](spark, DIR).orderBy("doc_id", "position").collect():
        got.setdefault(r["doc_id"], []).append(r["text"])
    many = 0
    for r in table(spark, "documents").filter("text is not null").collect():
        sentences = [s for s in (x.strip() for x in re.split(r"(?<=[.!?])\s+", r["text"].strip())) if s]
        pieces = []
        for s in sentences:
            ws = s.split()
            pieces += [" ".join(ws[i : i + 120]) for i in range(0, len(ws), 120)]
        chunks, held = [], []
        for i, p in enumerate([*pieces, None]):
            if p is not None:
                held.append(p)
            n = sum(len(x.split()) for x in held)
            if held and (n >= 180 or p is None):
                if n < 60 and chunks:
                    chunks[-1] += " " + " ".join(held)
                else:
                    chunks.append(" ".join(held))
                held = [p] if p is not None else []
        many += len(chunks) > 2
        assert [c.strip() for c in got.get(r["doc_id"], [])] == [c.strip() for c in chunks], r["doc_id"]
    assert many > 5


@pytest.mark.parametrize("broadcast", [64 << 20, 0])
def test_top_k_of_blocks(spark, monkeypatch, broadcast):
    monkeypatch.setattr(vectors, "MOST_BROADCAST", broadcast)
    plain, blocks = random.Random(3), vectors._in_blocks
    monkeypatch.setattr(vectors, "_in_blocks", lambda rows, numbers: blocks(7, 20))
    rows = [(f"{i:03}", [plain.randint(-2, 2) / 4 for _ in range(3)]) for i in range(150)]
    odd = [("n", None), ("m", [None, 1.0, 1.0]), ("x", [float("nan"), 1.0, 1.0]), ("y", [float("inf"), 1.0, 1.0]), ("z", [9.0, 9.0])]
    chunks = spark.createDataFrame(rows + odd, "idx string, embedding array<float>")
    queries = chunks.filter("idx like '%3' or idx in ('n', 'z')").withColumnRenamed("idx", "query_id")
    want = set()
    for name, q in [*[r for r in rows if r[0][-1] == "3"], odd[-1]]:
        hits = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), i) for i, v in [*rows, odd[-1]] if len(v) == len(q))
        want |= {(name, n, i, -s + 0.0) for n, (s, i) in enumerate(hits[:4], 1)}
    assert {tuple(r) for r in vectors.top_k(queries, chunks, 4).collect()} == want and len(want) > 50
    assert vectors.top_k(queries.limit(0), chunks).count() == 0 and vectors.top_k(queries, chunks.limit(0)).count() == 0


@needs_data
def test_every_event_is_repaired(spark):
    got = QUERIES["json_repaired"](spark, DIR)
    events = spark.read.parquet(f"{DIR}/events.parquet").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
    assert got.exceptAll(events).isEmpty() and events.exceptAll(got).isEmpty()
