"""Alignments against whole texts encoded at once, with odd texts, short runs of events and both ways of counting pairs."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from test_entry import DIR, needs_data

from vellumflow.llm import token_alignment as ta
from vellumflow.llm.registry import QUERIES

ODD = [
    None, "", " ", "   ", "\n", "a", "a ", " a", "two  spaces   three", "tab\tand\nline \n  end\n\n", "\n\nstart", "it's we'll don't 'tis", "<|endoftext|> <s> </s> <unk> <0x0A>", "marker ▁ in text", "▁", "café naïve über",
    "中文字符 混合 text", "emoji \U0001f600\U0001f468‍\U0001f469 end", "nbsp here   em　ideographic", "é combining ́alone", "\x00nul \x1c\x1d\x1e\x1f controls \x85 next", "zero​width ﻿bom ‏ rtl שלום",
    "12345 6,789.00 3.14e-10", "x" * 3000, "word " * 2000, "a\r\nb\r\n c", "...!!! ??? --- ___", "  ogham ᠎ sep", "trailing marks ́ ̂", "\U0010ffff  private", "mixed   line   sep", "UPPER lower 'S 's ’s",
]


def encoders():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(ta.BYTE_BPE)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=ta.PIECES)


def brute(rows):
    """By row: (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, sha), as the definitions say it."""
    a, b = encoders()
    byte_of = {}
    plain = [x for x in range(256) if 33 <= x <= 126 or 161 <= x <= 172 or x >= 174]
    for i, x in enumerate(plain + [x for x in range(256) if x not in plain]):
        byte_of[chr(x) if i < len(plain) else chr(256 + i - len(plain))] = x
    out, links, pairs = [], [], Counter()
    for d, text in rows:
        whole = (" " + (text or "")).encode()
        ia = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ib = b.encode(text) if text else []
        ta_ = [bytes(byte_of[c] for c in a.id_to_token(i)) for i in ia]
        tb = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ib for p in [b.id_to_piece(i)]]
        if not text or b"".join(ta_) != whole or b"".join(tb) != whole:
            out.append([d, 0, 0, 0, 0, ""]), links.append([])
            continue
        ea, eb = np.cumsum([len(x) for x in ta_]).tolist(), np.cumsum([len(x) for x in tb]).tolist()
        groups, mine, i, j = [], [], 0, 0
        for end in sorted(set(ea) & set(eb)):
            i2, j2 = ea.index(end, i) + 1, eb.index(end, j) + 1
            groups.append(",".join(map(str, ia[i:i2])) + "|" + ",".join(map(str, ib[j:j2])))
            mine.append((ia[i2 - 1], ib[j2 - 1]))
            i, j = i2, j2
        links.append(mine)
        pairs.update(mine)
        out.append([d, len(ia), len(ib), len(groups), len(mine), hashlib.sha256(";".join(groups).encode()).hexdigest()])
    top = defaultdict(int)
    for (_, y), n in pairs.items():
        top[y] = max(top[y], n)
    return Counter((*r[:5], sum(pairs[p] == top[p[1]] for p in m), sum(pairs[p] for p in m), r[5]) for r, m in zip(out, links, strict=True))


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def digest(rows):
    return Counter(tuple(r[c] for c in COLUMNS[:7]) + (hashlib.sha256(r["groups"].encode()).hexdigest() if r["groups"] else "",) for r in rows)


@pytest.mark.parametrize("text_ids", [False, True])
def test_alignments_of_odd_texts(spark, text_ids):
    rng = random.Random(8)
    texts = ODD + ["".join(rng.choice(["a", "B", " ", " ", "\n", "\t", "é", "中", "'s", "1", ".", " ", "the ", "▁", "́"]) for _ in range(rng.randrange(1, 60))) for _ in range(300)] + ODD[5:9]
    ids = [None if i % 17 == 3 else i // 2 for i in range(len(texts))]
    rows = [(f"d{i}" if text_ids and i is not None else i, t) for i, t in zip(ids, texts, strict=True)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], f"doc_id {'string' if text_ids else 'int'}, text string, n_a int, groups string").repartition(3)
    want = brute(rows)
    for run in (4096, 3):
        aligned = ta.write_table(ta.align(docs, run=run), "aligned")
        assert aligned.schema["doc_id"].dataType.simpleString() == ("string" if text_ids else "int")
        for most in (2_000_000, 0):
            assert digest(ta.with_counts(aligned, broadcast_pairs=most).collect()) == want
    linked = aligned.collect()
    assert all(r["n_links"] == len(r["links"]) and [tuple(x) for x in r["links"]] == [tuple(int(g.split(",")[-1]) for g in x.split("|")) for x in r["groups"].split(";") if x] for r in linked)


def test_the_faster_encoder_gives_the_same_ids():
    a, _ = encoders()
    rng = random.Random(4)
    texts = [t for t in ODD if t] + ["".join(rng.choice("abcdetns'.,1é中- \n") for _ in range(rng.randrange(1, 300))) for _ in range(300)] + ["".join(rng.choice("abcdef") for _ in range(20_000))]
    fast = ta._coders(ta.BYTE_BPE, ta.PIECES)[2]
    assert [fast.encode_ordinary(" " + t) for t in texts] == [a.encode(" " + t, add_special_tokens=False).ids for t in texts]


def test_alignment_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ta.align(empty).collect() == [] and ta.with_counts(ta.write_table(ta.align(empty), "aligned")).collect() == []


@needs_data
def test_query_against_whole_encodings(spark):
    import pyarrow.parquet as pq

    rows = list(zip(*pq.read_table(f"{DIR}/documents.parquet").select(["doc_id", "text"]).to_pydict().values(), strict=True))
    got = QUERIES["op13_token_alignment"](spark, DIR)
    assert sorted(got.columns) == sorted(COLUMNS)
    assert Counter(tuple(r[c] for c in COLUMNS) for r in got.collect()) == brute(rows)
