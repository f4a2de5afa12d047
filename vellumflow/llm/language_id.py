"""Language identification by segmentation-marginalised unigrams.

A language gives each piece of a fixed public vocabulary a probability. The probability of a word is the sum over all its segmentations
into pieces of the product of their probabilities, found by a forward algorithm; that of a text is the product over its words. The
language of highest probability is predicted; its posterior under equal priors is the score.

Words are runs of letters (what str.isalpha takes) and their combining marks, in lower case, with the marker of a word start; they may
have any length. Since no piece reaches over a word, each distinct word is summed once per worker (a cache of bounded size).

Training is expectation-maximisation over word counts of labelled documents: about `sample` documents of each language, chosen by a hash
of their ids, of which the `words` most frequent words of each language count, so that every labelled language keeps its own. Both
bounds are parameters and hold for each language by itself; the number of languages has none. The model's size is that of the vocabulary
times the number of languages, and it is held by the driver and every worker. Only in training, runs of more than 32 letters are learned in
parts, of which the first alone has the marker.

Results: null text, text without letters, and any text if nothing could be learned, is `und` with score 0. Of languages of equal probability
the first by name is predicted. Repeated rows get equal results, and count in training as often as they occur.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .lattice import Lattice, groups
from .sentencepieces import Cache, add_columns
from .store import table, with_small_batches
from .vocabulary import PIECES, vocabulary
from .wordhash import release_memory, slices

_PLAIN, _LETTERS = re.compile("[a-z]+"), regex.compile(r"\p{L}[\p{L}\p{M}]*")
#: The probability of a character that is no piece, in every language.
_UNKNOWN = 1e-7
#: Positions times languages of a lattice that is worked out at once.
_POSITIONS = 400_000


def words_of(text: str | None) -> list[str]:
    if not text:
        return []
    return (_PLAIN if text.isascii() else _LETTERS).findall(text.lower())


def parts_of(word: str, most: int = 32) -> list[str]:
    """A word with its marker, in parts."""
    return [" " + word] if len(word) <= most else [" " * (i == 0) + word[i : i + most] for i in range(0, len(word), most)]


def _lattices(trie, marked: list[str], unknown: int, langs: int):
    raw = [w.encode() for w in marked]
    for group in groups(raw, max(5_000, _POSITIONS // max(1, langs))):
        yield np.array(group), Lattice(trie, [raw[i] for i in group], unknown)


def word_scores(trie, p: np.ndarray, words: list[str]) -> np.ndarray:
    """log P(word | language) by word and language."""
    out = np.zeros((len(words), p.shape[1]))
    for group, lattice in _lattices(trie, [" " + w for w in words], len(p) - 1, p.shape[1]):
        out[group] = lattice.log_total(p)
    return out


class Times:
    """Counts n of words (numbers in ascending order) in languages (numbers), of which only those of the words asked for are spread over an array [word, language]."""

    def __init__(self, word: np.ndarray, lang: np.ndarray, n: np.ndarray, words: int, langs: int):
        self.lang, self.n, self.shape = lang, n, (words, langs)
        self.first = np.searchsorted(word, np.arange(words + 1))

    def __getitem__(self, asked: np.ndarray) -> np.ndarray:
        sizes = self.first[asked + 1] - self.first[asked]
        at = np.repeat(self.first[asked] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        out = np.zeros((len(asked), self.shape[1]))
        out[np.repeat(np.arange(len(asked)), sizes), self.lang[at]] = self.n[at]
        return out


def fit(trie, n_pieces: int, words: list[str], times: np.ndarray | Times, rounds: int = 4, smooth: float = 0.05) -> np.ndarray:
    """words: with their markers. Piece probabilities by language, with a last row for unknown characters. times[w, l]: how often language l has word w. Each language is mixed with the average of all, smoothed by `smooth` uses of every piece."""
    p = np.full((n_pieces + 1, times.shape[1]), 1 / n_pieces)
    p[-1] = _UNKNOWN
    for _ in range(rounds):
        uses = np.zeros_like(p)
        for group, lattice in _lattices(trie, words, n_pieces, p.shape[1]):
            uses += lattice.expected(p, times[group])
        uses = uses[:-1]
        pooled = uses.sum(1) + smooth
        pooled /= pooled.sum()
        p[:-1] = (uses + 50 * pooled[:, None]) / (uses.sum(0) + 50)
    return p


def _counts(batches):
    for b in batches:
        for i, j in slices(b.column(1)):
            part = b.slice(i, j - i)
            got: dict = {}
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                mine = got.setdefault(lang, {})
                for word in words_of(text):
                    for w in parts_of(word):
                        mine[w] = mine.get(w, 0) + 1
            rows = [(lang, w, n) for lang, mine in got.items() for w, n in mine.items()]
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], ["lang", "word", "n"])
    release_memory()


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = 300, words: int = 150_000, path: str = PIECES):
    """Learns (languages, probabilities) from the rows of docs that have a language and a text; None if there are none."""
    rows = docs.select(F.xxhash64(F.col(doc_id)).alias("h"), F.col(lang).alias("lang"), F.col(text).alias("text")).filter("lang is not null and text is not null")
    share = rows.groupBy("lang").agg(F.least(F.lit(1.0), sample / F.count("*")).alias("share"))
    chosen = with_small_batches(rows).join(F.broadcast(share), "lang").filter(F.pmod("h", F.lit(1_000_003)) < F.col("share") * 1_000_003)
    counted = chosen.select("lang", "text").mapInArrow(_counts, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    got = counted.withColumn("k", rank).filter(F.col("k") <= words).select("lang", "word", "n").toArrow()
    if not got.num_rows:
        return None
    langs, known = (sorted(pc.unique(got.column(c)).to_pylist()) for c in ("lang", "word"))
    word, own = (pc.index_in(got.column(c).combine_chunks(), pa.array(of, pa.string())).to_numpy() for c, of in (("word", known), ("lang", langs)))
    order = np.argsort(word, kind="stable")
    times = Times(word[order], own[order], got.column("n").to_numpy()[order], len(known), len(langs))
    v = vocabulary(path)
    return langs, fit(v.trie, len(v.surface), known, times)


def _predict(shared, key: str, names: tuple[str, str], at: int, drop: bool):
    """at: the text's column; drop: it was sent for this only."""

    def run(batches):
        langs, p, trie = shared.value
        cache = Cache.of(("language", key))
        for b in batches:
            for i, j in slices(b.column(at)):
                part = b.slice(i, j - i)
                found = [words_of(t) for t in part.column(at).to_pylist()]
                new = set().union(*found)
                known = cache.look(new, lambda ws: [x.tobytes() for x in word_scores(trie, p, ws)])
                best, score = [], []
                flat = np.frombuffer(b"".join([b"".join(map(known.__getitem__, ws)) for ws in found]), np.float64)
                sums = np.zeros((len(found), len(langs)))
                counts = np.fromiter(map(len, found), np.int64, len(found))
                some = np.flatnonzero(counts)
                if len(some) and langs:
                    sums[some] = np.add.reduceat(flat.reshape(-1, len(langs)), np.cumsum(counts)[some] - counts[some], axis=0)
                for n, s in zip(counts.tolist(), sums, strict=True):
                    if n == 0 or not langs:
                        best.append("und")
                        score.append(0.0)
                    else:
                        k = int(np.argmax(s))
                        best.append(langs[k])
                        score.append(float(1 / np.exp(s - s[k]).sum()))
                part = part.drop_columns(part.schema.names[at]) if drop else part
                yield pa.record_batch([*part.columns, pa.array(best, pa.string()), pa.array(score)], [*part.schema.names, *names])
        release_memory(("language", key))

    return run


def predict(docs: DataFrame, model, text: str = "text", path: str = PIECES, names: tuple[str, str] = ("lang_pred", "lang_score")) -> DataFrame:
    """docs with the language and its score as columns of these names, which replace ones so called."""
    langs, p = model or ([], np.zeros((len(vocabulary(path).surface) + 1, 0)))
    shared = docs.sparkSession.sparkContext.broadcast((langs, p, vocabulary(path).trie))
    return add_columns(docs, text, {names[0]: "string", names[1]: "double"}, lambda at, drop: _predict(shared, uuid.uuid4().hex, names, at, drop))


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4; 0 for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4, F.lit(0))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.filter(fold() != 2))
    out = predict(docs.select("doc_id", "text", (fold() == 2).alias("held_out")), model)
    return out.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))
