"""Pieces of a public tokenizer file."""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np

from .lattice import DoubleArrayTrie

PIECES = "/opt/tokenizers/piece_bpe_32k.model"


@dataclass(frozen=True)
class Vocabulary:
    """surface: each id's bytes (a space for the white-space marker; one byte for a byte piece; empty for control pieces). score: log scores. byte_ids: the ids of the 256 byte pieces, or -1."""

    surface: list[bytes]
    score: np.ndarray
    byte_ids: np.ndarray
    trie: DoubleArrayTrie


@functools.lru_cache(maxsize=4)
def vocabulary(path: str = PIECES) -> Vocabulary:
    """Reads a sentencepiece model. Scores that are log probabilities are used as they are; those of a merge model are ranks (some may have a huge one), for which Zipf's law gives log scores: -log(rank + 2)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    ids = range(n)
    names = [model.id_to_piece(i) for i in ids]
    raw = np.array([model.get_score(i) for i in ids])
    plain = np.array([not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) for i in ids])
    surface = [names[i].replace("▁", " ").encode() if plain[i] else b"" for i in ids]
    byte_ids = np.full(256, -1)
    for i in ids:
        if model.is_byte(i):
            byte_ids[int(names[i][3:5], 16)] = i
            surface[i] = bytes([int(names[i][3:5], 16)])
    if plain.any() and np.median(raw[plain]) < -1000:
        raw = -np.log(2 + np.clip(raw[plain].max() - raw, 0, n))
    score = np.where(plain, raw, -np.inf)
    return Vocabulary(surface, score, byte_ids, DoubleArrayTrie([s if plain[i] else b"" for i, s in enumerate(surface)]))
