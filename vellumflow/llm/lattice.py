"""Segmentation lattices of many short byte strings at once, over a double-array trie of pieces."""

from __future__ import annotations

import numpy as np


class DoubleArrayTrie:
    """A byte trie as two integer arrays: the child of state s by byte b is t = base[s] + b, and exists where check[t] == s."""

    def __init__(self, pieces: list[bytes]):
        children: list[dict[int, int]] = [{}]
        ends: dict[int, int] = {}
        for i, piece in enumerate(pieces):
            if not piece:
                continue
            at = 0
            for b in piece:
                if (to := children[at].get(b)) is None:
                    to = children[at][b] = len(children)
                    children.append({})
                at = to
            ends.setdefault(at, i)
        size = 2 * len(children) + 1024
        base, check, value = np.zeros(size, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        free = bytearray(b"\x01") * size
        free[0] = 0
        self.longest = max(map(len, pieces), default=0)
        low, todo = 1, [(0, 0)]
        while todo:
            node, state = todo.pop()
            kids = sorted(children[node])
            if kids:
                at = low
                while True:
                    at = free.find(1, at)
                    b = at - kids[0]
                    if b > 0 and all(free[b + k] for k in kids[1:]):
                        break
                    at += 1
                if len(kids) == 1 and at == low:
                    low += 1
                if b + 600 > len(free):
                    grow = len(free)
                    free += bytearray(b"\x01") * grow
                    base, check, value = (np.concatenate([x, np.full(grow, fill)]) for x, fill in ((base, 0), (check, -1), (value, -1)))
                base[state] = b
                for k in kids:
                    free[b + k], check[b + k] = 0, state
                    value[b + k] = ends.get(children[node][k], -1)
                    todo.append((children[node][k], b + k))
                low = free.find(1, low)
        used = int(np.flatnonzero(check >= 0).max(initial=0)) + 257
        pad = max(0, used - len(check))
        self.base = np.concatenate([base, np.zeros(pad, np.int64)])[:used].astype(np.int32)
        self.check = np.concatenate([check, np.full(pad, -1)])[:used].astype(np.int32)
        self.value = np.concatenate([value, np.full(pad, -1)])[:used].astype(np.int32)


def groups(words: list[bytes], most: int = 100_000):
    """Lists of places in words, by length, of at most `most` positions together (or one longer word): bounds a lattice's memory."""
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    a = 0
    while a < len(order):
        z = a + 1
        while z < len(order) and (z + 1 - a) * (len(words[order[z]]) + 1) <= most:
            z += 1
        yield order[a:z]
        a = z


class Lattice:
    """Arcs of some strings: word, start, end (byte positions in the word) and piece (unknown for a character that is no piece of its own), in order of end, word and start."""

    def __init__(self, trie: DoubleArrayTrie, words: list[bytes], unknown: int):
        self.length = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        first = np.cumsum(self.length) - self.length
        word = np.repeat(np.arange(len(words)), self.length)
        stop = (first + self.length)[word] if len(words) else first
        opens = np.flatnonzero((flat & 0xC0) != 0x80)
        char_end = np.concatenate([opens[1:], [len(flat)]])[: len(opens)]
        lone = np.zeros(len(opens), bool)
        begin, at, state, which = opens, opens.copy(), np.zeros(len(opens), np.int64), np.arange(len(opens))
        b_all, e_all, p_all = [], [], []
        while len(begin):
            to = trie.base[state] + flat[at]
            ok = trie.check[to] == state
            begin, at, state, which = begin[ok], at[ok] + 1, to[ok].astype(np.int64), which[ok]
            piece = trie.value[state]
            hit = piece >= 0
            b_all.append(begin[hit])
            e_all.append(at[hit])
            p_all.append(piece[hit])
            lone[which[hit & (at == char_end[which])]] = True
            more = at < stop[begin]
            begin, at, state, which = begin[more], at[more], state[more], which[more]
        b_all.append(opens[~lone])
        e_all.append(char_end[~lone])
        p_all.append(np.full((~lone).sum(), unknown))
        b, e, p = (np.concatenate(x).astype(np.int64) for x in (b_all, e_all, p_all))
        w = word[b] if len(b) else b
        start, end = b - first[w], e - first[w]
        width = int(self.length.max(initial=0)) + 1
        order = np.argsort((end * len(words) + w) * width + start, kind="stable") if len(b) else b
        self.word, self.start, self.end, self.piece, self.width = w[order], start[order], end[order], p[order], width
        self.by_end = np.searchsorted(self.end, np.arange(width + 1))

    def viterbi(self, score: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        """Each word's best pieces (32-bit ids, little-endian), and which words use the last id, that of unknown characters; of equal paths the one with the longer last piece."""
        n = len(self.length)
        best, back = np.full((n, self.width), -np.inf), np.zeros((n, self.width), np.int64)
        best[:, 0] = 0
        for e in range(1, self.width):
            a, z = self.by_end[e], self.by_end[e + 1]
            if a == z:
                continue
            w = self.word[a:z]
            value = best[w, self.start[a:z]] + score[self.piece[a:z]]
            edge = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
            top = np.maximum.reduceat(value, edge)
            where = np.where(value == np.repeat(top, np.diff(np.append(edge, z - a))), np.arange(z - a), z - a)
            best[w[edge], e] = top
            back[w[edge], e] = a + np.minimum.reduceat(where, edge)
        at, alive, ws, out = self.length.copy(), np.flatnonzero(self.length > 0), [], []
        while len(alive):
            arc = back[alive, at[alive]]
            ws.append(alive)
            out.append(self.piece[arc])
            at[alive] = self.start[arc]
            alive = alive[at[alive] > 0]
        if not ws:
            return [b""] * n, np.zeros(n, bool)
        steps = np.concatenate([np.full(len(x), -i) for i, x in enumerate(ws)])
        w, ids = np.concatenate(ws), np.concatenate(out).astype(np.int32)
        order = np.lexsort((steps, w))
        raw, cut = ids[order].tobytes(), 4 * np.concatenate([[0], np.cumsum(np.bincount(w, minlength=n))])
        return [raw[i:j] for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)], np.bincount(w[ids == len(score) - 1], minlength=n) > 0

    def _sums(self, p: np.ndarray, a: int, z: int, key: np.ndarray, value: np.ndarray, into: np.ndarray) -> None:
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        into[key[edge]] += np.add.reduceat(value, edge, axis=0)

    def forward(self, p: np.ndarray) -> np.ndarray:
        """alpha[word, position, model]: the summed probability of all segmentations of each prefix; p: probabilities by piece and model."""
        alpha = np.zeros((len(self.length), self.width, p.shape[1]))
        alpha[:, 0] = 1
        for e in range(1, self.width):
            a, z = self.by_end[e], self.by_end[e + 1]
            if a < z:
                w = self.word[a:z]
                self._sums(p, a, z, w, alpha[w, self.start[a:z]] * p[self.piece[a:z]], alpha[:, e])
        return alpha

    def total(self, alpha: np.ndarray) -> np.ndarray:
        return alpha[np.arange(len(self.length)), self.length]

    def log_total(self, p: np.ndarray) -> np.ndarray:
        """The logarithm of total(forward(p)), scaled on the way, so that words of any length don't underflow; a model less probable than the best one of a stretch by 1e-300 gets that."""
        alpha, scale = np.zeros((len(self.length), self.width, p.shape[1])), np.zeros(len(self.length))
        alpha[:, 0] = 1
        reach = int((self.end - self.start).max(initial=1))
        for e in range(1, self.width):
            a, z = self.by_end[e], self.by_end[e + 1]
            if a < z:
                w = self.word[a:z]
                self._sums(p, a, z, w, alpha[w, self.start[a:z]] * p[self.piece[a:z]], alpha[:, e])
            if e % 16 == 0:
                near = alpha[:, max(0, e - reach) : e + 1]
                top = near.max(axis=(1, 2), initial=0)
                low = np.flatnonzero((top < 1e-40) & (top > 0))
                near[low] /= top[low, None, None]
                scale[low] += np.log(top[low])
        return np.log(np.maximum(self.total(alpha), 1e-300)) + scale[:, None]

    def expected(self, p: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Expected uses of each piece by model, if word w occurs times[w, model] times."""
        alpha = self.forward(p)
        total = self.total(alpha)
        beta = np.zeros_like(alpha)
        beta[np.arange(len(self.length)), self.length] = 1
        for e in range(self.width - 1, 0, -1):
            a, z = self.by_end[e], self.by_end[e + 1]
            if a < z:
                w, s = self.word[a:z], self.start[a:z]
                np.add.at(beta, (w, s), beta[w, e] * p[self.piece[a:z]])
        weight = times / np.maximum(total, 1e-300)
        post = alpha[self.word, self.start] * p[self.piece] * beta[self.word, self.end] * weight[self.word]
        return np.stack([np.bincount(self.piece, post[:, m], len(p)) for m in range(p.shape[1])], axis=1)
