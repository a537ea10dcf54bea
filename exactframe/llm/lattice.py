"""All segmentations of a word into the pieces of a vocabulary: marginal probability and expected piece counts."""

from __future__ import annotations

import numpy as np

from .shingles import _powers, mix

_U = np.uint64
#: Bytes of a word up to which words of one length are done together; longer ones are done one by one, by another recursion with the same result.
LONG = 48
#: Words done together.
TOGETHER = 8192
#: Places of a long word whose arcs are held at a time.
SPAN = 1 << 16
#: What keeps products of many weights away from zero: a factor for each byte, and, in long words, one now and then.
_LIFT, _STEP_UP = 64.0, 1e100
_TABLE = np.where(np.arange(256) == 0, _U(1), mix(np.arange(256, dtype=np.uint64) + _U(77)))


def vocabulary(path: str) -> tuple[list[bytes], np.ndarray]:
    """(pieces as bytes, a space for the start of a word; weights from the vocabulary's own scores) of a sentencepiece model.

    Each byte is a piece too. The scores of a merge vocabulary are ranks, so a weight is the inverse of the rank.
    """
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    found: dict[bytes, float] = {bytes([b]): 0.1 / m.get_piece_size() for b in range(256)}
    for i in range(m.get_piece_size()):
        if m.is_control(i) or m.is_unknown(i) or m.is_byte(i):
            continue
        piece = m.id_to_piece(i).replace("▁", " ").encode()
        if piece.rfind(b" ") <= 0:
            found[piece] = found.get(piece, 0.0) + 1 / (10 + abs(m.get_score(i)))
    w = np.array(list(found.values()))
    return list(found), w / w.sum()


class Lattice:
    """Log-space forward and backward recursions over words, each written with a space before it."""

    def __init__(self, pieces: list[bytes], weights: np.ndarray):
        self.longest = max(map(len, pieces))
        self.powers = _powers(self.longest, _U(0x9E3779B97F4A7C15))
        keys = np.array([self._key(p) for p in pieces], np.uint64)
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.log = np.log(weights)
        self.lifted = weights * _LIFT ** np.array([len(p) for p in pieces], float)
        # piece by the first bits of its key: -1 for none, -2 for several
        self.direct = np.full(1 << 20, -1, np.int32)
        slots, first, many = np.unique(self.keys >> _U(44), return_index=True, return_counts=True)
        self.direct[slots] = np.where(many == 1, self.order[first], -2)
        self.own = keys

    def _key(self, piece: bytes) -> np.uint64:
        b = np.frombuffer(piece, np.uint8)
        return mix(np.array([(_TABLE[b] * self.powers[: len(b)]).sum(dtype=np.uint64) + _U(len(b))], np.uint64))[0]

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the keys are pieces, which pieces)."""
        found = self.direct[keys >> _U(44)]
        at = np.flatnonzero(found != -1)
        found, k = found[at].astype(np.int64), keys[at]
        if len(more := np.flatnonzero(found == -2)):
            found[more] = self.order[np.minimum(np.searchsorted(self.keys, k[more]), len(self.keys) - 1)]
        ok = self.own[found] == k
        return at[ok], found[ok]

    def _arcs(self, b: np.ndarray):
        """For words of one length, as a matrix of bytes: (from, to, which words, which pieces), by ascending start."""
        values = _TABLE[b]
        width = b.shape[1]
        for i in range(width):
            h = np.zeros(len(b), np.uint64)
            for j in range(i, min(i + self.longest, width)):
                h += values[:, j] * self.powers[j - i]
                rows, pieces = self._find(mix(h + _U(j - i + 1)))
                if len(rows):
                    yield i, j + 1, rows, pieces

    def _forward(self, b: np.ndarray, arcs) -> np.ndarray:
        alpha = np.full((b.shape[1] + 1, len(b)), -np.inf)
        alpha[0] = 0
        for i, j, rows, pieces in arcs:
            alpha[j, rows] = np.logaddexp(alpha[j, rows], alpha[i, rows] + self.log[pieces])
        return alpha

    def _groups(self, words: list[bytes]):
        by: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            by.setdefault(len(w), []).append(k)
        for n, ks in by.items():
            for lo in range(0, len(ks), TOGETHER if n < LONG else 1):
                part = ks[lo : lo + (TOGETHER if n < LONG else 1)]
                yield part, np.frombuffer(b"".join(b" " + words[k] for k in part), np.uint8).reshape(len(part), n + 1)

    def log_probability(self, words: list[bytes]) -> np.ndarray:
        """Natural log of the sum, over all segmentations, of the product of the weights."""
        out = np.zeros(len(words))
        for part, b in self._groups(words):
            out[part] = self._long_forward(b[0])[-1] if b.shape[1] > LONG else self._forward(b, self._arcs(b))[-1]
        return out

    def _span(self, b: np.ndarray, lo: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The arcs from SPAN places of one long word, by place: (how many begin there, their lengths, their pieces)."""
        hi = min(lo + SPAN, len(b))
        values = _TABLE[b[lo : hi + self.longest]]
        h = np.zeros(hi - lo, np.uint64)
        found = []
        for n in range(1, min(self.longest, len(values)) + 1):
            inside = min(hi - lo, len(values) - n + 1)
            h = h[:inside] + values[n - 1 : n - 1 + inside] * self.powers[n - 1]
            rows, pieces = self._find(mix(h + _U(n)))
            found.append(np.stack([rows, np.full(len(rows), n), pieces]))
        start, length, piece = np.hstack(found)
        order = np.argsort(start, kind="stable")
        return np.bincount(start, minlength=hi - lo), length[order], piece[order]

    def _long_forward(self, b: np.ndarray) -> np.ndarray:
        """Log-probability of what precedes each place of one word. Only as many states as a piece is long are held beside it."""
        logs = np.empty(len(b) + 1)
        w = np.exp(self.log)
        state, lifts = [1.0] + [0.0] * self.longest, 0
        for lo in range(0, len(b), SPAN):
            many, length, piece = self._span(b, lo)
            here, weight, n = [], w[piece].tolist(), length.tolist()
            k = 0
            for m in many.tolist():
                a = state[0]
                while a < 1 / _STEP_UP:
                    state = [x * _STEP_UP for x in state]
                    a, lifts = state[0], lifts + 1
                here.append((a, lifts))
                for k in range(k, k + m):
                    state[n[k]] += a * weight[k]
                k += 1 if m else 0
                state = [*state[1:], 0.0]
            at = np.array(here)
            logs[lo : lo + len(here)] = np.log(at[:, 0]) - at[:, 1] * np.log(_STEP_UP)
        logs[-1] = np.log(state[0]) - lifts * np.log(_STEP_UP) if state[0] > 0 else -np.inf
        return logs

    def _long_expected(self, b: np.ndarray, out: np.ndarray) -> float:
        """Adds one word's expected counts to ``out``; the log-probability of the word."""
        before = self._long_forward(b)
        total = before[-1]
        w = np.exp(self.log)
        state, lifts = [1.0] + [0.0] * self.longest, 0  # of what follows a place and the next ones
        after = np.empty(len(b) + 1)
        after[-1] = 0.0
        for lo in reversed(range(0, len(b), SPAN)):
            many, length, piece = self._span(b, lo)
            ends = np.cumsum(many)
            begin, n, weight = (ends - many).tolist(), length.tolist(), w[piece].tolist()
            for i in range(len(many) - 1, -1, -1):
                a = sum(state[n[k] - 1] * weight[k] for k in range(begin[i], begin[i] + int(many[i])))
                state = [a, *state[:-1]]
                while 0 < a < 1 / _STEP_UP:
                    state = [x * _STEP_UP for x in state]
                    a, lifts = state[0], lifts + 1
                after[lo + i] = np.log(a) - lifts * np.log(_STEP_UP)
            start = lo + np.repeat(np.arange(len(many)), many)
            out += np.bincount(piece, np.exp(before[start] + self.log[piece] + after[start + length] - total), len(out))
        return float(total)

    def expected(self, words: list[bytes], times: np.ndarray) -> tuple[np.ndarray, float]:
        """(expected count of each piece over the words, each counted so many times; their log-probability)."""
        out, total = np.zeros(len(self.log)), 0.0
        for part, b in self._groups(words):
            n = times[part]
            long = np.arange(len(b)) if b.shape[1] > LONG else None
            if long is None:  # products without logarithms, each byte lifted by a constant
                arcs = list(self._arcs(b))
                alpha, beta = np.zeros((2, b.shape[1] + 1, len(b)))
                alpha[0] = beta[-1] = 1.0
                for i, j, rows, pieces in arcs:
                    alpha[j, rows] += alpha[i, rows] * self.lifted[pieces]
                for i, j, rows, pieces in reversed(arcs):
                    beta[i, rows] += beta[j, rows] * self.lifted[pieces]
                all_ = alpha[-1]
                long = np.flatnonzero(all_ < 1e-250)  # too small for that
                share = np.where(all_ < 1e-250, 0.0, n / np.maximum(all_, 1e-250))
                for i, j, rows, pieces in arcs:
                    out += np.bincount(pieces, alpha[i, rows] * self.lifted[pieces] * beta[j, rows] * share[rows], len(out))
                fine = all_ >= 1e-250
                total += float((n[fine] * (np.log(all_[fine]) - b.shape[1] * np.log(_LIFT))).sum())
            for k in long.tolist():
                one = np.zeros(len(out))
                total += n[k] * self._long_expected(b[k], one)
                out += n[k] * one
        return out, total
