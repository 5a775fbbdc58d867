"""A small gated recurrent network in numpy with a class-factored output softmax.

The probability of a token is P(class | state) * P(token | class, state). The first
classes hold the most frequent words, ``PER_CLASS`` each, with a softmax of their own;
the other classes hold a band of rarer words each, whose share within the band comes
from their counts. Output biases start at the unigram distribution.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

HIDDEN, PER_CLASS = 24, 64


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-x))


@dataclass
class Gru:
    """Tokens 0 .. words - 1 are words; words + b stands for any word of band b."""

    words: int
    bands: int
    table: np.ndarray  # (words + bands) x 3H: what an input token adds to the gates
    u: np.ndarray  # H x 3H
    b: np.ndarray
    wc: np.ndarray  # H x classes
    bc: np.ndarray
    ww: np.ndarray  # word classes x H x PER_CLASS
    bw: np.ndarray

    @property
    def hidden(self) -> int:
        return self.u.shape[0]

    @classmethod
    def start(cls, word_counts: np.ndarray, band_counts: np.ndarray, hidden: int = HIDDEN, seed: int = 5) -> Gru:
        """word_counts: of words in the order of their numbers; band_counts: all tokens of each band."""
        draw = np.random.default_rng(seed)
        k, bands = len(word_counts), len(band_counts)
        n = -(-k // PER_CLASS)
        padded = np.zeros(n * PER_CLASS)
        padded[:k] = word_counts
        by_class = padded.reshape(n, PER_CLASS)
        mass = np.concatenate([by_class.sum(axis=1), band_counts]) + 1e-3
        inside = np.where(np.arange(n * PER_CLASS).reshape(n, -1) < k, np.log(by_class + 0.1), -1e9)
        f = np.float32
        make = lambda *shape: (draw.standard_normal(shape) * 0.1).astype(f)
        return cls(
            k, bands, make(k + bands, 3 * hidden), (draw.standard_normal((hidden, 3 * hidden)) / np.sqrt(hidden)).astype(f), np.zeros(3 * hidden, f),
            make(hidden, n + bands), np.log(mass / mass.sum()).astype(f), make(n, hidden, PER_CLASS), (inside - np.log(np.exp(inside).sum(axis=1, keepdims=True))).astype(f),
        )

    def step(self, h: np.ndarray, token: np.ndarray) -> np.ndarray:
        m = self.hidden
        x, g = self.table[token], h @ self.u
        x = x + self.b
        gates = _sigmoid(x[:, : 2 * m] + g[:, : 2 * m])
        new = np.tanh(x[:, 2 * m :] + gates[:, m:] * g[:, 2 * m :])
        return new + gates[:, :m] * (h - new)

    def class_of(self, token: np.ndarray) -> np.ndarray:
        n = self.ww.shape[0]
        return np.where(token < self.words, token // PER_CLASS, token - self.words + n)

    def log_prob(self, h: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Natural log of P(token | state), for a band token that of its band."""
        kind = self.class_of(token)
        out = h @ self.wc
        out += self.bc
        out -= out.max(axis=1, keepdims=True)
        got = out[np.arange(len(token)), kind] - np.log(np.exp(out).sum(axis=1))
        order = np.argsort(kind, kind="stable")
        cuts = np.searchsorted(kind[order], np.arange(self.ww.shape[0] + 1))
        for k in range(self.ww.shape[0]):
            at = order[cuts[k] : cuts[k + 1]]
            if len(at):
                inner = h[at] @ self.ww[k]
                inner += self.bw[k]
                inner -= inner.max(axis=1, keepdims=True)
                got[at] += inner[np.arange(len(at)), token[at] - k * PER_CLASS] - np.log(np.exp(inner).sum(axis=1))
        return got.astype(np.float64)

    def score(self, ids: np.ndarray, ptr: np.ndarray, end: int, chunk: int = 1 << 15) -> np.ndarray:
        """Natural log-likelihood of each whole token list; lists run side by side and keep their state to the end."""
        sizes = np.diff(ptr)
        order = np.argsort(-sizes, kind="stable")
        sizes, first = sizes[order], ptr[:-1][order]
        total = np.zeros(len(order))
        h = np.zeros((len(order), self.hidden), np.float32)
        last = np.full(len(order), end, np.int64)
        states: list[np.ndarray] = []
        wanted: list[np.ndarray] = []
        held, t, live = 0, 0, len(order)
        steps = int(sizes[0]) if len(sizes) else 0
        while t < steps:
            live = int(np.searchsorted(-sizes, -t, "left")) if sizes[live - 1] <= t else live
            h = self.step(h[:live], last[:live])
            last = ids[first[:live] + t]
            states.append(h)
            wanted.append(last)
            held += live
            t += 1
            if held >= chunk or t == steps:
                got = self.log_prob(np.concatenate(states), np.concatenate(wanted))
                at = 0
                for w in wanted:
                    total[: len(w)] += got[at : at + len(w)]
                    at += len(w)
                states, wanted, held = [], [], 0
        out = np.zeros(len(order))
        out[order] = total
        return out

    # ------------------------------------------------------------ training

    PARAMETERS = ("table", "u", "b", "wc", "bc", "ww", "bw")

    def fresh_steps(self) -> dict[str, np.ndarray]:
        """Squared gradients so far, by which steps shrink; training that goes on takes them over."""
        return {k: np.full_like(getattr(self, k), 1e-6) for k in self.PARAMETERS}

    def train(self, ids: np.ndarray, end: int, streams: int = 64, window: int = 24, rate: float = 0.08, epochs: int = 1, steps: dict[str, np.ndarray] | None = None) -> list[float]:
        """Truncated backpropagation over parallel streams of a token list whose texts end with ``end``; returns mean losses."""
        per = (len(ids) - 1) // streams
        if per < 2:
            return []
        grid = ids[: per * streams].reshape(streams, per)
        sums = self.fresh_steps() if steps is None else steps
        losses = []
        for _ in range(epochs):
            h, before = np.zeros((streams, self.hidden), np.float32), np.full(streams, end, np.int64)
            for t in range(0, per, window):
                part = grid[:, t : t + window]
                loss, h = self._update(h, np.concatenate([before[:, None], part[:, :-1]], axis=1), part, end, sums, rate)
                before = part[:, -1]
                losses.append(loss)
        return losses

    def _apply(self, name: str, grad: np.ndarray, sums: dict, rate: float, at=None) -> None:
        """A step for all rows or those at ``at``, distinct ones; a gradient of 0 changes nothing."""
        grad.clip(-1, 1, out=grad)
        s = sums[name] if at is None else sums[name][at]
        s += grad * grad
        if at is not None:
            sums[name][at] = s
        grad /= np.sqrt(s)
        grad *= rate
        if at is None:
            getattr(self, name)[:] -= grad
        else:
            getattr(self, name)[at] -= grad

    def _words_inside(self, flat: np.ndarray, token: np.ndarray, kind: np.ndarray, dflat: np.ndarray, scale: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Loss of words in their classes, and the gradients of ww and bw times scale; adds to dflat.

        Classes with about as many tokens are padded to equal lengths and worked on side by
        side. The last row of flat and dflat stands for what is padded.
        """
        order = np.append(np.argsort(kind, kind="stable"), len(token))
        counts = np.bincount(kind, minlength=self.ww.shape[0])[: self.ww.shape[0]]
        first = np.cumsum(counts) - counts
        size = np.maximum(np.ceil(np.log2(np.maximum(counts, 1))), 3)
        dw, db, loss = np.zeros_like(self.ww), np.zeros_like(self.bw), 0.0
        for step in np.unique(size[counts > 0]):
            ks = np.flatnonzero((size == step) & (counts > 0))
            place = np.arange(counts[ks].max())
            inside = place < counts[ks][:, None]
            at = order[np.where(inside, first[ks][:, None] + place, len(token))]
            x, w = flat[at], self.ww[ks]
            q = x @ w
            q += self.bw[ks][:, None, :]
            total = _exp(q)
            c, r = np.nonzero(inside)
            local = token[at[c, r]] - ks[c] * PER_CLASS
            loss -= np.log(q[c, r, local] / total[c, r] + 1e-30).sum()
            q *= (scale * inside / total)[:, :, None]
            q[c, r, local] -= scale
            dflat[at] += q @ w.transpose(0, 2, 1)
            dw[ks], db[ks] = x.transpose(0, 2, 1) @ q, q.sum(axis=1)
        return loss, dw, db

    def _update(self, h0: np.ndarray, inputs: np.ndarray, wanted: np.ndarray, end: int, sums: dict, rate: float) -> tuple[float, np.ndarray]:
        n, steps = inputs.shape
        m, f = self.hidden, np.float32
        scale = f(1.0 / n)
        given = np.ascontiguousarray(inputs.T)
        starts = given == end  # a text begins without a state
        some = starts.any(axis=1)
        goes_on = (~starts)[:, :, None].astype(f)
        x = self.table[given]
        x += self.b
        xg, xn = np.negative(x[:, :, : 2 * m]), np.ascontiguousarray(x[:, :, 2 * m :])
        ug, un = np.negative(self.u[:, : 2 * m]), np.ascontiguousarray(self.u[:, 2 * m :])
        prev, news, inner = (np.empty((steps, n, m), f) for _ in range(3))
        gates, hs = np.empty((steps, n, 2 * m), f), np.zeros((steps * n + 1, m), f)
        by_step = hs[:-1].reshape(steps, n, m)
        h = h0
        with np.errstate(over="ignore"):
            for t in range(steps):
                p, a, new = prev[t], gates[t], news[t]
                if some[t]:
                    np.multiply(h, goes_on[t], out=p)
                else:
                    p[:] = h
                np.matmul(p, ug, out=a)
                a += xg[t]
                np.exp(a, out=a)
                a += 1
                np.reciprocal(a, out=a)
                np.matmul(p, un, out=inner[t])
                np.multiply(a[:, m:], inner[t], out=new)
                new += xn[t]
                np.tanh(new, out=new)
                h = by_step[t]
                np.subtract(p, new, out=h)
                h *= a[:, :m]
                h += new
        # Output layer for all steps at once, rows by step.
        flat, token = hs[:-1], wanted.T.reshape(-1)
        kind, rows = self.class_of(token), np.arange(n * steps)
        p = flat @ self.wc
        p += self.bc
        total = _exp(p)
        loss = -np.log(p[rows, kind] / total + 1e-30).sum()
        p *= (scale / total)[:, None]
        p[rows, kind] -= scale
        dflat = np.zeros((n * steps + 1, m), f)
        np.matmul(p, self.wc.T, out=dflat[:-1])
        dwc, dbc = flat.T @ p, p.sum(axis=0)
        more, dww, dbw = self._words_inside(hs, token, kind, dflat, scale)
        # All of a step's gradients are its state's times these.
        z, r = gates[:, :, :m], gates[:, :, m:]
        by_new = (1 - z) * (1 - news * news)
        by = np.empty((steps, n, 3, m), f)
        by[:, :, 0] = (prev - news) * z * (1 - z)
        np.multiply(by_new, r, out=by[:, :, 2])
        by[:, :, 1] = by[:, :, 2] * inner * (1 - r)
        dg, back = np.empty((steps, n, 3 * m), f), np.ascontiguousarray(self.u.T)
        dflat = dflat[:-1].reshape(steps, n, m)
        carry = np.zeros((n, m), f)
        for t in range(steps - 1, -1, -1):
            dh = dflat[t]
            dh += carry
            np.multiply(dh[:, None], by[t], out=dg[t].reshape(n, 3, m))
            np.matmul(dg[t], back, out=carry)
            carry += dh * z[t]
            if some[t]:
                carry *= goes_on[t]
        dg = dg.reshape(-1, 3 * m)
        du = prev.reshape(-1, m).T @ dg
        dg[:, 2 * m :] = (dflat * by_new).reshape(-1, m)
        used, dtable = _sum_by(given.reshape(-1), dg)
        self._apply("table", dtable, sums, rate, used)
        self._apply("b", dg.sum(axis=0), sums, rate)
        for name, grad in (("u", du), ("wc", dwc), ("bc", dbc), ("ww", dww), ("bw", dbw)):
            self._apply(name, grad, sums, rate)
        return float((loss + more) / (n * steps)), h.copy()


def _exp(x: np.ndarray) -> np.ndarray:
    """Turns x into its exponentials but for a factor by row; returns their sums over the last axis."""
    kept = x - x.max()
    ones = np.ones(x.shape[-1], x.dtype)
    np.exp(kept, out=kept)
    total = kept @ ones
    if total.size and total.min() < 1e-20:  # rows that lie far below the greatest value
        kept = np.exp(x - x.max(axis=-1, keepdims=True))
        total = kept @ ones
    x[...] = kept
    return total


def _sum_by(name: np.ndarray, rows: np.ndarray, few: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Distinct names, and the sum of each one's rows."""
    order = np.argsort(name, kind="stable")
    name = name[order]
    first = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
    count = np.diff(np.append(first, len(name)))
    out = rows[order[first]]
    for k in range(1, few):
        at = np.flatnonzero((count > k) & (count <= few))
        out[at] += rows[order[first[at] + k]]
    for i in np.flatnonzero(count > few):
        out[i] = rows[order[first[i] : first[i] + count[i]]].sum(axis=0)
    return name[first], out
