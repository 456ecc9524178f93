"""A gated recurrent language model with a class-factored softmax, in numpy.

Tokens are small integers: 0 ends a text, 1..n_words are words with outputs of
their own, and the rest fall into buckets. An output word's probability is that
of its class times that within the class; for a bucket the class is all.
Many texts run side by side in lanes; a lane takes one text after another, and
its state is carried from window to window until the text ends.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

HIDDEN = 24
CLASSES = 40
BUCKETS = 32
#: Rows of logits at a time, which stay in the processor's cache.
ROWS = 2048
#: Times the width that a window has at the utmost when texts are scored and few lanes are left.
#: In learning a window is a step, and fewer steps were measured to learn less.
LONGER = 32


@dataclass
class Layout:
    """Output words sorted by class: `edges` cut 0..n_words into classes."""

    n_words: int
    edges: np.ndarray
    n_buckets: int = BUCKETS

    @property
    def n_classes(self) -> int:
        return len(self.edges) - 1

    def class_of(self) -> np.ndarray:
        words = np.repeat(np.arange(self.n_classes), np.diff(self.edges))
        return np.concatenate([words, self.n_classes + np.arange(self.n_buckets)]).astype(np.int32)


def layout(counts: np.ndarray, classes: int = CLASSES) -> Layout:
    """Classes of about equal mass of root counts; counts of 0..n_words fall."""
    mass = np.cumsum(np.sqrt(np.maximum(counts, 1)))
    edges = np.searchsorted(mass, mass[-1] * np.arange(1, classes) / classes, "left")
    return Layout(len(counts) - 1, np.unique(np.concatenate([[0], edges, [len(counts)]])))


def init(lay: Layout, counts: np.ndarray, bucket_mass: np.ndarray, seed: int = 1) -> dict[str, np.ndarray]:
    """Parameters whose output biases are the unigram frequencies."""
    rng, h, n_in = np.random.default_rng(seed), HIDDEN, lay.n_words + 1 + lay.n_buckets
    small = lambda *shape: (0.1 * rng.standard_normal(shape)).astype(np.float32)
    words = np.maximum(counts.astype(float), 0.5)
    mass = np.concatenate([np.add.reduceat(words, lay.edges[:-1]), np.maximum(bucket_mass.astype(float), 0.5)])
    inside = np.log(words / np.repeat(mass[: lay.n_classes], np.diff(lay.edges)))
    return {"input": small(n_in, 3 * h), "state": small(h, 3 * h), "gate": np.zeros(3 * h, np.float32), "class": small(h, len(mass)), "class_bias": np.log(mass / mass.sum()).astype(np.float32), "word": small(h, lay.n_words + 1), "word_bias": inside.astype(np.float32)}


def pack(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)])


def unpack(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def lanes(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the texts, lane after lane, and the lanes' tokens, longest first."""
    order = np.argsort(-sizes, kind="stable")
    n = min(most, len(sizes))
    lane_of = np.empty(len(sizes), np.int64)
    lane_of[order[:n]] = np.arange(n)
    if len(sizes) > n:  # the longest one each, the rest evenly by the running total
        load = sizes[order[:n]]
        rest = order[n:]
        room = np.cumsum(np.maximum(0, max(int(load.max()), -(-int(sizes.sum()) // n)) - load))
        middle = np.cumsum(sizes[rest]) - sizes[rest] / 2
        lane_of[rest] = np.minimum(np.searchsorted(room * (sizes[rest].sum() / max(room[-1], 1)), middle, "right"), n - 1)
    load = np.bincount(lane_of, sizes, n).astype(np.int64)
    rank = np.empty(n, np.int64)
    rank[np.argsort(-load, kind="stable")] = np.arange(n)
    return np.argsort(rank[lane_of], kind="stable"), np.sort(load)[::-1]


class Network:
    def __init__(self, lay: Layout, params: dict[str, np.ndarray], sums: dict[str, np.ndarray] | None = None):
        self.lay, self.p, self.class_of = lay, params, lay.class_of()
        self.several = np.concatenate([np.diff(lay.edges) > 1, np.zeros(lay.n_buckets, bool)])
        self.sums = sums or {k: np.full(v.shape, 1e-6, np.float32) for k, v in params.items()}

    # -- forward -------------------------------------------------------------

    def _window(self, h: np.ndarray, x: np.ndarray, start: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """States after each input of the window (steps, lanes, HIDDEN). Within, a row is a
        feature of all lanes, so that every operation is one run over memory."""
        p, d = self.p, HIDDEN
        out, tape = np.empty((*x.shape, d), p["state"].dtype), []
        state, h = np.ascontiguousarray(p["state"].T), np.ascontiguousarray(h.T)
        for t in range(len(x)):
            if start[t].any():
                h = np.where(start[t], 0, h).astype(h.dtype)
            given = p["input"][x[t]]
            given += p["gate"]
            given = given.T
            s = state @ h
            zr = s[: 2 * d] + given[: 2 * d]
            np.negative(zr, out=zr)
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            z, r = zr[:d], zr[d:]
            c = r * s[2 * d :]
            c += given[2 * d :]
            np.tanh(c, out=c)
            if keep:
                tape.append((h, z, r, c, s[2 * d :]))
            h = z * (h - c)
            h += c
            out[t] = h.T
        return out, tape

    def _outputs(self, h: np.ndarray, y: np.ndarray, learn: bool) -> tuple[np.ndarray, np.ndarray | None, dict[str, np.ndarray]]:
        """Natural log-probabilities of the targets; with `learn` also the gradients.

        Rows go by target, so those of a class are neighbours; a column of ones takes the
        biases along. Errors are never written out: the softmax and target parts of the
        gradients are summed apart, the latter for all rows at once.
        """
        p, lay = self.p, self.lay
        order = np.argsort(y.astype(np.int16) if lay.n_words + lay.n_buckets < 1 << 15 else y, kind="stable")
        y = y[order]
        c = self.class_of[y]
        x = np.empty((len(y), HIDDEN + 1), h.dtype)
        x[:, :HIDDEN], x[:, HIDDEN] = h[order], 1
        logp = np.zeros(len(y), h.dtype)
        dx = np.zeros_like(x) if learn else None
        grads: dict[str, np.ndarray] = {}
        several = self.several[c]  # whose class has several words
        places = np.arange(max(ROWS, len(y)))
        blocks = [(i, min(i + ROWS, len(y)), 0, len(p["class_bias"])) for i in range(0, len(y), ROWS)]
        for name, target, rows, own in (("class", c, slice(None), blocks), ("word", y, several, self._segments(c))):
            w = np.concatenate([p[name].T, p[name + "_bias"][:, None]], 1)
            # no logit is above this, so no exponential overflows
            top = float((np.abs(p[name]).sum(0) + p[name + "_bias"]).max())
            if safe := top - float(p[name + "_bias"].min()) < 60:
                w[:, HIDDEN] -= top
            ones, sums, total = np.ones(len(w), w.dtype), np.zeros_like(w), np.ones(len(y), w.dtype)
            most = np.zeros(len(y), w.dtype)
            named = np.empty(len(y), w.dtype)  # the targets' logits; in learning their weights are gathered anyway
            for i, j, a, b in own:
                part, given = w[a:b], x[i:j]
                e = given @ part.T
                if not learn:
                    named[i:j] = e[places[: j - i], target[i:j] - a]
                if not safe:
                    most[i:j] = e.max(1)
                    e -= most[i:j, None]
                np.exp(e, out=e)
                total[i:j] = size = e @ ones[a:b]
                if learn:
                    share = (1 / size)[:, None]
                    sums[a:b] += e.T @ (given * share)
                    back = e @ part
                    back *= share
                    dx[i:j] += back
            if learn:
                given, target = x[rows], target[rows]
                chosen = w[target]
                named[rows] = np.einsum("ij,ij->i", given, chosen)
                dx[rows] -= chosen
                if len(target):
                    new = np.flatnonzero(np.diff(target, prepend=-1))
                    sums[target[new]] -= np.add.reduceat(given, new, 0)
                grads[name], grads[name + "_bias"] = np.ascontiguousarray(sums[:, :HIDDEN].T), sums[:, HIDDEN]
            logp[rows] += named[rows] - most[rows] - np.log(total[rows])
        back_to = np.empty_like(order)
        back_to[order] = np.arange(len(order))
        return logp[back_to], dx[back_to, :HIDDEN] if learn else None, grads

    def _segments(self, c: np.ndarray) -> list[tuple[int, int, int, int]]:
        """Of sorted classes the rows of each class with several words, and its words."""
        cuts = np.searchsorted(c, np.arange(self.lay.n_classes + 1)).tolist()
        edges = self.lay.edges.tolist()
        return [(i, j, a, b) for i, j, a, b in zip(cuts, cuts[1:], edges, edges[1:]) if j > i and b - a > 1]

    def _windows(self, tokens: list[np.ndarray], width: int, most: int, longer: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Inputs, starts, targets (-1: none) and places of each window, and the lanes'
        states, which the caller replaces in place. Lanes that have ended drop out; the
        windows of the others get up to `longer` times as long, so each has about as many tokens."""
        if not tokens:
            return
        sizes = np.array([len(t) for t in tokens], np.int64)
        order, load = lanes(sizes, most)
        flat = np.concatenate([tokens[i] for i in order.tolist()])
        first = np.cumsum(sizes[order]) - sizes[order]
        begin = (np.cumsum(sizes) - sizes)[order]
        place = np.arange(len(flat)) + np.repeat(begin - first, sizes[order])
        starts = np.zeros(len(flat), bool)
        starts[first] = True
        given = np.concatenate([[0], flat[:-1]])
        given[starts] = 0
        lane = np.cumsum(load) - load
        h = np.zeros((len(load), HIDDEN), np.float32)
        a = 0
        while a < load[0]:
            n = int(np.searchsorted(-load, -a, "left"))
            step = a + np.arange(min(width * min(longer, len(load) // n), int(load[0]) - a))[:, None]
            a += len(step)
            inside = step < load[:n]
            at = np.where(inside, lane[:n] + step, 0)
            yield given[at], starts[at] & inside, np.where(inside, flat[at], -1), place[at], h[:n]

    def log_probabilities(self, tokens: list[np.ndarray], width: int = 32, most: int = 1024) -> np.ndarray:
        """Natural log-probability of every token, of its class only for a bucket."""
        out = np.zeros(sum(map(len, tokens)))
        for x, s, y, place, h in self._windows(tokens, width, most, LONGER):
            states, _ = self._window(h, x, s, False)
            h[:] = states[-1]
            have = y >= 0
            out[place[have]] = self._outputs(states[have], y[have], False)[0]
        return out

    # -- learning --------------------------------------------------------------

    def learn(self, tokens: list[np.ndarray], every: int = 1, rate: float = 0.08, width: int = 16, most: int = 512) -> int:
        """One pass of truncated backpropagation: all windows carry the state on, one
        window in `every` is learnt from, in turn. Returns tokens learnt from."""
        learnt = 0
        for k, (x, s, y, _, h) in enumerate(self._windows(tokens, width, most)):
            take = k % every == 0
            states, tape = self._window(h, x, s, take)
            h[:] = states[-1]
            if not take:
                continue
            have = y >= 0
            _, dh, grads = self._outputs(states[have], y[have], True)
            back = np.zeros_like(states)
            back[have] = dh
            self._back(x, s, back, tape, grads)
            learnt += int(have.sum())
            # by the same number in all windows: the few lanes of a long text's end count little
            self._update(grads, width * min(most, len(tokens)), rate)
        return learnt

    def _back(self, x: np.ndarray, start: np.ndarray, back: np.ndarray, tape: list, grads: dict[str, np.ndarray]) -> None:
        d, state = HIDDEN, np.ascontiguousarray(self.p["state"])
        given = np.empty((len(x), 3 * d, x.shape[1]), state.dtype)
        total = np.zeros_like(state)
        dh = np.zeros((d, x.shape[1]), state.dtype)
        u = np.empty_like(given[0])
        for t in range(len(x) - 1, -1, -1):
            h, z, r, c, s = tape[t]
            dh += back[t].T
            g = given[t]
            dc, dz, dr = g[2 * d :], g[:d], g[d : 2 * d]
            np.multiply(dh, 1 - z, out=dc)
            dc *= 1 - c * c
            np.subtract(h, c, out=dz)
            dz *= z * (1 - z)
            dz *= dh
            np.multiply(dc, s, out=dr)
            dr *= r * (1 - r)
            u[: 2 * d] = g[: 2 * d]
            np.multiply(dc, r, out=u[2 * d :])
            total += h @ u.T
            dh *= z
            dh += state @ u
            if start[t].any():
                dh[:, start[t]] = 0
        grads["state"] = total
        flat, ids = np.ascontiguousarray(given.transpose(0, 2, 1)).reshape(-1, 3 * d), x.ravel()
        grads["gate"] = flat.sum(0)
        order = np.argsort(ids.astype(np.int16) if self.lay.n_words + self.lay.n_buckets < 1 << 15 else ids, kind="stable")
        ids = ids[order]
        at = np.flatnonzero(np.diff(ids, prepend=-1))
        grads["input"] = (ids[at], np.add.reduceat(flat[order], at, 0))

    def _update(self, grads: dict, n: int, rate: float) -> None:
        """Adagrad, with each entry's mean gradient limited."""
        for k, g in grads.items():
            rows, g = g if isinstance(g, tuple) else (slice(None), g)
            g = g / n
            np.clip(g, -0.05, 0.05, out=g)
            sums = self.sums[k][rows]
            sums += g * g
            if not isinstance(rows, slice):
                self.sums[k][rows] = sums
            g *= rate
            g /= np.sqrt(sums)
            self.p[k][rows] -= g
