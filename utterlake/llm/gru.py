"""A small gated recurrent language model in numpy: class-factored softmax, truncated backpropagation, carried state."""

from __future__ import annotations

import numpy as np

#: Words in a class of the output layer, at least.
CLASS = 64
#: Logits that are worked out at once, so that they stay in a core's cache.
BLOCK = 1 << 17
#: Inputs for words outside the vocabulary, by a hash of their endings.
ENDINGS = 512


#: Factors of the gates' inputs: the first two go halved into _sigmoid.
HALVED = np.array([0.5, 0.5, 1], np.float32).reshape(3, 1, 1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """Of twice x, in place; tanh has no overflow."""
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


def _softmax(h: np.ndarray, place: np.ndarray, bounds: list, w: np.ndarray, grad: np.ndarray | None) -> tuple[np.ndarray, np.ndarray | None]:
    """(log probability at each row's place, gradient for h, if grad is given; grad then takes up the gradient of w).

    Rows from bounds[k] to bounds[k + 1] choose among the outputs of class k, w[k]. The last column of h is 1 and the last one of w the
    biases, so the products take them in. Only products go class by class; all else is done for a block of rows at once, whatever their
    classes. Probabilities are never divided by their sums: rows of h and of its gradient are, which are shorter.

    Logits are log frequencies plus small corrections and are clipped far from overflow, where a state within -1 and 1 could get there.
    """
    width = w.shape[1]
    clip = np.max(np.abs(w) @ np.ones(w.shape[2], w.dtype), initial=0) > 59
    rows = max(1, BLOCK // width)
    x = np.empty((min(rows, len(h)), width), h.dtype)
    ones = np.ones(width, h.dtype)
    out = np.empty(len(h), h.dtype)
    dh = None if grad is None else np.empty_like(h)
    k = 0
    for a in range(0, len(h), rows):
        b = min(a + rows, len(h))
        parts = []
        while bounds[k] < b:
            first, end = max(a, bounds[k]), min(b, bounds[k + 1])
            if end > first:
                parts.append((k, slice(first, end), x[first - a : end - a]))
            if bounds[k + 1] > b or k + 2 == len(bounds):
                break
            k += 1
        y = x[: b - a]
        for c, own, d in parts:
            np.matmul(h[own], w[c].T, out=d)
        if clip:
            np.clip(y, -60, 60, out=y)
        at = np.arange(0, y.size, width) + place[a:b]
        flat = y.ravel()
        got = flat[at]
        np.exp(y, out=y)
        total = y @ ones
        np.subtract(got, np.log(total), out=out[a:b])
        if grad is not None:
            flat[at] -= total
            total = total[:, None]
            hs = h[a:b] / total
            for c, own, d in parts:
                grad[c] += d.T @ hs[own.start - a : own.stop - a]
                np.matmul(d, w[c], out=dh[own])
            dh[a:b] /= total
    return out, dh


class Model:
    """Parameters by name. Outputs: class 0 stands for all words outside the vocabulary, class 1 + i // size holds word i.

    A large vocabulary has about as many classes as words in a class, so the output of a token costs the root of the vocabulary.
    """

    def __init__(self, words: int, hidden: int = 16, seed: int = 6, counts: np.ndarray | None = None, rest: float = 1.0):
        self.words, self.hidden = words, hidden
        self.size = CLASS
        while self.size**2 < words:
            self.size *= 2
        self.classes = 1 + -(-words // self.size)
        rng = np.random.default_rng(seed)

        def draw(*shape, scale):
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        self.p = {
            # inputs: the words, the endings, the start of a text
            "embed": draw(words + ENDINGS + 1, hidden, scale=0.3),
            # update gate, reset gate, candidate
            "wx": draw(3, hidden, hidden, scale=hidden**-0.5),
            "wh": draw(3, hidden, hidden, scale=hidden**-0.5),
            "b": np.zeros((3, 1, hidden), np.float32),
            "wc": draw(hidden, self.classes, scale=0.05),
            "bc": np.zeros(self.classes, np.float32),
            "wo": draw((self.classes - 1) * self.size, hidden, scale=0.05),
            "bo": np.full((self.classes - 1) * self.size, -30, np.float32),
        }
        if counts is not None:
            # start at the frequencies of the corpus
            self.p["bo"][:words] = np.log(counts + 0.5)
            padded = np.zeros((self.classes - 1) * self.size)
            padded[:words] = counts
            self.p["bc"][:] = np.log(np.concatenate(([rest], padded.reshape(-1, self.size).sum(1))) + 0.5)

    @property
    def start(self) -> int:
        return self.words + ENDINGS

    def pack(self) -> bytes:
        return b"".join(v.tobytes() for v in self.p.values())

    def unpack(self, blob: bytes) -> Model:
        at = 0
        flat = np.frombuffer(blob, np.float32)
        for k, v in self.p.items():
            self.p[k] = flat[at : at + v.size].reshape(v.shape).copy()
            at += v.size
        return self

    def table(self) -> np.ndarray:
        """What each input adds to the gates, (3, inputs, hidden)."""
        return np.matmul(self.p["embed"], self.p["wx"] * HALVED) + self.p["b"] * HALVED

    def recur(self, inputs: np.ndarray, fresh: np.ndarray, state: np.ndarray, table: np.ndarray | None = None):
        """Hidden states (steps, lanes, hidden) of inputs (steps, lanes). fresh: lanes whose text starts at a step. With the table of these
        parameters nothing is kept for learning."""
        steps, lanes = inputs.shape
        n = self.hidden
        wh = self.p["wh"] * HALVED
        if table is None:
            x = self.p["embed"].take(inputs, 0)
            ax = np.matmul(x.reshape(-1, n), self.p["wx"] * HALVED)
            ax += self.p["b"] * HALVED
            ax = ax.reshape(3, steps, lanes, n)
        else:
            x, ax = None, table.take(inputs, 1)
        out = np.empty((steps, lanes, n), state.dtype)
        cache = []
        ah = zr = c = None
        for t, starts in enumerate(fresh.any(1).tolist()):
            if starts:
                state = state * ~fresh[t][:, None]
            ah = np.matmul(state, wh, out=ah)
            zr = np.add(ax[:2, t], ah[:2], out=zr)
            z, r = _sigmoid(zr)
            c = np.multiply(r, ah[2], out=c)
            c += ax[2, t]
            np.tanh(c, out=c)
            if table is None:
                cache.append((state, z, r, c, ah[2]))
            state = np.subtract(state, c, out=out[t])
            state *= z
            state += c
            if table is None:
                ah = zr = c = None
        return out, state.copy(), x, cache

    def log_probs(self, h: np.ndarray, targets: np.ndarray, grad: dict | None = None):
        """(natural log probability of each target, gradient for h). targets: words, -1 for one outside the vocabulary."""
        p, n = self.p, self.hidden
        h = np.concatenate((h, np.ones((len(h), 1), h.dtype)), 1)
        wc = np.concatenate((p["wc"].T, p["bc"][:, None]), 1)[None]
        wo = np.concatenate((p["wo"], p["bo"][:, None]), 1).reshape(-1, self.size, n + 1)
        dwc, dwo = (None, None) if grad is None else (np.zeros_like(wc), np.zeros_like(wo))
        # sizes are powers of two, and -1 shifted is -1
        group = ((targets >> (self.size.bit_length() - 1)) + 1).astype(np.int32)
        first, dh = _softmax(h, group, [0, len(h)], wc, dwc)
        out = first.astype(np.float64)
        # rows in the order of their classes, so that a class is a slice
        order = np.argsort(group if self.classes > 1 << 15 else group.astype(np.int16), kind="stable")
        bounds = np.searchsorted(group[order], np.arange(1, self.classes + 1))
        order = order[bounds[0] :]
        if len(order):
            more, dhs = _softmax(h.take(order, 0), targets[order] & (self.size - 1), (bounds - bounds[0]).tolist(), wo, dwo)
            # back in the order of the rows, with nothing for those of class 0
            back = np.full(len(h), len(order))
            back[order] = np.arange(len(order))
            out += np.append(more, 0).take(back)
            if grad is not None:
                dh += np.concatenate((dhs, np.zeros_like(dhs[:1]))).take(back, 0)
        if grad is not None:
            dwo = dwo.reshape(-1, n + 1)
            grad["wc"] += dwc[0, :, :n].T
            grad["bc"] += dwc[0, :, n]
            grad["wo"] += dwo[:, :n]
            grad["bo"] += dwo[:, n]
            dh = np.ascontiguousarray(dh[:, :n])
        return out, dh

    def learn(self, inputs, fresh, targets, live, state, adam: dict, rate: float):
        """One step over a window: forward, back through the window only, Adam. Returns the state to carry on with."""
        steps, lanes = inputs.shape
        n = self.hidden
        h, last, x, cache = self.recur(inputs, fresh, state)
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        flat = np.flatnonzero(live.ravel())
        if len(flat) == live.size:
            dh = self.log_probs(h.reshape(-1, n), targets.ravel(), grad)[1]
        else:
            dflat = self.log_probs(h.reshape(-1, n).take(flat, 0), targets.ravel()[flat], grad)[1]
            dh = np.zeros((steps * lanes, n), dflat.dtype)
            dh[flat] = dflat
        dh = dh.reshape(steps, lanes, n)
        dax = np.empty((3, steps, lanes, n), dh.dtype)
        dah = np.empty((3, lanes, n), dh.dtype)
        carry = np.zeros((lanes, n), dh.dtype)
        back = np.ascontiguousarray(self.p["wh"].transpose(0, 2, 1))
        for t in range(steps - 1, -1, -1):
            before, z, r, c, ahc = cache[t]
            d = dh[t]
            d += carry
            dz, dr, dc = dax[0, t], dax[1, t], dax[2, t]
            np.multiply(d, z, out=carry)
            np.subtract(before, c, out=dz)
            dz *= carry
            dz *= 1 - z
            np.subtract(d, carry, out=dc)
            dc *= 1 - c * c
            np.multiply(dc, r, out=dah[2])
            np.multiply(dah[2], ahc, out=dr)
            dr *= 1 - r
            dah[0], dah[1] = dz, dr
            grad["wh"] += np.matmul(before.T, dah)
            for part in np.matmul(dah, back):
                carry += part
            if fresh[t].any():
                carry *= ~fresh[t][:, None]
        dax = dax.reshape(3, -1, n)
        grad["b"] += np.matmul(np.ones((1, dax.shape[1]), dax.dtype), dax)
        grad["wx"] += np.matmul(x.reshape(-1, n).T, dax)
        dx = np.matmul(dax, self.p["wx"].transpose(0, 2, 1)).sum(0)
        ids = inputs.ravel()
        order = np.argsort(ids.astype(np.uint16 if self.start < 1 << 16 else np.int32), kind="stable")
        ids = ids[order]
        first = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
        grad["embed"][ids[first]] = np.add.reduceat(dx.take(order, 0), first)
        # a tenth of the mean gradient
        scale = 0.1 / max(1, len(flat))
        adam["t"] = t = adam.get("t", 0) + 1
        for k, g in grad.items():
            g *= scale
            if "m" + k not in adam:
                adam["m" + k], adam["v" + k] = np.zeros_like(g), np.zeros_like(g)
            m, v = adam["m" + k], adam["v" + k]
            m *= 0.9
            m += g
            v *= 0.99
            # a hundredth of the gradient's square
            g *= g
            v += g
            np.sqrt(v, out=g)
            g += 1e-6
            np.divide(m, g, out=g)
            g *= rate * (1 - 0.99**t) ** 0.5 / (1 - 0.9**t)
            self.p[k] -= g
        return last


def lanes_of(counts: np.ndarray, lanes: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Lane and first step of each text, and the steps of the longest lane: long texts first, always to the shortest lane."""
    import heapq

    lane, begin = np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
    heap = [(0, k) for k in range(max(1, min(lanes, len(counts))))]
    for d in np.argsort(-counts, kind="stable").tolist():
        used, k = heap[0]
        lane[d], begin[d] = k, used
        heapq.heapreplace(heap, (used + int(counts[d]), k))
    return lane, begin, max(u for u, _ in heap)


def arrange(counts: np.ndarray, offs: np.ndarray, inputs: np.ndarray, lanes: int):
    """Tokens of texts laid out as (steps, lanes): inputs, fresh, live, the place of each token in the flat layout, and how many
    lanes reach each step; lanes come longest first, so these are the first ones."""
    lane, begin, steps = lanes_of(counts, lanes)
    width = int(lane.max(initial=0)) + 1
    ends = np.zeros(width, np.int64)
    np.maximum.at(ends, lane, begin + counts)
    order = np.argsort(-ends, kind="stable")
    number = np.empty(width, np.int64)
    number[order] = np.arange(width)
    lane = number[lane]
    place = np.repeat(begin * width + lane - offs[:-1] * width, counts) + np.arange(int(offs[-1])) * width
    grid = np.zeros(steps * width, np.int64)
    grid[place] = inputs
    fresh = np.zeros(steps * width, bool)
    fresh[place[offs[:-1][counts > 0]]] = True
    live = np.zeros(steps * width, bool)
    live[place] = True
    shape = (steps, width)
    reach = width - np.searchsorted(ends[order][::-1], np.arange(steps), "right")
    return grid.reshape(shape), fresh.reshape(shape), live.reshape(shape), place, reach


def arrange_evenly(offs: np.ndarray, inputs: np.ndarray, lanes: int):
    """Tokens laid end to end and cut into lanes of one length, whatever the texts: inputs, fresh, live and places. A lane may begin
    within a text, with an empty state."""
    n = len(inputs)
    steps = -(-n // lanes)
    i = np.arange(n)
    place = i % steps * lanes + i // steps
    grid = np.zeros(steps * lanes, np.int64)
    grid[place] = inputs
    fresh = np.zeros(steps * lanes, bool)
    fresh[place[offs[:-1]]] = True
    fresh[:lanes] = True
    live = np.zeros(steps * lanes, bool)
    live[place] = True
    return grid.reshape(steps, lanes), fresh.reshape(steps, lanes), live.reshape(steps, lanes), place
