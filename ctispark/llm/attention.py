"""A small causal self-attention model over symbol sequences, in numpy.

One head: keys are the symbols' embeddings, queries and values are linear in
them (a matrix of the keys' own would only be multiplied into that of the
queries); scores get a learned term for the distance, and the attended values
are added to the embedding before the output.

The output has two steps that give each symbol a probability of its own: a
softmax over classes, then, within the class, a tree of decisions down to the
symbol. A decision is logistic in the first BRANCH numbers of the state, with
the log odds of the counts as a fixed term. Counts of neighbours may be given
too: how much more often a class follows this symbol, and how much more often a
decision falls out this way behind a symbol of this class, than all in all.
Embeddings and decisions begin at zero, so what was never trained is as likely
as the counts have it.
"""

import itertools
from typing import NamedTuple

import numpy as np

#: Positions of a window, where a model is not given others; a scoring window begins half of them before the first that it scores.
SPAN = 16
WIDTH, BRANCH = 16, 8


class Outputs(NamedTuple):
    """How symbols are predicted: their classes, the classes' shares, and each symbol's path of decisions, lengths[symbol] entries of nodes and signs from starts[symbol]; odds: the fixed terms of the decisions.

    With counts of neighbours: after, what is added to the classes' terms behind each symbol, and turns, what is added to odds behind each class; the last row of both is for the start of a text.
    """

    classes: np.ndarray
    shares: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    nodes: np.ndarray
    signs: np.ndarray
    odds: np.ndarray
    after: np.ndarray | None = None
    turns: np.ndarray | None = None


def factored(counts: np.ndarray, kind: np.ndarray, classes: int) -> Outputs:
    """Symbols by kind and then by count, cut where a class has its part of all; a class is halved by counts again and again."""
    smooth = counts + 1.0
    order = np.lexsort((-counts, kind))
    before = np.cumsum(smooth[order]) - smooth[order]
    cls = np.empty(len(counts), np.int64)
    cls[order] = np.minimum((before / smooth.sum() * classes).astype(np.int64), classes - 1)
    paths: list[list[tuple[int, int]]] = [[] for _ in counts]
    odds: list[float] = []
    upto = np.concatenate(([0.0], np.cumsum(smooth[order])))
    bounds = np.searchsorted(cls[order], np.arange(classes + 1)).tolist()
    open_ = [(a, b, []) for a, b in zip(bounds, bounds[1:], strict=False) if a < b]
    while open_:
        a, b, path = open_.pop()
        if b - a == 1:
            paths[order[a]] = path
            continue
        middle = (upto[a] + upto[b]) / 2
        k = int(np.searchsorted(upto[a + 1 : b], middle)) + a + 1
        if k > a + 1 and (k >= b or middle - upto[k - 1] < upto[k] - middle):
            k -= 1
        node = len(odds)
        odds.append(float(np.log((upto[k] - upto[a]) / (upto[b] - upto[k]))))
        open_ += [(a, k, [*path, (node, 1)]), (k, b, [*path, (node, -1)])]
    lengths = np.array([len(p) for p in paths], np.int64)
    flat = np.array([step for p in paths for step in p], np.int64).reshape(-1, 2)
    shares = np.bincount(cls, smooth, classes) / smooth.sum()
    return Outputs(cls, shares, np.cumsum(lengths) - lengths, lengths, np.ascontiguousarray(flat[:, 0]), flat[:, 1].astype(np.float32), np.array(odds, np.float32))


def conditioned(out: Outputs, by_symbol: np.ndarray, by_class: np.ndarray, weight: float = 8.0) -> Outputs:
    """out with counts of neighbours: by_symbol of classes behind each symbol, by_class of symbols behind each class; each is mixed with weight times what the counts of all have."""
    shares = np.maximum(out.shares, 1e-6)
    after = np.log((by_symbol + weight * shares) / (by_symbol.sum(axis=1, keepdims=True) + weight)) - np.log(shares)
    owner = np.repeat(np.arange(len(out.lengths)), out.lengths)
    steps = np.repeat(out.starts, out.lengths) + np.arange(len(owner)) - np.repeat(np.cumsum(out.lengths) - out.lengths, out.lengths)
    nodes, up = out.nodes[steps], out.signs[steps] > 0
    p = 1 / (1 + np.exp(-out.odds.astype(np.float64)))
    turns = np.zeros((len(by_class), len(out.odds)), np.float32)
    for k, n in enumerate(by_class):
        yes, no = (np.bincount(nodes[own], n[owner[own]], len(p)) for own in (up, ~up))
        turns[k] = np.log((yes + weight * p) / (no + weight * (1 - p))) - out.odds
    return out._replace(after=after.astype(np.float32), turns=turns)


def _summed(places: np.ndarray, columns: np.ndarray, n: int) -> np.ndarray:
    """A row for each of n places: the sums of what goes there of each of columns, which are long runs of numbers and so quicker than many short rows."""
    out = np.empty((n, len(columns)), columns.dtype)
    for k, column in enumerate(columns):
        out[:, k] = np.bincount(places, column, n)
    return out


def _rows(keys: np.ndarray, columns: np.ndarray, real: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys, below size, in order, a row of the sums of each one's numbers in columns, and how often each is real."""
    there = np.zeros(size, bool)
    there[keys] = True
    distinct = np.flatnonzero(there)
    place = np.empty(size, np.int64)
    place[distinct] = np.arange(len(distinct))
    at = place.take(keys)
    return distinct, _summed(at, columns, len(distinct)), np.bincount(at[real], minlength=len(distinct))


def _exp(m: np.ndarray) -> np.ndarray:
    """exp of the last axis up to a factor of its own, in place; the greatest is only taken off where numbers are large."""
    if not m.max(initial=0) < 60:
        m -= m.max(axis=-1, keepdims=True)
    return np.exp(m, out=m)


class Attention:
    """Predicts the next symbol from those before it; the number behind the last symbol stands before the first."""

    def __init__(self, out: Outputs, span: int = SPAN, seed: int = 7, kind: type = np.float32):
        rng = np.random.default_rng(seed)
        self.out, self.kind, self.span, self.half, self.first = out, kind, span, span // 2, len(out.classes)
        c = len(out.shares)
        self.shapes = {"Q": (WIDTH, WIDTH), "V": (WIDTH, WIDTH), "W": (WIDTH, c), "b": (c,), "r": (span,)}
        self.p = {k: (rng.normal(0, 0.25, s) if len(s) > 1 else np.zeros(s)).astype(kind) for k, s in self.shapes.items()}
        self.p["b"] = np.log(np.maximum(out.shares, 1e-6)).astype(kind)
        self.p["E"] = np.zeros((self.first + 1, WIDTH), kind)
        self.p["U"] = np.zeros((len(out.odds), BRANCH), kind)
        self.groups = np.append(out.classes, len(out.shares))
        self.fixed = None if out.turns is None else (out.turns + out.odds).ravel()
        self.distance = np.arange(span)[:, None] - np.arange(span)

    def table(self) -> np.ndarray:
        """All parameters in rows of BRANCH numbers: embeddings, decisions, then the others, filled up with zeros."""
        flat = np.concatenate([self.p[k].ravel() for k in self.shapes])
        return np.concatenate((self.p["E"].reshape(-1, BRANCH), self.p["U"], np.append(flat, np.zeros(-len(flat) % BRANCH)).reshape(-1, BRANCH))).astype(np.float32)

    def load(self, table: np.ndarray) -> "Attention":
        a, b = self.p["E"].size // BRANCH, len(self.p["U"])
        self.p["E"], self.p["U"] = table[:a].reshape(-1, WIDTH).astype(self.kind), table[a : a + b].astype(self.kind)
        flat, at = table[a + b :].ravel(), 0
        for k, s in self.shapes.items():
            n = int(np.prod(s))
            self.p[k] = flat[at : at + n].reshape(s).astype(self.kind)
            at += n
        return self

    def _steps(self, h: np.ndarray, x: np.ndarray, y: np.ndarray):
        """The decisions on the paths of targets y behind symbols x, depth by depth: whose they are, their states by column, nodes, signs, weights by column and margins; then the targets by the lengths of their paths, longest first, and where each depth begins and the last ends: its decisions are those of the first targets in that order."""
        o = self.out
        lengths = o.lengths.take(y)
        order = np.argsort(-lengths.astype(np.int16), kind="stable")
        deep = len(y) - np.cumsum(np.bincount(lengths))[:-1]
        bounds = np.concatenate(([0], np.cumsum(deep)))
        each = [*deep.tolist(), 0]
        owner = np.concatenate([order[:k] for k in each])
        first = o.starts.take(y).take(order)
        at = np.concatenate([first[:k] + depth for depth, k in enumerate(each)])
        nodes, signs = o.nodes.take(at), o.signs.take(at)
        own = np.ascontiguousarray(h[:, :BRANCH].take(order, axis=0).T)
        state = np.concatenate([own[:, :k] for k in each], axis=1)
        weights = np.ascontiguousarray(self.p["U"].take(nodes, axis=0).T)
        margin = (state * weights).sum(axis=0)
        if o.turns is None:
            margin += o.odds.take(nodes)
        else:
            place = (self.groups.take(x) * len(o.odds)).take(owner)
            place += nodes
            margin += self.fixed.take(place)
        margin *= signs
        return owner, state, nodes, signs, weights, np.clip(margin, -60, 60, out=margin), order, bounds.tolist()

    def gradients(self, x: np.ndarray, y: np.ndarray, real: np.ndarray, measured: bool = False) -> tuple[float, dict]:
        """Mean loss (if measured) of targets y after symbols x (windows by span, where real), and gradients; those of E and U are rows' numbers, rows, and how often each was used."""
        p, root, ones = self.p, self.kind(np.sqrt(WIDTH)), lambda *n: np.ones(n, self.kind)
        blocks = lambda m: m.reshape(-1, self.span, WIDTH)
        flip = lambda m: m.transpose(0, 2, 1)
        xs, ys, n, span = x.ravel(), y.ravel(), x.size, self.span
        told = real.ravel()
        weight = told.astype(self.kind) / self.kind(max(1, int(real.sum())))
        e = p["E"].take(xs, axis=0)
        keys = np.ascontiguousarray(flip(blocks(e)))
        # shares above their gradients, and gradients of attended values above queries: what both give the keys is one product
        shares, given = np.empty((len(x), 2 * span, span), self.kind), np.empty((len(x), 2 * span, WIDTH), self.kind)
        s, ds = shares[:, :span], shares[:, span:]
        q = given[:, span:]
        q[...] = blocks(e @ (p["Q"] / root))
        np.matmul(q, keys, out=s)
        s += np.where(self.distance >= 0, p["r"][np.maximum(self.distance, 0)], self.kind(-np.inf))
        _exp(s)
        total = (s @ ones(span, 1)).reshape(n, 1)
        c = (s @ blocks(e)).reshape(n, -1)
        c /= total
        h = c @ p["V"]
        h += e
        # classes
        z = h @ p["W"]
        z += p["b"]
        if self.out.after is not None:
            z += self.out.after.take(xs, axis=0)
        _exp(z)
        sums, cls = z @ ones(z.shape[1], 1), np.arange(n) * z.shape[1] + self.out.classes.take(ys)
        flat = z.reshape(-1)
        loss = -float((np.log(np.maximum(flat[cls] / sums[:, 0], 1e-30)) * weight).sum()) if measured else 0.0
        z *= weight[:, None] / sums
        flat[cls] -= weight
        dh = z @ p["W"].T
        # decisions within the class
        owner, state, nodes, signs, weights, margin, order, bounds = self._steps(h, xs, ys)
        own = weight.take(owner)
        if measured:
            loss += float((np.log1p(np.exp(-margin)) * own).sum())
        own *= signs
        np.exp(margin, out=margin)
        margin += 1
        own /= margin
        weights *= own
        state *= -own
        back = np.zeros((BRANCH, n), self.kind)
        for a, b in itertools.pairwise(bounds):
            back[:, : b - a] += weights[:, a:b]
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        dh[:, :BRANCH] -= np.ascontiguousarray(back.T).take(place, axis=0)
        found = {"W": h.T @ z, "b": (ones(1, n) @ z)[0], "U": _rows(nodes, state, told.take(owner), len(p["U"]))}
        # attention; the sum of gradients times shares is that of gradients times attended values
        dc = dh @ p["V"].T
        found["V"] = c.T @ dh
        dc /= total
        given[:, :span] = blocks(dc)
        np.matmul(given[:, :span], keys, out=ds)
        c *= dc
        ds -= (c @ ones(WIDTH, 1)).reshape(*x.shape, 1)
        ds *= s
        dq = (ds @ blocks(e)).reshape(n, -1)
        de = dq @ (p["Q"].T / root)
        de += dh
        de3 = blocks(de)
        de3 += flip(shares) @ given
        by = (ones(1, len(x)) @ shares.reshape(len(x), -1)).reshape(2 * span, span)[span:]
        found["r"] = np.bincount(np.maximum(self.distance, 0).ravel(), np.where(self.distance >= 0, by, 0).ravel(), span)
        return loss, found | {"Q": e.T @ dq / root, "E": _rows(xs, np.ascontiguousarray(de.T), told, len(p["E"]))}

    def scorer(self):
        """A function of (symbols, lengths), sequences one behind the other: the natural log of each symbol's probability."""
        p, half, span, classes = self.p, self.half, self.span, self.out.classes
        first, none = self.first, self.first + 1  # before a sequence; nothing there
        e = np.concatenate((p["E"], np.zeros((1, WIDTH), self.kind)))
        query = p["Q"] / self.kind(np.sqrt(WIDTH))
        ahead = np.arange(half)[:, None] + half - np.arange(span)
        near = np.where(ahead >= 0, p["r"][np.maximum(ahead, 0)], self.kind(-np.inf))
        # what a symbol and what is attended to add to the classes' terms and to the first numbers of the state
        given = p["E"] @ p["W"] + p["b"] + (0 if self.out.after is None else self.out.after)
        attended = np.concatenate((p["V"] @ p["W"], p["V"][:, :BRANCH]), axis=1)

        def score(symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
            # each sequence gets half places of nothing in front, and is filled up to a multiple of half
            blocks = -(-lengths // half)
            places = (blocks + 1) * half
            starts = np.cumsum(places) - places + half
            at = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(len(symbols))
            x, y = np.full(int(places.sum()), none), np.zeros(int(places.sum()), np.int64)
            y[at] = symbols
            x[starts[lengths > 0]] = first
            inner = np.ones(len(symbols), bool)
            inner[np.cumsum(lengths)[lengths > 0] - 1] = False
            x[at[inner] + 1] = symbols[inner]
            filled = np.zeros(len(x), bool)
            filled[at] = True
            x, y, filled = x.reshape(-1, half), y.reshape(-1, half), filled.reshape(-1, half)
            asked = np.ones(len(x), bool)
            asked[(np.cumsum(blocks + 1) - blocks - 1)] = False
            rows = np.flatnonzero(asked)
            out = np.zeros(x.shape, np.float64)
            for k in range(0, len(rows), 512):
                own = rows[k : k + 512]
                kept = e.take(np.concatenate((x[own - 1], x[own]), axis=1), axis=0)
                late = kept[:, half:].reshape(-1, WIDTH)
                s = (late @ query).reshape(-1, half, WIDTH) @ kept.transpose(0, 2, 1)
                s += near
                empty = x[own - 1, 0] == none  # the first block of a sequence
                s[empty, :, :half] = -np.inf
                _exp(s)
                c = (s @ kept).reshape(-1, WIDTH)
                c /= s.reshape(len(c), -1) @ np.ones((span, 1), self.kind)
                z = c @ attended
                h = z[:, -BRANCH:] + late[:, :BRANCH]
                real = np.flatnonzero(filled[own])
                behind, targets = np.minimum(x[own].ravel(), first).take(real), y[own].ravel().take(real)
                z = z[:, :-BRANCH].take(real, axis=0)
                z += given.take(behind, axis=0)
                _exp(z)
                got = np.log(z.ravel().take(np.arange(len(z)) * z.shape[1] + classes.take(targets)) / (z @ np.ones(z.shape[1], self.kind)))
                _, _, _, _, _, margin, order, bounds = self._steps(h.take(real, axis=0), behind, targets)
                lost = np.log(np.exp(-margin) + 1)
                paths = np.zeros(len(targets), self.kind)
                for a, b in itertools.pairwise(bounds):
                    paths[: b - a] += lost[a:b]
                got[order] -= paths
                block = np.zeros(len(own) * half)
                block[real] = got
                out[own] = block.reshape(-1, half)
            return out.ravel()[at]

        return score


def train(model: Attention, windows, rate: float = 0.02, before: np.ndarray | None = None, decided: np.ndarray | None = None) -> int:
    """Adam over windows, (x, y, real) batches, and Adagrad for embeddings and decisions. Returns how many targets it has seen; adds to before how often each symbol stood before them, and to decided how often each decision was made."""
    m = {k: np.zeros(s) for k, s in model.shapes.items()}
    v = {k: np.zeros(s) for k, s in model.shapes.items()}
    squares = {k: np.zeros(model.p[k].shape, model.kind) for k in ("E", "U")}
    seen = t = 0
    for x, y, real in windows:
        _, g = model.gradients(x, y, real)
        t += 1
        seen += int(real.sum())
        for k, counts, faster in (("E", before, 5), ("U", decided, 10)):
            at, rows, times = g.pop(k)
            if counts is not None:
                counts[at] += times
            now = squares[k].take(at, axis=0)
            now += rows * rows
            squares[k][at] = now
            np.sqrt(now, out=now)
            now += model.kind(1e-8)
            rows *= model.kind(faster * rate * min(1.0, t / 20))
            rows /= now
            model.p[k][at] = model.p[k].take(at, axis=0) - rows
        for k in g:
            m[k] += 0.1 * (g[k] - m[k])
            v[k] += 0.01 * (g[k] ** 2 - v[k])
            step = rate * min(1.0, t / 20) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
            model.p[k] = (model.p[k] - step).astype(model.kind)
    return seen
