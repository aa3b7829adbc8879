"""A small gated recurrent network with a class-factored softmax, in numpy.

Output i is member i % MEMBERS of class i // MEMBERS: its probability is that of
the class times that of the member within the class, so a token costs one softmax
over the classes and one over MEMBERS. Lanes read one text after another, the
state going on to a text's end and zero where a text begins.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

HIDDEN, EMBED, MEMBERS = 32, 16, 32


def shapes(classes: int) -> list[tuple[str, tuple[int, ...]]]:
    """Parameters in order."""
    h = HIDDEN
    return [("emb", (classes * MEMBERS, EMBED)), ("win", (EMBED, 3 * h)), ("bin", (3 * h,)), ("rec", (h, 3 * h)), ("wcls", (h, classes)), ("bcls", (classes,)), ("wmem", (classes, h, MEMBERS)), ("bmem", (classes, MEMBERS))]


def init(counts: np.ndarray, seed: int = 1) -> dict[str, np.ndarray]:
    """Random weights; counts (classes x MEMBERS) are the corpus's: the biases start at
    them, so the untrained network is the class-factored unigram model."""
    rng = np.random.default_rng(seed)
    p = {k: (rng.standard_normal(s) * 0.1).astype(np.float32) for k, s in shapes(len(counts))}
    p["rec"] = (rng.standard_normal((HIDDEN, 3 * HIDDEN)) / np.sqrt(HIDDEN)).astype(np.float32)
    p["bin"][:] = 0
    p["bin"][:HIDDEN] = 1.0  # hold the state at first
    for w in ("wcls", "wmem"):
        p[w] *= 0.1
    by_class = counts.sum(1)
    p["bcls"] = np.log((by_class + 0.5) / (by_class + 0.5).sum()).astype(np.float32)
    p["bmem"] = np.log((counts + 1e-3) / (counts + 1e-3).sum(1, keepdims=True)).astype(np.float32)
    return p


def flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in p])


def unflat(w: np.ndarray, classes: int) -> dict[str, np.ndarray]:
    """The parameters as views of one vector."""
    out, at = {}, 0
    for k, s in shapes(classes):
        n = int(np.prod(s))
        out[k] = w[at : at + n].reshape(s)
        at += n
    return out


class Scratch:
    """Arrays by name, used again from window to window: fresh ones would cost a page fault a page."""

    def __init__(self, kind):
        self.kind, self.held = kind, {}

    def __call__(self, name: str, *shape: int) -> np.ndarray:
        size = int(np.prod(shape))
        got = self.held.get(name)
        if got is None or len(got) < size:
            got = self.held[name] = np.empty(size, self.kind)
        return got[:size].reshape(shape)


class Window:
    """What a window's pass forward leaves for the pass back, features x steps x
    lanes: gates are contiguous, and sums over the window are single products."""

    def __init__(self, p):
        self.p, self.new = p, Scratch(p["rec"].dtype)

    def run(self, inputs: np.ndarray, h: np.ndarray, fresh: np.ndarray, keep: bool = True) -> np.ndarray:
        """The states after each step, with a last row of ones. h: the state before
        (features x lanes); fresh: where a text begins, so its lane's state is zero
        before; keep: for a pass back."""
        p, n, new, (steps, lanes) = self.p, HIDDEN, self.new, inputs.shape
        after = new("after", n + 1, steps, lanes)
        after[n] = 1
        if keep:
            self.gates = gates = new("gates", 3 * n, steps, lanes)  # z, r and the candidate
            self.cand = cand = new("cand", n, steps, lanes)  # what the reset gate acts on
            self.before = prior = new("before", n, steps, lanes)
        # a row of ones takes the bias in
        self.inputs = read = new("inputs", EMBED + 1, steps, lanes)
        np.take(np.ascontiguousarray(p["emb"].T), inputs, axis=1, out=read[:EMBED], mode="clip")
        read[EMBED] = 1
        into = np.concatenate([p["win"], p["bin"][None]]).T
        # sigmoid(x) is tanh(x / 2) / 2 + 1 / 2: the half is taken in the weights
        by_zr = 0.5 * np.concatenate([p["rec"][:, : 2 * n].T, into[: 2 * n]], 1)
        by_k, into_k = np.ascontiguousarray(p["rec"][:, 2 * n :].T), np.ascontiguousarray(into[2 * n :])
        both, u, c, k, f = new("both", n + EMBED + 1, lanes), new("u", 2 * n, lanes), new("c", n, lanes), new("k", n, lanes), new("f", n, lanes)
        now, token = both[:n], both[n:]  # state and input together: one product for two gates
        now[:] = h
        starts = fresh.any(1)
        for t in range(steps):
            token[:] = read[:, t]
            if starts[t]:
                now[:, fresh[t]] = 0
            if keep:
                prior[:, t] = now
            np.dot(by_zr, both, out=u)
            np.dot(by_k, now, out=c)
            np.dot(into_k, token, out=k)
            np.tanh(u, out=u)
            u *= 0.5
            u += 0.5
            np.multiply(u[n:], c, out=f)
            k += f
            np.tanh(k, out=k)
            now -= k
            now *= u[:n]
            now += k
            after[:n, t] = now
            if keep:
                gates[: 2 * n, t], gates[2 * n :, t], cand[:, t] = u, k, c
        return after


def _safe(p) -> bool:
    """Whether no softmax can overflow or vanish: states lie between -1 and 1."""
    low, high = 0.0, 0.0
    for w, b in ((p["wcls"], p["bcls"]), (p["wmem"], p["bmem"])):
        span = np.abs(w).sum(-2)
        low, high = min(low, float((b - span).max(-1).min())), max(high, float((b + span).max()))
    return low > -60 and high < 60


def _softmax(logit: np.ndarray, at: np.ndarray, safe: bool, back: bool) -> np.ndarray:
    """Log probabilities of `at` (a row for each column of logit). back: logit
    becomes the gradient of minus their sum."""
    column = np.arange(logit.shape[1])
    if not safe:
        logit -= logit.max(0)
    own = logit[at, column]
    np.exp(logit, out=logit)
    total = logit.sum(0)
    if back:
        logit *= 1 / total
        logit[at, column] -= 1
    return own - np.log(total)


def outputs(p, x: np.ndarray, y: np.ndarray, new: Scratch, g: dict | None = None, scale: float = 1.0) -> tuple[np.ndarray, np.ndarray | None]:
    """The log probabilities of outputs y at states x (features and a row of ones x
    tokens). g: gets the gradients of minus their sum times `scale`; then that by x is
    returned, too."""
    safe, h, n, classes = _safe(p), HIDDEN, len(y), len(p["bcls"])
    cls, mem = (y // MEMBERS).astype(np.int16), y % MEMBERS
    to_class = np.concatenate([p["wcls"], p["bcls"][None]])
    to_member = np.concatenate([p["wmem"], p["bmem"][:, None]], 1)
    lc = new("class", classes, n)
    np.dot(to_class.T, x, out=lc)
    out = _softmax(lc, cls, safe, g is not None)
    order = np.argsort(cls, kind="stable")  # class by class: one product each
    ends = np.searchsorted(cls[order], np.arange(classes + 1)).tolist()
    xs, lm = new("sorted", h + 1, n), new("member", MEMBERS, n)
    np.take(x, order, axis=1, out=xs, mode="clip")
    for k in range(classes):
        a, b = ends[k], ends[k + 1]
        if a < b:
            lm[:, a:b] = to_member[k].T @ xs[:, a:b]
    out[order] += _softmax(lm, mem[order], safe, g is not None)
    if g is None:
        return out, None
    lc *= scale
    lm *= scale
    by_class = x @ lc.T
    g["wcls"][:], g["bcls"][:] = by_class[:h], by_class[h]
    by_x, back = new("by_x", h, n), new("back", h, n)
    for k in range(classes):
        a, b = ends[k], ends[k + 1]
        if a < b:
            own = lm[:, a:b]
            by_member = xs[:, a:b] @ own.T
            g["wmem"][k], g["bmem"][k] = by_member[:h], by_member[h]
            back[:, a:b] = p["wmem"][k] @ own
        else:
            g["wmem"][k] = g["bmem"][k] = 0
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    turned = xs[:h]
    np.take(back, place, axis=1, out=turned, mode="clip")
    np.dot(p["wcls"], lc, out=by_x)
    by_x += turned
    return out, by_x


def window_gradient(p, inputs: np.ndarray, y: np.ndarray, mask: np.ndarray, h0: np.ndarray, fresh: np.ndarray, window: Window | None = None, g: dict | None = None):
    """(loss, gradient, last state, tokens) of a window (steps x lanes) of tokens.

    inputs: outputs read; y: those to predict, where mask holds; fresh: where a text
    begins, so its lane's state is zero before; h0: features x lanes. The gradient
    stops at the window's start. window, g: to be used again."""
    steps, lanes = inputs.shape
    n = HIDDEN
    window = window or Window(p)
    new = window.new
    if g is None:
        g = {k: np.empty_like(v) for k, v in p.items()}
    out = window.run(inputs, h0, fresh)
    last = out[:n, -1].copy()
    x, goal = out.reshape(n + 1, -1), y.reshape(-1)
    live = None if mask.all() else np.flatnonzero(mask.reshape(-1))
    if live is not None:
        x, goal = np.take(x, live, axis=1), goal[live]
    total = max(1, len(goal))
    logs, dx = outputs(p, x, goal, new, g, 1 / total)
    if live is not None:
        whole = np.zeros((n, steps * lanes), x.dtype)
        whole[:, live] = dx
        dx = whole
    dh = dx.reshape(n, steps, lanes)
    # what doesn't depend on later steps, for the whole window at once
    z, r, k = window.gates[:n], window.gates[n : 2 * n], window.gates[2 * n :]
    keep, by_z, cand = new("keep", *z.shape), new("by_z", *z.shape), window.cand
    np.subtract(1, z, out=keep)
    np.subtract(window.before, k, out=by_z)
    by_z *= z
    by_z *= keep
    k *= k
    np.subtract(1, k, out=k)
    keep *= k
    cand *= r
    np.subtract(1, r, out=k)
    cand *= k
    du, dk = new("du", *window.gates.shape), k  # the candidate isn't needed any more
    own, e, d, back = new("own", 3 * n, lanes), new("k", n, lanes), new("f", n, lanes), new("now", n, lanes)
    back[:] = 0
    starts = fresh.any(1)
    for t in range(steps - 1, -1, -1):
        np.add(dh[:, t], back, out=d)
        np.multiply(d, by_z[:, t], out=own[:n])
        np.multiply(d, keep[:, t], out=e)
        np.multiply(e, cand[:, t], out=own[n : 2 * n])
        np.multiply(e, r[:, t], out=own[2 * n :])
        np.dot(p["rec"], own, out=back)
        d *= z[:, t]
        back += d
        if starts[t]:
            back[:, fresh[t]] = 0
        du[:, t], dk[:, t] = own, e
    flat_du = du.reshape(3 * n, -1)
    np.dot(window.before.reshape(n, -1), flat_du.T, out=g["rec"])
    du[2 * n :] = dk
    into = window.inputs.reshape(EMBED + 1, -1) @ flat_du.T
    g["win"][:], g["bin"][:] = into[:EMBED], into[EMBED]
    # sums by token, as tokens repeat
    read = inputs.reshape(-1).astype(np.int16 if len(p["emb"]) < 1 << 15 else np.int32)
    hit = np.argsort(read, kind="stable")
    token, first = np.unique(read[hit], return_index=True)
    g["emb"][:] = 0
    g["emb"][token] = np.add.reduceat((flat_du.T @ p["win"].T)[hit], first, axis=0)
    return -float(logs.sum()) / total, g, last, len(goal)


class Adam:
    """Over one vector of parameters; a gradient longer than 1 is cut to 1."""

    def __init__(self, w: np.ndarray):
        self.t = 0
        self.m, self.v = np.zeros_like(w), np.zeros_like(w)

    def apply(self, w: np.ndarray, g: np.ndarray, rate: float) -> None:
        self.t += 1
        g *= min(1.0, 1.0 / (float(np.sqrt(np.dot(g, g))) + 1e-9))
        self.m += 0.1 * (g - self.m)
        g *= g
        self.v += 0.005 * (g - self.v)
        np.divide(self.v, 1 - 0.995**self.t, out=g)
        np.sqrt(g, out=g)
        g += 1e-6
        np.divide(self.m, g, out=g)
        w -= (rate / (1 - 0.9**self.t)) * g


def blocks(texts: Iterable[np.ndarray], start: int, lanes: int, steps: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts dealt to lanes as these come free: (read, own, fresh, of), steps x lanes
    each. own: outputs; read: the ones before them, `start` at a text's beginning;
    fresh: where one begins; of: the text's number, -1 where nothing is left. Memory:
    one text a lane."""
    source = enumerate(texts)
    rest: list[tuple[int, np.ndarray]] = [(-1, np.zeros(0, np.int16))] * lanes
    before = np.full(lanes, start, np.int64)
    open_ = True
    while True:
        own, of, fresh = np.full((lanes, steps), start, np.int64), np.full((lanes, steps), -1, np.int64), np.zeros((lanes, steps), bool)
        for j in range(lanes):
            at = 0
            i, t = rest[j]
            while at < steps:
                if not len(t):
                    if not open_:
                        break
                    i, t = next(source, (-1, None))
                    if t is None:
                        open_, t = False, np.zeros(0, np.int16)
                        break
                    if not len(t):
                        continue
                    fresh[j, at] = True
                m = min(steps - at, len(t))
                own[j, at : at + m], of[j, at : at + m] = t[:m], i
                t, at = t[m:], at + m
            rest[j] = (i, t)
        used = np.flatnonzero((of >= 0).any(1))
        if not len(used):
            return
        read = np.concatenate([before[:, None], own[:, :-1]], 1)
        read[fresh] = start
        before = own[:, -1]
        if len(used) < lanes:  # lanes left without a text stay so
            own, of, fresh, read, before = own[used], of[used], fresh[used], read[used], before[used]
            rest = [rest[j] for j in used]
            lanes = len(used)
            yield np.ascontiguousarray(read.T), np.ascontiguousarray(own.T), np.ascontiguousarray(fresh.T), np.ascontiguousarray(of.T), used
        else:
            yield np.ascontiguousarray(read.T), np.ascontiguousarray(own.T), np.ascontiguousarray(fresh.T), np.ascontiguousarray(of.T), None


def train(w: np.ndarray, texts: Iterable[np.ndarray], start: int, classes: int, rates: tuple[float, float] = (0.003, 0.003), tokens: int = 1, lanes: int = 256, window: int = 32) -> int:
    """Truncated backpropagation over every token of whole texts (arrays of outputs):
    the state goes on from window to window, the gradient stops at a window's start.
    The rate goes from the first of `rates` to the second over about `tokens` tokens.
    w, the parameters as one vector, changes in place; returns the tokens seen."""
    p = unflat(w, classes)
    grad = np.empty_like(w)
    g = unflat(grad, classes)
    opt, seen = Adam(w), 0
    h, held = np.zeros((HIDDEN, lanes), w.dtype), Window(p)
    for read, own, fresh, of, used in blocks(texts, start, lanes, window):
        if used is not None:
            h = h[:, used]
        _, _, h, n = window_gradient(p, read, own, of >= 0, h, fresh, held, g)
        opt.apply(w, grad, rates[0] + (rates[1] - rates[0]) * min(1.0, seen / max(1, tokens)))
        seen += n
    return seen


def log10_likelihood(w: np.ndarray, texts: Iterable[np.ndarray], start: int, classes: int, lanes: int = 512, window: int = 32) -> Iterator[tuple[int, float]]:
    """(number, log10 of the probability) of each text that isn't empty, in the order
    in which they end. The state goes on to a text's end."""
    p = unflat(w, classes)
    h, held = np.zeros((HIDDEN, lanes), w.dtype), Window(p)
    total: dict[int, float] = {}
    for read, own, fresh, of, used in blocks(texts, start, lanes, window):
        if used is not None:
            h = h[:, used]
        out = held.run(read, h, fresh, keep=False)
        h = out[:HIDDEN, -1].copy()
        live = np.flatnonzero(of.reshape(-1) >= 0)
        x, y = out.reshape(HIDDEN + 1, -1), own.reshape(-1)
        got = np.zeros(len(y))
        if len(live) < len(y):
            got[live] = outputs(p, np.take(x, live, axis=1), y[live], held.new)[0]
        else:
            got[:] = outputs(p, x, y, held.new)[0]
        # lane by lane, a text's tokens are side by side
        which = of.T.reshape(-1)
        first = np.flatnonzero(np.append(True, which[1:] != which[:-1]))
        for i, s in zip(which[first].tolist(), np.add.reduceat(got.reshape(own.shape).T.reshape(-1), first).tolist(), strict=True):
            if i >= 0:
                total[i] = total.get(i, 0.0) + s
        going = set(of[-1].tolist())  # texts that may go on
        for i in [i for i in total if i not in going]:
            yield i, total.pop(i) / np.log(10)
    for i, s in total.items():
        yield i, s / np.log(10)
