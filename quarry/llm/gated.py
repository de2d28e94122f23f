"""A gated recurrent language model with class-factored outputs, in numpy.

Frequent words have codes 0..words-1 in order of frequency and fall into classes of equal numbers of words; any other
token has the code words + its class. The model gives P(class | state) and, for frequent words, P(word | class, state).
Training is truncated backpropagation over windows, the state carried from window to window; scoring carries the state
through whole documents.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np

#: Size of the state, and of an input's embedding.
STATE, EMBEDDING = 8, 8
#: Documents scored side by side, tokens of a window, streams trained side by side, steps of a training window.
LANES, WINDOW, TRAIN_LANES, TRAIN_STEPS = 512, 8192, 512, 16


@dataclass(frozen=True)
class Codes:
    """The codes of tokens: side classes of side frequent words each, then the classes of other words, then the end."""

    side: int
    spellings: int

    @property
    def words(self) -> int:
        return self.side * self.side

    @property
    def classes(self) -> int:
        return self.side + self.spellings + 1

    @property
    def inputs(self) -> int:
        return self.words + self.classes

    @property
    def end(self) -> int:
        return self.inputs - 1

    def class_of(self, codes: np.ndarray) -> np.ndarray:
        return np.where(codes < self.words, codes // self.side, codes - self.words)

    def shapes(self) -> dict[str, tuple]:
        return {"ob": (self.classes,), "oc": (STATE, self.classes), "wb": (self.side, self.side), "wc": (self.side, STATE, self.side), "x": (self.inputs, EMBEDDING), "xb": (2 * STATE,), "xw": (EMBEDDING, 2 * STATE), "zc": (STATE, 2 * STATE)}


def views(vector: np.ndarray, codes: Codes) -> dict[str, np.ndarray]:
    """The weights by name, as views of one vector."""
    out, at = {}, 0
    for k, shape in codes.shapes().items():
        n = int(np.prod(shape))
        out[k] = vector[at : at + n].reshape(shape)
        at += n
    return out


def n_weights(codes: Codes) -> int:
    return sum(int(np.prod(s)) for s in codes.shapes().values())


def initial(codes: Codes, counts: np.ndarray, others: np.ndarray, seed: int = 4) -> np.ndarray:
    """Weights of a small random recurrence whose outputs are the smoothed unigram model.

    counts: of the frequent words (words of them); others: mass of each other class, the end last.
    """
    rnd = np.random.default_rng(seed)
    vector = np.zeros(n_weights(codes), np.float32)
    w = views(vector, codes)
    mass = counts.reshape(codes.side, codes.side) + 0.5
    classes = np.concatenate([mass.sum(1), others])
    w["x"][:], w["xw"][:] = rnd.normal(0, 0.5, w["x"].shape), rnd.normal(0, 0.5, w["xw"].shape)
    w["zc"][:] = rnd.normal(0, 0.3 / np.sqrt(STATE), w["zc"].shape)
    w["ob"][:], w["wb"][:] = np.log(classes / classes.sum()), np.log(mass / mass.sum(1, keepdims=True))
    return vector


def run(w: dict, h: np.ndarray, inputs: np.ndarray, keep: np.ndarray, trace: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """States after each step (steps, lanes, STATE), and the last one (STATE, lanes); keep is 0 where a document begins.

    An update gate z and a candidate c come from the state and the input's embedding: h + z (c - h). Both bend by
    x / (1 + |x|), far cheaper than tanh; z is shifted to lie between 0 and 1.
    """
    embedded = w["x"].take(inputs.ravel(), axis=0) @ w["xw"]
    embedded += w["xb"]
    x = np.ascontiguousarray(embedded.reshape(*inputs.shape, 2 * STATE).transpose(0, 2, 1))
    back, out = np.ascontiguousarray(w["zc"].T), np.empty((len(inputs), STATE, inputs.shape[1]), x.dtype)
    fresh = (keep == 0).any(axis=1).tolist()
    for t in range(len(inputs)):
        if fresh[t]:
            h = h * keep[t]
        zc = back @ h
        zc += x[t]
        wide = np.abs(zc)
        wide += 1.0
        zc /= wide
        z, c = zc[:STATE], zc[STATE:]
        z *= 0.5
        z += 0.5
        if trace is not None:
            trace.append((h, z, c, wide))
        step = np.subtract(c, h, out=out[t])
        step *= z
        step += h
        h = step
    return np.ascontiguousarray(out.transpose(0, 2, 1)), h


def _exp(logits: np.ndarray, steep: bool) -> np.ndarray:
    """Exponentials in place; their sums by row. steep: rows are shifted by their maximum first."""
    if steep:
        logits -= logits.max(axis=1, keepdims=True)
    np.exp(logits, out=logits)
    return logits @ np.ones(logits.shape[1], logits.dtype)


def _steep(weights: np.ndarray) -> bool:
    """Whether logits could leave the range of exp: states lie within -1 and 1."""
    return bool(np.abs(weights).sum(axis=-2).max() > 40)


def _by_class(codes: Codes, targets: np.ndarray):
    """(class, rows) of the frequent words among targets."""
    rows = np.flatnonzero(targets < codes.words)
    cls = (targets[rows] // codes.side).astype(np.uint16)
    rows = rows[np.argsort(cls, kind="stable")]
    ends = np.cumsum(np.bincount(cls, minlength=codes.side)).tolist()
    return [(k, rows[a:b]) for k, (a, b) in enumerate(zip([0, *ends], ends)) if b > a]  # noqa: B905


def log_probabilities(w: dict, codes: Codes, h: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Natural logs of P(class) and, for frequent words, P(word | class)."""
    every, steep = np.arange(len(targets)), _steep(w["oc"])
    logits = h @ w["oc"]
    logits += w["ob"]
    if steep:
        logits -= logits.max(axis=1, keepdims=True)
    out = logits[every, codes.class_of(targets)]
    out -= np.log(_exp(logits, False))
    steep = _steep(w["wc"])
    for k, rows in _by_class(codes, targets):
        logits = h.take(rows, axis=0) @ w["wc"][k]
        logits += w["wb"][k]
        if steep:
            logits -= logits.max(axis=1, keepdims=True)
        mine = logits[every[: len(rows)], targets[rows] % codes.side]
        out[rows] += mine - np.log(_exp(logits, False))
    return out


def _lanes(lengths: np.ndarray, lanes: int) -> list[list[int]]:
    """Documents dealt to lanes, longest first to the shortest lane; lanes by falling length."""
    heap = [(0, k) for k in range(min(lanes, len(lengths)))]
    dealt: list[list[int]] = [[] for _ in heap]
    sizes = lengths.tolist()
    for d in np.argsort(-lengths, kind="stable").tolist():
        at, k = heap[0]
        dealt[k].append(d)
        heapq.heapreplace(heap, (at + sizes[d], k))
    return [dealt[k] for _, k in sorted(heap, key=lambda x: (-x[0], x[1]))]


def score_documents(w: dict, codes: Codes, tokens: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Natural log probability of each document; tokens: their codes one after another, each document's end included.

    Memory follows the tokens: lanes of unequal length are read where they lie, so one very long document costs no more.
    """
    lengths = np.asarray(lengths, np.int64)
    total = np.zeros(len(lengths))
    if not len(lengths):
        return total
    lanes = _lanes(lengths, LANES)
    order = np.array([d for lane in lanes for d in lane], np.int64)
    starts, mine = np.cumsum(lengths) - lengths, lengths[order]
    firsts = np.cumsum(mine) - mine
    targets = tokens[np.repeat(starts[order] - firsts, mine) + np.arange(len(tokens))]
    inputs = np.empty_like(targets)
    inputs[1:] = targets[:-1]
    inputs[firsts] = codes.end
    begins = np.ones(len(targets), np.float32)
    begins[firsts] = 0
    owner = np.repeat(order, mine).astype(np.int32)
    sizes = np.array([lengths[lane].sum() for lane in lanes])
    offset = np.cumsum(sizes) - sizes
    h = np.zeros((STATE, len(lanes)), w["x"].dtype)
    a, most = 0, int(sizes[0])
    while a < most:
        on = int((sizes > a).sum())
        steps = min(max(1, WINDOW // on), most - a)
        at = np.arange(a, a + steps)[:, None]
        real = at < sizes[None, :on]
        at = np.where(real, at + offset[:on], offset[:on])
        states, h = run(w, h[:, :on], inputs[at], np.where(real, begins[at], 1.0))
        at = at[real]
        total += np.bincount(owner[at], log_probabilities(w, codes, states[real], targets[at]), len(lengths))
        a += steps
    return total


def gradients(w: dict, codes: Codes, h: np.ndarray, inputs: np.ndarray, targets: np.ndarray, keep: np.ndarray, real: np.ndarray, g: dict) -> tuple[float, np.ndarray]:
    """Loss a token and the state to go on with; g gets the gradients by backpropagation through these steps only."""
    trace: list = []
    states, last = run(w, h, inputs, keep, trace)
    s, want, on = states.reshape(-1, STATE), targets.ravel(), real.ravel()
    some = None if on.all() else on.astype(s.dtype)
    share = 1.0 / max(1, int(on.sum()))
    every, cls = np.arange(len(want)), codes.class_of(want)

    def outer(d: np.ndarray, rows: np.ndarray, col: np.ndarray, steep: bool) -> float:
        """d: logits in, derivatives out; the summed loss."""
        if steep:
            d -= d.max(axis=1, keepdims=True)
        hit = d[every[: len(col)], col]
        sums = _exp(d, False)
        d *= (1.0 / sums)[:, None]
        d[every[: len(col)], col] -= 1
        loss = np.log(sums) - hit
        if some is not None:
            d *= some[rows][:, None]
            loss *= some[rows]
        return float(loss.sum())

    d = s @ w["oc"]
    d += w["ob"]
    loss = outer(d, slice(None), cls, _steep(w["oc"]))
    g["oc"][:], g["ob"][:] = (s.T @ d) * share, (np.ones(len(d), d.dtype) @ d) * share
    ds = d @ w["oc"].T
    g["wc"][:] = 0
    g["wb"][:] = 0
    steep = _steep(w["wc"])
    for k, rows in _by_class(codes, want):
        mine = s.take(rows, axis=0)
        d = mine @ w["wc"][k]
        d += w["wb"][k]
        loss += outer(d, rows, want[rows] % codes.side, steep)
        g["wc"][k], g["wb"][k] = (mine.T @ d) * share, (np.ones(len(d), d.dtype) @ d) * share
        ds[rows] += d @ w["wc"][k].T
    ds *= share
    ds = ds.reshape(states.shape)
    down = np.ascontiguousarray(ds.transpose(0, 2, 1))
    da, dh, fresh = np.empty((len(inputs), 2 * STATE, inputs.shape[1]), s.dtype), np.zeros_like(last), (keep == 0).any(axis=1).tolist()
    for t in range(len(inputs) - 1, -1, -1):
        before, z, c, wide = trace[t]
        dh += down[t]
        d = da[t]
        np.subtract(c, before, out=c)
        c *= dh
        np.multiply(c, 0.5, out=d[:STATE])
        z *= dh
        d[STATE:] = z
        wide *= wide
        d /= wide
        dh -= z
        dh += w["zc"] @ d
        if fresh[t]:
            dh *= keep[t]
    flat = inputs.ravel()
    dx = np.ascontiguousarray(da.transpose(0, 2, 1)).reshape(-1, 2 * STATE)
    befores = np.ascontiguousarray(np.stack([x[0] for x in trace]).transpose(0, 2, 1)).reshape(-1, STATE)
    g["zc"][:] = befores.T @ dx
    g["xb"][:] = np.ones(len(dx), dx.dtype) @ dx
    g["xw"][:] = w["x"].take(flat, axis=0).T @ dx
    dx = dx @ w["xw"].T
    order = np.argsort(flat.astype(np.uint16) if codes.inputs < 1 << 16 else flat, kind="stable")
    flat = flat.take(order)
    first = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
    g["x"][:] = 0
    g["x"][flat[first]] = np.add.reduceat(dx.take(order, axis=0), first, axis=0)
    return loss * share, last


def train(vector: np.ndarray, codes: Codes, tokens: np.ndarray, lengths: np.ndarray, rate: float = 0.02) -> np.ndarray:
    """Adam over windows of equal stretches of all documents side by side; a stretch may begin inside a document."""
    vector = vector.copy()
    n = len(tokens)
    if not n:
        return vector
    w, slope = views(vector, codes), np.empty_like(vector)
    g = views(slope, codes)
    lanes = int(min(TRAIN_LANES, max(1, n // (32 * TRAIN_STEPS))))
    steps = -(-n // lanes)
    firsts = np.cumsum(lengths) - lengths
    inputs = np.empty_like(tokens)
    inputs[1:] = tokens[:-1]
    inputs[firsts] = codes.end
    keep = np.ones(n, np.float32)
    keep[firsts] = 0
    first, second, h = np.zeros_like(vector), np.zeros_like(vector), np.zeros((STATE, lanes), vector.dtype)
    windows = -(-steps // TRAIN_STEPS)
    for k in range(windows):
        at = np.arange(k * TRAIN_STEPS, min(steps, (k + 1) * TRAIN_STEPS))[:, None] + steps * np.arange(lanes)
        real = at < n
        at = np.minimum(at, n - 1)
        _, h = gradients(w, codes, h, inputs[at], tokens[at], keep[at], real, g)
        norm = float(np.sqrt(slope @ slope))
        slope *= min(1.0, 1.0 / (norm + 1e-9))
        pace = rate * (1 - 0.9 * k / windows) * min(1.0, lanes / 64 + 0.1)
        first += 0.1 * (slope - first)
        second += 0.01 * (slope * slope - second)
        vector -= (pace / (1 - 0.9 ** (k + 1))) * first / (np.sqrt(second * (1 / (1 - 0.99 ** (k + 1)))) + 1e-6)
    return vector
