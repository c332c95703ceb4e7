"""A gated recurrent language model in numpy: truncated backpropagation, class-factored softmax, state carried over windows."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np

#: Embedding and state width, classes, and words a class.
WIDTH, STATE, CLASSES, CLASS_WORDS = 16, 16, 32, 64
VOCABULARY = CLASSES * CLASS_WORDS
#: Tokens a window; gradients do not cross its start, the state does.
STEPS = 24
LANES, SCORED_LANES = 256, 512
RATE = 0.08
#: Ids of the end of a text (also what stands before its start) and of words outside the vocabulary.
END, OTHER = 0, 1

SHAPES = {"emb": (VOCABULARY, WIDTH), "wx": (WIDTH, 3 * STATE), "b": (3 * STATE,), "wh": (STATE, 3 * STATE), "wc": (STATE, CLASSES),
          "bc": (CLASSES,), "ww": (CLASSES, STATE, CLASS_WORDS), "bw": (CLASSES, CLASS_WORDS)}
SIZE = sum(int(np.prod(s)) for s in SHAPES.values())


def initial(seed: int = 5) -> np.ndarray:
    r = np.random.default_rng(seed)
    return np.concatenate([(np.zeros(s) if n[0] == "b" else r.normal(0, 0.1, s)).ravel() for n, s in SHAPES.items()]).astype(np.float32)


def views(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in SHAPES.items():
        size = int(np.prod(shape))
        out[name] = flat[at:at + size].reshape(shape)
        at += size
    return out


def _bounded(weights: np.ndarray) -> bool:
    """Whether no state, whose members lie between -1 and 1, gives logits that ``exp`` can't take; the last weights are the bias."""
    return float(np.abs(weights).sum(axis=-2).max()) < 80


def _with_one(hs: np.ndarray) -> np.ndarray:
    return np.concatenate([hs, np.ones((len(hs), 1), hs.dtype)], axis=1)


def _softmax(hs: np.ndarray, weights: np.ndarray, target: np.ndarray, bounded: bool, share: float, dw: np.ndarray | None):
    """Log probability of each target, ``hs`` ending in ones for the bias. With ``dw``, gradients of minus their sum times ``share`` are added
    there and that of ``hs`` is returned too."""
    x, at = hs @ weights, np.arange(len(hs))
    if not bounded:
        x -= x.max(axis=1, keepdims=True)
    own = x[at, target]
    np.exp(x, out=x)
    total = x @ np.ones(x.shape[1], x.dtype)
    own -= np.log(total)
    if dw is None:
        return own, None
    x *= (share / total)[:, None]
    x[at, target] -= share
    dw += hs.T @ x
    return own, x @ weights[:-1].T


@dataclass
class Lanes:
    """Texts side by side, each whole in one lane: what is read, what comes next, where a text starts, whose token it is."""

    inputs: np.ndarray
    targets: np.ndarray
    fresh: np.ndarray
    owner: np.ndarray


def lanes(texts: list[np.ndarray], most: int = LANES) -> Lanes:
    """Longest text first into the shortest lane; ``owner`` is -1 where a lane has run out."""
    size = [len(t) + 1 for t in texts]
    count = max(1, min(most, len(texts), sum(size) // max(max(size), STEPS)))
    heap, held = [(0, n) for n in range(count)], [[] for _ in range(count)]
    for n in sorted(range(len(texts)), key=lambda n: -size[n]):
        length, lane = heapq.heappop(heap)
        held[lane].append(n)
        heapq.heappush(heap, (length + size[n], lane))
    steps = max(length for length, _ in heap)
    inputs, targets = np.zeros((steps, count), np.int32), np.zeros((steps, count), np.int32)
    fresh, owner = np.zeros((steps, count), bool), np.full((steps, count), -1, np.int32)
    for lane, own in enumerate(held):
        at = 0
        for n in own:
            end = at + size[n]
            inputs[at, lane], inputs[at + 1:end, lane] = END, texts[n]
            targets[at:end - 1, lane], targets[end - 1, lane] = texts[n], END
            fresh[at, lane], owner[at:end, lane] = True, n
            at = end
    return Lanes(inputs, targets, fresh, owner)


class Model:
    def __init__(self, flat: np.ndarray) -> None:
        self.flat = flat
        self.p = views(flat)

    def _states(self, inputs: np.ndarray, fresh: np.ndarray, h: np.ndarray, projected: np.ndarray, keep: bool):
        """States after each step of a window; with ``keep`` also what the backward pass needs: states before, gates, candidates and
        the part of these that the reset gate scales."""
        s, dtype = STATE, self.flat.dtype
        half = np.repeat(np.array([0.5, 0.5, 1], dtype), s)  # a logistic gate is half a tanh of half its input
        wh, gx = self.p["wh"] * half, (projected * half)[inputs]
        out = np.empty((len(inputs), *h.shape), dtype)
        before, gates, news, scaled = (np.empty((len(inputs), len(h), w), dtype) for w in (s, 2 * s, s, s)) if keep else [None] * 4
        h, starts = h.astype(dtype), fresh.any(axis=1)
        for t in range(len(inputs)):
            if starts[t]:
                h = np.where(fresh[t][:, None], dtype.type(0), h)
            gh = h @ wh
            g = np.add(gx[t, :, :2 * s], gh[:, :2 * s], out=gates[t] if keep else None)
            np.tanh(g, out=g)
            g *= dtype.type(0.5)
            g += dtype.type(0.5)
            n = np.multiply(g[:, s:], gh[:, 2 * s:], out=news[t] if keep else None)
            n += gx[t, :, 2 * s:]
            np.tanh(n, out=n)
            if keep:
                before[t], scaled[t] = h, gh[:, 2 * s:]
            h = np.subtract(h, n, out=out[t])
            h *= g[:, :s]
            h += n
        return out, h, (before, gates, news, scaled)

    def _outputs(self, hs: np.ndarray, y: np.ndarray, grad: dict[str, np.ndarray] | None = None):
        """Natural log probability of each target: its class, then the word in the class. With ``grad``, gradients of
        minus their mean are added there and the gradient of the states is returned too."""
        dtype, share = self.flat.dtype, 1 / max(1, len(y))
        order = np.argsort((y // CLASS_WORDS).astype(np.uint8), kind="stable")
        hs, y = _with_one(hs.astype(dtype, copy=False)[order]), y[order]
        cls, slot = y // CLASS_WORDS, y % CLASS_WORDS
        wc = np.concatenate([self.p["wc"], self.p["bc"][None]])
        ww = np.concatenate([self.p["ww"], self.p["bw"][:, None]], axis=1)
        dwc, dww = (None, None) if grad is None else (np.zeros_like(wc), np.zeros_like(ww))
        logp, dh = _softmax(hs, wc, cls, _bounded(wc), share, dwc)
        ends, bounded = np.searchsorted(cls, np.arange(CLASSES + 1)), _bounded(ww)
        for c in np.flatnonzero(np.diff(ends)):
            own = slice(ends[c], ends[c + 1])
            more, dmore = _softmax(hs[own], ww[c], slot[own], bounded, share, None if grad is None else dww[c])
            logp[own] += more
            if grad is not None:
                dh[own] += dmore
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        if grad is None:
            return logp[back], None
        for name, d in (("wc", dwc[:-1]), ("bc", dwc[-1]), ("ww", dww[:, :-1]), ("bw", dww[:, -1])):
            grad[name] += d
        return logp[back], dh[back]

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        """Log10 probability of each text with its end; a text's state is carried through all its windows."""
        if not texts:
            return np.zeros(0)
        side = lanes(texts, SCORED_LANES)
        projected = self.p["emb"] @ self.p["wx"] + self.p["b"]
        out, h = np.zeros(len(texts)), np.zeros((side.inputs.shape[1], STATE), np.float32)
        for a in range(0, len(side.inputs), 2 * STEPS):
            part = slice(a, a + 2 * STEPS)
            hs, h, _ = self._states(side.inputs[part], side.fresh[part], h, projected, False)
            live = side.owner[part] >= 0
            logp, _ = self._outputs(hs[live], side.targets[part][live])
            out += np.bincount(side.owner[part][live], logp, len(texts))
        return out / np.log(10)

    def train(self, texts: list[np.ndarray], squares: np.ndarray) -> float:
        """One pass of truncated backpropagation (Adagrad, ``squares`` are its sums); mean loss in nats."""
        side = lanes(texts)
        h = np.zeros((side.inputs.shape[1], STATE), np.float32)
        total = count = 0.0
        flat = np.zeros(SIZE, np.float32)
        for a in range(0, len(side.inputs), STEPS):
            part = slice(a, a + STEPS)
            inputs, fresh, live = side.inputs[part], side.fresh[part], side.owner[part] >= 0
            flat[:] = 0
            g = views(flat)
            projected = self.p["emb"] @ self.p["wx"] + self.p["b"]
            hs, h, kept = self._states(inputs, fresh, h, projected, True)
            logp, dlive = self._outputs(hs[live], side.targets[part][live], g)
            douts = np.zeros_like(hs)
            douts[live] = dlive
            self._back(inputs, fresh, kept, douts, g)
            total, count = total - float(logp.sum()), count + len(logp)
            squares += flat * flat
            self.flat -= RATE * flat / (np.sqrt(squares) + 1e-6)
        return total / max(count, 1)

    def _back(self, inputs, fresh, kept, douts, g) -> None:
        s, (before, gates, news, scaled) = STATE, kept
        z, r = gates[:, :, :s], gates[:, :, s:]
        back = np.ascontiguousarray(self.p["wh"].T)
        # what a state's gradient is multiplied with to give those of the three parts of ``h @ wh``
        by = np.empty((*inputs.shape, 3, s), before.dtype)
        to_new = (1 - z) * (1 - news * news)
        by[:, :, 0] = (before - news) * z * (1 - z)
        by[:, :, 2] = to_new * r
        by[:, :, 1] = by[:, :, 2] * scaled * (1 - r)
        d_all, carry, starts = np.empty_like(before), np.zeros_like(before[0]), fresh.any(axis=1)
        for t in range(len(inputs) - 1, -1, -1):
            d = np.add(douts[t], carry, out=d_all[t])
            by[t] *= d[:, None]
            carry = by[t].reshape(-1, 3 * s) @ back
            carry += d * z[t]
            if starts[t]:
                carry[fresh[t]] = 0
        g["wh"] += before.reshape(-1, s).T @ by.reshape(-1, 3 * s)
        by[:, :, 2] = d_all * to_new  # and of the three parts of the inputs
        flat, ids = by.reshape(-1, 3 * s), inputs.ravel()
        g["b"] += flat.sum(axis=0)
        order = np.argsort(ids.astype(np.uint16), kind="stable")
        ids = ids[order]
        heads = np.flatnonzero(np.diff(ids, prepend=-1))
        sums, ids = np.add.reduceat(flat[order], heads, axis=0), ids[heads]
        g["wx"] += self.p["emb"][ids].T @ sums
        g["emb"][ids] += sums @ self.p["wx"].T
