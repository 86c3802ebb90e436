"""A gated recurrent language model in numpy, with an output factored into classes."""

from __future__ import annotations

import numpy as np

from textguard.llm.shipping import ship

ship(__name__)

PARTS = ("inputs", "carry", "bias", "to_class", "class_bias", "to_word", "word_bias")


def _exponents(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Powers of e and their sums by row; states and biases are bounded, and so are logits in practice."""
    np.minimum(logits, np.float32(60), out=logits)
    odds = np.exp(logits)
    return odds, odds @ np.ones(odds.shape[1], np.float32)


class Gru:
    """Tokens 0..classes*size-1; token t belongs to class t // size. `end` ends a document and
    starts the next one: after it the state is zero. P(token) = P(class) P(token | class)."""

    def __init__(self, frequencies: np.ndarray, classes: int, hidden: int, end: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.classes, self.size, self.hidden, self.end = classes, len(frequencies) // classes, hidden, end
        grouped = (frequencies + 0.5).reshape(classes, self.size)
        self.inputs = rng.normal(0, 0.1, (classes * self.size, 3 * hidden))
        self.carry = rng.normal(0, hidden ** -0.5, (hidden, 3 * hidden))
        self.bias = np.zeros(3 * hidden)
        self.to_class = np.zeros((hidden, classes))
        self.class_bias = np.log(grouped.sum(1) / grouped.sum())
        self.to_word = np.zeros((classes, hidden, self.size))
        self.word_bias = np.log(grouped / grouped.sum(1, keepdims=True))
        for part in PARTS:
            setattr(self, part, getattr(self, part).astype(np.float32))

    def weights(self) -> np.ndarray:
        return np.concatenate([getattr(self, part).ravel() for part in PARTS])

    def load(self, weights: np.ndarray) -> Gru:
        at = 0
        for part in PARTS:
            old = getattr(self, part)
            setattr(self, part, weights[at: at + old.size].reshape(old.shape).astype(np.float32))
            at += old.size
        return self

    def step(self, before: np.ndarray, state: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States after reading the tokens `before`; with `keep`, what the way back needs is put there."""
        h = self.hidden
        state = state * (before != self.end)[:, None]
        x = self.inputs[before] + self.bias
        g = state @ self.carry
        gates = np.tanh((x[:, : 2 * h] + g[:, : 2 * h]) * np.float32(0.5)) * np.float32(0.5) + np.float32(0.5)
        z, r = gates[:, :h], gates[:, h:]
        new = np.tanh(x[:, 2 * h:] + r * g[:, 2 * h:])
        out = new + z * (state - new)
        if keep is not None:
            keep.append((state, gates, new, g[:, 2 * h:]))
        return out

    def log_odds(self, states: np.ndarray, targets: np.ndarray, grads: dict | None = None,
                 values: bool = True) -> np.ndarray | None:
        """Natural log-probabilities of the targets (if `values` are asked for). With `grads`, gradients
        of their negative sum are put there, that by the states under "states"."""
        owner = targets // self.size
        logits = states @ self.to_class
        logits += self.class_bias
        odds, total = _exponents(logits)
        rows = np.arange(len(targets))
        out = logits[rows, owner] - np.log(total) if values else None
        if grads is not None:
            odds /= total[:, None]
            odds[rows, owner] -= 1
            grads["to_class"] = states.T @ odds
            grads["class_bias"] = odds.sum(0)
            back = odds @ self.to_class.T
            grads["to_word"], grads["word_bias"] = np.zeros_like(self.to_word), np.zeros_like(self.word_bias)
        order = np.argsort(owner.astype(np.uint8 if self.classes < 256 else np.int32), kind="stable")
        cuts = np.searchsorted(owner[order], np.arange(self.classes + 1))
        for c in range(self.classes):
            own = order[cuts[c]: cuts[c + 1]]
            if not len(own):
                continue
            some = states[own]
            logits = some @ self.to_word[c]
            logits += self.word_bias[c]
            inside = targets[own] - c * self.size
            odds, total = _exponents(logits)
            rows = np.arange(len(own))
            if values:
                out[own] += logits[rows, inside] - np.log(total)
            if grads is not None:
                odds /= total[:, None]
                odds[rows, inside] -= 1
                grads["to_word"][c] = some.T @ odds
                grads["word_bias"][c] = odds.sum(0)
                back[own] += odds @ self.to_word[c].T
        if grads is not None:
            grads["states"] = back
        return out

    def window(self, before: np.ndarray, targets: np.ndarray, state: np.ndarray,
               values: bool = True) -> tuple[float | None, dict, np.ndarray]:
        """Loss (if `values` are asked for), gradients and last state of a window (steps x streams);
        errors flow back to the window's start and no farther."""
        steps, h = len(before), self.hidden
        kept: list = []
        states = np.empty((steps, before.shape[1], h), np.float32)
        for t in range(steps):
            state = states[t] = self.step(before[t], state, kept)
        grads: dict = {}
        logs = self.log_odds(states.reshape(-1, h), targets.reshape(-1), grads, values)
        loss = -float(logs.sum(dtype=np.float64)) if values else None
        back = grads.pop("states").reshape(states.shape)
        by_x, by_g = np.empty((steps, before.shape[1], 3 * h), np.float32), np.empty((steps, before.shape[1], 3 * h), np.float32)
        later = np.zeros_like(state)
        turned = np.ascontiguousarray(self.carry.T)
        for t in range(steps - 1, -1, -1):
            old, gates, new, g = kept[t]
            z, r = gates[:, :h], gates[:, h:]
            error = back[t] + later
            by_new = error * (1 - z) * (1 - new * new)
            by_gates = by_x[t][:, : 2 * h]
            by_gates[:, :h] = error * (old - new)
            by_gates[:, h:] = by_new * g
            by_gates *= gates * (1 - gates)
            by_x[t][:, 2 * h:] = by_new
            by_g[t][:, : 2 * h] = by_gates
            by_g[t][:, 2 * h:] = by_new * r
            later = (error * z + by_g[t] @ turned) * (before[t] != self.end)[:, None]
        flat, olds = by_x.reshape(-1, 3 * h), np.concatenate([k[0] for k in kept])
        grads["carry"] = olds.T @ by_g.reshape(-1, 3 * h)
        grads["bias"] = flat.sum(0)
        grads["inputs"] = np.zeros_like(self.inputs)
        tokens = before.reshape(-1)
        order = np.argsort(tokens.astype(np.uint16) if len(self.inputs) < 65536 else tokens, kind="stable")
        first = np.flatnonzero(np.diff(tokens[order], prepend=-1))
        grads["inputs"][tokens[order][first]] = np.add.reduceat(flat[order], first, axis=0)
        return loss, grads, state


class Trainer:
    """Truncated backpropagation with Adam over streams of tokens."""

    def __init__(self, model: Gru, streams: int = 256, steps: int = 16, rate: float = 0.01):
        self.model, self.streams, self.steps, self.rate = model, streams, steps, rate
        self.rest = np.zeros(0, np.int64)
        self.tokens, self.updates = 0, 0
        self.moments = {part: [np.zeros_like(getattr(model, part)) for _ in range(2)] for part in PARTS}

    def learn(self, tokens: np.ndarray, last: bool = False) -> None:
        """Documents' tokens, each ended by the end token. What does not fill windows waits for the
        next call; the last call uses narrower streams for it."""
        tokens = np.concatenate([self.rest, tokens])
        self.rest = tokens[:0]
        if not last and len(tokens) < 16 * self.streams * self.steps:
            self.rest = tokens
            return
        streams = max(1, min(self.streams, len(tokens) // (4 * self.steps)))
        length = len(tokens) // streams
        if not length:
            return
        block = tokens[: streams * length].reshape(streams, length).T
        before = np.vstack([np.concatenate([[self.model.end], block[-1, :-1]])[None], block[:-1]])
        state = np.zeros((streams, self.model.hidden), np.float32)
        for t in range(0, length, self.steps):
            _, grads, state = self.model.window(before[t: t + self.steps], block[t: t + self.steps], state, values=False)
            self._update(grads, streams * min(self.steps, length - t))
        if streams * length < len(tokens):  # fewer tokens than streams
            self.rest = tokens[streams * length:]
        if last and len(self.rest):
            rest, self.rest = self.rest, tokens[:0]
            column = np.concatenate([[tokens[streams * length - 1]], rest])[:, None]
            _, grads, _ = self.model.window(column[:-1], column[1:], state[-1:])
            self._update(grads, len(rest))

    def _update(self, grads: dict, n: int) -> None:
        self.tokens += n
        self.updates += 1
        scale = self.rate * np.sqrt(1 - 0.99 ** self.updates) / (1 - 0.9 ** self.updates)
        for part in PARTS:
            mean, square = self.moments[part]
            grad = grads[part] / np.float32(n)
            mean += np.float32(0.1) * (grad - mean)
            square += np.float32(0.01) * (grad * grad - square)
            getattr(self.model, part)[...] -= np.float32(scale) * mean / (np.sqrt(square) + np.float32(1e-6))


def log_likelihoods(model: Gru, tokens: np.ndarray, lengths: np.ndarray, at_once: int = 16_000) -> np.ndarray:
    """Natural log-likelihood of each document (its tokens, ended by the end token). All documents
    go side by side, the longest first; the state is carried from window to window to the end."""
    starts = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    starts, sizes = starts[order], lengths[order]
    total = np.zeros(len(lengths))
    state = np.zeros((len(lengths), model.hidden), np.float32)
    rising = -sizes
    t, longest = 0, int(sizes[0]) if len(sizes) else 0
    while t < longest:
        states, targets, who = [], [], []
        room = at_once
        while t < longest and room > 0:
            active = int(np.searchsorted(rising, -t, "left"))  # documents with more than t tokens
            at = starts[:active] + t
            before = tokens[at - 1] if t else np.full(active, model.end, np.int64)
            state = model.step(before, state[:active])
            states.append(state)
            targets.append(tokens[at])
            who.append(np.arange(active))
            room -= active
            t += 1
        logs = model.log_odds(np.concatenate(states), np.concatenate(targets))
        total += np.bincount(np.concatenate(who), weights=logs, minlength=len(total))
    out = np.empty(len(lengths))
    out[order] = total
    return out
