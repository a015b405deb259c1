"""A gated recurrent network over word ids with a class-factored softmax, in numpy.

A word's probability is that of its class times its own within the class. Head words are cut into classes by the square
roots of their counts, so that frequent words have narrow classes; two further classes hold the words that have no
output of their own. Training is by truncated backpropagation: the state goes on from window to window, gradients stop
at its start.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

#: Units of the state, classes of head words, classes beyond them.
HIDDEN, CLASSES, BEYOND = 16, 28, 2
#: Streams trained side by side (fewer where a stretch of words would have under LEAST windows of them), words of a window,
#: step size of Adagrad and what its sums begin with.
LANES, LEAST, WINDOW, RATE, START = 256, 128, 16, 0.05, 1e-5
#: Documents scored side by side, and words of a window there.
SCORE_LANES, SCORE_WINDOW = 256, 32


def class_starts(counts: Sequence[int], classes: int = CLASSES) -> np.ndarray:
    """First words of up to `classes` classes of words in falling order of counts, and the number of words."""
    mass = np.cumsum(np.sqrt(np.asarray(counts, dtype=np.float64) + 1))
    cuts = np.searchsorted(mass, mass[-1] * np.arange(1, classes) / classes, side="right")
    return np.unique(np.r_[0, np.minimum(cuts, len(mass)), len(mass)]).astype(np.int64)


@dataclass
class Network:
    """starts: first word of each class of head words, and their number; the ids after it are the classes beyond.

    inputs: what an id adds to the update gate, the reset gate and the candidate; state: what the state adds to them;
    by_class, by_word: outputs, with the biases of classes and words.
    """

    starts: np.ndarray
    inputs: np.ndarray
    state: np.ndarray
    by_class: np.ndarray
    class_bias: np.ndarray
    by_word: np.ndarray
    word_bias: np.ndarray

    NAMES = ("inputs", "state", "by_class", "class_bias", "by_word", "word_bias")

    def __post_init__(self):
        heads = len(self.starts) - 1
        self.class_of = np.r_[np.repeat(np.arange(heads), np.diff(self.starts)), heads + np.arange(BEYOND)].astype(np.uint8)

    @classmethod
    def begun(cls, counts: Sequence[int], beyond: Sequence[int], seed: int = 11) -> Network:
        """A network whose biases are the logarithms of the counts: of the head words, falling, and of what is beyond."""
        starts, words, rng = class_starts(counts), len(counts), np.random.default_rng(seed)
        counts = np.asarray(counts, dtype=np.float64) + 0.5
        of_class = np.r_[np.add.reduceat(counts, starts[:-1]), np.asarray(beyond, dtype=np.float64) + 0.5]
        draw = lambda *shape: (0.1 * rng.standard_normal(shape)).astype(np.float32)
        within = np.log(counts / np.repeat(of_class[:-BEYOND], np.diff(starts)))
        return cls(
            starts, draw(words + BEYOND, 3 * HIDDEN), draw(HIDDEN, 3 * HIDDEN), draw(HIDDEN, len(of_class)), np.log(of_class / of_class.sum()).astype(np.float32), draw(words, HIDDEN), within.astype(np.float32)
        )

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, n).ravel() for n in self.NAMES])

    def filled(self, flat: np.ndarray) -> Network:
        """This network's form with other parameters."""
        at, parts = 0, []
        for n in self.NAMES:
            own = getattr(self, n)
            parts.append(flat[at : at + own.size].astype(np.float32).reshape(own.shape))
            at += own.size
        return Network(self.starts, *parts)

    def walked(self, given: np.ndarray, first: np.ndarray, h: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """States after each of the ids given (steps, lanes), from the states h before them; where `first` is set, the
        state begins anew. With `keep`, what backpropagation needs."""
        steps, lanes = given.shape
        x, out, kept = self.inputs[given], np.empty((steps, lanes, HIDDEN), dtype=np.float32), []
        anew = first.any(axis=1)
        for t in range(steps):
            if anew[t]:
                h = np.where(first[t][:, None], np.float32(0), h)
            s = h @ self.state
            gates = x[t, :, : 2 * HIDDEN] + s[:, : 2 * HIDDEN]
            np.multiply(gates, 0.5, out=gates)
            np.tanh(gates, out=gates)
            np.multiply(gates, 0.5, out=gates)
            np.add(gates, 0.5, out=gates)
            update, reset = gates[:, :HIDDEN], gates[:, HIDDEN:]
            told = s[:, 2 * HIDDEN :]
            new = reset * told
            np.add(new, x[t, :, 2 * HIDDEN :], out=new)
            np.tanh(new, out=new)
            before = h
            h = h - new
            np.multiply(h, update, out=h)
            np.add(h, new, out=h)
            out[t] = h
            if keep:
                kept.append((before, update, reset, told, new))
        return out, kept

    @staticmethod
    def _exponents(h1: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """h1 @ weights, whose last row is the bias; less each row's greatest where they might be too great for exp."""
        logits = h1 @ weights
        # no part of a state is beyond 1
        if np.abs(weights).sum(axis=0).max() > 60:
            logits -= logits.max(axis=1, keepdims=True)
        return logits

    def log_p(self, h: np.ndarray, words: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Log probability of each word after its state (of its class alone, if it is beyond). With `grads`, also the
        gradient of their sum in h; those in the outputs are put into `grads`."""
        n, of = len(words), self.class_of[words]
        h1 = np.concatenate([h, np.ones((n, 1), dtype=h.dtype)], axis=1)
        p = self._exponents(h1, np.concatenate([self.by_class, self.class_bias[None, :]]))
        out = p[np.arange(n), of]
        np.exp(p, out=p)
        total = p @ np.ones(p.shape[1], dtype=p.dtype)
        out -= np.log(total)
        dh = None
        if grads is not None:
            p *= np.float32(-1) / total[:, None]
            p[np.arange(n), of] += 1
            grads["by_class"], grads["class_bias"] = h.T @ p, p.sum(axis=0)
            dh = p @ self.by_class.T
            grads["by_word"], grads["word_bias"] = np.zeros_like(self.by_word), np.zeros_like(self.word_bias)
        order = np.argsort(of, kind="stable")
        ends = np.cumsum(np.bincount(of, minlength=len(self.starts) - 1 + BEYOND))
        for k in range(len(self.starts) - 1):
            rows = order[ends[k - 1] if k else 0 : ends[k]]
            if not len(rows):
                continue
            low, high = self.starts[k], self.starts[k + 1]
            if high - low == 1:
                continue
            weights = self.by_word[low:high]
            own = h1[rows]
            logits = self._exponents(own, np.concatenate([weights.T, self.word_bias[None, low:high]]))
            at = words[rows] - low
            picked = logits[np.arange(len(rows)), at]
            np.exp(logits, out=logits)
            total = logits @ np.ones(high - low, dtype=logits.dtype)
            out[rows] += picked - np.log(total)
            if grads is not None:
                logits *= np.float32(-1) / total[:, None]
                logits[np.arange(len(rows)), at] += 1
                grads["by_word"][low:high] = logits.T @ own[:, :HIDDEN]
                grads["word_bias"][low:high] = logits.sum(axis=0)
                dh[rows] += logits @ weights
        return out, dh

    def gradients(self, given: np.ndarray, first: np.ndarray, words: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict]:
        """(log probabilities, last states, gradients of their sum) of a window; of `inputs` only rows, as (ids, rows)."""
        steps, lanes = given.shape
        out, kept = self.walked(given, first, h, keep=True)
        grads: dict = {}
        logs, dout = self.log_p(out.reshape(-1, HIDDEN), words.ravel(), grads)
        dout = dout.reshape(steps, lanes, HIDDEN)
        dx, drec = np.empty((steps, lanes, 3 * HIDDEN), dtype=np.float32), np.empty((steps, lanes, 3 * HIDDEN), dtype=np.float32)
        dh = np.zeros((lanes, HIDDEN), dtype=np.float32)
        back = np.ascontiguousarray(self.state.T)
        for t in range(steps - 1, -1, -1):
            before, update, reset, told, new = kept[t]
            dh = dh + dout[t]
            dnew = dh * (1 - update) * (1 - new * new)
            dx[t, :, :HIDDEN] = dh * (before - new) * update * (1 - update)
            dx[t, :, HIDDEN : 2 * HIDDEN] = dnew * told * reset * (1 - reset)
            dx[t, :, 2 * HIDDEN :] = dnew
            drec[t, :, : 2 * HIDDEN] = dx[t, :, : 2 * HIDDEN]
            np.multiply(dnew, reset, out=drec[t, :, 2 * HIDDEN :])
            dh = dh * update + drec[t] @ back
            if first[t].any():
                dh[first[t]] = 0
        grads["state"] = np.concatenate([k[0] for k in kept]).T @ drec.reshape(-1, 3 * HIDDEN)
        ids = given.ravel()
        order = np.argsort(ids, kind="stable")
        sorted_ids = ids[order]
        begins = np.flatnonzero(np.r_[True, sorted_ids[1:] != sorted_ids[:-1]])
        grads["inputs"] = (sorted_ids[begins], np.add.reduceat(dx.reshape(-1, 3 * HIDDEN)[order], begins, axis=0))
        return logs, out[-1], grads


class Trainer:
    """Adagrad over windows of a stream of documents, each closed by `end`."""

    def __init__(self, net: Network, end: int):
        self.net, self.end = net, end
        self.sums = {n: np.full(getattr(net, n).shape, START, dtype=np.float32) for n in net.NAMES}

    def learn(self, stream: np.ndarray) -> None:
        """One pass over the stream (ids of whole documents), cut into lanes of one length; a document that a lane's end
        cuts goes on in the next lane from an empty state."""
        lanes = min(LANES, max(1, len(stream) // (LEAST * WINDOW)))
        steps = -(-len(stream) // lanes)
        whole = np.full(lanes * steps, self.end, dtype=np.int64)
        whole[: len(stream)] = stream
        words = whole.reshape(lanes, steps).T
        given = np.concatenate([np.full((1, lanes), self.end), words[:-1]])
        first = given == self.end
        h = np.zeros((lanes, HIDDEN), dtype=np.float32)
        for at in range(0, steps, WINDOW):
            part = slice(at, at + WINDOW)
            _, h, grads = self.net.gradients(given[part], first[part], words[part], h)
            n = np.float32(lanes * len(words[part]))
            for name, g in grads.items():
                own, sums = getattr(self.net, name), self.sums[name]
                rows, g = g if name == "inputs" else (slice(None), g)
                g = g / n
                total = sums[rows] + g * g
                sums[rows] = total
                own[rows] += np.float32(RATE) * g / np.sqrt(total)


def scored(net: Network, docs: Sequence[np.ndarray], end: int) -> np.ndarray:
    """Natural log probability of each whole document (ids that close with `end`), its state carried through all windows.

    Documents are dealt to lanes, the longest first; a lane's next document begins where one ends.
    """
    order = sorted(range(len(docs)), key=lambda i: -len(docs[i]))
    lanes: list[list[int]] = [[] for _ in range(min(SCORE_LANES, len(docs)))]
    load = [(0, i) for i in range(len(lanes))]
    for i in order:
        n, lane = heapq.heappop(load)
        lanes[lane].append(i)
        heapq.heappush(load, (n + len(docs[i]), lane))
    lanes = [lanes[i] for n, i in sorted(load, key=lambda x: -x[0])]
    streams = [np.concatenate([docs[i] for i in own]) for own in lanes]
    lengths = np.array([len(s) for s in streams], dtype=np.int64)
    told = [np.empty(n, dtype=np.float32) for n in lengths]
    h = np.zeros((len(lanes), HIDDEN), dtype=np.float32)
    last = np.full(len(lanes), end, dtype=np.int64)
    for at in range(0, int(lengths.max(initial=0)), SCORE_WINDOW):
        live = int(np.searchsorted(-lengths, -at))  # lanes that go on beyond `at`
        words = np.full((live, min(SCORE_WINDOW, int(lengths[0]) - at)), end, dtype=np.int64)
        for row in range(live):
            part = streams[row][at : at + SCORE_WINDOW]
            words[row, : len(part)] = part
        words = words.T
        given = np.concatenate([last[None, :live], words[:-1]])
        last = words[-1]
        states, _ = net.walked(given, given == end, h[:live], keep=False)
        h = states[-1]
        logs = net.log_p(states.reshape(-1, HIDDEN), np.ascontiguousarray(words).ravel())[0].reshape(words.shape).T
        for row in range(live):
            part = told[row][at : at + SCORE_WINDOW]
            part[:] = logs[row, : len(part)]
    out = np.zeros(len(docs))
    for own, logs in zip(lanes, told, strict=True):
        ends = np.cumsum([len(docs[i]) for i in own])
        out[own] = np.add.reduceat(logs.astype(np.float64), np.r_[0, ends[:-1]])
    return out
