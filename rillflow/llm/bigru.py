"""A bidirectional gated recurrent network over bytes, in numpy, trained by backpropagation through time.

Gates and candidates are piecewise linear (clipped), which costs a third of the
time of exponentials.
"""

from __future__ import annotations

import numpy as np

WINDOW = 256
#: Slope of the update and reset gates around their middle.
SLOPE = 0.25


def active_rows(lengths: np.ndarray) -> list[int]:
    """How many of the rows, sorted by falling length, have a byte at each step."""
    return [int(x) for x in np.searchsorted(-lengths, -np.arange(1, int(lengths[0]) + 1), side="right")]


def softmax(logits: np.ndarray) -> np.ndarray:
    """Probabilities over the middle axis, in place."""
    logits -= logits.max(axis=1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=1, keepdims=True)
    return logits


class BiGru:
    """Labels every byte of a window of up to ``WINDOW`` bytes with a probability for each class.

    The parameters of both directions are ``(byte table, recurrence)``; both hold
    the update gate, the reset gate and the candidate side by side.
    """

    def __init__(self, classes: int, hidden: int = 8, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        f32 = lambda shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.params = [
            f32((256, 3 * hidden), 0.3), f32((hidden, 3 * hidden), 1.0 / np.sqrt(hidden)),
            f32((256, 3 * hidden), 0.3), f32((hidden, 3 * hidden), 1.0 / np.sqrt(hidden)),
            f32((2 * hidden, classes), 1.0 / np.sqrt(2 * hidden)), np.zeros(classes, np.float32),
        ]

    def _add_logits(self, at: np.ndarray, active: list[int], steps: range, table: np.ndarray, recurrence: np.ndarray, out: np.ndarray, logits: np.ndarray) -> None:
        """Adds one direction's share of the logits (steps, classes, n); rows are sorted by falling length.

        The reverse direction runs from the last step down, so a row begins with
        an empty state at its own last byte.
        """
        n, hidden = at.shape[1], self.hidden
        gate_table, gate_rec = table[:, : 2 * hidden] * np.float32(SLOPE) + np.float32(0.5), recurrence[:, : 2 * hidden] * np.float32(SLOPE)
        own_table, own_rec, weights = table[:, 2 * hidden :].copy(), recurrence[:, 2 * hidden :].copy(), out.T.copy()
        h = np.zeros((n, hidden), dtype=np.float32)
        gates, more = np.empty((n, 2 * hidden), np.float32), np.empty((n, 2 * hidden), np.float32)
        candidate, past = np.empty((n, hidden), np.float32), np.empty((n, hidden), np.float32)
        for t in steps:
            m = active[t]
            g, r, c, p, state = gates[:m], more[:m], candidate[:m], past[:m], h[:m]
            gate_table.take(at[t, :m], axis=0, out=g, mode="clip")
            np.matmul(state, gate_rec, out=r)
            g += r
            np.clip(g, 0, 1, out=g)
            own_table.take(at[t, :m], axis=0, out=c, mode="clip")
            np.matmul(state, own_rec, out=p)
            p *= g[:, hidden:]
            c += p
            np.clip(c, -1, 1, out=c)
            state -= c
            state *= g[:, :hidden]
            state += c
            logits[t, :, :m] += weights @ state.T

    def sums(self, windows: np.ndarray, lengths: np.ndarray, rows: int = 4096) -> np.ndarray:
        """Per window, the sum of its positions' class probabilities; any order."""
        table_f, rec_f, table_b, rec_b, out, bias = self.params
        found = np.zeros((len(windows), bias.size), dtype=np.float32)
        order = np.argsort(-lengths, kind="stable")
        for first in range(0, len(order), rows):
            part = order[first : first + rows]
            active = active_rows(lengths[part])
            steps = len(active)
            at = np.ascontiguousarray(windows[part][:, :steps].T).astype(np.intp)
            logits = np.zeros((steps, bias.size, len(part)), np.float32) + bias[:, None]
            self._add_logits(at, active, range(steps), table_f, rec_f, out[: self.hidden], logits)
            self._add_logits(at, active, range(steps - 1, -1, -1), table_b, rec_b, out[self.hidden :], logits)
            p = softmax(logits)
            p *= (np.arange(steps)[:, None] < lengths[part][None, :])[:, None, :]
            found[part] = p.sum(axis=0).T
        return found

    def _run(self, windows: np.ndarray, active: list[int], steps: range, table: np.ndarray, recurrence: np.ndarray, keep: dict) -> np.ndarray:
        """States at each step, (steps, n, hidden), and in ``keep`` what backpropagation needs."""
        hidden = self.hidden
        out = np.zeros((len(active), len(windows), hidden), dtype=table.dtype)
        h = np.zeros((len(windows), hidden), dtype=table.dtype)
        for t in steps:
            m = active[t]
            x = table[windows[:m, t]]
            rec = h[:m] @ recurrence
            gates = np.minimum(np.maximum(SLOPE * (x[:, : 2 * hidden] + rec[:, : 2 * hidden]) + 0.5, 0), 1)
            update, reset = gates[:, :hidden], gates[:, hidden:]
            candidate = np.minimum(np.maximum(x[:, 2 * hidden :] + reset * rec[:, 2 * hidden :], -1), 1)
            keep[t] = (h[:m].copy(), update, reset, candidate, rec[:, 2 * hidden :])
            h[:m] = candidate + update * (h[:m] - candidate)
            out[t, :m] = h[:m]
        return out

    def _back(self, windows: np.ndarray, active: list[int], steps: range, recurrence: np.ndarray, keep: dict, grad_states: np.ndarray, grad_table: np.ndarray, grad_rec: np.ndarray) -> None:
        """Backpropagation through time of one direction, its steps in reverse; adds to the gradients."""
        carry = np.zeros((len(windows), self.hidden), dtype=grad_table.dtype)
        slope = lambda gate: SLOPE * ((gate > 0) & (gate < 1))
        used, moved = [], []
        for t in reversed(steps):
            m = active[t]
            before, update, reset, candidate, rec_c = keep[t]
            g = grad_states[t, :m] + carry[:m]
            d_candidate = g * (1 - update) * ((candidate > -1) & (candidate < 1))
            d_update = g * (before - candidate) * slope(update)
            d_reset = d_candidate * rec_c * slope(reset)
            used.append(windows[:m, t])
            moved.append(np.concatenate([d_update, d_reset, d_candidate], axis=1))
            d_rec = np.concatenate([d_update, d_reset, d_candidate * reset], axis=1)
            grad_rec += before.T @ d_rec
            carry[:m] = g * update + d_rec @ recurrence.T
        np.add.at(grad_table, np.concatenate(used), np.concatenate(moved))

    def gradients(self, windows: np.ndarray, lengths: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy over all positions, and its gradient for every parameter; ``lengths`` must fall."""
        active = active_rows(lengths)
        ahead, back = range(len(active)), range(len(active) - 1, -1, -1)
        table_f, rec_f, table_b, rec_b, out, bias = self.params
        keep_f: dict = {}
        keep_b: dict = {}
        both = np.concatenate([self._run(windows, active, ahead, table_f, rec_f, keep_f), self._run(windows, active, back, table_b, rec_b, keep_b)], axis=2)
        p = softmax(np.swapaxes(both @ out + bias, 1, 2))
        real = (np.arange(len(active))[:, None] < lengths[None, :]).astype(both.dtype)
        total = real.sum()
        rows = np.arange(len(labels))
        loss = -float((np.log(p[:, labels, rows] + 1e-9) * real).sum() / total)
        p[:, labels, rows] -= 1
        d_logits = np.swapaxes(p * (real / total)[:, None, :], 1, 2)
        flat = d_logits.reshape(-1, d_logits.shape[2])
        grads = [np.zeros_like(x) for x in self.params]
        grads[4] += both.reshape(-1, both.shape[2]).T @ flat
        grads[5] += flat.sum(axis=0)
        d_both = d_logits @ out.T
        self._back(windows, active, ahead, rec_f, keep_f, d_both[:, :, : self.hidden], grads[0], grads[1])
        self._back(windows, active, back, rec_b, keep_b, d_both[:, :, self.hidden :], grads[2], grads[3])
        return loss, grads

    def train(self, draw, steps: int, rate: float) -> list[float]:
        """Adam on the batches (windows, lengths, labels) that ``draw`` gives; returns the losses."""
        first = [np.zeros_like(x) for x in self.params]
        second = [np.zeros_like(x) for x in self.params]
        losses = []
        for step in range(1, steps + 1):
            loss, grads = self.gradients(*draw())
            losses.append(loss)
            now = rate * (0.1 if step > 0.8 * steps else 1.0)
            size = np.sqrt(sum(float((g * g).sum()) for g in grads))
            for k, g in enumerate(grads):
                g *= min(1.0, 1.0 / max(size, 1e-12))  # a long window may have a steep gradient
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                self.params[k] -= (now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(self.params[k].dtype)
        return losses
