"""A byte convolutional network in numpy: multi-width filters, max pooling, a linear layer on top.

A filter of width w adds one learned weight for each of w neighbouring bytes. Pooling takes each filter's maximum over a
window of fixed length; a text is cut into such windows, overlapping by more than the widest filter, so that every
byte of the whole text is met. The pooled values go through a rectifier and a linear layer to the logits.

Filters start at every byte. At inference the weights of two neighbouring bytes are summed beforehand into tables of
65,536 rows, so that a filter costs w/2 lookups a position. Training is plain Adam on windows of a bounded sample, with the gradient of max pooling
sent to the position that won. Everything is seeded: equal samples give equal models.
"""

from __future__ import annotations

import numpy as np

PAD = 0


class ByteConvNet:
    def __init__(self, classes: int, widths=(4, 6), filters: int = 16, window: int = 512, overlap: int = 32, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.classes, self.widths, self.filters, self.window, self.step = classes, tuple(widths), filters, window, window - overlap
        self.kernels = [rng.normal(0, 0.3, (w, 256, filters)).astype(np.float32) for w in widths]
        self.bias = np.zeros(filters * len(widths), np.float32)
        self.top = rng.normal(0, 0.1, (filters * len(widths), classes)).astype(np.float32)
        self.top_bias = np.zeros(classes, np.float32)
        self.tables: list | None = None
        if min(self.widths) < 1 or max(self.widths) > overlap:
            raise ValueError("widths must be from 1 to the overlap")

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "tables"} | {"tables": None}

    # ---- windows ----------------------------------------------------------------------------------------------

    def windows(self, data: bytes) -> np.ndarray:
        """The overlapping windows of a text, (n, window) bytes; the last is padded."""
        n = max(1, -(-(len(data) - self.window) // self.step) + 1)
        padded = np.full((n - 1) * self.step + self.window, PAD, np.uint8)
        padded[: len(data)] = np.frombuffer(data, np.uint8)
        return np.lib.stride_tricks.sliding_window_view(padded, self.window)[:: self.step]

    # ---- forward ----------------------------------------------------------------------------------------------

    def _pool_train(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pooled values and winning positions of a batch of windows."""
        pooled, won = [], []
        for kernel in self.kernels:
            w = kernel.shape[0]
            n = x.shape[1] - max(self.widths) + 1
            out = kernel[0][x[:, :n]]
            for k in range(1, w):
                out += kernel[k][x[:, k : k + n]]
            at = out.argmax(axis=1)
            won.append(at)
            pooled.append(np.take_along_axis(out, at[:, None, :], 1)[:, 0, :])
        return np.concatenate(pooled, 1) + self.bias, np.concatenate(won, 1)

    def _make_tables(self) -> None:
        """For each offset 0, 2, 4, ...: the summed weights of byte pairs, filters of all widths that reach so far side by side."""
        b = np.arange(65536)
        low, high = b & 255, b >> 8
        self.tables = []
        for offset in range(0, max(self.widths), 2):
            kernels = [k for k in sorted(self.kernels, key=lambda k: -k.shape[0]) if k.shape[0] > offset]
            self.tables.append(np.ascontiguousarray(np.concatenate([k[offset][low] + (k[offset + 1][high] if offset + 1 < k.shape[0] else 0) for k in kernels], 1).astype(np.float32)))
        order = sorted(range(len(self.kernels)), key=lambda i: -self.kernels[i].shape[0])
        self.columns = np.concatenate([np.arange(self.filters) + i * self.filters for i in order])

    def pool(self, x: np.ndarray) -> np.ndarray:
        """Pooled values of windows, (n, window) bytes -> (n, filters of all widths)."""
        if self.tables is None:
            self._make_tables()
        # the last byte has no neighbour; what is beside it has no weight
        after = np.concatenate([x[:, 1:], np.zeros((len(x), 1), np.uint8)], 1)
        pairs = x.astype(np.uint16) | after.astype(np.uint16) << 8
        count = self.window - max(self.widths) + 1
        out = np.empty((len(x), self.bias.size), np.float32)
        for at in range(0, len(x), 16):  # what a slice needs stays in the processor's cache
            part = pairs[at : at + 16]
            value = np.take(self.tables[0], part[:, :count], axis=0)
            for k, table in enumerate(self.tables[1:], 1):
                value[:, :, : table.shape[1]] += np.take(table, part[:, 2 * k : 2 * k + count], axis=0)
            value.max(axis=1, out=out[at : at + 16])
        pooled = np.empty_like(out)
        pooled[:, self.columns] = out
        return pooled + self.bias

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled, 0) @ self.top + self.top_bias

    # ---- training ---------------------------------------------------------------------------------------------

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 600, batch: int = 64, rate: float = 0.02, seed: int = 11, decay: float = 1e-4) -> None:
        """x: (n, window) bytes, y: classes, weight: chance of a window to be drawn."""
        rng = np.random.default_rng(seed)
        chance = weight / weight.sum()
        params = [*self.kernels, self.bias, self.top, self.top_bias]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        draws = rng.choice(len(x), size=(steps, batch), p=chance)
        for t in range(1, steps + 1):
            pick = draws[t - 1]
            xb, yb = x[pick], y[pick]
            pooled, won = self._pool_train(xb)
            hidden = np.maximum(pooled, 0)
            z = hidden @ self.top + self.top_bias
            z -= z.max(1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(1, keepdims=True)
            p[np.arange(batch), yb] -= 1
            p /= batch
            d_hidden = (p @ self.top.T) * (pooled > 0)
            grads = []
            for i, kernel in enumerate(self.kernels):
                cols = slice(i * self.filters, (i + 1) * self.filters)
                g, at = np.zeros_like(kernel), won[:, cols]
                f = np.broadcast_to(np.arange(self.filters), at.shape)
                for k in range(kernel.shape[0]):
                    np.add.at(g[k], (np.take_along_axis(xb, at + k, 1), f), d_hidden[:, cols])
                grads.append(g)
            grads += [d_hidden.sum(0), hidden.T @ p, p.sum(0)]
            step = rate * min(1.0, 2.0 * (1 - (t - 1) / steps))
            for j, (param, grad) in enumerate(zip(params, grads, strict=True)):
                grad = grad + decay * param
                first[j] += 0.1 * (grad - first[j])
                second[j] += 0.01 * (grad * grad - second[j])
                param -= step * (first[j] / (1 - 0.9**t)) / (np.sqrt(second[j] / (1 - 0.99**t)) + 1e-6)
        self.tables = None
