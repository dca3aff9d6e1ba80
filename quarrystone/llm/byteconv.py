"""A small byte-level convolutional network in numpy, shared by the classifiers.

Filters see one-hot bytes, so a filter of width w is w tables of 256 weights.
Texts are laid out in blocks of BLOCK bytes (zero padded, each text on a block
boundary); a filter's response is max-pooled within blocks, blocks are pooled
to overlapping chunks, and chunk vectors feed a head.  Training and scoring
use the same layout over the whole of every text.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

#: Bytes in a pooling block; a chunk is a few blocks.
BLOCK = 32
COUNTDOWN = np.arange(BLOCK, 0, -1, dtype=np.uint8)[:, None]
#: Bytes convolved at once, which bounds memory whatever a text's length.
RUN_BYTES = 1 << 15


def layout(data: np.ndarray, offsets: np.ndarray, gap: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Bytes padded so that each text starts a block, and each text's first block (n + 1 of them).

    ``gap`` zeros at least follow a text in its blocks, so that filters may stay within them.  Even an empty text has one block.
    """
    sizes = np.diff(offsets) + gap
    blocks = np.maximum(1, -(-sizes // BLOCK))
    first = np.concatenate([[0], np.cumsum(blocks)])
    out = np.zeros(first[-1] * BLOCK, np.uint8)
    for at, a, b in zip((first[:-1] * BLOCK).tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        out[at : at + b - a] = data[a:b]
    return out, first


@dataclass
class FilterBank:
    """``tables[k]``: weights (width, 256, filters) of one width; biases are shared by all positions."""

    tables: list[np.ndarray]
    bias: np.ndarray
    pairs: list[np.ndarray] = field(default_factory=list)

    @staticmethod
    def random(widths: tuple[int, ...], filters: int, rng: np.random.Generator) -> FilterBank:
        tables = [rng.normal(0, 0.3 / np.sqrt(w), (w, 256, filters)).astype(np.float32) for w in widths]
        return FilterBank(tables, np.zeros(filters * len(widths), np.float32))

    @property
    def reach(self) -> int:
        return max(len(t) for t in self.tables)

    def compiled(self) -> FilterBank:
        """All widths in tables over byte pairs, narrower filters padded by zeros: few wide look-ups when scoring."""
        wide = np.concatenate([np.concatenate([t, np.zeros((self.reach + self.reach % 2 - len(t), 256, t.shape[2]), np.float32)]) for t in self.tables], 2)
        self.pairs = [(wide[k][:, None, :] + wide[k + 1][None, :, :]).reshape(65536, -1) for k in range(0, len(wide), 2)]
        return self

    def responses(self, b: np.ndarray, n: int) -> np.ndarray:
        """Responses at the first n positions of b, which holds reach bytes more."""
        if self.pairs:
            two = b[:-1].astype(np.int32) * 256 + b[1:]
            out = self.pairs[0].take(two[:n], 0)
            for k, p in enumerate(self.pairs[1:], 1):
                out += p.take(two[2 * k : 2 * k + n], 0)
            return out
        parts = []
        for t in self.tables:
            out = t[0].take(b[:n], 0)
            for k in range(1, len(t)):
                out += t[k].take(b[k : k + n], 0)
            parts.append(out)
        return parts[0] if len(parts) == 1 else np.concatenate(parts, 1)

    def block_max(self, data: np.ndarray, last: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Per block the largest response of each filter, with its position if asked; in ``last`` blocks (of texts) filters stay within."""
        padded = np.concatenate([data, np.zeros(self.reach + 1, np.uint8)])
        best, at = [], []
        for i in range(0, len(data), RUN_BYTES):
            n = min(RUN_BYTES, len(data) - i)
            r = self.responses(padded[i : i + n + self.reach + 1], n).reshape(n // BLOCK, BLOCK, -1)
            own = last[np.searchsorted(last, i // BLOCK) : np.searchsorted(last, (i + n) // BLOCK)] - i // BLOCK
            r[own, BLOCK - self.reach + 1 :] = -np.inf
            top = block_tops(r)
            best.append(top)
            if where:
                k = BLOCK - block_tops((r == top[:, None]).view(np.uint8) * COUNTDOWN).astype(np.int64)  # the first of the largest
                at.append(k + (i + BLOCK * np.arange(len(k)))[:, None])
        return np.maximum(np.concatenate(best) + self.bias, 0), np.concatenate(at) if where else None


def block_tops(a: np.ndarray) -> np.ndarray:
    """The maximum over axis 1 of BLOCK, by halves: long runs, which numpy's own max and argmax over such an axis don't make."""
    while a.shape[1] > 1:
        half = a.shape[1] // 2
        a = np.maximum(a[:, :half], a[:, half:])
    return a[:, 0]


def chunk_bounds(first: np.ndarray, blocks: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end block of each chunk, and each text's first chunk.

    Chunks start every ``step`` blocks and hold up to ``blocks``; together they cover the text.
    """
    n = np.diff(first)
    count = 1 + np.maximum(0, -(-(n - blocks) // step))
    begin = np.concatenate([[0], np.cumsum(count)])
    k = np.arange(begin[-1]) - np.repeat(begin[:-1], count)
    start = np.repeat(first[:-1], count) + k * step
    return start, np.minimum(start + blocks, np.repeat(first[1:], count)), begin


def segment_max(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Largest value of each segment of rows; segments may overlap but are short."""
    out = values[start].copy()
    for k in range(1, int((end - start).max(initial=1))):
        np.maximum(out, values[np.minimum(start + k, end - 1)], out=out)
    return out


def segment_argmax(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    best, row = values[start].copy(), np.repeat(start[:, None], values.shape[1], 1)
    for k in range(1, int((end - start).max(initial=1))):
        i = np.minimum(start + k, end - 1)
        more = values[i] > best
        best, row = np.where(more, values[i], best), np.where(more, i[:, None], row)
    return row


class Adam:
    def __init__(self, params: list[np.ndarray], rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m, self.v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]

    def step(self, grads: list[np.ndarray]) -> None:
        self.t += 1
        fix = self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for p, m, v, g in zip(self.params, self.m, self.v, grads, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= (fix * m / (np.sqrt(v) + 1e-8)).astype(p.dtype)


@dataclass
class ConvNet:
    """Filters, chunk max-pooling, then a two-layer head over [mean; max] of a text's chunk vectors.

    With ``per_chunk`` the head sees each chunk (a fixed-length window) alone and the
    text's probabilities are the mean of its windows'.
    """

    bank: FilterBank
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    blocks: int
    step: int
    per_chunk: bool

    @staticmethod
    def random(widths: tuple[int, ...], filters: int, hidden: int, classes: int, blocks: int, step: int, per_chunk: bool, seed: int) -> ConvNet:
        rng = np.random.default_rng(seed)
        bank = FilterBank.random(widths, filters, rng)
        d = filters * len(widths) * (1 if per_chunk else 2)
        return ConvNet(bank, rng.normal(0, 1 / np.sqrt(d), (d, hidden)).astype(np.float32), np.zeros(hidden, np.float32), rng.normal(0, 1 / np.sqrt(hidden), (hidden, classes)).astype(np.float32), np.zeros(classes, np.float32), blocks, step, per_chunk)

    def head(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.maximum(x @ self.w1 + self.b1, 0)
        z = h @ self.w2 + self.b2
        p = np.exp(z - z.max(1, keepdims=True))
        return h, p / p.sum(1, keepdims=True)

    def probabilities(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Class probabilities of each text, from all of its bytes."""
        laid, first = layout(data, offsets, self.bank.reach - 1)
        pooled, _ = self.bank.block_max(laid, first[1:] - 1)
        start, end, begin = chunk_bounds(first, self.blocks, self.step)
        v = segment_max(pooled, start, end)
        if self.per_chunk:
            p = np.add.reduceat(self.head(v)[1], begin[:-1], 0)
            return p / np.diff(begin)[:, None]
        mean = np.add.reduceat(v, begin[:-1], 0) / np.diff(begin)[:, None]
        return self.head(np.concatenate([mean, np.maximum.reduceat(v, begin[:-1], 0)], 1).astype(np.float32))[1]

    def fit(self, data: np.ndarray, offsets: np.ndarray, labels: np.ndarray, epochs: int, batch: int, rate: float, seed: int) -> ConvNet:
        """Adam on the mean cross-entropy; the gradient of max-pooling goes to the arg-max position only."""
        params = [*self.bank.tables, self.bank.bias, self.w1, self.b1, self.w2, self.b2]
        adam, rng = Adam(params, rate), np.random.default_rng(seed)
        for epoch in range(epochs):
            adam.rate = rate * (1 - epoch / epochs) + 0.02 * rate
            order = rng.permutation(len(labels))
            for i in range(0, len(order), batch):
                own = order[i : i + batch]
                sizes = offsets[own + 1] - offsets[own]
                local = np.concatenate([[0], np.cumsum(sizes)])
                adam.step(self.gradients(np.concatenate([data[offsets[k] : offsets[k + 1]] for k in own]), local, labels[own]))
        self.bank.compiled()
        return self

    def gradients(self, data: np.ndarray, offsets: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
        laid, first = layout(data, offsets, self.bank.reach - 1)
        pooled, at = self.bank.block_max(laid, first[1:] - 1, where=True)
        start, end, begin = chunk_bounds(first, self.blocks, self.step)
        row = segment_argmax(pooled, start, end)
        v, pos = np.take_along_axis(pooled, row, 0), np.take_along_axis(at, row, 0)
        count = np.diff(begin)
        owner = np.repeat(np.arange(len(count)), count)
        if self.per_chunk:
            x, y, weight = v, labels[owner], (1 / count)[owner] / len(labels)
        else:
            x = np.concatenate([np.add.reduceat(v, begin[:-1], 0) / count[:, None], np.maximum.reduceat(v, begin[:-1], 0)], 1).astype(np.float32)
            y, weight = labels, np.full(len(labels), 1 / len(labels))
        h, p = self.head(x)
        dz = p.copy()
        dz[np.arange(len(y)), y] -= 1
        dz = (dz * weight[:, None]).astype(np.float32)
        dh = (dz @ self.w2.T) * (h > 0)
        dx = dh @ self.w1.T
        if self.per_chunk:
            dv = dx
        else:
            f = v.shape[1]
            top = (v == x[owner, f:]).astype(np.float32)  # overlapping chunks may share the largest response
            top /= np.add.reduceat(top, begin[:-1], 0)[owner]
            dv = dx[owner, :f] / count[owner, None] + dx[owner, f:] * top
        dv = dv * (v > 0)
        out, f0 = [], 0
        padded = np.concatenate([laid, np.zeros(self.bank.reach + 1, np.uint8)])
        for t in self.bank.tables:
            f = t.shape[2]
            g, q = dv[:, f0 : f0 + f].ravel(), pos[:, f0 : f0 + f].ravel()
            col = np.tile(np.arange(f), len(dv))
            out.append(np.stack([np.bincount(padded[q + k].astype(np.int64) * f + col, g, 256 * f).reshape(256, f) for k in range(len(t))]))
            f0 += f
        return [*out, dv.sum(0), x.T @ dh, dh.sum(0), h.T @ dz, dz.sum(0)]
