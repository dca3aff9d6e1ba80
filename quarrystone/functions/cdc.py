"""Content-defined chunking: cut points depend on the bytes before them.

A rolling Gear hash over the last 64 bytes, stricter before the average size and
laxer after it (normalised chunking), within least and greatest sizes.  Boundaries of other
chunkers of this family differ; spans are contiguous and cover the input.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

WINDOW = 64


@cache
def gear() -> np.ndarray:
    """256 random-looking 64-bit values from a mixing rule."""
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def rolling(data: np.ndarray) -> np.ndarray:
    """Gear hash at each byte: the sum of the last 64 values, each shifted by its age; by doubling."""
    h, have = gear()[data], 1
    while have < WINDOW:
        older = np.zeros_like(h)
        older[have:] = h[:-have]
        h = h + (older << np.uint64(have))
        have *= 2
    return h


class Chunker:
    """feed() gives the spans (offset, length) that are certain so far, finish() the last one."""

    def __init__(self, least: int, average: int, most: int):
        if not 0 < least <= average <= most:
            raise ValueError("sizes must rise: 0 < least <= average <= most")
        self.least, self.average, self.most = least, average, most
        bits = max(1, average.bit_length() - 1)
        top = lambda n: np.uint64(((1 << n) - 1) << (64 - n))
        self.strict, self.lax = top(min(63, bits + 1)), top(max(1, bits - 1))
        self.held, self.offset = b"", 0

    def feed(self, data: bytes) -> list[tuple[int, int]]:
        self.held += data
        out = []
        while len(self.held) >= self.most:
            out.append(self._cut())
        return out

    def finish(self) -> list[tuple[int, int]]:
        out = []
        while self.held:
            out.append(self._cut())
        return out

    def _cut(self) -> tuple[int, int]:
        part = np.frombuffer(self.held[: self.most], np.uint8)
        n = len(part)
        if n > self.least:
            h = rolling(part)
            near = np.flatnonzero(h[self.least : min(self.average, n)] & self.strict == 0)
            far = np.flatnonzero(h[self.average : n] & self.lax == 0) if n > self.average else near[:0]
            n = self.least + int(near[0]) if len(near) else self.average + int(far[0]) if len(far) else n
        span = (self.offset, n)
        self.held, self.offset = self.held[n:], self.offset + n
        return span


def spans(data: bytes, least: int, average: int, most: int, feed: int = 64 * 1024) -> list[tuple[int, int]]:
    c = Chunker(least, average, most)
    out = [s for i in range(0, len(data), feed) for s in c.feed(data[i : i + feed])]
    return out + c.finish()


def chunk(df: DataFrame, key: str, data: str, least: int, average: int, most: int) -> DataFrame:
    """(key, chunk_no, offset, length) of each row's binary ``data``; empty or null data has none."""

    def run(batches):
        for pdf in batches:
            rows = [(k, n, o, size) for k, b in zip(pdf[key], pdf[data], strict=True) if b for n, (o, size) in enumerate(spans(b, least, average, most))]
            yield pd.DataFrame(rows, columns=[key, "chunk_no", "offset", "length"])

    kind = dict(df.dtypes)[key]
    return df.select(key, data).mapInPandas(run, f"{key} {kind}, chunk_no long, offset long, length long")
