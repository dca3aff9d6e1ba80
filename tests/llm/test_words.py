"""Word splitting and hashing against plain Python."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from quarrystone.llm import words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab é\t\n\x0b\x1c\x85 😀", max_size=30)), max_size=8)


@given(TEXTS)
@settings(max_examples=200, deadline=None)
def test_words_are_those_of_the_pattern(texts):
    for column in (pa.array(texts, pa.string()), pa.concat_arrays([pa.array(["x y"], pa.string()), pa.array(texts, pa.string())]).slice(1)):
        got = [[] for _ in texts]
        for s in words.slices(column):
            raw = s.data.tobytes()
            for i in range(s.n):
                a, b = s.text(i)
                got[s.first + i] = [raw[x:y].decode() for x, y in zip(s.starts[a:b], s.ends[a:b], strict=True)]
        assert got == [WORD.findall(t or "") for t in texts]


def test_hashes_name_words():
    texts = ["a b a", "b", "ab a", "A B"]
    by = {}
    for s in words.slices(pa.array(texts)):
        raw = s.data.tobytes()
        for h, x, y in zip(s.hashes.tolist(), s.starts, s.ends, strict=True):
            by.setdefault(raw[x:y], set()).add(h)
    assert all(len(v) == 1 for v in by.values()) and len({next(iter(v)) for v in by.values()}) == len(by)
    low = next(words.slices(pa.array(["a É", "A É"]), lower=True))
    assert low.hashes[0] == low.hashes[2] and low.hashes[1] == low.hashes[3]


def test_windows():
    v = np.random.default_rng(0).integers(0, 5, 200).astype(np.uint64)
    h = words.rolling_hash(v, 7)
    same = {}
    for i in range(len(v) - 6):
        assert same.setdefault(tuple(v[i : i + 7].tolist()), h[i]) == h[i]
    assert len(set(same.values())) == len(same)
    for width in (1, 2, 5, 31):
        assert words.sliding_argmin(v, width).tolist() == [i + int(v[i : i + width].argmin()) for i in range(len(v) - width + 1)]
    assert len(words.rolling_hash(v[:3], 7)) == 0 and len(words.sliding_argmin(v[:3], 7)) == 0


def test_hashes_do_not_depend_on_runs(monkeypatch):
    text = pa.array(["some words " * 40 + "x" * 500 + " end", "", " a"])
    whole = next(words.slices(text)).hashes
    monkeypatch.setattr(words, "SLICE_BYTES", 64)
    assert np.concatenate([s.hashes for s in words.slices(text)]).tolist() == whole.tolist()
