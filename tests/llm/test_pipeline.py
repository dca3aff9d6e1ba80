"""Each stage of the pipeline against plain Python, on what its predecessor kept."""

import re
import struct
import zlib
from collections import defaultdict
from types import SimpleNamespace

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from quarrystone.llm import common, pii
from quarrystone.llm.queries import QUERIES, table, tokenizer_path

from .test_operators import brute_components, brute_pii, brute_repeats, sha

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    """The documents after each stage, read back from Parquet."""
    docs, out = table(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name))
        stage(spark, docs, SF).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns_stay(spark, kept):
    want = table(spark, SF, "documents").dtypes
    assert all(df.dtypes == want for df in kept[:-1])


def test_quality(spark, kept):
    good = {r.doc_id for r in QUERIES["op1_quality"](spark, SF).collect() if r.predicted}
    assert set(texts(kept[0])) == good


def test_near_duplicates(kept):
    before = texts(kept[0])
    component = brute_components(sorted(before.items()), 5, 80, 100)
    assert texts(kept[1]) == {k: t for k, t in before.items() if component[k][1] == k}
    assert len(before) > kept[1].count()


def test_repeated_passages(kept):
    before, after = texts(kept[1]), texts(kept[2])
    want = {int(k): (n, gone, digest) for k, n, gone, digest in brute_repeats(sorted(before.items()), 50)}
    for k, t in after.items():
        n, gone, digest = want[k]
        assert sha(" ".join(re.findall(r"[^\x20\x09-\x0D]+", t))) == digest
        assert gone or t == before[k]
    assert set(after) == set(before) and any(gone for _, gone, _ in want.values())


def test_personal_data(spark, kept):
    before, after = texts(kept[2]), kept[3].collect()
    spans = {r.doc_id: r.spans for r in pii.digests(kept[2]).collect()}
    for r in after:
        out, at = "", 0
        for s in filter(None, spans[r.doc_id].split(",")):
            kind, a, b = s.split(":")
            if int(a) >= at:
                out, at = out + before[r.doc_id][at : int(a)] + f"<{kind.upper()}>", int(b)
        assert r.text == out + before[r.doc_id][at:] and r.n_chars == len(r.text)
    assert any(brute_pii(t) for t in before.values()) and not any(brute_pii(r.text) for r in after)


def test_packing(kept):
    filled = defaultdict(int)
    for r in kept[4].collect():
        filled[r.sequence_id] += r.length
    assert {r.doc_id for r in kept[4].collect()} == set(texts(kept[3]))
    assert all(n <= 2048 and n & (n - 1) == 0 for n in filled.values())


def test_packed_ids_are_those_of_the_texts(kept):
    exact, pieces = Tokenizer.from_file(tokenizer_path()), defaultdict(list)
    for r in kept[4].collect():
        assert zlib.crc32(struct.pack(f"<{len(r.ids)}I", *r.ids)) == r.ids_crc32
        pieces[r.doc_id].append((r.start, r.ids))
    got = {k: [i for _, ids in sorted(x) for i in ids] for k, x in pieces.items()}
    assert got == {k: [*exact.encode(t, add_special_tokens=False).ids, 1] for k, t in texts(kept[3]).items()}


def test_run(spark, kept, monkeypatch, tmp_path):
    """The rows are those of the stages one by one; what remains in the shared folder is the result."""
    assert corpus_pipeline.ORACLE_SQL is None
    monkeypatch.setattr(common, "shared_dir", lambda _: str(tmp_path))
    got = corpus_pipeline.run(spark, SF)
    rows = lambda df: sorted(map(tuple, df.groupBy("doc_id").sum("length").collect()))
    assert rows(got) == rows(kept[4]) != []
    assert [p.name.split("-")[0] for p in tmp_path.iterdir()] == ["packing"]


def test_shared_folder():
    """Where spark.checkpoint.dir is unset, only a local master gets a folder."""
    context = SimpleNamespace(master="local[2]", applicationId="a")
    session = SimpleNamespace(conf={}, sparkContext=context)
    assert common.shared_dir(session) == common.shared_dir(session)
    context.master = "spark://host:7077"
    with pytest.raises(RuntimeError, match="checkpoint"):
        common.shared_dir(session)
    session.conf = {"spark.checkpoint.dir": "hdfs:///x"}
    assert common.shared_dir(session) == "hdfs:///x"
