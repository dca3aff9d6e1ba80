"""The ten operators against brute force, and on awkward and empty tables."""

import hashlib
import math
import random
import re
import struct
import time
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from tokenizers import Tokenizer

from quarrystone.llm import bpe, byteconv, classify, common, embeddings, jaccard, packing, pii, secret_scan, substrings
from quarrystone.llm.common import connected_components, possibly_in
from quarrystone.llm.queries import QUERIES, tokenizer_path

SF = "/root/testdata/sf0.01"
OPS = [n for n in QUERIES if n.startswith("op")]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


@pytest.mark.parametrize("name", OPS)
def test_empty_tables(spark, empty_path, name):
    assert QUERIES[name](spark, empty_path).collect() == []


@pytest.mark.parametrize("name", [n for n in OPS if n not in ("op3_packing", "op7_embedding_dedup", "op10_topk")])
def test_awkward_documents_keep_their_rows(spark, awkward_path, awkward, name):
    got = [r.doc_id for r in QUERIES[name](spark, awkward_path).collect()]
    assert sorted(map(str, got)) == sorted(str(r.doc_id) for r in awkward.collect())


def test_pipeline_on_awkward_and_empty_tables(spark, awkward_path, empty_path):
    assert QUERIES["pipeline"](spark, empty_path).collect() == []
    assert QUERIES["pipeline"](spark, awkward_path).columns[0] == "doc_id"


# 1, 2 --------------------------------------------------------------------------------------------


def test_quality_on_held_out_rows(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = QUERIES["op1_quality"](spark, SF).join(labels, "doc_id").where("held_out").collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.9


def test_held_out_rule(spark):
    rows = spark.range(50).select("id", classify.held_out("id")).collect()
    assert [r[1] for r in rows] == [zlib.crc32(str(r.id).encode()) % 4 == 2 for r in rows]


def test_held_out_labels_are_not_learned(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet").limit(200), spark.read.parquet(f"{SF}/labels.parquet")
    flipped = labels.withColumn("quality", classify.F.when(classify.held_out(), 1 - classify.F.col("quality")).otherwise(classify.F.col("quality")))
    a, b = (classify.fit_quality(docs, x) for x in (labels, flipped))
    assert np.array_equal(a.w1, b.w1)


def test_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = QUERIES["op2_language"](spark, SF).join(docs, "doc_id").where("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.97


def test_no_letters(spark, awkward_path):
    got = {r.doc_id: r for r in QUERIES["op2_language"](spark, awkward_path).collect()}
    assert {got[k].lang_pred for k in (0, 1, 7, 9)} == {"und"} and got[8].lang_pred != "und"


def small_net(per_chunk):
    net = byteconv.ConvNet.random(widths=(2, 3, 4), filters=3, hidden=4, classes=3, blocks=3, step=2, per_chunk=per_chunk, seed=3)
    net.bank.bias[:] = np.random.default_rng(4).normal(size=len(net.bank.bias)).astype(np.float32) * 0.1
    return net


def texts_of(seed):
    rng = np.random.default_rng(seed)
    return [rng.integers(97, 123, n).astype(np.uint8).tobytes() for n in (0, 1, 5, 31, 32, 33, 64, 95, 96, 97, 700, 3000)]


def packed_texts(texts):
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])


def naive_probabilities(net, text):
    """One text by plain loops: convolution, pooling to blocks and chunks, head, softmax."""
    reach = max(len(t) for t in net.bank.tables)
    n = max(1, -(-(len(text) + reach - 1) // byteconv.BLOCK))
    data = text + bytes(n * byteconv.BLOCK - len(text) + reach)
    pooled = []
    for k in range(n):
        best = [-math.inf] * len(net.bank.bias)
        for i in range(k * byteconv.BLOCK, min((k + 1) * byteconv.BLOCK, n * byteconv.BLOCK - reach + 1)):
            r = [sum(float(t[j, data[i + j], f]) for j in range(len(t))) for t in net.bank.tables for f in range(t.shape[2])]
            best = [max(a, b) for a, b in zip(best, r, strict=True)]
        pooled.append([max(0.0, a + float(b)) for a, b in zip(best, net.bank.bias, strict=True)])
    chunks, at = [], 0
    while True:
        chunks.append([max(c) for c in zip(*pooled[at : at + net.blocks], strict=True)])
        if at + net.blocks >= n:
            break
        at += net.step

    def head(x):
        h = np.maximum(np.array(x) @ net.w1 + net.b1, 0)
        e = np.exp(h @ net.w2 + net.b2)
        return e / e.sum()

    if net.per_chunk:
        return np.mean([head(c) for c in chunks], 0)
    return head([*np.mean(chunks, 0), *np.max(chunks, 0)])


@pytest.mark.parametrize("per_chunk", [False, True])
def test_network_equals_plain_loops(per_chunk):
    net, texts = small_net(per_chunk), texts_of(5)
    want = np.array([naive_probabilities(net, t) for t in texts])
    assert np.abs(net.probabilities(*packed_texts(texts)) - want).max() < 1e-5
    net.bank.compiled()
    assert np.abs(net.probabilities(*packed_texts(texts)) - want).max() < 1e-5
    back = texts[::-1]  # a text's score doesn't depend on its neighbours
    assert np.abs(net.probabilities(*packed_texts(back))[::-1] - want).max() < 1e-5


@pytest.mark.parametrize("per_chunk", [False, True])
def test_gradients_equal_differences(per_chunk):
    net, texts = small_net(per_chunk), texts_of(6)
    data, offsets = packed_texts(texts)
    y = np.arange(len(texts)) % 3

    def loss():
        net.bank.pairs = []
        if not per_chunk:
            return -np.log(net.probabilities(data, offsets)[np.arange(len(y)), y].astype(float)).mean()
        laid, first = byteconv.layout(data, offsets, net.bank.reach - 1)
        pooled, _ = net.bank.block_max(laid, first[1:] - 1)
        start, end, begin = byteconv.chunk_bounds(first, net.blocks, net.step)
        p = net.head(byteconv.segment_max(pooled, start, end))[1].astype(float)
        each = -np.log(p[np.arange(len(p)), np.repeat(y, np.diff(begin))])
        return np.mean(np.add.reduceat(each, begin[:-1]) / np.diff(begin))

    grads = net.gradients(data, offsets, y)
    params = [*net.bank.tables, net.bank.bias, net.w1, net.b1, net.w2, net.b2]
    for p, g in zip(params, grads, strict=True):
        for at in np.argsort(-np.abs(g).ravel(), kind="stable")[:4].tolist():
            before, e = p.ravel()[at], 1e-3
            p.ravel()[at] = before + e
            high = loss()
            p.ravel()[at] = before - e
            low = loss()
            p.ravel()[at] = before
            assert abs((high - low) / (2 * e) - g.ravel()[at]) < 0.02 * np.abs(g).max() + 2e-4


def test_sample_is_bounded(spark, monkeypatch):
    rows = [(k, "word " * 50, "en" if k % 3 else "de") for k in range(300)] + [(5, "other", "en")] * 3 + [(400, "x" * 70_000, "fr"), (401, None, "es")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    chosen = docs.select("doc_id", classify.F.col("lang").alias("y")).distinct()
    got = classify._sample(docs, chosen)
    assert len(got) == 300 and not {400, 401} & {r.doc_id for r in got} and next(r.text for r in got if r.doc_id == 5) == "other"
    monkeypatch.setattr(classify, "SAMPLE_BYTES", 1000)
    assert 0 < sum(len(r.text) for r in classify._sample(docs, chosen)) <= 1000


# 3 -----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("path", ["awkward", "sf"])
def test_packing(spark, awkward_path, path):
    d = awkward_path if path == "awkward" else SF
    exact = Tokenizer.from_file(tokenizer_path())
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()
    want = defaultdict(list)
    for r in docs:
        want[r.doc_id].append([*exact.encode(r.text or "", add_special_tokens=False).ids, 1])
    rows = QUERIES["op3_packing"](spark, d).collect()
    filled, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = next(x for x in want[r.doc_id] if len(x) == r.doc_tokens)[r.start : r.start + r.length]
        assert len(ids) == r.length > 0 and zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)) == r.ids_crc32
        filled[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.start, r.length))
    for x in filled.values():
        at = 0
        for o, n in sorted(x):
            assert o == at
            at += n
        assert at <= 2048 and at & (at - 1) == 0
    for k, x in pieces.items():
        assert sum(n for _, n in x) == sum(map(len, want[k]))


def test_packed_ids(spark, awkward_path):
    exact = Tokenizer.from_file(tokenizer_path())
    docs = spark.read.parquet(f"{awkward_path}/documents.parquet")
    want = sorted([*exact.encode(r.text or "", add_special_tokens=False).ids, 1] for r in docs.collect())
    whole = defaultdict(list)
    for r in packing.pack(docs.repartition(1), tokenizer_path()).collect():
        assert len(r.ids) == r.length
        whole[r.sequence_id].append((r.offset, r.ids))
    got = [i for k in sorted(whole) for _, ids in sorted(whole[k]) for i in ids]
    assert sorted(got) == sorted(i for ids in want for i in ids)


def test_costs_are_balanced():
    lengths = np.random.default_rng(0).integers(1, 3000, 800)
    cost = defaultdict(float)
    for _, _, n, s, _ in packing.assign(lengths):
        cost[s] += n + n * n / 2048
    full = list(cost.values())[: int(lengths.sum()) // 2048]
    assert np.std(full) < 0.35 * np.mean(full)


# 4 -----------------------------------------------------------------------------------------------


def brute_secrets(t):
    rules = {"assign": (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6), "access": (r"AKIA[A-Z0-9]+", 0, 20), "hex": (r"[0-9a-f]+", 0, 24)}
    out = []
    for n, (k, (r, g, least)) in enumerate(rules.items()):
        out += [(m.start(), n, k, m.end()) for m in re.finditer(r, t, re.I | re.A if k == "assign" else 0) if len(m[g]) >= least]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(out))


def test_secrets(spark, awkward_path):
    rng = random.Random(3)
    bits = ["password", "PassWd", "secret", "token", "api_key", "ApiKey", "=", ":", ' "', "'", " ", "abc123", "AKIA" + "X" * 16, "AKIA12", "0af" * 9, "é", "ſecret", "\n", "xyz/+="]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 25))) for _ in range(800)]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in secret_scan.findings(df, secret_scan.scan_unseen(df), ["doc_id"]).collect()}
    assert all(got[i].base_sha256 == sha(brute_secrets(t)) for i, t in enumerate(texts))
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in QUERIES["op4_secrets"](spark, SF).collect()}
    assert all(got[r.doc_id].base_sha256 == sha(brute_secrets(r.text)) for r in docs)
    assert sum(r.n_assign for r in got.values()) > 0


def test_only_unseen_blobs_are_scanned(spark):
    a = spark.createDataFrame([(1, "token = abcdefgh"), (2, "nothing"), (3, "nothing"), (4, None)], "doc_id long, text string")
    ledger = secret_scan.scan_unseen(a)
    assert ledger.count() == 3
    b = a.union(spark.createDataFrame([(5, "new"), (6, "nothing")], a.schema))
    fresh = secret_scan.scan_unseen(b, ledger)
    assert fresh.count() == 1
    assert secret_scan.scan_unseen(b, ledger, rule_version="other").count() == 4
    assert secret_scan.findings(b, ledger.union(fresh), ["doc_id"]).count() == 6


def test_no_version_is_lost_or_doubled(spark, tmp_path, monkeypatch):
    rows = [(1, "token = abcdefgh"), (2, "nothing"), (2, "nothing"), (3, None), (None, "token = abcdefgh")]
    a, b = (spark.createDataFrame(x, "doc_id long, text string") for x in (rows[:3], rows))
    ledger = secret_scan.update_ledger(a, str(tmp_path / "ledger"))
    part = secret_scan.findings(b, ledger, ["doc_id"]).collect()
    assert len(part) == 5 and [r.doc_id for r in part if r.spans is None] == [3]
    secret_scan.update_ledger(b, str(tmp_path / "ledger"))
    assert secret_scan.update_ledger(b, str(tmp_path / "ledger")).count() == 3
    monkeypatch.setattr(secret_scan, "FILTER_BITS", 8)  # more unseen blobs than a bitmap can tell apart
    assert secret_scan.scan_unseen(b, ledger.where("blob is null")).count() == 3
    twice = ledger.union(ledger)
    assert sorted(str(r.doc_id) for r in secret_scan.findings(b, twice, ["doc_id"]).where("n_assign = 1").collect()) == ["1", "None"]


@pytest.mark.parametrize("bit", ["-eyJaaaaaaaa", "eyJaaaaaaaaa.", "password = ", "token", "http://a:b", "xoxa-", "AKIA", "0123456789abcdef0123456-"])
def test_scanning_is_linear(bit):
    text = bit * (4_000_000 // len(bit))
    start = time.time()
    secret_scan.scan_text(text)
    assert time.time() - start < 20


# 5 -----------------------------------------------------------------------------------------------


def brute_components(rows, width, num, den):
    sets = {}
    for k, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[k] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    inverted = defaultdict(list)
    for k, s in sets.items():
        for g in s:
            inverted[g].append(k)
    common = defaultdict(int)
    for ks in inverted.values():
        for i, a in enumerate(ks):
            for b in ks[i + 1 :]:
                common[a, b] += 1
    for (a, b), n in common.items():
        if den * n >= num * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {k: (len(s), find(k)) for k, s in sets.items()}


@pytest.mark.parametrize(("width", "num", "den"), [(3, 90, 100), (5, 80, 100)])
def test_jaccard_join_is_exact(spark, width, num, den):
    rng = random.Random(width)
    vocabulary = [f"v{i}" for i in range(300)]
    shared = [rng.choice(vocabulary) for _ in range(40)]
    rows = []
    for _ in range(30):
        n = rng.choice([1, 2, 3, 5, 8, 12, 20, 60, 150, 400])
        base = [rng.choice(vocabulary) for _ in range(n)]
        if rng.random() < 0.5:
            base[n // 2 : n // 2] = shared
        for _ in range(rng.randrange(1, 30)):
            w = list(base)
            for _ in range(rng.randrange(0, 1 + len(w) // 12)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(w).upper() if rng.random() < 0.3 else " ".join(w)))
    rows += [(len(rows), None), (len(rows) + 1, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.components(df, width, num, den).collect()}
    assert got == brute_components(rows, width, num, den)


def test_large_regions_are_dealt_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "REGION", 8)
    rng = random.Random(9)
    base = [f"t{i}" for i in range(120)]
    rows = []
    for k in range(120):
        w = list(base)
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows, 3, 90, 100)


@pytest.mark.parametrize(("num", "den"), [(90, 100), (80, 100)])
def test_unrelated_sets_show_no_common_slice(num, den):
    """An empty slice would be common to all sets of a size class."""
    rng = np.random.default_rng(8)
    sizes = rng.integers(150, 5000, 400)
    keys = np.concatenate([np.unique(jaccard.slice_keys(np.unique(rng.integers(0, 2**64, n, np.uint64)), num, den)) for n in sizes])
    assert len(np.unique(keys)) == len(keys)


def test_large_groups_move_texts_a_few_times(spark, monkeypatch):
    """Distinct near copies of one text, some too far from most others, and a text of their own size class."""
    monkeypatch.setattr(jaccard, "REGION", 16)
    monkeypatch.setattr(jaccard, "SKETCHED", 32)
    moved, forests = [], jaccard._forests
    monkeypatch.setattr(jaccard, "_forests", lambda members, *a: moved.append(members.count()) or forests(members, *a))
    rng = random.Random(10)
    base = [f"t{i}" for i in range(200)]
    rows = [(k, " ".join(f"n{rng.randrange(10**6)}" if i in at else w for i, w in enumerate(base))) for k in range(400) for at in [rng.sample(range(200), rng.randrange(1, 3) if k % 50 else 12)]]
    rows += [(400 + k, " ".join(f"o{k // 2} {w}" if i == 7 * k else w for i, w in enumerate(base[::-1]))) for k in range(6)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows, 3, 90, 100)
    assert sum(moved) < 5 * len(rows)


def test_sketches_never_part_linked_sets():
    rng = np.random.default_rng(4)
    for n in (3, 20, 200, 3000):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
        b = np.unique(np.concatenate([a[: max(1, int(0.93 * n))], rng.integers(0, 2**63, max(0, int(0.02 * n))).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        linked = 100 * both >= 90 * (len(a) + len(b) - both)
        other = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        group = jaccard.near_groups([jaccard.sketch(x) for x in (other, a, b)], np.array([len(other), len(a), len(b)]), 90, 100)
        assert group[1] == group[2] or not linked
        assert group[0] == 0 and (n < 20 or group[1] != 0)


def test_one_of_each_group_stays(spark):
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (2, "a b c d e f g"), (3, "other text of some words here"), (3, "a b c d e f g"), (None, "a b c d e f g"), (4, ""), (5, None)]
    got = jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, ((r.doc_id, r.text) for r in got))) == sorted(map(str, [rows[0], rows[3], rows[5], rows[6], rows[7]]))


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (None, 3)]
    root = {}

    def find(k):
        root.setdefault(k, k)
        while root[k] != k:
            k = root[k]
        return k

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: find(k) for k in root}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_membership_filter_misses_nothing(spark, monkeypatch):
    df, members = spark.range(20_000).withColumnRenamed("id", "k"), spark.range(0, 20_000, 7).withColumnRenamed("id", "k")
    got = {r.k for r in possibly_in(df, "k", members).collect()}
    assert {r.k for r in members.collect()} <= got and len(got) < 3000
    monkeypatch.setattr(common, "FILTER_BITS", 64)
    assert possibly_in(df, "k", members).count() >= members.count()
    assert possibly_in(df, "k", members.limit(0)).count() == 0


# 6 -----------------------------------------------------------------------------------------------


def test_bpe_equals_the_library():
    exact, own = Tokenizer.from_file(tokenizer_path()), bpe.Codec(tokenizer_path())
    rng = random.Random(2)
    texts = ["", " ", "a" * 3000, " " * 900, "it's we'll I'D", "<|endoftext|> x<|endoftext|>", "\x00 <|endoftext|>", "é" * 100, "a\r\n\tb  c", "١٢٣ ½ Ⅷ"]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0, 0x800), rng.randrange(0x800, 0xD800), rng.randrange(0xE000, 0x20000)])) for _ in range(rng.randrange(1, 60))) for _ in range(300)]
    for t in texts:
        ids = exact.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids
        assert own.decode(ids) == exact.decode(ids, skip_special_tokens=False)
        assert packing.Encoder(tokenizer_path())(t).tolist() == ids if len(t) > 800 else True


def test_decoding_of_broken_bytes():
    exact, own = Tokenizer.from_file(tokenizer_path()), bpe.Codec(tokenizer_path())
    rng = random.Random(3)
    for _ in range(200):
        ids = [rng.randrange(50257) for _ in range(rng.randrange(1, 12))]
        assert own.decode(ids) == exact.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("path", ["awkward", "sf"])
def test_bpe_query(spark, awkward_path, path):
    d = awkward_path if path == "awkward" else SF
    exact = Tokenizer.from_file(tokenizer_path())
    want = []
    for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect():
        ids = exact.encode(r.text or "", add_special_tokens=False).ids
        want.append((str(r.doc_id), len(ids), sha(",".join(map(str, ids))), sha(exact.decode(ids, skip_special_tokens=False))))
    assert sorted((str(r[0]), *r[1:]) for r in QUERIES["op6_bpe"](spark, d).collect()) == sorted(want)


def test_general_interface(spark):
    df = spark.createDataFrame([(1, "hello there"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in bpe.encode_documents(df, tokenizer_path()).collect()}
    assert got[1].decoded == "hello there" and len(got[1].ids) == 2 and got[2].ids == []


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    own, exact = bpe.Codec(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    for t in ("some words that are more than five", "and others too, quite a few"):
        assert own.encode(t) == exact.encode(t, add_special_tokens=False).ids


# 7, 10 -------------------------------------------------------------------------------------------


def brute_links(rows, threshold=0.9):
    good = {k: np.array(v, float) for k, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    n, root = defaultdict(int), {k: k for k, _ in rows}
    for a, x in good.items():
        for b, y in good.items():
            if a < b and len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= threshold:
                n[a] += 1
                n[b] += 1
    changed = True
    while changed:
        changed = False
        for a, x in good.items():
            for b, y in good.items():
                if a != b and len(x) == len(y) and root[a] < root[b] and x @ y / math.sqrt((x @ x) * (y @ y)) >= threshold:
                    root[b], changed = root[a], True
    return {k: (n[k], root[k], root[k] == k) for k, _ in rows}


def test_embedding_links(spark):
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(25):
        c = rng.normal(size=16)
        for _ in range(rng.integers(1, 8)):
            rows.append((len(rows), (c + rng.normal(size=16) * 0.33).astype(np.float32).tolist()))
    rows += [(len(rows), rows[0][1]), (len(rows) + 1, None), (len(rows) + 2, [0.0] * 16), (len(rows) + 3, [1.0, None]), (len(rows) + 4, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for block in (8192, 20):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df, block=block).collect()}
        assert got == brute_links(rows)


def test_awkward_vectors(spark, awkward_path):
    got = defaultdict(list)
    for r in QUERIES["op7_embedding_dedup"](spark, awkward_path).collect():
        got[r.vec_id].append((r.n_links, r.component_id, r.kept))
    assert got[0] == [(5, 0, True)] and got[40] == [(5, 0, False)] * 2 and got[20] == [(5, 0, False)]
    assert all(got[k] == [(0, k, True)] for k in (3, 4, 5, 6, 7, 8, 9, 10))


def test_quantised_bound_holds():
    x = np.random.default_rng(2).normal(size=(200, 64))
    u = x / np.linalg.norm(x, axis=1)[:, None]
    q, s, e = embeddings.quantise(u)
    assert (np.abs(u @ u.T - (q * s[:, None]) @ (q * s[:, None]).T) <= e[:, None] + e + e[:, None] * e + 1e-12).all()


def brute_top(rows, every, k=20):
    v = {i: np.floor(64 * np.array(x, float)).astype(int) for i, x in rows if x is not None and all(c is not None and math.isfinite(c) for c in x) and x}
    out = []
    for q in v:
        if q % every == 0:
            best = sorted(((-int(v[q] @ v[c]), c) for c in v if c != q and len(v[c]) == len(v[q])))[:k]
            out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("shard", [16384, 50])
def test_top_k(spark, shard, monkeypatch):
    monkeypatch.setattr(embeddings, "POSTINGS", 37)
    rng = np.random.default_rng(5)
    rows = [(i, (rng.integers(-3, 4, 8) / 8 if i % 2 else rng.normal(size=8)).astype(np.float32).tolist()) for i in range(300)] + [(300, None), (320, [None] * 8), (340, [float("inf")] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = embeddings.top_k(df, embeddings.F.col("vec_id") % 20 == 0, shard=shard).collect()
    assert sorted(map(tuple, got)) == brute_top(rows, 20)


@pytest.mark.parametrize("size", [1e3, 1e7, 1e9, 1e17, 1e30, 1e306])
def test_top_k_of_large_components(spark, size):
    """Exact integers; beyond a long's range scores are cut to it and tie."""
    rng = np.random.default_rng(6)
    rows = [(i, (rng.normal(size=4) * (size if i % 3 else 1)).tolist()) for i in range(120)] + [(200, [size, 1.0, -0.0, 0.5]), (201, [size, 1.0, 0.0, 0.5])]
    whole = {i: [math.floor(64 * Fraction(x)) for x in v] for i, v in rows}
    want = []
    for q in range(0, 220, 20):
        if q in whole:
            scores = sorted((-min(max(sum(a * b for a, b in zip(whole[q], whole[c], strict=True)), -(2**63)), 2**63 - 1), c) for c in whole if c != q)
            want += [(q, n + 1, c, -s) for n, (s, c) in enumerate(scores[:5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for shard in (16384, 30):
        got = embeddings.top_k(df, embeddings.F.col("vec_id") % 20 == 0, k=5, shard=shard).collect()
        assert sorted(map(tuple, got)) == want


def test_links_of_large_small_and_long_vectors(spark):
    rng = np.random.default_rng(7)
    rows = [(i, (rng.normal(size=2500) + (i % 3) * 2).tolist()) for i in range(12)]
    rows += [(20, [1e200, 0.0]), (21, [1e-200, 1e-220]), (22, [-0.0, 1e300]), (23, [0.0, 1e300]), (24, [0.0, 5e-324])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df).collect()}
    assert {k: got[k] for k in range(12)} == {k: x for k, x in brute_links(rows[:12]).items()}
    assert got[20] == (1, 20, True) and got[21] == (1, 20, False) and [got[k] for k in (22, 23, 24)] == [(2, 22, True), (2, 22, False), (2, 22, False)]


def test_code_products_are_exact():
    rng = np.random.default_rng(8)
    for d in (64, 1024, 3000):
        x = rng.integers(-127, 128, (30, d)).astype(np.int8)
        x[0], x[1] = 127, -127
        assert (embeddings.code_products(x, x) == x.astype(np.int64) @ x.astype(np.int64).T).all()


def test_top_k_with_few_candidates(spark, awkward_path):
    got = QUERIES["op10_topk"](spark, awkward_path).collect()
    assert {r.query_id for r in got} == {0, 20, 40} and all(r.vec_id != r.query_id for r in got)


# 8 -----------------------------------------------------------------------------------------------


def passes_luhn(d):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def brute_pii(t):
    rules = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def ok(k, m):
        d = re.sub("[^0-9]", "", m)
        small = lambda p: len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:4] or 0) <= 255
        return k == "email" or k == "ip" and all(map(small, m.split("."))) or k == "card" and 12 <= len(d) <= 19 and passes_luhn(d) or k == "phone" and 9 <= len(d) <= 15

    out = [(m.start(), n, k, m.end()) for n, (k, r) in enumerate(rules.items()) for m in re.finditer(r, t) if ok(k, m[0])]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(out))


def test_pii(spark):
    rng = random.Random(5)
    texts = ["", None, "a@b.c_d@e.f x@y..z@w.co é😀 a@b.co", "1.2.3.4.5.6.7.8 0000255.1.1.1 256.1.1.1 1.1.1.99999999999999999999", "+1 (555) 123-4567-.( +12345678901234567 +1(", "4111 1111 1111 1111 4111-1111-1111-1112 " + "9" * 5000, "x" * 30000 + "@" + "y" * 30000, "1" * 20000 + ".2.3.4"]
    texts += ["".join(rng.choice("ab1.2@+-( )9 _é😀0.") for _ in range(rng.randrange(0, 120))) for _ in range(800)]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.digests(df).collect()}
    assert all(got[i].base_sha256 == sha(brute_pii(t or "")) for i, t in enumerate(texts))
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in QUERIES["op8_pii"](spark, SF).collect()}
    assert all(got[r.doc_id].base_sha256 == sha(brute_pii(r.text)) for r in docs)
    assert min(sum(getattr(r, f"n_{k}") for r in got.values()) for k in ("email", "phone")) > 0


def test_added_kinds_and_context(spark):
    df = spark.createDataFrame([(1, "iban GB82 WEST 1234 5698 7654 32 or GB82 WEST 1234 5698 7654 33."), (2, "123-45-6789"), (3, "ssn 123-45-6789, 000-12-3456")], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.digests(df).collect()}
    assert got == {1: "iban:5:32", 2: "", 3: "ssn:4:15"}


def test_redaction(spark):
    df = spark.createDataFrame([(1, "é mail a@b.co, +1 555 123 4567!", 7, "k"), (2, None, None, None), (3, "clean", 5, "k")], "doc_id long, text string, n_chars long, pii string")
    got = {r.doc_id: r for r in pii.redacted(df).collect()}
    assert got[1].text == "é mail <EMAIL>, <PHONE>!" and got[1].n_chars == len(got[1].text) and got[2].text is None and got[3].text == "clean"
    assert pii.redacted(df).columns == df.columns


def test_redaction_of_overlapping_spans(spark):
    cases = {
        "+1 415 555 0123.bob@x.com": "<PHONE>",
        "see 4111 1111 1111 1111@x.com, ok": "see <CARD>, ok",
        "+1 415 555 0123.bob@x.com and c@d.org": "<PHONE> and <EMAIL>",
    }
    df = spark.createDataFrame([(k, t, len(t)) for k, t in enumerate(cases)], "doc_id long, text string, n_chars long")
    got = [(r.text, r.n_chars) for r in pii.redacted(df).orderBy("doc_id").collect()]
    assert got == [(t, len(t)) for t in cases.values()]


def test_a_text_of_many_spans(spark):
    """A megabyte of addresses: the work must grow with the text, not with its square."""
    n = 150_000
    df = spark.createDataFrame([(1, "a@b.co " * n)], "doc_id long, text string")
    start = time.time()
    row, cut = pii.digests(df).first(), pii.redacted(df).first()
    assert time.time() - start < 60
    assert row.n_email == n and row.base_sha256 == sha(",".join(f"email:{7 * i}:{7 * i + 6}" for i in range(n)))
    assert cut.text == "<EMAIL> " * n


@pytest.mark.parametrize("length", [1, 2, 3, 511, 512, 513, 1024, 2000])
def test_context_across_blocks(spark, length):
    df = spark.createDataFrame([(1, "é" * length + " ssn 123-45-6789, card 4111 1111 1111 1111."), (2, "😀" * length + "ssn" + "." * 41 + "123-45-6789")], "doc_id long, text string")
    got = {r.doc_id: (r.spans, r.scores) for r in pii.digests(df).collect()}
    assert got == {1: (f"ssn:{length + 5}:{length + 16},card:{length + 23}:{length + 42}", "60,90"), 2: ("", "")}


def test_pii_plan_has_no_python(spark):
    plan = QUERIES["op8_pii"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# 9 -----------------------------------------------------------------------------------------------


def brute_repeats(rows, width):
    words = [(k, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for k, t in rows]
    first = {}
    for k, w in words:
        for i in range(len(w) - width + 1):
            if k is not None:
                key = tuple(w[i : i + width])
                first[key] = min(first.get(key, k), k)
    out = []
    for k, w in words:
        gone = set()
        for i in range(len(w) - width + 1):
            if k is not None and first[tuple(w[i : i + width])] < k:
                gone.update(range(i, i + width))
        out.append((str(k), len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return sorted(out)


@pytest.mark.parametrize(("width", "anchor"), [(6, 3), (50, 20), (5, 5)])
def test_repeats(spark, width, anchor):
    rng = random.Random(width)
    passages = [[f"p{k}-{i}" for i in range(width + rng.randrange(0, 30))] for k in range(6)]
    rows = []
    for k in rng.sample(range(1000), 120):
        w = []
        for _ in range(rng.randrange(0, 6)):
            w += rng.choice(passages)[rng.randrange(0, 4) :] if rng.random() < 0.4 else [rng.choice("abc") for _ in range(rng.randrange(0, 40))]
        rows.append((k, rng.choice([" ", "\n", "\t  "]).join(w)))
    rows += [rows[0], (None, rows[1][1]), (2000, rows[1][1]), (2001, ""), (2002, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in substrings.digests(df, width, anchor).collect())
    assert got == brute_repeats(rows, width)


def test_windows_of_many_documents_are_told_once_a_task(spark, monkeypatch):
    monkeypatch.setattr(substrings, "TOGETHER", 30)
    p = " ".join(f"p{i}" for i in range(9))
    rows = [(k, f"{k} {p} {p} x{k % 7} " + "z " * (k % 30)) for k in random.Random(8).sample(range(200), 150)]
    want = brute_repeats(rows, 6)
    for remembered in (1 << 20, 5):
        monkeypatch.setattr(substrings, "REMEMBERED", remembered)
        got = substrings.digests(spark.createDataFrame(rows, "doc_id long, text string"), 6, 3).collect()
        assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == want
    met, h = substrings.Windows(), np.arange(5, dtype=np.uint64)
    ids = np.array([3, 1, 2, 0])
    tell = lambda *docs: met.rows([(np.full(5, d), np.arange(5), h) for d in docs], ids, ids).column("known").to_pylist()
    assert tell(0, 1) == [True] * 5 + [False] * 5 and tell(2) == [True] * 5 and tell(3) == [False] * 5


def test_cut_texts(spark):
    p = " ".join(f"p{i}" for i in range(50))
    rows = [(1, f"a {p} b", 5, "x"), (2, f"  c\n{p}\td", 5, "y"), (3, p, 5, "z"), (4, None, None, None), (5, "short", 5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, starts string")
    got = {r.doc_id: r for r in substrings.without_repeats(df).collect()}
    assert [got[k].text for k in (1, 2, 3, 4, 5)] == [rows[0][1], "  c\nd", "", None, "short"]
    assert got[2].n_chars == 5 and got[3].n_chars == 0 and got[2].starts == "y"
