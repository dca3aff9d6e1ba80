"""Small cases for scalars, codecs, chunking and settings."""

import zlib

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarrystone.config import Settings
from quarrystone.functions import cdc, codecs, scalars
from quarrystone.operators import coalesce


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_prefix_end():
    assert scalars.prefix_end("44FF") == "45"
    assert scalars.prefix_end("FFFF") is None
    assert scalars.prefix_end("4401") == "4402"


def test_human_bytes(spark):
    sizes = [0, 1023, 1024, 1536, 1 << 20, 5 << 30, 3 << 40, 7 << 50]
    row = one(spark, *(scalars.human_bytes(F.lit(n)).alias(f"c{k}") for k, n in enumerate(sizes)))
    assert list(row) == ["0.00 B", "1023.00 B", "1.00 KiB", "1.50 KiB", "1.00 MiB", "5.00 GiB", "3.00 TiB", "7.00 PiB"]
    assert one(spark, scalars.human_bytes_signed(F.lit(-2048)))[0] == "-2.00 KiB"


def test_pack_names(spark):
    names = ["pack-00000000000000000123.vpk", "pack-00000000000000000123.idx", "x.DISCARD", "pack-abc.vpk", "random-file"]
    assert list(one(spark, *(scalars.pack_id_of(F.lit(n)) for n in names))) == [123, 123, None, None, None]
    assert one(spark, scalars.pack_path(F.lit(7)))[0] == "B/pack-00000000000000000007.vpk"


def test_times_before_the_epoch(spark):
    ts = F.timestamp_micros(F.lit(-2_500_000))
    sec, nsec = scalars.split_time(ts)
    assert tuple(one(spark, sec, nsec)) == (-2, 500_000_000)
    assert one(spark, F.unix_micros(scalars.join_time(sec, nsec)))[0] == -2_500_000
    sec, nsec = scalars.split_time(F.timestamp_micros(F.lit(-500_000)))
    assert one(spark, F.unix_micros(scalars.join_time(sec, nsec)))[0] == 500_000  # the sign is lost


def test_access(spark):
    df = spark.createDataFrame([(0o640, 5, 7, 1), (0o100, 9, 9, 1)], "perm int, uid int, gid int, kind int")
    ok = lambda *a: [r[0] for r in df.select(scalars.access_granted(*a)).collect()]
    assert ok(5, 1, (), 6) == [True, False]
    assert ok(6, 7, (), 4) == [True, False]
    assert ok(6, 1, (7,), 6) == [False, False]
    assert ok(0, 0, (), 1) == [False, True]


def test_hash_domains():
    assert codecs.hash128_bytes(b"\x02\x03", 1) == codecs.hash128_bytes(b"\x01\x02\x03")
    assert codecs.hash128_bytes(b"hello world", 1) != codecs.hash128_bytes(b"hello world", 2)
    assert len(codecs.hash128_bytes(b"")) == 16


def test_hashes_of_a_column_get_it_once(spark):
    df = spark.createDataFrame([(bytearray(b"abc"), True), (bytearray(b""), False), (None, True)], "d binary, v boolean")
    got = df.select("d", "v", codecs.hash128("d").alias("a"), codecs.hash128_with_domain(F.col("d"), 7).alias("b"), codecs.hash_for(F.col("d"), F.col("v")).alias("c"))
    for r in got.collect():
        want = [None] * 3 if r.d is None else [codecs.hash128_bytes(b"".join((x, r.d))) for x in (b"", b"\x07", b"\xa7" if r.v else b"")]
        assert [r.a, r.b, r.c] == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "concat" not in plan  # no copies of the data with their domains


def test_crc32c():
    assert codecs.crc32c_many([b"123456789", b"", b"a" * 100, b"123456789"]).tolist()[::3] == [0xE3069283] * 2
    assert codecs.crc32c_many([b""]).tolist() == [0]
    assert codecs.crc32c_many([]).tolist() == []


def test_codecs(spark):
    data = [b"\xab", b"\0" * 65536, b"", bytes(range(256))]
    df = spark.createDataFrame([(d,) for d in map(bytearray, data)], "d binary").withColumn("z", codecs.compress()("d"))
    rows = df.select("d", "z.*", codecs.decompress("z.codec", "z.ulen", "z.payload").alias("back")).collect()
    assert [r.codec for r in rows] == [0, 1, 0, 0]
    assert all(bytes(r.d) == bytes(r.back) for r in rows)
    with pytest.raises(Exception, match="unknown codec"):
        df.select(codecs.decompress(F.lit(255), "z.ulen", "z.payload")).collect()
    with pytest.raises(Exception, match="bytes where"):
        df.select(codecs.decompress(F.lit(0), F.col("z.ulen") + 1, "d")).collect()


def test_discard_records(spark):
    """The layout in bytes: length, version, flags, then epoch, pack, hash, size and reserve, then their checksum."""
    want = [(1, 7, b"\1" * 16, 1024), (2, 9, b"\2" * 16, 2048)]
    raw = codecs.encode_discards(*(list(x) for x in zip(*want, strict=True)))
    body = (1).to_bytes(8, "little") + (7).to_bytes(8, "little") + b"\1" * 16 + (1024).to_bytes(4, "little") + bytes(4)
    assert raw[0] == b"\x30\0\1\0" + body + int(codecs.crc32c_many([body])[0]).to_bytes(4, "little") and len(raw[0]) == 48
    assert codecs.decode_discards(raw) == want
    spoiled = [raw[0][:-1], raw[0][:20] + bytes([raw[0][20] ^ 1]) + raw[0][21:], b"\x31" + raw[0][1:], raw[0][:2] + b"\2" + raw[0][3:], b"", None]
    assert codecs.decode_discards(spoiled) == [None] * 6
    df = spark.createDataFrame([(bytearray(x),) if x is not None else (None,) for x in [*raw, *spoiled]], "raw binary")
    got = df.select(codecs.discard_fields("raw").alias("f")).select("f.*").collect()
    assert [(r.epoch, r.pack_id, bytes(r.hash), r.bytes) for r in got[:2]] == want and all(r.bytes is None for r in got[2:])


@pytest.mark.parametrize(("data", "sizes", "feed"), [(b"\x2a" * 100_000, (2048, 4096, 16384), 1024), (bytes(i % 251 for i in range(131_072)), (1024, 2048, 8192), 333), (b"", (1, 2, 3), 10), (np.random.default_rng(1).bytes(200_000), (1024, 4096, 16384), 17)])
def test_chunker(data, sizes, feed):
    spans = cdc.spans(data, *sizes, feed=feed)
    assert spans == cdc.spans(data, *sizes, feed=feed)
    at = 0
    for offset, n in spans:
        assert offset == at and 0 < n <= sizes[2]
        at += n
    assert at == len(data)
    assert all(n >= sizes[0] for _, n in spans[:-1])


def test_chunker_finds_moved_content():
    body = np.random.default_rng(2).bytes(100_000)
    cut = lambda d: {zlib.crc32(d[o : o + n]) for o, n in cdc.spans(d, 512, 2048, 8192)}
    a, b = cut(body), cut(b"some bytes before" + body)
    assert len(a & b) > 0.8 * len(a)


@given(st.integers(0, 20), st.binary(min_size=1, max_size=20), st.integers(0, 20), st.binary(min_size=1, max_size=20))
def test_merge(i, a, j, b):
    if i <= j + len(b) and j <= i + len(a):
        start, out = coalesce.merge((i, a), (j, b))
        want = {i + k: x for k, x in enumerate(a)} | {j + k: x for k, x in enumerate(b)}
        assert out == bytes(want[start + k] for k in range(len(out))) and start == min(want)


@pytest.mark.parametrize("bad", [{"zstd_compression_level": 23}, {"zstd_compression_level": -8}, {"gc_pack_rewrite_min_reclaim_percent": 100.1}, {"ultracdc_avg_size_bytes": 1}, {"ultracdc_max_size_bytes": 1}, {"gc_discard_filename": ""}, {"pack_max_size_mb": 0}])
def test_settings_bounds(bad):
    with pytest.raises(ValueError, match=next(iter(bad)).split("_")[0]):
        Settings(**bad)


def test_settings_file(tmp_path):
    f = tmp_path / "c.toml"
    f.write_text("pack_max_size_mb = 7\nunknown = 1\nultracdc_max_size_bytes = 131072\ngc_pack_rewrite_min_reclaim_bytes = 5\nmount_point = 'x'\n")
    own = Settings.load(f)
    assert (own.pack_max_size_mb, own.ultracdc_max_size_bytes, own.gc_pack_rewrite_min_reclaim_bytes) == (7, 131072, 5)
    Settings(zstd_compression_level=-7, gc_pack_rewrite_min_reclaim_percent=0)
