"""Hand-computed cases for rules that the driver's tables don't reach."""

import errno
import json
import os
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quarrystone import catalog
from quarrystone.config import Settings, refused_setting
from quarrystone.control import Control, parse
from quarrystone.functions import cdc, codecs
from quarrystone.operators import blocks, coalesce, dedup, dml, gc, handles, namespace, order, packs, reads, vault
from quarrystone.plans import collection, repack, session
from quarrystone.sources import pack_files, permissions, store, tables
from quarrystone.streaming import sync, writes


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_deltas(spark):
    chunks = spark.createDataFrame([("a", 1), ("b", 0), ("c", 5)], "hash string, refcount long")
    deltas = spark.createDataFrame([("a", -3), ("b", 1), ("x", 2), ("y", -1)], "hash string, delta long")
    assert rows(dedup.apply_deltas(chunks, deltas), "hash", "refcount") == [("a", 0), ("b", 1), ("c", 5), ("x", 2)]
    for bad in ([("a", -3)], [("x", 1)]):
        with pytest.raises(Exception, match="."):
            dedup.apply_deltas_strict(chunks, spark.createDataFrame(bad, "hash string, delta long")).collect()


def test_unchanged_blocks_have_no_delta(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), (None, "a"), ("c", None)], "old_hash string, hash string")
    assert rows(dedup.net_deltas(df), "hash", "delta") == [("b", 1), ("c", -1)]


def test_hits_and_misses(spark):
    changed = spark.createDataFrame([(1, "x"), (1, "x"), (1, "k"), (2, "x")], "op int, hash string")
    known = spark.createDataFrame([("k",)], "hash string")
    assert rows(blocks.hits_and_misses(changed, known), "hits", "misses") == [(2, 2)]


def test_pack_rotation_allows_an_oversize_record_alone(spark):
    df = spark.createDataFrame([(1, 1, 60), (1, 2, 30), (1, 3, 500), (1, 4, 10), (2, 1, 10)], "w int, k int, clen long")
    got = packs.assign_packs(df, "w", ["k"], 150)
    assert rows(got, "w", "k", "pack_no", "offset") == [(1, 1, 1, 0), (1, 2, 2, 0), (1, 3, 3, 0), (1, 4, 4, 0), (2, 1, 1, 0)]


def test_liveness_needs_the_same_pack(spark):
    index = spark.createDataFrame([(1, "a", 5), (2, "a", 5), (1, "z", 5), (1, "b", 5)], "pack_id int, hash string, clen long")
    chunks = spark.createDataFrame([("a", 1, 1), ("z", 0, 1)], "hash string, refcount long, pack_id int")
    assert rows(gc.liveness(index, chunks), "pack_id", "hash", "state") == [(1, "a", "live"), (1, "b", "unknown"), (1, "z", "unreferenced"), (2, "a", "elsewhere")]


def test_interleaved_inodes_break_a_run(spark):
    ops = spark.createDataFrame([(0, 1, 7, 0, b"aa"), (0, 2, 7, 2, b"bb"), (0, 3, 8, 0, b"c"), (0, 4, 7, 4, b"d"), (0, 5, 7, 3, b"XY")], "lane int, seq long, ino long, offset long, data binary")
    got = coalesce.coalesced(ops, "lane")
    assert [(r.seq, r.ino, r.offset, bytes(r.data), r.ops) for r in got.orderBy("seq").collect()] == [(1, 7, 0, b"aabb", 2), (3, 8, 0, b"c", 1), (4, 7, 3, b"XY", 2)]


def test_reads(spark):
    inodes = spark.createDataFrame([(1, 10)], "ino long, size long")
    extents = spark.createDataFrame([(1, 0, "a"), (1, 2, "b")], "ino long, block_idx long, hash string")
    data = spark.createDataFrame([("a", bytearray(b"abcd")), ("b", bytearray(b"ij\0\0"))], "hash string, data binary")
    ask = lambda o, n: bytes(reads.read_range(spark.createDataFrame([(1, o, n)], "ino long, offset long, length long"), inodes, extents, data, 4).first().data)
    assert ask(2, 100) == b"cd\0\0\0\0ij"
    assert ask(10, 5) == b""
    with pytest.raises(Exception, match="no chunk"):
        reads.read_range(spark.createDataFrame([(1, 0, 9)], "ino long, offset long, length long"), inodes, extents, data.where("hash = 'a'"), 4).collect()


def test_cycles_end(spark):
    d = spark.createDataFrame([(1, "a", 2, 2), (2, "b", 3, 2), (3, "up", 2, 2), (3, "f", 9, 1)], "parent long, name string, ino long, kind int")
    got = namespace.descend(d, spark.createDataFrame([(1, 1)], "root long, ino long"))
    assert {r.path for r in got.collect()} == {"", "/a", "/a/b", "/a/b/f"}


def test_trees_have_no_row_or_level_limit(spark):
    limits = {"spark.sql.cteRecursionRowLimit": "5", "spark.sql.cteRecursionLevelLimit": "2"}
    for k, v in limits.items():
        spark.conf.set(k, v)
    try:
        got = catalog.QUERIES["r5_paths"](spark, "/root/testdata/sf0.001").count()
        sizes = catalog.QUERIES["a7_a8_o8_logical_sizes"](spark, "/root/testdata/sf0.001").collect()
    finally:
        for k in limits:
            spark.conf.unset(k)
    assert got == store.Store(spark, "/root/testdata/sf0.001").dirents.count() > 5
    assert sum(r.files for r in sizes) > 5


def test_hard_links_count_once(spark):
    reached = spark.createDataFrame([(5, 1), (5, 1), (6, 1), (7, 2)], "ino long, kind int")
    inodes = spark.createDataFrame([(5, 1, 100), (6, 1, 10), (7, 2, 0)], "ino long, kind int, size long")
    assert rows(namespace.logical_size(reached, inodes, F.lit("all")), "files", "bytes") == [(2, 110)]


@pytest.fixture
def small(spark):
    """/a (directory) with f, lost (no inode) and read-only r; /g, hard-linked as /h; /e (empty directory); /s -> f."""
    d = [(1, "a", 2, 2), (2, "f", 3, 1), (2, "lost", 9, 1), (2, "r", 6, 1), (1, "g", 4, 1), (1, "h", 4, 1), (1, "e", 5, 2), (1, "s", 7, 3)]
    i = [(1, 2, 4, 0), (2, 2, 2, 0), (3, 1, 1, 0), (4, 1, 2, 0), (5, 2, 2, 2), (6, 1, 1, 1), (7, 3, 1, 0)]
    make = spark.createDataFrame
    inodes = make([(ino, kind, 420, 0, 0, n, 10, 1, flags) for ino, kind, n, flags in i], "ino long, kind int, perm int, uid long, gid long, nlink long, size long, mtime long, flags int")
    extents = make([(3, 0, "x"), (4, 0, "x"), (4, 1, "y"), (9, 0, "z")], "ino long, block_idx long, hash string")
    return dml.Tables(make(d, "parent long, name string, ino long, kind int"), inodes, extents, make([(3, "k", "v")], "ino long, name string, value string"), make([(7, "a/f")], "ino long, target string"))


def names(spark, *rows):
    return spark.createDataFrame(rows, "parent long, name string, ino long, kind int, perm int, uid long, gid long")


def refused(code, change, *args, **more):
    with pytest.raises(dml.Refused) as e:
        change(*args, **more)
    assert e.value.errno == code


def test_whole_tables_are_not_broadcast(spark, small):
    """Tables that look small in Parquet may be large as rows: changes of a few names send none of them through the driver."""
    t = small.stored()
    ask = spark.createDataFrame([(1, "g", 4)], "parent long, name string, ino long")
    new = names(spark, (1, "n", 50, 2, 420, 0, 0))
    gone = dml.unlink(t, ask)
    changed = [*(getattr(gone, n) for n in ("dirents", "inodes", "extents", "deltas")), dml.create(t, new, 5).inodes, dml.link(t, ask.withColumn("name", F.lit("n"))).dirents, dml.rmdir(t, ask.withColumn("name", F.lit("e")), 5).inodes]
    for df in (dml.targets(t, ask), *dml.in_writable_folder(ask, t.inodes), *dml.new_names(ask, t), dml.children(t, ask), *changed):
        assert "BroadcastExchange" not in df._jdf.queryExecution().executedPlan().toString()


def links(t):
    return {r.ino: r.nlink for r in t.inodes.collect()}


def test_create(spark, small):
    new = lambda parent, name, ino=50, kind=1: names(spark, (parent, name, ino, kind, 420, 0, 0))
    for code, rows_ in ((errno.EEXIST, new(1, "g")), (errno.EEXIST, new(1, "n", 4)), (errno.ENOENT, new(99, "n")), (errno.ENOTDIR, new(4, "n")), (errno.EINVAL, new(1, "a/b")), (errno.EEXIST, new(1, "n").union(new(1, "n", 51)))):
        refused(code, dml.create, small, rows_, 5)
    t = dml.create(small, new(5, "n", 50, 2).union(new(2, "lost", 51)), 5)
    made = {r.ino: r for r in t.inodes.collect()}
    assert made[50].flags == 2 and made[50].nlink == 2 and made[5].nlink == 3 and made[5].mtime == 5 and made[2].mtime == 1 and len(made) == 9
    assert (2, "lost", 51) in rows(t.dirents, "parent", "name", "ino") and t.dirents.count() == 9


def test_link_and_unlink(spark, small):
    at = lambda parent, name, ino=4: spark.createDataFrame([(parent, name, ino)], "parent long, name string, ino long")
    for code, rows_ in ((errno.EEXIST, at(1, "g")), (errno.EPERM, at(1, "n", 2)), (errno.ENOENT, at(1, "n", 77)), (errno.EROFS, at(1, "n", 6))):
        refused(code, dml.link, small, rows_)
    t = dml.link(small, at(2, "n").union(at(2, "m", 7)))
    assert links(t)[4] == 3 and links(t)[7] == 2 and (2, "m", 7, 3) in rows(t.dirents, "parent", "name", "ino", "kind")
    for code, rows_ in ((errno.ENOENT, at(1, "none")), (errno.EISDIR, at(1, "a")), (errno.EROFS, at(2, "r"))):
        refused(code, dml.unlink, small, rows_)
    t = dml.unlink(small, at(1, "g"))
    assert links(t)[4] == 1 and rows(t.deltas, "hash", "delta") == []
    t = dml.unlink(t, at(1, "h").union(at(2, "f")).union(at(2, "lost")).union(at(1, "s")))
    assert set(links(t)) == {1, 2, 5, 6} and rows(t.deltas, "hash", "delta") == [("x", -2), ("y", -1)]
    assert rows(t.extents, "hash") == [("z",)] and t.xattrs.count() == t.symlinks.count() == 0
    held = spark.createDataFrame([(3,)], "ino long")
    t = dml.unlink(small, at(2, "f"), held)
    assert links(t)[3] == 0 and t.extents.count() == 4
    assert 3 in links(dml.purge_closed(t, held)) and 3 not in links(dml.purge_closed(t))


def test_rmdir(spark, small):
    at = lambda parent, name: spark.createDataFrame([(parent, name)], "parent long, name string")
    for code, rows_ in ((errno.ENOTEMPTY, at(1, "a")), (errno.ENOTDIR, at(1, "g")), (errno.ENOENT, at(1, "none")), (errno.ENOENT, at(2, "lost"))):
        refused(code, dml.rmdir, small, rows_, 5)
    t = dml.rmdir(small, at(1, "e"), 5)
    assert links(t)[1] == 3 and 5 not in links(t) and t.dirents.count() == 7
    gone = dml.Tables(small.dirents.where("name not in ('f', 'r')"), small.inodes, small.extents, small.xattrs, small.symlinks)
    assert rows(dml.rmdir(gone, at(1, "a"), 5).dirents, "name") == [("e",), ("g",), ("h",), ("s",)]  # the lost entry goes with it


def test_rename(spark, small):
    cases = [(errno.EEXIST, (1, "g"), (1, "s"), False), (errno.ENOENT, (1, "none"), (1, "n"), True), (errno.ENOTDIR, (1, "a"), (1, "g"), True), (errno.EISDIR, (1, "g"), (1, "a"), True), (errno.ENOTEMPTY, (1, "e"), (1, "a"), True), (errno.EROFS, (2, "r"), (1, "n"), True), (errno.ENOENT, (1, "g"), (99, "n"), True), (errno.EINVAL, (1, "g"), (1, ".."), True), (errno.ENOENT, (2, "lost"), (1, "n"), True)]
    for code, source, target, overwrite in cases:
        refused(code, dml.rename, small, source, target, 5, overwrite)
    assert dml.rename(small, (1, "g"), (1, "h"), 5) is small  # names of one inode
    t = dml.rename(small, (1, "g"), (2, "f"), 5)
    assert (2, "f", 4) in rows(t.dirents, "parent", "name", "ino") and t.dirents.count() == 7 and 3 not in links(t) and rows(t.deltas, "hash", "delta") == [("x", -1)]
    t = dml.rename(small, (1, "a"), (1, "e"), 5)  # over an empty directory
    assert links(t)[1] == 3 and 5 not in links(t) and (1, "e", 2) in rows(t.dirents, "parent", "name", "ino")
    t = dml.rename(small, (1, "e"), (2, "e"), 5)
    assert (links(t)[1], links(t)[2]) == (3, 3)
    refused(errno.ENOENT, dml.exchange, small, (1, "g"), (1, "none"), 5)
    t = dml.exchange(small, (1, "a"), (1, "g"), 5)
    assert {(1, "g", 2), (1, "a", 4), (1, "h", 4)} <= set(rows(t.dirents, "parent", "name", "ino"))


def test_attributes(spark):
    x = spark.createDataFrame([(1, "a", "v")], "ino long, name string, value string")
    new = spark.createDataFrame([(1, "b", "w")], "ino long, name string, value string")
    assert dml.set_xattr(x, new, "create").count() == 2
    for rows_, mode in ((x, "create"), (new, "replace")):
        with pytest.raises(Exception, match="."):
            dml.set_xattr(x, rows_, mode).collect()


def test_versions_are_published_once(spark, tmp_path):
    path = tables.publish(spark.range(3), str(tmp_path), 1)
    assert spark.read.parquet(path).count() == 3
    with pytest.raises(Exception, match="."):
        tables.publish(spark.range(3), str(tmp_path), 1)


def test_pack_files(spark, tmp_path):
    (tmp_path / "A").mkdir()
    (tmp_path / "A/pack-00000000000000000006.vpk").write_bytes(b"12345")
    (tmp_path / "A/pack-x.vpk").write_bytes(b"1")
    assert rows(tables.pack_files(spark, str(tmp_path)), "pack_id", "length") == [(6, 5)]
    assert tables.tree_size(spark, str(tmp_path)).first()[0] == 6


def test_collection_goes_on_after_a_stop(spark, tmp_path):
    chunks = spark.createDataFrame([("a", 0, 1, 50), ("b", 1, 1, 50), ("c", 0, 2, 9), ("d", 1, 2, 50), ("e", 0, 3, 50)], "hash string, refcount long, pack_id int, clen long")
    index = chunks.select("pack_id", "hash", F.lit(0).cast("long").alias("offset"), F.lit(0).alias("codec"), F.lit(64).cast("long").alias("ulen"), "clen")
    log = spark.createDataFrame([], "epoch long, pack_id int, hash string, bytes long")
    again = lambda: collection.Collection(spark, str(tmp_path), 3, Settings(gc_pack_rewrite_min_reclaim_bytes=50), batch=2)
    again().start(chunks, log, index)
    assert again().step(idle=False) == "busy" and again().state()["version"] == "1"
    assert again().step() == "scanned" and again().state()["gc.cursor"] == "b" and rows(again().table("chunks"), "hash") == [("b",), ("c",), ("d",), ("e",)]
    again().table("chunks").write.parquet(str(tmp_path / "chunks" / "v000000000003"))  # a commit that broke off
    assert again().step() == "scanned" and again().state()["gc.epoch"] == "2"
    assert again().step() == "scanned" and again().state()["gc.phase"] == collection.REWRITE
    assert rows(again().table("discards"), "epoch", "pack_id", "hash", "bytes") == [(1, 1, "a", 50), (2, 2, "c", 9), (3, 3, "e", 50)]
    assert again().step() == "rewritten" and rows(again().table("index"), "pack_id", "hash") == [(1, "b"), (2, "c"), (2, "d"), (3, "e")]
    assert again().step() == "done" and again().state()["gc.phase"] == collection.SCAN  # pack 2 has too little, pack 3 is active
    assert rows(again().table("discards"), "hash") == [("c",), ("e",)]
    assert again().until_stable() == 1


def test_ranks(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7919 % 1000).alias("k"), F.lit("x").alias("v")).repartition(7)
    assert rows(order.ranked(df, ["k"]), "k", "rank") == [(k, k + 1) for k in range(1000)]
    assert rows(order.numbered_pages(df, ["k"], 300).groupBy("page").count(), "page", "count") == [(0, 300), (1, 300), (2, 300), (3, 100)]
    assert order.ranked(df.limit(0), ["k"]).count() == 0


def test_zero_ref_pages_follow_the_cursor(spark):
    chunks = spark.range(0, 50).selectExpr("printf('%03d', id) as hash", "id % 3 as refcount", "cast(id % 4 as int) as pack_id", "id as clen")
    want, cursor = [], None
    while True:
        page = gc.zero_ref_scan(chunks, cursor, 7)
        want += rows(page, "hash", "pack_id", "clen", "next_cursor")
        last = chunks.where(F.lit(cursor is None) | (F.col("hash") > cursor)).orderBy("hash").limit(7).agg(F.max("hash")).first()[0]
        if last is None:
            break
        cursor = last
    assert rows(gc.zero_ref_pages(chunks, 7), "hash", "pack_id", "clen", "next_cursor") == sorted(want)


def test_pack_files_round_trip(spark, tmp_path):
    records = spark.createDataFrame([(1, 1, pack_files.PACK_MAGIC, "0a" * 16, 0, 9, b"abc"), (1, 2, pack_files.PACK_MAGIC, "0b" * 16, 1, 9, b""), (8, 1, b"XXXX", "0c" * 16, 0, 1, b"z")], "pack_id long, seq long, magic binary, hash string, codec int, ulen long, payload binary")
    assert rows(pack_files.write_packs(records, str(tmp_path)), "pack_id", "length") == [(1, 67), (8, 33)]
    assert rows(tables.pack_files(spark, str(tmp_path)), "pack_id", "length") == [(1, 67), (8, 33)]
    raw = (tmp_path / pack_files.pack_name(1)).read_bytes()
    assert raw[:32] == b"VPK2" + b"\x0a" * 16 + bytes(4) + b"\x09\0\0\0\x03\0\0\0"
    got = pack_files.read_records(spark, str(tmp_path))
    assert rows(got, "pack_id", "offset", "hash", "clen") == [(1, 0, "0a" * 16, 3), (1, 35, "0b" * 16, 0), (8, 0, "0c" * 16, 1)]
    assert rows(pack_files.bad_headers(got), "pack_id", "offset") == [(8, 0)]
    (tmp_path / pack_files.pack_name(1)).write_bytes(raw[:-1])  # a torn tail
    assert rows(pack_files.read_records(spark, str(tmp_path)).where("pack_id = 1"), "hash") == [("0a" * 16,)]


def test_packs_are_read_in_parts(spark, tmp_path, monkeypatch):
    """No file is held whole: Spark, which refuses to hold more than 50 bytes of one here, only lists them."""
    records = spark.range(300).selectExpr("1L + id % 2 as pack_id", "id as seq", "cast('VPK2' as binary) as magic", "md5(cast(id as string)) as hash", "0 as codec", "9L as ulen", "cast(repeat(cast(id as string), cast(id % 40 as int)) as binary) as payload")
    root = str(tmp_path / "a b%20")
    pack_files.write_packs(records, root).collect()
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "50")
    try:
        got = pack_files.read_records(spark, root).join(records.withColumnRenamed("payload", "own"), ["pack_id", "hash"])
        assert rows(got.groupBy(F.expr("payload = own and clen = length(own)").alias("same")).count(), "same", "count") == [(True, 300)]
        crcs = pack_files.read_checksums(spark, root).join(records.select("pack_id", "hash", codecs.crc32c("payload").alias("own")), ["pack_id", "hash"])
        assert rows(pack_files.read_headers(spark, root), "pack_id", "offset", "hash", "clen") == rows(pack_files.read_records(spark, root), "pack_id", "offset", "hash", "clen")
        index = pack_files.read_records(spark, root).drop("payload")
        checked = pack_files.read_payloads(index.where("clen > 0"), index, pack_files.read_records(spark, root)).join(records.select("pack_id", "hash", "payload").withColumnRenamed("payload", "own"), ["pack_id", "hash"])
        assert rows(checked.groupBy(F.expr("problem is null and payload = own").alias("same")).count(), "same", "count") == [(True, 292)]
        assert "payload" not in pack_files.read_headers(spark, root).columns
        assert rows(crcs.groupBy(F.expr("crc = own").alias("same")).count(), "same", "count") == [(True, 300)]
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")

    raw = Path(root, pack_files.pack_name(1)).read_bytes()
    took = []

    class File:
        def read_at(self, n, at):
            took.append(n)
            return raw[at : at + n]

    monkeypatch.setattr(pack_files, "READ_BYTES", 64)
    found = list(pack_files.walk(File(), len(raw), True))
    assert len(found) == 150 and max(took) == 32 + max(len(x[-1]) for x in found) < 160
    assert b"".join(pack_files.encode_header(bytes.fromhex(h), codec, ulen, clen, magic) + payload for _, magic, h, codec, ulen, clen, payload in found) == raw


def test_chunk_counts_are_those_of_plain_chunking(spark):
    files = {r.ino: r.text for r in store.Store(spark, "/root/testdata/sf0.001").files.collect()}
    got = dict(rows(catalog.QUERIES["p2_cdc_chunk_counts"](spark, "/root/testdata/sf0.001"), "ino", "chunks"))
    assert got == {k: len(cdc.spans(t.encode(), 256, 1024, 4096)) for k, t in files.items()}


def test_vault(spark, small):
    t, own, material = vault.create(small, 60, "secret", 5)
    assert {r.ino: r.flags for r in t.inodes.collect()}[60] == 6 and links(t)[1] == 5
    refused(errno.EEXIST, vault.create, t, 61, "again", 6)
    for password, key_file in (("other", material), ("secret", vault.generate_key())):
        with pytest.raises(PermissionError):
            own.unlock(spark, password, key_file)
    with pytest.raises(PermissionError):
        own.key()
    opened = own.unlock(spark, "secret", material)
    for change in (own.lock, lambda: opened.unlock(spark, "secret", material)):
        with pytest.raises(OSError, match="vault is"):
            change()
    sealed = spark.range(1).select(vault.encrypt(F.lit(b"data"), opened.key()).alias("c"))
    bad = F.concat(F.substring("c", F.lit(1), F.octet_length("c") - 1), F.lit(b"\0"))
    got = sealed.select(vault.decrypt("c", opened.key()).alias("a"), vault.decrypt(bad, opened.key()).alias("b")).first()
    assert bytes(got.a) == b"data" and got.b is None


def test_conflicts_meet_in_one_bin(spark):
    locks = spark.createDataFrame([(1, 1, 0, 100, "w"), (1, 2, 90, 300, "r"), (1, 3, 95, 96, "r"), (1, 4, 301, 400, "w"), (2, 5, 0, 400, "w"), (1, 6, 300, 300, "w")], "ino int, owner int, start long, end long, typ string")
    for size in (1, 32, 1000):
        assert rows(coalesce.conflicts(locks, size), "ino", "owner", "other") == [(1, 1, 2), (1, 1, 3), (1, 2, 6)]


def test_set_locks(spark):
    shape = "ino int, owner int, start long, end long, typ string"
    held = spark.createDataFrame([(1, 1, 0, 100, "w"), (1, 2, 200, 300, "r"), (1, 1, 400, 500, "r")], shape)
    asked = spark.createDataFrame([(1, 2, 50, 60, "r"), (1, 3, 250, 260, "r"), (1, 1, 90, 150, "u"), (1, 3, 450, 460, "w"), (2, 9, 0, 10, "w")], shape)
    for size in (10, 1 << 20):
        now, refused = coalesce.set_locks(held, asked, size)
        assert rows(refused, "owner", "start") == [(2, 50), (3, 450)]
        assert rows(now, "ino", "owner", "start", "typ") == [(1, 1, 400, "r"), (1, 2, 200, "r"), (1, 3, 250, "r"), (2, 9, 0, "w")]


def test_write_service(spark, tmp_path):
    """Operations are applied once, in batches; errors surface in drain; a closed service refuses."""
    done, broken = [], []

    def apply(batch, batch_id):
        if broken:
            raise ValueError("disk full")
        done.append((batch_id, sorted(r.seq for r in batch.collect())))

    make = lambda *seqs: spark.createDataFrame([(q, 1, 0, 5) for q in seqs], writes.OPS).coalesce(1)
    service = writes.WriteService(spark, str(tmp_path / "ops"), str(tmp_path / "state"), apply)
    service.enqueue(make(1, 2))
    service.enqueue(make(3))
    assert done == []
    service.drain()
    service.enqueue_and_wait(make(4))
    assert sorted(q for _, seqs in done for q in seqs) == [1, 2, 3, 4]
    broken.append(1)
    service.enqueue(make(5))
    with pytest.raises(Exception, match="disk full"):
        service.drain()
    broken.clear()
    service.start("100 milliseconds")
    service.enqueue_and_wait(make(6))
    assert sorted(q for _, seqs in done for q in seqs) == [1, 2, 3, 4, 5, 6]
    service.shutdown()
    with pytest.raises(RuntimeError, match="closed"):
        service.enqueue(make(7))


def test_repack_guard():
    repack.check_pack_size(None, 5)
    with pytest.raises(ValueError, match="repack"):
        repack.check_pack_size(4, 5)


def test_control_requests():
    seen = []
    control = Control({"snapshot_list": lambda: ["a", "b"], "vault_create": lambda password, key_path=None: seen.append((password, key_path)) or "written", "vault_lock": lambda: None})
    answers = [json.loads(a) for a in control.serve(['{"op": "snapshot_list", "more": 1}', "", '{"op": "vault_create", "password": "p"}', '{"op": "vault_create", "password": "p", "key_path": "k"}', '{"op": "vault_lock"}'])]
    assert [(a["ok"], a["names"], a["message"]) for a in answers] == [(True, ["a", "b"], ""), (True, [], "written"), (True, [], "written"), (True, [], "")]
    assert seen == [("p", None), ("p", "k")]
    for line in ("no JSON", "[]", "{}", '{"op": "other"}', '{"op": ["stats"]}', '{"op": "vault_create"}', '{"op": "snapshot_create", "name": 5}', '{"op": "stats"}'):
        answer = json.loads(control.handle(line))
        assert not answer["ok"] and answer["error"]
    assert parse('{"op": "vault_unlock", "password": "p", "key_file": "f"}') == ("vault_unlock", {"password": "p", "key_file": "f"})
    with pytest.raises(ValueError, match="no such"):
        Control({"format": lambda: None})


def test_session(spark, small, tmp_path):
    """Snapshots share blocks and go whole; a vault is made once, its key file is needed; the report tells counts."""
    moved = lambda df, *cols: df.select(*(F.when(F.col(c) > 1, F.col(c) + 10).otherwise(F.col(c)).alias(c) if c in cols else c for c in df.columns))
    small = dml.Tables(moved(small.dirents, "parent", "ino"), *(moved(x, "ino") for x in (small.inodes, small.extents, small.xattrs, small.symlinks)))
    files = small.extents.groupBy("hash").agg(F.count("*").alias("refcount"))
    chunks = files.selectExpr("hash", "refcount", "1 as pack_id", "1 as codec", "4L as ulen", "3L as clen")
    folder = spark.createDataFrame([(1, ".snapshots", 2, 2, 493, 0, 0)], "parent long, name string, ino long, kind int, perm int, uid long, gid long")
    start = dml.create(small, folder, 5).stored()
    before = {n: rows(getattr(start, n), "*") for n in ("dirents", "inodes", "extents")}
    counts = rows(chunks, "hash", "refcount")
    own = session.Session(start, chunks, spark.createDataFrame([], "name string, root_ino long, created long"), clock=lambda: 9)
    own.snapshot_create("one")
    assert rows(own.chunks, "hash", "refcount") == [("x", 5), ("y", 3), ("z", 1)]  # hard links part, what is lost isn't cloned
    assert own.tables.inodes.where("flags & 1 = 0").count() == start.inodes.where("flags & 1 = 0").count()
    own.snapshot_create("two")  # no snapshot of a snapshot
    assert own.snapshot_list() == ["one", "two"] and rows(own.chunks, "hash", "refcount") == [("x", 8), ("y", 5), ("z", 1)]
    refused(errno.EEXIST, own.snapshot_create, "one")
    assert "orphan_extents: 1\nmissing_chunks: 0\nrefcount_mismatches: 0" in own.stats()
    for name in ("one", "two"):
        own.snapshot_delete(name)
    refused(errno.ENOENT, own.snapshot_delete, "one")
    refused(errno.EINVAL, own.snapshot_create, "..")
    assert {n: rows(getattr(own.tables, n), "*") for n in before} == before and rows(own.chunks, "hash", "refcount") == counts
    refused(errno.ENOENT, own.vault_lock)
    path = own.vault_create("secret", str(tmp_path / "key"))
    assert os.stat(path).st_mode & 0o777 == 0o600
    with pytest.raises(FileExistsError):
        own.vault_create("secret", path)
    with pytest.raises(PermissionError):
        own.vault_unlock("other", path)
    own.vault_unlock("secret", path)
    own.vault_lock()


def test_handles(spark, small):
    new = lambda *r: spark.createDataFrame([*r], "fh long, ino long, truncate boolean")
    none = spark.createDataFrame([], "fh long, ino long")
    entry = small.dirents.where("kind = 1").first()
    file, size = entry.ino, small.inodes.where(F.col("ino") == entry.ino).first()["size"]
    refused(errno.ENOENT, handles.opened, small, none, new((1, 999, False)))
    refused(errno.EISDIR, handles.opened, small, none, new((1, 1, False)))
    refused(errno.EBADF, handles.opened, small, none, new((1, file, False), (1, file, False)))
    t, held = handles.opened(small, none, new((1, file, False), (2, file, False)))
    assert t.inodes.where(F.col("ino") == file).first()["size"] == size
    names = small.dirents.where(F.col("ino") == file).select("parent", "name")
    t = dml.unlink(t, names, held.select("ino"))
    t, held = handles.released(t, held, spark.createDataFrame([(1,)], "fh long"))
    assert t.inodes.where(F.col("ino") == file).first()["nlink"] == 0
    refused(errno.EBADF, handles.released, t, held, spark.createDataFrame([(1,)], "fh long"))
    t, held = handles.released(t, held, spark.createDataFrame([(2,)], "fh long"))
    assert t.inodes.where(F.col("ino") == file).isEmpty() and held.isEmpty()
    t, _ = handles.opened(small, none, new((1, file, True)))
    assert t.inodes.where(F.col("ino") == file).first()["size"] == 0 and t.extents.where(F.col("ino") == file).isEmpty()


def test_permissions(spark, tmp_path):
    root, outside = tmp_path / "data", tmp_path / "outside"
    (root / "A").mkdir(parents=True)
    outside.write_bytes(b"x")
    for p in (outside, root / "A" / "pack", root / "log"):
        p.write_bytes(b"x")
        p.chmod(0o604)
    (root / "A" / "link").symlink_to(outside)
    assert permissions.normalize_tree(spark, str(root)) == [("", True, 0o770), ("A", True, 0o770), ("A/pack", False, 0o660), ("log", False, 0o660)]
    assert outside.stat().st_mode & 0o777 == 0o604 and (root / "log").stat().st_mode & 0o777 == 0o660
    assert permissions.normalize_tree(spark, str(tmp_path / "missing")) == []


def test_sync_service(spark, tmp_path):
    """Background cycles go on after an error; the last sync is a full one and raises."""
    chunks = spark.createDataFrame([("a", 0, 1, 5), ("b", 1, 1, 5)], "hash string, refcount long, pack_id int, clen long")
    log = spark.createDataFrame([], "epoch long, pack_id int, hash string, bytes long")
    index = spark.createDataFrame([(1, "a", 0, 1, 5, 5)], "pack_id int, hash string, offset long, codec int, ulen long, clen long")
    store_ = collection.Collection(spark, str(tmp_path), 3, batch=10)
    store_.start(chunks, log, index)
    service = sync.SyncService(store_)
    service.counters["errors"] = 4
    assert service.cycle(full=True) == "synced" and store_.state()["counter.errors"] == "4" and store_.table("chunks").count() == 2
    version = store_.state()["version"]
    assert service.fsync() == "synced" and store_.state()["version"] == version  # nothing changed
    step, calls = store_.step, []

    def flaky(idle):
        calls.append(idle)
        if len(calls) == 1:
            raise OSError("disk full")
        return step(idle)

    store_.step = flaky
    service.start(0.05)
    end = time.time() + 30
    while len(calls) < 3 and time.time() < end:
        time.sleep(0.05)
    service.shutdown()
    assert service.errors == 1 and len(calls) >= 3 and store_.table("chunks").count() == 1
    store_.commit = lambda *a, **k: (_ for _ in ()).throw(OSError("disk full"))
    service.counters["errors"] = 5
    with pytest.raises(OSError, match="disk full"):
        service.shutdown()


def test_refused_settings():
    assert refused_setting("") == "" and refused_setting("zstd_compression_level = 23") == "zstd_compression_level"
    assert refused_setting("ultracdc_min_size_bytes = 70000") == "ultracdc"
