"""Queries over the driver's tables for each operator of the store, with SQL for the oracle.

A query's name starts with the operator's id.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce, wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .config import KIND_DIR, PACK_MAGIC, SNAPSHOTS_INO, Settings, refused_setting
from .control import Control
from .functions import cdc, codecs, scalars
from .operators import audit, blocks, coalesce, dedup, dml, gc, handles, namespace, packs, reads, snapshots, vault
from .operators.order import numbered_pages, ranked
from .plans import collection, repack, session, stats, write_path
from .shared import new_path, shared_dir, stored
from .ship import ship
from .sources import bootstrap, pack_files, permissions, tables
from .sources.store import BLOCK, FILE0, PACKS, PRELUDE, Store
from .streaming import sync, writes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, prelude: bool = True):
    """Registers a function of a Store under its name, and its SQL (with the store's tables)."""

    def register(f):
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(Store(spark, sf_dir))

        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = f"WITH RECURSIVE {PRELUDE}\n{sql}" if prelude else sql
        return f

    return register


# Scans -------------------------------------------------------------------------------------------


@query("SELECT doc_id + 1000000 AS ino, lang FROM documents WHERE doc_id = 42", prelude=False)
def s1_point_get(s):
    return tables.point_get(s.documents, doc_id=42).select((F.col("doc_id") + FILE0).alias("ino"), "lang")


@query("SELECT ino, block_idx, hash FROM extents WHERE ino >= 1000100 AND ino < 1000200")
def s2_range_scan(s):
    return tables.range_scan(s.extents, "ino", FILE0 + 100, FILE0 + 200).select("ino", "block_idx", "hash")


@query("SELECT ino, size, true AS has_more FROM inodes WHERE ino > 1000050 ORDER BY ino LIMIT 100")
def s3_page(s):
    return tables.page(s.inodes.select("ino", "size"), ["ino"], (FILE0 + 50,), 100)


@query("SELECT parent, name, ino FROM dirents WHERE parent = 1 AND name LIKE 'link-%'")
def s4_prefix_scan(s):
    key = scalars.dirent_key("parent", "name")
    start = "44" + f"{1:016X}" + "00" + b"link-".hex().upper()
    return s.dirents.where((key >= start) & (key < scalars.prefix_end(start))).select("parent", "name", "ino")


def written_packs(s, records: DataFrame | None = None) -> str:
    """A folder with the store's pack files: each entry's payload is its block, cut to the stored length."""
    root = shared_folder(s.spark)
    rows = (s.pack_index if records is None else records).join(s.payloads, "hash")
    magic = F.lit(PACK_MAGIC) if records is None else F.col("magic")
    pack_files.write_packs(rows.select("pack_id", "seq", magic.alias("magic"), "hash", "codec", "ulen", F.substring("data", F.lit(1), F.col("clen").cast("int")).alias("payload")), root).write.format("noop").mode("overwrite").save()
    return root


@query("SELECT pack_id, CAST(sum(32 + clen) AS BIGINT) AS length FROM pack_index GROUP BY pack_id")
def s5_pack_ids(s):
    """Pack files found in their folders."""
    return tables.pack_files(s.spark, written_packs(s))


@query('SELECT pack_id, hash, "offset", clen FROM pack_index WHERE pack_id = 5')
def s6_index_scan(s):
    return s.pack_index.where("pack_id = 5").select("pack_id", "hash", "offset", "clen")


@query("SELECT pack_id, min(\"offset\") AS \"offset\" FROM pack_index WHERE hash LIKE 'f0%' GROUP BY pack_id")
def s7_verify_headers(s):
    """The headers of all pack files, some of which have another magic; a file is read up to the first of these."""
    spoiled = s.pack_index.withColumn("magic", F.when(F.col("hash").like("f0%"), F.lit(b"XXXX")).otherwise(F.lit(PACK_MAGIC)))
    return pack_files.bad_headers(pack_files.read_headers(s.spark, written_packs(s, spoiled)))


@query("SELECT hash, pack_id, CASE WHEN hash LIKE 'd2%' THEN 'index clen' WHEN hash LIKE 'e3%' THEN 'no index entry' WHEN hash LIKE 'f4%' THEN 'codec' END AS problem, CASE WHEN hash LIKE 'd2%' OR hash LIKE 'e3%' OR hash LIKE 'f4%' THEN 0 ELSE clen END AS bytes FROM chunks")
def s8_pack_verify(s):
    """Every chunk's payload through the index from its pack file; some index rows and some headers are wrong."""
    wrong = s.pack_index.withColumn("magic", F.lit(PACK_MAGIC)).withColumn("codec", F.when(F.col("hash").like("f4%"), 9).otherwise(F.col("codec")))
    index = s.pack_index.where("hash not like 'e3%'").withColumn("clen", F.when(F.col("hash").like("d2%"), F.col("clen") + 1).otherwise(F.col("clen")))
    got = pack_files.read_payloads(s.chunks, index, pack_files.read_records(s.spark, written_packs(s, wrong)))
    return got.select("hash", "pack_id", "problem", F.coalesce(F.octet_length("payload"), F.lit(0)).cast("long").alias("bytes"))


@query('SELECT pack_id, hash, max("offset") AS "offset" FROM pack_index GROUP BY pack_id, hash')
def s9_last_entry(s):
    return packs.last_entries(s.pack_index).select("pack_id", "hash", "offset")


@query("SELECT count(*) FILTER (hash NOT LIKE '%3') AS valid, count(*) FILTER (hash LIKE '%3') AS invalid FROM discards WHERE epoch = 1")
def s10_discard_read(s):
    """The log up to the checkpoint that the first append left; records whose checksum is wrong are counted only."""
    log = ranked(s.discards, ["epoch", "hash"], "pos")
    checkpoint = log.where("epoch = 1").count() + 1
    return gc.split_log(log, checkpoint, ~F.col("hash").like("%3"))[1]


@query("SELECT row_number() OVER (ORDER BY r, name) - 1 AS pos, name, ino FROM (SELECT 0 AS r, '.' AS name, 1 AS ino UNION ALL SELECT 1, '..', 1 UNION ALL SELECT 2, name, ino FROM dirents WHERE parent = 1 AND ino IN (SELECT ino FROM inodes))")
def s11_listing(s):
    return namespace.listing(s.dirents, s.inodes, 1, 1)


@query("SELECT name, ino, kind FROM dirents WHERE parent = 1005")
def s12_dirents(s):
    return s.dirents.where("parent = 1005").select("name", "ino", "kind")


@query()
def s13_tree_size(s):
    return tables.tree_size(s.spark, s.sf_dir)


@query("SELECT * FROM (VALUES ('VmRSS:     1234 kB', 1263616), ('VmSize: 7 kB', 7168), ('Name: x', NULL), ('Rss: -1 kB', NULL)) AS t(line, bytes)", prelude=False)
def s14_proc_lines(s):
    rows = s.spark.createDataFrame([("VmRSS:     1234 kB",), ("VmSize: 7 kB",), ("Name: x",), ("Rss: -1 kB",)], "line string")
    return rows.select("line", scalars.parse_kib("line").alias("bytes"))


@query("SELECT * FROM (VALUES ('pack_max_size_mb', 5000.0), ('batch_max_size_mb', 512.0), ('zstd_compression_level', 3.0), ('ultracdc_avg_size_bytes', 32768.0), ('gc_pack_rewrite_min_reclaim_percent', 12.5), ('block_size', 1048576.0)) AS t(name, value)", prelude=False)
def s15_settings(s):
    """A file's keys, defaults for those it lacks, keys unknown here ignored."""
    own = Settings.parse("pack_max_size_mb = 5000\ngc_pack_rewrite_min_reclaim_percent = 12.5\nmount_point = \"/mnt\"\n")
    return s.spark.createDataFrame([(n, float(getattr(own, n))) for n in ("pack_max_size_mb", "batch_max_size_mb", "zstd_compression_level", "ultracdc_avg_size_bytes", "gc_pack_rewrite_min_reclaim_percent", "block_size")], "name string, value double")


# Sinks -------------------------------------------------------------------------------------------


def shared_folder(spark: SparkSession) -> str:
    return new_path(spark, "store")


@query("SELECT count(*) AS n, CAST(sum(refcount) AS BIGINT) AS refs FROM chunks WHERE hash NOT LIKE '1%'")
def k1_atomic_commit(s):
    root = shared_folder(s.spark)
    first = s.spark.read.parquet(tables.publish(s.chunks, root, 1))
    second = s.spark.read.parquet(tables.publish(first.where("hash not like '1%'"), root, 2))
    return second.agg(F.count("*").alias("n"), F.sum("refcount").alias("refs"))


FOLD_SQL = """, r AS (SELECT substr(hash, 1, 1) AS writer, hash, clen, row_number() OVER (PARTITION BY substr(hash, 1, 1) ORDER BY hash) AS k FROM chunks),
fold AS (SELECT writer, hash, k, CAST(1 AS BIGINT) AS pack_no, CAST(0 AS BIGINT) AS "offset", 32 + clen AS used FROM r WHERE k = 1
  UNION ALL SELECT r.writer, r.hash, r.k, CASE WHEN used + 32 + clen > 20000 THEN pack_no + 1 ELSE pack_no END, CASE WHEN used + 32 + clen > 20000 THEN 0 ELSE used END, CASE WHEN used + 32 + clen > 20000 THEN 32 + clen ELSE used + 32 + clen END
  FROM fold JOIN r ON r.writer = fold.writer AND r.k = fold.k + 1)"""


@query(FOLD_SQL + ' SELECT writer, hash, pack_no, "offset" FROM fold')
def n3_pack_assignment(s):
    rows = s.chunks.select(F.substring("hash", 1, 1).alias("writer"), "hash", "clen")
    return packs.assign_packs(rows, "writer", ["hash"], 20_000).select("writer", "hash", "pack_no", "offset")


@query(FOLD_SQL + ' SELECT writer, pack_no, count(*) AS records, CAST(max(used) AS BIGINT) AS size FROM fold GROUP BY writer, pack_no')
def k2_k3_append_and_rotate(s):
    rows = packs.assign_packs(s.chunks.select(F.substring("hash", 1, 1).alias("writer"), "hash", "clen"), "writer", ["hash"], 20_000)
    return rows.groupBy("writer", "pack_no").agg(F.count("*").alias("records"), F.max(F.col("offset") + 32 + F.col("clen")).alias("size"))


@query("SELECT pack_id, count(*) AS n FROM (SELECT pack_id FROM entries UNION ALL SELECT pack_id FROM chunks WHERE hash LIKE '9%') GROUP BY pack_id")
def k4_append_index(s):
    root = shared_folder(s.spark)
    s.entries.select("pack_id", "hash").write.parquet(root + "/index")
    s.chunks.where("hash like '9%'").select("pack_id", "hash").write.mode("append").parquet(root + "/index")
    return s.spark.read.parquet(root + "/index").groupBy("pack_id").agg(F.count("*").alias("n"))


@query('SELECT pack_id, seq, hash, "offset" FROM pack_index')
def k5_rebuild_index(s):
    records = s.entries.withColumn("seq", F.row_number().over(Window.partitionBy("pack_id").orderBy("hash")))
    return packs.with_offsets(records).select("pack_id", "seq", "hash", "offset")


@query("SELECT epoch, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes FROM discards GROUP BY epoch")
def k6_discard_append(s):
    root = shared_folder(s.spark)
    s.discards.where("epoch = 1").write.parquet(root + "/log")
    s.discards.where("epoch = 2").write.mode("append").parquet(root + "/log")
    return s.spark.read.parquet(root + "/log").groupBy("epoch").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


@query("SELECT pack_id, count(*) AS n FROM discards WHERE pack_id NOT IN (3, 4) GROUP BY pack_id")
def k7_o7_discard_rewrite(s):
    root = shared_folder(s.spark)
    gone = s.spark.createDataFrame([(3,), (4,)], "pack_id int")
    path = tables.publish(gc.without_packs(s.discards, gone), root, 2)
    return s.spark.read.parquet(path).groupBy("pack_id").agg(F.count("*").alias("n"))


COMPACT_SQL = """, kept AS (SELECT i.* FROM (SELECT *, row_number() OVER (PARTITION BY pack_id, hash ORDER BY "offset") AS k FROM pack_index WHERE pack_id <> 24) i
  JOIN chunks c ON c.hash = i.hash AND c.pack_id = i.pack_id AND c.refcount > 0 WHERE k = 1)
SELECT pack_id, hash, CAST(coalesce(sum(32 + clen) OVER (PARTITION BY pack_id ORDER BY "offset" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset", clen FROM kept
UNION ALL SELECT pack_id, hash, "offset", clen FROM pack_index WHERE pack_id = 24"""


@query(COMPACT_SQL)
def k8_j13_n5_compact(s):
    return packs.compacted(s.pack_index, gc.live_hashes(s.chunks), active=PACKS).select("pack_id", "hash", "offset", "clen")


@query()
def k9_m9_crc_index(s):
    """Every index row with the CRC-32C of its payload, read from the pack files."""
    return pack_files.read_checksums(s.spark, written_packs(s)).select("pack_id", "offset", "hash", "crc")


SIZES_SQL = """, reach AS (SELECT d.name AS top, d.ino, d.kind FROM dirents d WHERE parent = 1 UNION ALL SELECT r.top, d.ino, d.kind FROM reach r JOIN dirents d ON d.parent = r.ino WHERE r.kind = 2),
sizes AS (SELECT CASE WHEN top = 'fr' THEN 'snapshots' WHEN top = 'es' THEN 'vault' ELSE 'live' END AS scope, i.ino, i.size FROM reach r JOIN inodes i ON i.ino = r.ino WHERE r.kind = 1 GROUP BY ALL)"""
STATS_SQL = SIZES_SQL + """,
st AS (SELECT (SELECT count(*) FROM inodes) AS inodes, (SELECT count(*) FROM inodes WHERE kind = 1) AS files, (SELECT count(*) FROM inodes WHERE kind = 2) AS directories,
  (SELECT CAST(coalesce(sum(size), 0) AS BIGINT) FROM sizes WHERE scope = 'live') AS live_bytes, (SELECT CAST(coalesce(sum(size), 0) AS BIGINT) FROM sizes) AS logical_bytes,
  (SELECT CAST(sum(ulen) AS BIGINT) FROM chunks) AS uncompressed, (SELECT CAST(sum(clen) AS BIGINT) FROM chunks) AS compressed, (SELECT count(*) FROM chunks) AS chunks, (SELECT count(*) FROM chunks WHERE refcount = 0) AS zero_ref_chunks,
  (SELECT count(*) FROM extents WHERE ino NOT IN (SELECT ino FROM inodes)) AS orphan_extents, (SELECT count(DISTINCT hash) FROM extents WHERE hash NOT IN (SELECT hash FROM chunks)) AS missing_chunks,
  (SELECT count(*) FROM chunks c LEFT JOIN (SELECT hash, count(*) AS n FROM extents GROUP BY hash) e ON e.hash = c.hash WHERE coalesce(n, 0) <> refcount) AS refcount_mismatches)"""


def scoped_sizes(s) -> DataFrame:
    tree = namespace.below(s.dirents, 1)
    top = F.split_part("path", F.lit("/"), F.lit(2))
    scope = F.when(top == "fr", "snapshots").when(top == "es", "vault").otherwise("live")
    return namespace.logical_size(tree, s.inodes, scope)


def all_stats(s) -> DataFrame:
    return stats.collect_stats(s.inodes, s.extents, s.chunks, scoped_sizes(s))


HUMAN_SQL = "CASE WHEN {x} < 1024 THEN printf('%.2f B', {x} / 1.0) WHEN {x} < 1048576 THEN printf('%.2f KiB', {x} / 1024.0) WHEN {x} < 1073741824 THEN printf('%.2f MiB', {x} / 1048576.0) ELSE printf('%.2f GiB', {x} / 1073741824.0) END"


@query(STATS_SQL + f""", rows AS (SELECT unnest([{{'position': 0, 'metric': 'inodes', 'value': inodes}}, {{'position': 1, 'metric': 'files', 'value': files}}, {{'position': 2, 'metric': 'directories', 'value': directories}}, {{'position': 3, 'metric': 'live_bytes', 'value': live_bytes}}, {{'position': 4, 'metric': 'logical_bytes', 'value': logical_bytes}}, {{'position': 5, 'metric': 'uncompressed', 'value': uncompressed}}, {{'position': 6, 'metric': 'compressed', 'value': compressed}}, {{'position': 7, 'metric': 'chunks', 'value': chunks}}, {{'position': 8, 'metric': 'zero_ref_chunks', 'value': zero_ref_chunks}}, {{'position': 9, 'metric': 'orphan_extents', 'value': orphan_extents}}, {{'position': 10, 'metric': 'missing_chunks', 'value': missing_chunks}}, {{'position': 11, 'metric': 'refcount_mismatches', 'value': refcount_mismatches}}], recursive := true) FROM st)
SELECT position, metric, value, CASE WHEN regexp_matches(metric, 'bytes|compressed') THEN {HUMAN_SQL.format(x='value')} ELSE CAST(value AS VARCHAR) END AS readable FROM rows""")
def k10_stats_report(s):
    return stats.report(all_stats(s))


OFFLINE_SQL = """, x AS (SELECT i.*, CASE WHEN c.hash IS NULL THEN 'unknown' WHEN refcount <= 0 THEN 'unreferenced' WHEN c.pack_id <> i.pack_id THEN 'elsewhere' ELSE 'live' END AS state FROM pack_index i LEFT JOIN chunks c ON c.hash = i.hash AND c.hash NOT LIKE '7%'),
p AS (SELECT pack_id, hash, state, count(*) AS n, max(clen) AS clen FROM x GROUP BY ALL)"""


@query(OFFLINE_SQL + """ SELECT count(DISTINCT pack_id) AS packs, CAST(sum(n) AS BIGINT) AS entries, CAST(sum(CASE WHEN state = 'live' THEN n ELSE 0 END) AS BIGINT) AS live_entries, CAST(sum(CASE WHEN state = 'unknown' THEN n ELSE 0 END) AS BIGINT) AS unknown_entries,
 CAST(sum(CASE WHEN state = 'unreferenced' THEN n ELSE 0 END) AS BIGINT) AS unreferenced_entries, CAST(sum(CASE WHEN state = 'elsewhere' THEN n ELSE 0 END) AS BIGINT) AS elsewhere_entries, CAST(sum(CASE WHEN state <> 'live' THEN n - 1 ELSE 0 END) AS BIGINT) AS collapsed_duplicates,
 count(*) FILTER (state <> 'live') AS discards, CAST(sum(CASE WHEN state <> 'live' THEN clen ELSE 0 END) AS BIGINT) AS discard_bytes FROM p""")
def k11_a12_o6_offline_report(s):
    return gc.offline_report(s.pack_index, s.chunks.where("hash not like '7%'"))


@query(OFFLINE_SQL + " SELECT pack_id, hash, clen AS bytes FROM p WHERE state <> 'live'")
def j11_offline_rebuild(s):
    return gc.rebuilt_discards(s.pack_index, s.chunks.where("hash not like '7%'"), 9).select("pack_id", "hash", "bytes")


@query()
def k12_new_chunks(s):
    """Distinct new blocks, compressed, with their checksums."""
    known = s.chunks.where("hash like '0%'")
    fresh = dedup.new_hashes(s.blocks.select(F.md5("data").alias("hash"), "data"), known)
    return fresh.withColumn("z", codecs.compress(3)("data")).select("hash", "z.codec", "z.ulen", "z.clen", codecs.crc32c("z.payload").alias("crc"))


# Scalars -----------------------------------------------------------------------------------------


@query()
def p1_cdc_spans(s):
    return cdc.chunk(s.files.select("ino", F.encode("text", "UTF-8").alias("data")), "ino", "data", 256, 1024, 4096)


def cdc_spans(s):
    return cdc.chunk(s.files.select("ino", F.encode("text", "UTF-8").alias("data")), "ino", "data", 256, 1024, 4096)


@query()
def p2_cdc_chunk_counts(s):
    """(ino, chunks): the number of content-defined chunks of each file, 0 for empty ones."""
    counts = cdc_spans(s).groupBy("ino").agg(F.count("*").alias("n"))
    return s.files.select("ino").join(counts, "ino", "left").select("ino", F.coalesce("n", F.lit(0)).alias("chunks"))


@query("SELECT ino, n AS covered, n BETWEEN 1 AND 4096 OR n = 0 AS one_at_most FROM f")
def p2_cdc_coverage(s):
    """Chunks cover each file; files up to the greatest size may be one chunk, others can't."""
    by = cdc_spans(s).groupBy("ino").agg(F.sum("length").alias("covered"), F.min(F.col("length") <= 4096).alias("ok"))
    rows = s.files.select("ino", "n").join(by, "ino", "left")
    return rows.select("ino", F.coalesce("covered", F.lit(0)).alias("covered"), (F.coalesce("ok", F.lit(True)) & (F.col("n") <= 4096)).alias("one_at_most"))


@query()
def p3_p4_p5_hashes(s):
    data = F.encode("text", "UTF-8")
    return s.files.select("ino", F.hex(codecs.hash128(data)).alias("plain"), F.hex(codecs.hash128_with_domain(data, 0xA7)).alias("vault"), F.hex(codecs.hash_for(data, F.col("source") == "src7")).alias("own"))


@query("SELECT count(*) AS files, count(*) AS same FROM documents", prelude=False)
def p6_p7_p8_codec_round_trip(s):
    z = s.files.select(F.encode("text", "UTF-8").alias("data")).withColumn("z", codecs.compress(3)("data"))
    back = z.select("data", codecs.decompress("z.codec", "z.ulen", "z.payload").alias("back"))
    return back.agg(F.count("*").alias("files"), F.count_if(F.col("data") == F.col("back")).alias("same"))


@query("SELECT count(*) AS files, count(*) FILTER (doc_id % 20 = 0) AS mismatches FROM documents", prelude=False)
def p9_checksum_mismatches(s):
    data = F.encode("text", "UTF-8")
    rows = s.files.select("doc_id", data.alias("data"), codecs.crc32c(data).alias("told")).withColumn("told", F.when(F.col("doc_id") % 20 == 0, F.col("told") + 1).otherwise(F.col("told")))
    return rows.select((F.col("told") != codecs.crc32c("data")).alias("bad")).agg(F.count("*").alias("files"), F.count_if("bad").alias("mismatches"))


@query("SELECT count(*) AS files, count(*) AS same, 0 AS opened_with_another_key FROM documents", prelude=False)
def p10_p11_encrypt(s):
    """Authenticated encryption round trip with AES-GCM, the authenticated cipher that Spark has, under fresh folder keys."""
    key, other = vault.generate_key(), vault.generate_key()
    rows = stored(s.files.select("text", vault.encrypt("text", key).alias("c")))
    rows = rows.select((vault.decrypt("c", key).cast("string") == F.col("text")).alias("ok"), vault.decrypt("c", other).isNotNull().alias("open"))
    return rows.agg(F.count("*").alias("files"), F.count_if("ok").alias("same"), F.count_if("open").alias("opened_with_another_key"))


@query("SELECT * FROM (VALUES ('created', 1, 0), ('wrong password', 0, 0), ('wrong key file', 0, 0), ('unlocked', 1, 1), ('locked', 1, 0)) AS t(step, ok, visible)", prelude=False)
def p12_p13_p14_p34_m4_m5_m6_vault(s):
    """A vault's life: made, refused to a wrong password and a wrong key file, unlocked, locked; visible: whether its folder shows."""
    t, own, material = vault.create(s.tables, 79_000_001, "secret", 5)
    folder = stored(t.inodes.where("ino = 79000001"))
    shown = lambda v: folder.where(scalars.visible(v.folder_key is not None)).count()

    def refused(password: str, key_file: bytes) -> int:
        try:
            own.unlock(s.spark, password, key_file)
        except PermissionError:
            return 0
        return 1

    opened = own.unlock(s.spark, "secret", material)
    rows = [("created", int(own.folder_key is None), shown(own)), ("wrong password", refused("other", material), shown(own)), ("wrong key file", refused("secret", vault.generate_key()), shown(own)), ("unlocked", int(len(opened.key()) == 32), shown(opened)), ("locked", int(opened.lock().folder_key is None), shown(opened.lock()))]
    return s.spark.createDataFrame(rows, "step string, ok int, visible int")


@query("SELECT ino, (size + 511) // 512 AS blocks, CASE kind WHEN 2 THEN 'directory' WHEN 3 THEN 'symlink' ELSE 'file' END AS type, CASE kind WHEN 2 THEN 16384 WHEN 3 THEN 40960 ELSE 32768 END AS flag, mtime, CAST(0 AS BIGINT) AS nsec FROM inodes")
def p15_p16_p17_attributes(s):
    sec, nsec = scalars.split_time(F.timestamp_seconds("mtime"))
    return s.inodes.select("ino", scalars.blocks_512("size").alias("blocks"), scalars.file_type("kind").alias("type"), scalars.mode_flag("kind").alias("flag"), sec.alias("mtime"), nsec.alias("nsec"))


@query("SELECT event_id, epoch_us(ts) AS micros, epoch_us(ts) // 1000000 AS sec, (epoch_us(ts) % 1000000) * 1000 AS nsec FROM events", prelude=False)
def p18_p19_times(s):
    sec, nsec = scalars.split_time("ts")
    rows = tables.table(s.spark, s.sf_dir, "events").select("event_id", sec.alias("sec"), nsec.alias("nsec"))
    return rows.select("event_id", F.unix_micros(scalars.join_time("sec", "nsec")).alias("micros"), "sec", "nsec")


@query("SELECT ino, block_idx, '45' || printf('%016X', ino) || printf('%016X', block_idx) AS key FROM extents")
def p20_p21_extent_keys(s):
    keys = s.extents.select(scalars.extent_key("ino", "block_idx").alias("key"))
    ino, block = scalars.extent_of_key("key")
    return keys.select(ino.alias("ino"), block.alias("block_idx"), "key")


@query("SELECT name, ino FROM dirents")
def p22_dirent_names(s):
    return s.dirents.select(scalars.dirent_key("parent", "name").alias("key"), "ino").select(scalars.name_of_dirent_key("key").alias("name"), "ino")


@query("SELECT * FROM (VALUES ('S:a', 'a'), ('S:', ''), ('SYS:x', NULL), ('I1', NULL)) AS t(key, name)", prelude=False)
def p23_snapshot_keys(s):
    return s.spark.createDataFrame([("S:a",), ("S:",), ("SYS:x",), ("I1",)], "key string").select("key", scalars.snapshot_name_of_key("key").alias("name"))


@query(f"SELECT ino, {HUMAN_SQL.format(x='size')} AS readable, '-' || {HUMAN_SQL.format(x='(size + 1)')} AS negative FROM inodes")
def p24_p25_human_bytes(s):
    return s.inodes.select("ino", scalars.human_bytes("size").alias("readable"), scalars.human_bytes_signed(-F.col("size") - 1).alias("negative"))


@query("SELECT hash, CAST(clen AS DOUBLE) / ulen AS full, CASE WHEN refcount = 0 THEN 0.0 ELSE CAST(clen AS DOUBLE) / refcount END AS each FROM chunks")
def p26_ratio(s):
    return s.chunks.select("hash", scalars.ratio("clen", "ulen").alias("full"), scalars.ratio("clen", "refcount").alias("each"))


@query("SELECT DISTINCT pack_id, substr('ABCDEF', pack_id % 6 + 1, 1) || '/pack-' || printf('%020d', pack_id) || '.vpk' AS path, pack_id AS parsed FROM chunks")
def p27_p28_pack_names(s):
    return s.chunks.select("pack_id").distinct().withColumn("path", scalars.pack_path("pack_id")).withColumn("parsed", scalars.pack_id_of("path"))


@query("SELECT count(*) AS records, count(*) AS decoded, CAST(sum(bytes) AS BIGINT) AS bytes FROM discards")
def p29_p30_discard_records(s):
    raw = s.discards.select(codecs.discard_record("epoch", "pack_id", F.unhex("hash"), "bytes").alias("raw"))
    return raw.select(codecs.discard_fields("raw").alias("f")).agg(F.count("*").alias("records"), F.count("f.bytes").alias("decoded"), F.sum("f.bytes").alias("bytes"))


HEXPAD = f"rpad({{}}, {2 * BLOCK}, '0')"


BLOCKS_SQL = f", b AS (SELECT ino, block_idx, {HEXPAD.format(f'substr(h, block_idx * {2 * BLOCK} + 1, {2 * BLOCK})')} AS h FROM (SELECT *, unnest(range(0, (n + {BLOCK - 1}) // {BLOCK})) AS block_idx FROM raw))"


@query(BLOCKS_SQL + " SELECT ino, block_idx, md5(unhex(substr(h, 1, 200) || '58595A' || substr(h, 207))) AS hash FROM b")
def p31_overlay(s):
    return s.blocks.select("ino", "block_idx", F.md5(blocks.patched(F.col("data"), F.lit(b"XYZ"), F.lit(100), BLOCK)).alias("hash"))


@query(BLOCKS_SQL + f" SELECT ino, block_idx, md5(unhex({HEXPAD.format('substr(h, 1, 200)')})) AS cut, md5(unhex(h)) AS padded FROM b")
def p32_pad_and_cut(s):
    return s.blocks.select("ino", "block_idx", F.md5(blocks.truncated(F.col("data"), F.lit(100), BLOCK)).alias("cut"), F.md5(blocks.padded(F.col("data"), BLOCK)).alias("padded"))


@query("SELECT * FROM (VALUES ('snap-01', true), ('', false), ('.', false), ('..', false), ('team/snap', false), ('prod.backup', true)) AS t(name, ok)", prelude=False)
def p33_names(s):
    return s.spark.createDataFrame([(n,) for n in ("snap-01", "", ".", "..", "team/snap", "prod.backup")], "name string").select("name", scalars.valid_name("name").alias("ok"))


# Filters -----------------------------------------------------------------------------------------


@query("SELECT hash, pack_id, clen, next_cursor FROM (SELECT *, max(hash) OVER (PARTITION BY page) AS next_cursor FROM (SELECT *, (row_number() OVER (ORDER BY hash) - 1) // 700 AS page FROM chunks)) WHERE refcount = 0")
def f1_o3_zero_ref_scan(s):
    """The whole scan, in pages of 700 keys."""
    return gc.zero_ref_pages(s.chunks, 700)


@query("SELECT count(*) AS n, count(*) FILTER (refcount = 0) AS dead FROM chunks WHERE NOT (refcount = 0 AND hash < '8')")
def f2_recheck_delete(s):
    candidates = s.chunks.where("hash < '8'").select("hash")
    return gc.delete_candidates(s.chunks, candidates).agg(F.count("*").alias("n"), F.count_if(F.col("refcount") == 0).alias("dead"))


@query("SELECT hash FROM chunks WHERE pack_id = 7 AND refcount > 0")
def f3_live_chunks(s):
    return gc.live_hashes(s.chunks).where("pack_id = 7").select("hash")


DEAD_SQL = """, d AS (SELECT pack_id, arg_max(bytes, epoch) AS bytes FROM discards GROUP BY pack_id, hash), sz AS (SELECT pack_id, CAST(sum(32 + clen) AS BIGINT) AS size FROM pack_index GROUP BY pack_id),
pd AS (SELECT d.pack_id, CAST(sum(bytes) AS BIGINT) AS dead, any_value(size) AS size, CAST(sum(bytes) AS DOUBLE) / any_value(size) * 100 AS percent FROM d JOIN sz ON sz.pack_id = d.pack_id GROUP BY d.pack_id)"""


@query(DEAD_SQL + " SELECT pack_id, dead, size FROM pd WHERE pack_id <> 24 AND (dead >= 9000 OR percent >= 9)")
def f4_reclaim_threshold(s):
    return gc.worth_rewriting(gc.dead_bytes(s.discards, s.pack_index), PACKS, 9000, 9.0).select("pack_id", "dead", "size")


@query(DEAD_SQL + " SELECT pack_id, dead, size, round(percent, 9) AS percent FROM pd")
def a11_n4_dead_bytes(s):
    return gc.dead_bytes(s.discards, s.pack_index).withColumn("percent", F.round("percent", 9))


LOCKS = "SELECT doc_id // 20 AS ino, doc_id AS owner, (doc_id * 7919) % 100 AS start, (doc_id * 7919) % 100 + 15 AS \"end\", CASE WHEN doc_id % 3 = 0 THEN 'w' ELSE 'r' END AS typ FROM documents"


def locks(s) -> DataFrame:
    return s.documents.selectExpr("doc_id div 20 as ino", "doc_id as owner", "(doc_id * 7919) % 100 as start", "(doc_id * 7919) % 100 + 15 as end", "case when doc_id % 3 = 0 then 'w' else 'r' end as typ")


@query(f"WITH l AS ({LOCKS}) SELECT a.ino, a.owner, b.owner AS other FROM l a JOIN l b ON a.ino = b.ino AND a.owner < b.owner AND a.start <= b.\"end\" AND b.start <= a.\"end\" AND (a.typ = 'w' OR b.typ = 'w')", prelude=False)
def f5_f6_j15_lock_conflicts(s):
    return coalesce.conflicts(locks(s), 32)


@query(f"WITH l AS ({LOCKS}) SELECT 'held' AS what, ino, owner, start, \"end\", typ FROM l WHERE owner % 2 = 0 UNION ALL SELECT 'refused', ino, owner, start, \"end\", typ FROM l a WHERE owner % 2 = 1 AND EXISTS (SELECT 1 FROM l b WHERE b.owner % 2 = 0 AND a.ino = b.ino AND a.start <= b.\"end\" AND b.start <= a.\"end\" AND (a.typ = 'w' OR b.typ = 'w')) UNION ALL SELECT 'held', ino, owner, start, \"end\", typ FROM l a WHERE owner % 2 = 1 AND NOT EXISTS (SELECT 1 FROM l b WHERE b.owner % 2 = 0 AND a.ino = b.ino AND a.start <= b.\"end\" AND b.start <= a.\"end\" AND (a.typ = 'w' OR b.typ = 'w'))", prelude=False)
def d30_setlk(s):
    """Owners with even numbers hold their locks, those with odd ones ask for theirs: all of the lock table."""
    even = F.col("owner") % 2 == 0
    held, refused = coalesce.set_locks(locks(s).where(even), locks(s).where(~even), 32)
    return held.select(F.lit("held").alias("what"), "*").unionByName(refused.select(F.lit("refused").alias("what"), "*"))


@query()
def d25_statfs(s):
    """The storage of the shared folder: whether there is any, and what is used is not more."""
    return tables.statfs(s.spark, shared_dir(s.spark)).select(((F.col("capacity") > 0) & (F.col("used") <= F.col("capacity")) & (F.col("available") >= 0)).alias("has_room"))


@query("SELECT ino, CASE WHEN uid = 1002 THEN (perm // 64) & 6 = 6 WHEN gid IN (100, 102) THEN (perm // 8) & 6 = 6 ELSE perm & 6 = 6 END AS granted FROM inodes")
def f8_access(s):
    return s.inodes.select("ino", scalars.access_granted(1002, 100, (102,), 6).alias("granted"))


@query("SELECT ino FROM inodes WHERE flags & 1 = 0 AND flags & 2 = 0")
def f9_f10_writable_visible(s):
    return s.inodes.where(scalars.writable() & scalars.visible(False)).select("ino")


@query("SELECT parent, name FROM dirents WHERE ino NOT IN (SELECT ino FROM inodes WHERE flags & 2 = 2)")
def f11_vault_gate(s):
    hidden = s.inodes.where(~scalars.visible(False)).select("ino")
    return s.dirents.join(hidden, "ino", "left_anti").select("parent", "name")


@query("SELECT ino FROM inodes WHERE kind = 2 AND ino NOT IN (SELECT parent FROM dirents WHERE kind <> 1 OR ino IN (SELECT ino FROM inodes WHERE flags = 0))")
def f14_empty_directories(s):
    shown = s.dirents.where("kind <> 1").unionByName(s.dirents.where("kind = 1").join(s.inodes.where("flags = 0").select("ino"), "ino", "left_semi").select(*s.dirents.columns))
    return s.inodes.where(F.col("kind") == KIND_DIR).select("ino").join(shown.select(F.col("parent").alias("ino")), "ino", "left_anti")


# Joins and aggregates ----------------------------------------------------------------------------


@query("SELECT DISTINCT hash FROM extents WHERE hash NOT IN (SELECT hash FROM chunks WHERE pack_id <= 12)")
def j1_dedup_probe(s):
    return dedup.new_hashes(s.extents, s.chunks.where("pack_id <= 12")).select("hash")


WRITES_SQL = f""", w AS (SELECT doc_id, {FILE0} + doc_id AS ino, 1000 AS off FROM documents),
touched AS (SELECT ino, unnest([0, 1]) AS block_idx FROM w),
old AS (SELECT t.ino, t.block_idx, e.hash AS old_hash, {HEXPAD.format("coalesce(CASE WHEN e.hash IS NULL THEN '' ELSE substr(r.h, CAST(t.block_idx * 2048 + 1 AS BIGINT), 2048) END, '')")} AS h
  FROM touched t LEFT JOIN extents e ON e.ino = t.ino AND e.block_idx = t.block_idx LEFT JOIN raw r ON r.ino = t.ino),
neu AS (SELECT ino, block_idx, old_hash, md5(unhex(CASE block_idx WHEN 0 THEN substr(h, 1, 2000) || repeat('51', 24) ELSE repeat('51', 26) || substr(h, 53) END)) AS hash FROM old)"""


def fifty_bytes(s) -> DataFrame:
    """A write of 50 bytes to each file, across the border of its first two blocks."""
    return s.documents.select(F.col("doc_id").alias("seq"), (F.col("doc_id") + FILE0).alias("ino"), F.lit(1000).cast("bigint").alias("offset"), F.lit(b"Q" * 50).alias("data"))


def stored_blocks(s) -> DataFrame:
    return s.blocks.select("ino", "block_idx", F.md5("data").alias("hash"), "data")


@query(WRITES_SQL + " SELECT ino, block_idx, old_hash, hash FROM neu")
def j2_patch_blocks(s):
    return blocks.patch_blocks(fifty_bytes(s), stored_blocks(s), BLOCK).select("ino", "block_idx", "old_hash", "hash")


DELTA_SQL = WRITES_SQL + """, dl AS (SELECT hash, CAST(sum(d) AS BIGINT) AS delta FROM (SELECT hash, 1 AS d FROM neu WHERE old_hash IS DISTINCT FROM hash UNION ALL SELECT old_hash, -1 FROM neu WHERE old_hash IS DISTINCT FROM hash AND old_hash IS NOT NULL) GROUP BY hash HAVING sum(d) <> 0)"""


@query(DELTA_SQL + " SELECT hash, delta FROM dl")
def a1_net_deltas(s):
    return dedup.net_deltas(blocks.patch_blocks(fifty_bytes(s), stored_blocks(s), BLOCK))


@query(DELTA_SQL + " SELECT coalesce(c.hash, dl.hash) AS hash, greatest(coalesce(refcount, 0) + coalesce(delta, 0), 0) AS refcount FROM chunks c FULL JOIN dl ON dl.hash = c.hash WHERE refcount IS NOT NULL OR delta > 0")
def a2_apply_deltas(s):
    deltas = dedup.net_deltas(blocks.patch_blocks(fifty_bytes(s), stored_blocks(s), BLOCK))
    return dedup.apply_deltas(s.chunks.select("hash", "refcount"), deltas)


@query("SELECT c.hash, CAST(refcount + coalesce(n, 0) AS BIGINT) AS refcount FROM chunks c LEFT JOIN (SELECT hash, count(*) AS n FROM extents GROUP BY hash) e ON e.hash = c.hash")
def a3_apply_strict(s):
    added = snapshots.added_refs(s.extents.join(s.chunks.select("hash"), "hash", "left_semi"))
    return dedup.apply_deltas_strict(s.chunks.select("hash", "refcount"), added)


@query("SELECT c.hash, CAST(greatest(refcount - coalesce(n, 0), 0) AS BIGINT) AS refcount FROM chunks c LEFT JOIN (SELECT hash, count(*) AS n FROM extents GROUP BY hash) e ON e.hash = c.hash")
def a4_decrement(s):
    return dedup.apply_deltas(s.chunks.select("hash", "refcount"), dedup.decrements(s.extents))


@query("SELECT e.ino, e.block_idx, c.pack_id, c.clen FROM extents e JOIN chunks c ON c.hash = e.hash")
def j3_chunk_lookup(s):
    return s.extents.join(s.chunks, "hash").select("ino", "block_idx", "pack_id", "clen")


@query("SELECT e.ino, CAST(sum(c.clen) AS BIGINT) AS clen FROM extents e JOIN chunks c ON c.hash = e.hash GROUP BY e.ino")
def j4_checked_lookup(s):
    known = s.extents.where("hash not like '0f%'")
    return audit.readable(known, s.chunks).groupBy("ino").agg(F.sum("clen").alias("clen"))


@query('SELECT e.ino, e.block_idx, i.pack_id, max(i."offset") AS "offset" FROM extents e JOIN chunks c ON c.hash = e.hash JOIN pack_index i ON i.hash = c.hash AND i.pack_id = c.pack_id GROUP BY ALL')
def j5_read_plan(s):
    index = packs.last_entries(s.pack_index).select("pack_id", "hash", "offset")
    return s.extents.join(s.chunks.select("hash", "pack_id"), "hash").join(index, ["pack_id", "hash"]).select("ino", "block_idx", "pack_id", "offset")


@query("SELECT ino, count(*) AS blocks, CAST(sum(clen) AS BIGINT) AS clen FROM extents e JOIN chunks c ON c.hash = e.hash WHERE ino IN (SELECT ino FROM inodes WHERE kind = 1 AND size <= 4096) GROUP BY ino")
def j6_small_files(s):
    small = s.inodes.where(f"kind = 1 and size <= {4 * BLOCK}").select("ino")
    return s.extents.join(small, "ino", "left_semi").join(s.chunks.select("hash", "clen"), "hash").groupBy("ino").agg(F.count("*").alias("blocks"), F.sum("clen").alias("clen"))


@query("SELECT r.ino, o AS \"offset\", md5(unhex(CASE o WHEN 0 THEN h ELSE substr(h, 1801, 600) END)) AS digest FROM raw r JOIN inodes i ON i.ino = r.ino, (VALUES (CAST(0 AS BIGINT)), (CAST(900 AS BIGINT))) AS v(o)")
def j7_read_range(s):
    """Every file whole, and 300 bytes of each from byte 900."""
    wanted = s.files.selectExpr("ino", "inline(array(struct(0L as offset, n as length), struct(900L as offset, 300L as length)))")
    payloads = s.blocks.select(F.md5("data").alias("hash"), "data").dropDuplicates(["hash"])
    return reads.read_range(wanted, s.inodes, s.extents, payloads, BLOCK).select("ino", "offset", F.md5("data").alias("digest"))


@query("SELECT ino, block_idx FROM extents WHERE ino NOT IN (SELECT ino FROM inodes)")
def j8_orphan_extents(s):
    return audit.orphan_extents(s.extents, s.inodes).select("ino", "block_idx")


@query("SELECT DISTINCT hash FROM extents WHERE hash NOT IN (SELECT hash FROM chunks)")
def j9_missing_chunks(s):
    return audit.missing_chunks(s.extents, s.chunks)


@query("SELECT c.hash, refcount, coalesce(n, 0) AS refs FROM chunks c LEFT JOIN (SELECT hash, count(*) AS n FROM extents GROUP BY hash) e ON e.hash = c.hash WHERE coalesce(n, 0) <> refcount")
def j10_refcount_audit(s):
    return audit.refcount_mismatches(s.chunks, s.extents)


@query("SELECT parent, name, ino FROM dirents WHERE ino NOT IN (SELECT ino FROM inodes)")
def j12_orphan_dirents(s):
    return audit.orphan_dirents(s.dirents, s.inodes).select("parent", "name", "ino")


@query("SELECT '/' || lang || '/' || source || '/' || doc_id AS path, ino FROM f UNION ALL SELECT '/' || lang || '/./' || source || '/../nowhere', NULL FROM f")
def j14_resolve_paths(s):
    paths = s.files.selectExpr("'/' || lang || '/' || source || '/' || doc_id as path").unionByName(s.files.selectExpr("'/' || lang || '/./' || source || '/../nowhere' as path"))
    return namespace.resolve(s.dirents, paths, 1)


@query("SELECT hash, count(*) AS refs FROM extents GROUP BY hash")
def a5_refcounts(s):
    return dedup.refcounts(s.extents)


@query("SELECT CAST(sum(ulen) AS BIGINT) AS uncompressed, CAST(sum(clen) AS BIGINT) AS compressed FROM chunks")
def a6_stored_bytes(s):
    return audit.stored_bytes(s.chunks)


@query(SIZES_SQL + " SELECT scope, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM sizes GROUP BY scope")
def a7_a8_o8_logical_sizes(s):
    return scoped_sizes(s)


@query(STATS_SQL + " SELECT * FROM st")
def a9_stats(s):
    return all_stats(s)


@query(STATS_SQL + " SELECT greatest(0.0, 1 - CAST(compressed AS DOUBLE) / uncompressed) AS compression_savings, CAST(logical_bytes AS DOUBLE) / uncompressed AS dedup_ratio, logical_bytes - compressed AS disk_delta, orphan_extents = 0 AND missing_chunks = 0 AND refcount_mismatches = 0 AS consistent FROM st")
def a10_ratios(s):
    return stats.with_ratios(all_stats(s)).select("compression_savings", "dedup_ratio", "disk_delta", "consistent")


@query("SELECT coalesce(max(pack_id), 0) AS max_pack_id FROM chunks")
def a13_max_pack(s):
    return s.chunks.agg(F.coalesce(F.max("pack_id"), F.lit(0)).alias("max_pack_id"))


@query(WRITES_SQL + ", g AS (SELECT ino % 7 AS op, neu.hash, count(*) AS n, max(CASE WHEN c.hash IS NULL THEN 1 ELSE 0 END) AS miss FROM neu LEFT JOIN chunks c ON c.hash = neu.hash WHERE old_hash IS DISTINCT FROM neu.hash GROUP BY ALL) SELECT CAST(sum(n - miss) AS BIGINT) AS hits, CAST(sum(miss) AS BIGINT) AS misses FROM g")
def a14_a16_hits_and_misses(s):
    changed = blocks.patch_blocks(fifty_bytes(s), stored_blocks(s), BLOCK).where("not (old_hash <=> hash)").select((F.col("ino") % 7).alias("op"), "hash")
    return blocks.hits_and_misses(changed, s.chunks)


@query("SELECT user_id, count(*) AS events, CAST(sum(length(props)) AS DOUBLE) / greatest(epoch_us(max(ts)) / 1000000.0 - epoch_us(min(ts)) / 1000000.0, 0.001) AS bytes_per_s FROM events GROUP BY user_id", prelude=False)
def a15_throughput(s):
    ts = F.col("ts").cast("timestamp")
    span = (F.unix_micros(F.max(ts)) / 1e6) - (F.unix_micros(F.min(ts)) / 1e6)
    return tables.table(s.spark, s.sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("events"), (F.sum(F.length("props")).cast("double") / F.greatest(span, F.lit(0.001))).alias("bytes_per_s"))


@query("SELECT pack_id, CAST(sum(32 + clen) AS BIGINT) AS size, count(*) AS records FROM pack_index GROUP BY pack_id")
def a17_pack_sizes(s):
    return packs.pack_sizes(s.entries)


@query("SELECT parent AS ino, 2 + count(*) FILTER (kind = 2) AS nlink FROM dirents GROUP BY parent")
def a18_directory_links(s):
    return namespace.directory_links(s.dirents)


# Order, paging, sets -----------------------------------------------------------------------------

TURNS_SQL = """WITH t AS (SELECT conv_id % 4 AS lane, conv_id * 100 + turn AS seq, conv_id AS ino, CAST(octet_length(encode(text)) AS BIGINT) AS length, CAST(coalesce(sum(octet_length(encode(text))) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + CASE WHEN turn >= 3 THEN 5 ELSE 0 END AS BIGINT) AS "offset" FROM conversations)"""


def turns(s) -> DataFrame:
    """Conversations as writes: each turn appends; from the fourth on there is a hole of five bytes."""
    size = F.octet_length(F.encode("text", "UTF-8")).cast("bigint")
    before = F.sum(size).over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1))
    rows = tables.table(s.spark, s.sf_dir, "conversations")
    return rows.select((F.col("conv_id") % 4).alias("lane"), (F.col("conv_id") * 100 + F.col("turn")).alias("seq"), F.col("conv_id").alias("ino"), size.alias("length"), (F.coalesce(before, F.lit(0)) + F.when(F.col("turn") >= 3, 5).otherwise(0)).alias("offset"), F.encode("text", "UTF-8").alias("data"))


N1_SQL = TURNS_SQL + """, m AS (SELECT *, CASE WHEN lag(ino) OVER (PARTITION BY lane ORDER BY seq) = ino AND lag("offset" + length) OVER (PARTITION BY lane ORDER BY seq) = "offset" THEN 0 ELSE 1 END AS start FROM t),
g AS (SELECT *, sum(start) OVER (PARTITION BY lane ORDER BY seq) AS run FROM m)
SELECT lane, CAST(run AS BIGINT) AS run, any_value(ino) AS ino, min(seq) AS first_seq, min("offset") AS "offset", CAST(sum(length) AS BIGINT) AS length, count(*) AS ops FROM g GROUP BY lane, run"""


@query(N1_SQL, prelude=False)
def n1_f7_appended_runs(s):
    return coalesce.appended_runs(turns(s).drop("data"), "lane")


@query(N1_SQL.replace("CAST(run AS BIGINT) AS run, ", "").replace("min(seq) AS first_seq", "min(seq) AS seq"), prelude=False)
def n1_n2_coalesced(s):
    return coalesce.coalesced(turns(s), "lane").select("lane", "seq", "ino", "offset", F.octet_length("data").cast("bigint").alias("length"), "ops")


@query("WITH t AS (SELECT conv_id AS ino, string_agg(hex(encode(text)), '' ORDER BY turn) AS h FROM conversations GROUP BY conv_id), b AS (SELECT ino, h, unnest(range(0, (length(h) // 2 + 255) // 256)) AS block_idx FROM t) SELECT ino, block_idx, md5(unhex(rpad(substr(h, block_idx * 512 + 1, 512), 512, '0'))) AS hash FROM b", prelude=False)
def n2_last_writer(s):
    rows = turns(s).withColumn("offset", F.when(F.col("seq") % 100 >= 3, F.col("offset") - 5).otherwise(F.col("offset")))
    return coalesce.last_writer(rows.select("seq", "ino", "offset", "data"), 256)


@query("SELECT name, ino, (row_number() OVER (ORDER BY name) - 1) // 10 AS page FROM dirents WHERE parent = 1")
def n6_stable_paging(s):
    """Every page of ten entries of the root, from one frozen listing."""
    return numbered_pages(s.dirents.where("parent = 1").select("name", "ino"), ["name"], 10)


@query("SELECT name FROM snapshots")
def o1_m1_snapshot_names(s):
    return snapshots.names(s.snapshots)


@query("SELECT pack_id, hash, row_number() OVER (PARTITION BY pack_id ORDER BY hash) AS k FROM chunks")
def o2_rewrite_order(s):
    return s.chunks.select("pack_id", "hash", F.row_number().over(Window.partitionBy("pack_id").orderBy("hash")).alias("k"))


@query("SELECT ino, string_agg(DISTINCT name, chr(0) ORDER BY name) AS names FROM xattrs GROUP BY ino")
def o4_attribute_names(s):
    return namespace.attribute_names(s.xattrs)


@query("SELECT count(*) AS names, count(DISTINCT ino) AS inodes FROM dirents")
def o5_distinct_inodes(s):
    return namespace.link_counts(s.dirents).agg(F.sum("links").alias("names"), F.count("*").alias("inodes"))


# Trees and snapshots -----------------------------------------------------------------------------

TREE_SQL = ", tree AS (SELECT ino, kind, '/' || name AS path, 1 AS level FROM dirents WHERE parent = 1 UNION ALL SELECT d.ino, d.kind, t.path || '/' || d.name, t.level + 1 FROM tree t JOIN dirents d ON d.parent = t.ino WHERE t.kind = 2)"
CLONE_SQL = TREE_SQL + ", ids AS (SELECT path, ino, kind, split_part(path, '/', 2) AS head, 900000000 + row_number() OVER (ORDER BY path) - 1 AS new_ino FROM tree)"


def tree(s) -> DataFrame:
    return namespace.below(stored(s.dirents, "dirents"), 1)  # a table of its own, as in a store: each level reads it


def clone(s) -> DataFrame:
    return stored(snapshots.clone_ids(tree(s), 900_000_000))


@query(TREE_SQL + " SELECT ino, kind, path, level FROM tree")
def r5_paths(s):
    return tree(s)


@query(TREE_SQL + " SELECT ino, kind, path, level FROM tree")
def r5_paths_by_levels(s):
    root = s.spark.createDataFrame([(1, 1)], "root long, ino long")
    return namespace.descend(s.dirents, root).where("level > 0").select("ino", "kind", "path", "level")


@query(CLONE_SQL + " SELECT path, ino, new_ino FROM ids")
def r1_clone_ids(s):
    return clone(s).select("path", "ino", "new_ino")


@query(CLONE_SQL + " SELECT coalesce(p.new_ino, 2001) AS parent, split_part(i.path, '/', -1) AS name, i.new_ino AS ino, i.kind FROM ids i LEFT JOIN ids p ON p.kind = 2 AND p.path = substr(i.path, 1, length(i.path) - length(split_part(i.path, '/', -1)) - 1)")
def m2_snapshot_create(s):
    return snapshots.clone_dirents(clone(s), 2001)


@query(CLONE_SQL + " SELECT i.new_ino AS ino, block_idx, hash FROM extents e JOIN ids i ON i.ino = e.ino")
def r2_clone_extents(s):
    return snapshots.clone_rows(s.extents.select("ino", "block_idx", "hash"), clone(s))


@query(CLONE_SQL + " SELECT i.new_ino AS ino, name, value FROM xattrs x JOIN ids i ON i.ino = x.ino")
def r3_clone_attributes(s):
    return snapshots.clone_rows(s.xattrs, clone(s))


@query(CLONE_SQL + " SELECT hash, count(*) AS delta FROM extents e JOIN ids i ON i.ino = e.ino GROUP BY hash")
def m2_snapshot_refs(s):
    return snapshots.added_refs(snapshots.clone_rows(s.extents, clone(s)))


GONE_SQL = TREE_SQL + ", gone AS (SELECT DISTINCT ino FROM tree WHERE path LIKE '/de%')"


@query(GONE_SQL + " SELECT hash, CAST(-count(*) AS BIGINT) AS delta FROM extents WHERE ino IN (SELECT ino FROM gone) GROUP BY hash")
def r4_m3_deleted_refs(s):
    gone = tree(s).where("path like '/de%'")
    return dedup.decrements(s.extents.join(gone.select("ino").distinct(), "ino", "left_semi"))


@query(GONE_SQL + " SELECT ino FROM inodes WHERE ino NOT IN (SELECT ino FROM gone)")
def r4_m3_delete_tree(s):
    return snapshots.without_tree(s.inodes, tree(s).where("path like '/de%'")).select("ino")


# Changes of the namespace ------------------------------------------------------------------------


@query("SELECT f.ino, size, perm, mtime FROM f JOIN inodes i ON i.ino = f.ino")
def d1_d2_lookup(s):
    names = s.files.select(F.col("doc_id").cast("string").alias("name"))
    return s.dirents.join(names, "name").join(s.inodes, "ino").select("ino", "size", "perm", "mtime")


@query("SELECT ino, CASE WHEN kind = 1 AND uid = 1001 THEN 448 ELSE perm END AS perm, CASE WHEN kind = 1 AND uid = 1001 THEN 1800000000 ELSE mtime END AS mtime FROM inodes")
def d3_setattr(s):
    own = s.inodes.where("kind = 1 and uid = 1001").selectExpr("ino", "448 as perm", "cast(null as bigint) as uid", "cast(null as bigint) as gid", "1800000000L as mtime")
    return dml.set_attributes(s.inodes, own).select("ino", "perm", "mtime")


@query("SELECT ino, target FROM symlinks")
def d4_readlink(s):
    return s.symlinks.join(s.inodes.where("kind = 3").select("ino"), "ino", "left_semi")


@query("SELECT count(*) AS inodes, CAST(sum(nlink) AS BIGINT) AS links, max(mtime) AS newest, (SELECT count(*) + 3 FROM dirents) AS names FROM (SELECT nlink + CASE WHEN ino = 1 THEN 2 ELSE 0 END AS nlink, CASE WHEN ino = 1 THEN 1900000000 ELSE mtime END AS mtime FROM inodes UNION ALL SELECT 2, 1900000000 FROM range(2) UNION ALL SELECT 1, 1900000000 FROM range(1))")
def d5_d8_create(s):
    new = s.spark.createDataFrame([(1, "new-a", 77_000_001, 2, 493, 0, 0), (1, "new-b", 77_000_002, 2, 493, 0, 0), (1, "new-c", 77_000_003, 1, 420, 0, 0)], "parent long, name string, ino long, kind int, perm int, uid long, gid long")
    done = dml.create(s.tables, new, 1_900_000_000)
    return done.inodes.agg(F.count("*").alias("inodes"), F.sum("nlink").alias("links"), F.max("mtime").alias("newest")).crossJoin(F.broadcast(done.dirents.agg(F.count("*").alias("names"))))


UNLINK_SQL = ", gone AS (SELECT f.ino FROM f LEFT JOIN inodes i ON i.ino = f.ino WHERE coalesce(flags, 0) & 1 = 0), dead AS (SELECT i.ino FROM inodes i JOIN gone ON gone.ino = i.ino WHERE nlink = 1)"


def unlink_names(s) -> DataFrame:
    """The name under /lang/source of every file that isn't read-only."""
    names = s.files.join(s.srcs.withColumnRenamed("ino", "parent"), ["lang", "source"]).select(F.col("parent").cast("bigint").alias("parent"), F.col("doc_id").cast("string").alias("name"), "ino")
    return names.join(s.inodes.where(~scalars.writable()).select("ino"), "ino", "left_anti")


def unlinked(s):
    return dml.unlink(s.tables, unlink_names(s))


@query(UNLINK_SQL + " SELECT i.ino, CAST(nlink - CASE WHEN gone.ino IS NULL THEN 0 ELSE 1 END AS BIGINT) AS nlink FROM inodes i LEFT JOIN gone ON gone.ino = i.ino WHERE i.ino NOT IN (SELECT ino FROM dead)")
def d9_d11_unlink(s):
    return unlinked(s).inodes.select("ino", "nlink")


@query(UNLINK_SQL + " SELECT hash, CAST(-count(*) AS BIGINT) AS delta FROM extents WHERE ino IN (SELECT ino FROM dead) GROUP BY hash")
def d10_d12_drop_payload(s):
    return unlinked(s).deltas


@query("SELECT count(*) AS names, (SELECT CAST(sum(nlink) AS BIGINT) FROM inodes) AS links, (SELECT count(*) FROM inodes) AS inodes FROM dirents")
def d13_rmdir(s):
    """A directory is made and removed."""
    new = s.spark.createDataFrame([(1, "hollow", 78_000_001, 2, 493, 0, 0)], "parent long, name string, ino long, kind int, perm int, uid long, gid long")
    done = dml.rmdir(dml.create(s.tables, new, 5).stored(), new, 6).stored()
    return done.dirents.agg(F.count("*").alias("names")).crossJoin(F.broadcast(done.inodes.agg(F.sum("nlink").alias("links"), F.count("*").alias("inodes"))))


@query("SELECT ino, kind, size FROM inodes UNION ALL SELECT 30000000 + doc_id, 3, 8 + octet_length(encode(CAST(doc_id AS VARCHAR))) FROM documents")
def d14_symlink(s):
    new = s.documents.selectExpr("1L as parent", "'to-' || doc_id as name", "30000000 + doc_id as ino", "'target: ' || doc_id as target")
    return dml.symlink(s.tables, new, 5).inodes.select("ino", "kind", "size")


@query("SELECT parent, CASE WHEN parent = 1 AND name = 'de' THEN 'deutsch' ELSE name END AS name, ino FROM dirents")
def d15_rename(s):
    return dml.rename(s.tables, (1, "de"), (1, "deutsch"), 7).dirents.select("parent", "name", "ino")


@query("""SELECT 'name' AS what, parent AS n, name, ino FROM dirents WHERE NOT (parent = 1 AND name IN ('link-50', 'link-100', 'link-150', 'sym-67'))
UNION ALL SELECT * FROM (VALUES ('name', 1, 'link-100', 1000050), ('name', 1, 'sym-67', 1000150))
UNION ALL SELECT 'links', CASE WHEN ino = 1000100 THEN nlink - 1 ELSE nlink END, '', ino FROM inodes WHERE ino <> 20000067 UNION ALL SELECT 'target', 0, target, ino FROM symlinks WHERE ino <> 20000067""")
def d15_replace(s):
    """Renames over a file that has another name, and over a symbolic link that has none."""
    first = dml.rename(s.tables.stored(), (1, "link-50"), (1, "link-100"), 7).stored()
    done = dml.rename(first, (1, "link-150"), (1, "sym-67"), 7).stored()
    names = done.dirents.selectExpr("'name' as what", "parent as n", "name", "ino")
    return names.unionByName(done.inodes.selectExpr("'links' as what", "nlink as n", "'' as name", "ino")).unionByName(done.symlinks.selectExpr("'target' as what", "0L as n", "target as name", "ino"))


@query("SELECT parent, CASE WHEN parent = 1 AND name = 'de' THEN 'en' WHEN parent = 1 AND name = 'en' THEN 'de' ELSE name END AS name, ino FROM dirents")
def d15_exchange(s):
    return dml.exchange(s.tables, (1, "de"), (1, "en"), 7).dirents.select("parent", "name", "ino")


@query("SELECT ino, nlink + CASE WHEN kind = 1 AND flags & 1 = 0 THEN 1 ELSE 0 END AS nlink FROM inodes")
def d16_link(s):
    """Another name for every file that isn't read-only."""
    new = s.inodes.where(scalars.writable() & (F.col("kind") == 1)).selectExpr("1L as parent", "'again-' || ino as name", "ino")
    return dml.link(s.tables, new).inodes.select("ino", "nlink")


@query("SELECT ino, name, CASE WHEN name = 'user.lang' THEN upper(value) ELSE value END AS value FROM xattrs")
def d26_setxattr(s):
    return dml.set_xattr(s.xattrs, s.xattrs.where("name = 'user.lang'").withColumn("value", F.upper("value")), "replace")


@query("SELECT ino, value AS lang FROM xattrs WHERE name = 'user.lang'")
def d27_getxattr(s):
    return namespace.attribute_map(s.xattrs).select("ino", F.element_at("attrs", "user.lang").alias("lang"))


@query("SELECT ino, name FROM xattrs WHERE name <> 'user.source'")
def d28_removexattr(s):
    return dml.remove_xattr(s.xattrs, s.xattrs.where("name = 'user.source'")).select("ino", "name")


@query("SELECT ino, CASE WHEN uid = 1003 THEN (perm // 64) & 4 = 4 WHEN gid = 999 THEN (perm // 8) & 4 = 4 ELSE perm & 4 = 4 END AS readable FROM inodes")
def d29_access(s):
    granted = scalars.access_granted(1003, 999, (), 4)
    return s.inodes.select("ino", granted.alias("readable"))


@query(f"SELECT e.ino, e.block_idx, e.hash AS old_hash, CASE WHEN e.block_idx = 0 THEN md5(unhex({HEXPAD.format('substr(h, 1, 1400)')})) END AS hash FROM extents e JOIN raw ON raw.ino = e.ino JOIN inodes i ON i.ino = e.ino WHERE i.size > 700")
def d32_truncate(s):
    new = s.files.select("ino", F.lit(700).cast("bigint").alias("new_size"))
    payloads = s.blocks.select(F.md5("data").alias("hash"), "data").dropDuplicates(["hash"])
    return reads.truncate(s.inodes, s.extents.select("ino", "block_idx", "hash"), payloads, new, BLOCK)


@query(UNLINK_SQL + """, cut AS (SELECT ino FROM inodes WHERE kind = 1 AND flags & 1 = 0 AND uid <> 1001 AND ino NOT IN (SELECT ino FROM dead))
SELECT 'size' AS what, CAST(ino AS VARCHAR) AS name, CASE WHEN ino IN (SELECT ino FROM cut) THEN 0 ELSE size END AS n FROM inodes WHERE ino NOT IN (SELECT ino FROM dead)
UNION ALL SELECT 'delta', hash, CAST(-count(*) AS BIGINT) FROM extents WHERE ino IN (SELECT ino FROM dead UNION ALL SELECT ino FROM cut) GROUP BY hash""")
def d17_d20_open_release(s):
    """Every file is opened, those of one owner and read-only ones untruncated, unlinked while open, and closed."""
    files = s.inodes.where("kind = 1")
    new = files.select(F.col("ino").alias("fh"), "ino", (scalars.writable() & (F.col("uid") != 1001)).alias("truncate"))
    t, held = handles.opened(s.tables, new.select("fh", "ino").limit(0), new)
    t = dml.unlink(t, unlink_names(s), held.select("ino"))
    t, held = handles.released(t, held, new.select("fh"))
    rows = t.inodes.selectExpr("'size' as what", "cast(ino as string) as name", "size as n")
    return rows.unionByName(t.deltas.selectExpr("'delta' as what", "hash as name", "delta as n"))


@query("SELECT count(*) AS files, true AS modes FROM (SELECT DISTINCT pack_id FROM pack_index)")
def m14_permissions(s):
    """The folder of the pack files: how many files, and whether all modes are as they must be."""
    found = permissions.normalize_tree(s.spark, written_packs(s))
    packs_ = [mode for path, folder, mode in found if not folder and path.endswith(".vpk")]
    good = all(mode == (permissions.DIR_MODE if folder else permissions.FILE_MODE) for _, folder, mode in found)
    return s.spark.createDataFrame([(len(packs_), good)], "files long, modes boolean")


@query("""SELECT ino, CASE WHEN n = 0 THEN 'batch_max_size_mb' WHEN ino % 41 > 29 THEN 'zstd_compression_level' WHEN n > 4096 THEN 'ultracdc' WHEN ino % 150 > 100 THEN 'gc_pack_rewrite_min_reclaim_percent' ELSE '' END AS refused FROM f""")
def f13_settings(s):
    """A settings file for each document, with values from its number and size: the first setting that is refused."""
    text = F.concat_ws("\n", F.format_string("batch_max_size_mb = %d", "n"), F.format_string("zstd_compression_level = %d", F.col("ino") % 41 - 7), F.format_string("ultracdc_min_size_bytes = %d\nultracdc_avg_size_bytes = 4096\nultracdc_max_size_bytes = 8192", F.greatest("n", F.lit(1))), F.format_string("gc_pack_rewrite_min_reclaim_percent = %d", F.col("ino") % 150))

    def check(batches):
        for pdf in batches:
            pdf["refused"] = [refused_setting(t) for t in pdf.pop("text")]
            yield pdf

    return s.files.select("ino", text.alias("text")).mapInPandas(check, "ino long, refused string")


@query("SELECT * FROM (VALUES ('inodes', 2), ('dirents', 1), ('extents', 0), ('chunks', 0), ('sys', 5)) AS t(name, n)", prelude=False)
def m10_bootstrap(s):
    made = bootstrap.bootstrap(s.spark, 0)
    parts = [made[n].agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n in ("inodes", "dirents", "extents", "chunks", "sys")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# Plans -------------------------------------------------------------------------------------------


K13_SQL = DELTA_SQL + """
SELECT 'extent' AS what, ino || ':' || block_idx AS name, hash AS value FROM neu
UNION ALL SELECT 'extent', e.ino || ':' || e.block_idx, e.hash FROM extents e LEFT JOIN neu ON neu.ino = e.ino AND neu.block_idx = e.block_idx WHERE neu.ino IS NULL
UNION ALL SELECT 'size', CAST(i.ino AS VARCHAR), CAST(CASE WHEN w.ino IS NULL THEN size ELSE greatest(size, 1050) END AS VARCHAR) FROM inodes i LEFT JOIN w ON w.ino = i.ino
UNION ALL SELECT 'count', coalesce(c.hash, dl.hash), CAST(greatest(coalesce(refcount, 0) + coalesce(delta, 0), 0) AS VARCHAR) FROM chunks c FULL JOIN dl ON dl.hash = c.hash WHERE refcount IS NOT NULL OR delta > 0
UNION ALL SELECT DISTINCT 'packed', hash, 'in place' FROM neu WHERE old_hash IS DISTINCT FROM hash AND hash NOT IN (SELECT hash FROM chunks)"""


@query(K13_SQL)
def k13_t13_commit_writes(s):
    """Extents, sizes, counts and packed chunks after the writes; a chunk is in place if it begins where the one before it in its pack ends and the pack keeps its limit."""
    done = write_path.commit_writes(fifty_bytes(s), s.inodes, s.extents, s.chunks, s.payloads, BLOCK, 20_000)
    end = F.col("offset") + 32 + F.col("clen")
    before = F.coalesce(F.lag(end).over(Window.partitionBy("writer", "pack_no").orderBy("offset")), F.lit(0))
    placed = done.new_chunks.withColumn("ok", (F.col("offset") == before) & (end <= 20_000) & (F.col("clen") == F.octet_length("payload")) & (F.col("ulen") == BLOCK))
    rows = [
        done.extents.selectExpr("'extent' as what", "ino || ':' || block_idx as name", "hash as value"),
        done.inodes.selectExpr("'size' as what", "cast(ino as string) as name", "cast(size as string) as value"),
        done.chunks.selectExpr("'count' as what", "hash as name", "cast(refcount as string) as value"),
        placed.selectExpr("'packed' as what", "hash as name", "case when ok then 'in place' else 'elsewhere' end as value"),
    ]
    return reduce(DataFrame.unionByName, rows)


REPACK_SQL = FOLD_SQL.replace("substr(hash, 1, 1)", "pack_id").replace("20000", "50000")


@query(REPACK_SQL + ' SELECT hash, writer AS old_pack_id, pack_no, "offset" FROM fold')
def m8_repack(s):
    return repack.repack(s.chunks, 50_000).select("hash", "old_pack_id", "pack_no", "offset")


@query("SELECT count(*) AS blocks, count(DISTINCT hash) AS distinct_blocks, CAST(sum(used) AS BIGINT) AS logical_bytes, count(DISTINCT hash) * 1024 AS stored_bytes, count(*) / count(DISTINCT hash) AS dedup_ratio FROM extents")
def flagship(s):
    """Block deduplication of all documents: the flagship."""
    return dedup.dedup_stats(s.extents, BLOCK)


# Streams -----------------------------------------------------------------------------------------

STREAM_SQL = TURNS_SQL + ' SELECT ino, count(*) AS ops, CAST(max("offset" + length) AS BIGINT) AS size FROM t GROUP BY ino'


def op_files(s) -> tuple[str, str]:
    """The operations as files, in arrival order, and a folder for the stream's own state."""
    root = shared_folder(s.spark)
    turns(s).select("seq", "ino", F.col("offset").cast("bigint").alias("offset"), "length").repartitionByRange(4, "seq").write.parquet(root + "/ops")
    return root + "/ops", root


@query(STREAM_SQL, prelude=False)
def t1_t6_micro_batches(s):
    """foreachBatch: each batch's totals are published under its id; repeats overwrite."""
    ops, root = op_files(s)

    def apply(batch: DataFrame, batch_id: int) -> None:
        writes.totals(batch).withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{root}/applied/{batch_id}")

    writes.drain(writes.batcher(writes.read_ops(s.spark, ops, 1), apply, root + "/state"))
    done = s.spark.read.option("recursiveFileLookup", True).schema("ino long, ops long, size long, batch int").parquet(root + "/applied")
    return done.groupBy("ino").agg(F.sum("ops").alias("ops"), F.max("size").alias("size"))


@query(STREAM_SQL.replace("count(*) AS ops", "count(*) AS version"), prelude=False)
def t12_versions(s):
    """Stateful: version and size of each inode, the last update of each."""
    ops, root = op_files(s)

    def apply(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{root}/updates/{batch_id}")

    stream = writes.versions(writes.read_ops(s.spark, ops, 1))
    writes.drain(stream.writeStream.outputMode("update").foreachBatch(apply).option("checkpointLocation", root + "/state").trigger(availableNow=True))
    updates = s.spark.read.option("recursiveFileLookup", True).schema("ino long, version long, size long, batch int").parquet(root + "/updates")
    return updates.groupBy("ino").agg(F.max("version").alias("version"), F.max("size").alias("size"))

@query(STREAM_SQL, prelude=False)
def t2_t3_t4_t5_write_service(s):
    """Operations put in by halves, one waited for; shutting down applies the other.  The second service goes on where the first ended."""
    root = shared_folder(s.spark)

    def apply(batch: DataFrame, batch_id: int) -> None:
        writes.totals(batch).withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{root}/applied/{batch_id}")

    ops = turns(s).select("seq", "ino", F.col("offset").cast("bigint").alias("offset"), "length")
    service = lambda: writes.WriteService(s.spark, root + "/ops", root + "/state", apply)
    first = service()
    first.enqueue_and_wait(ops.where("seq % 2 = 0"))
    first.shutdown()
    second = service()
    second.enqueue(ops.where("seq % 2 = 1"))
    second.shutdown()
    done = s.spark.read.option("recursiveFileLookup", True).schema("ino long, ops long, size long, batch int").parquet(root + "/applied")
    return done.groupBy("ino").agg(F.sum("ops").alias("ops"), F.max("size").alias("size"))


COLLECT_SQL = DEAD_SQL.replace("(SELECT pack_id, arg_max(bytes, epoch) AS bytes FROM discards GROUP BY pack_id, hash)", "(SELECT pack_id, clen AS bytes FROM chunks WHERE refcount = 0)") + """, worth AS (SELECT pack_id FROM pd WHERE pack_id <> 24 AND (dead >= 9000 OR percent >= 9))
SELECT 'chunks' AS what, pack_id, count(*) AS n FROM chunks WHERE refcount > 0 GROUP BY pack_id
UNION ALL SELECT 'discards', pack_id, count(*) FROM (SELECT pack_id FROM discards UNION ALL SELECT pack_id FROM chunks WHERE refcount = 0) WHERE pack_id NOT IN (SELECT pack_id FROM worth) GROUP BY pack_id
UNION ALL SELECT 'index', i.pack_id, count(DISTINCT CASE WHEN w.pack_id IS NULL THEN i.hash || i.seq ELSE i.hash END) FROM pack_index i LEFT JOIN worth w ON w.pack_id = i.pack_id LEFT JOIN chunks c ON c.hash = i.hash AND c.pack_id = i.pack_id AND c.refcount > 0 WHERE w.pack_id IS NULL OR c.hash IS NOT NULL GROUP BY i.pack_id
UNION ALL SELECT 'phase', 0, 0"""


def pack_counts(store: collection.Collection) -> DataFrame:
    """(what, pack_id, n): rows of each pack in the store's tables."""
    counts = [store.table(n).groupBy("pack_id").agg(F.count("*").alias("n")).select(F.lit(n).alias("what"), F.col("pack_id").cast("long").alias("pack_id"), "n") for n in collection.TABLES]
    return reduce(DataFrame.unionByName, counts)


def collected(s, packs_at_once: int | None, batch: int) -> DataFrame:
    """Rows of each pack after a whole collection: scans from an empty cursor to the end, then rewriting until nothing qualifies.

    Each cycle is a commit, and a new object goes on from the last one.
    """
    own = Settings(gc_pack_rewrite_min_reclaim_bytes=9000, gc_pack_rewrite_min_reclaim_percent=9.0)
    root = shared_folder(s.spark)
    again = lambda: collection.Collection(s.spark, root, PACKS, own, batch, packs_at_once)
    again().start(s.chunks, s.discards, s.pack_index.select("pack_id", "hash", "offset", "codec", "ulen", "clen"))
    while again().step() != "done":
        pass
    last = again()
    phase = s.spark.createDataFrame([("phase", 0, int(last.state()["gc.phase"]))], "what string, pack_id long, n long")
    return pack_counts(last).unionByName(phase)


@query(COLLECT_SQL)
def t9_t10_t11_incremental_collection(s):
    """Some packs a cycle, in pages of a third of the keys or so."""
    return collected(s, 8, 1 + s.chunks.count() // 3)


@query(COLLECT_SQL)
def t14_collect_until_stable(s):
    """The offline form: all packs that qualify at once."""
    return collected(s, None, 1 << 30)


@query(COLLECT_SQL + " UNION ALL SELECT 'reads', 0, 7")
def t7_t8_f12_d21_sync(s):
    """Sync cycles until collection is done: none collects while the store is busy or in a full sync; counters are kept."""
    own = Settings(gc_pack_rewrite_min_reclaim_bytes=9000, gc_pack_rewrite_min_reclaim_percent=9.0)
    store = collection.Collection(s.spark, shared_folder(s.spark), PACKS, own, 1 << 30, None)
    store.start(s.chunks, s.discards, s.pack_index.select("pack_id", "hash", "offset", "codec", "ulen", "clen"))
    service = sync.SyncService(store)
    service.counters["reads"], service.idle = 7, False
    before = store.state()["gc.epoch"]
    if service.cycle(full=False) != "busy" or service.fsync() != "synced" or store.state()["gc.epoch"] != before:
        raise AssertionError("collected out of turn")
    service.idle = True
    while service.cycle(full=False) != "done":
        pass
    service.shutdown()
    state = store.state()
    kept = s.spark.createDataFrame([("phase", 0, int(state["gc.phase"])), ("reads", 0, int(state["counter.reads"]))], "what string, pack_id long, n long")
    return pack_counts(store).unionByName(kept)


SESSION_SQL = TREE_SQL + """, k AS (SELECT count(*) AS n FROM tree t JOIN inodes i ON i.ino = t.ino)
SELECT * FROM (VALUES (0, true, '', ''), (1, true, 'monday', ''), (2, false, '', 'exists'), (3, false, '', 'invalid'), (4, true, 'monday', ''), (5, true, '', ''), (6, false, '', 'missing'), (7, true, '', ''), (8, false, '', 'invalid'), (9, false, '', 'invalid')) AS t(pos, ok, names, error)
UNION ALL SELECT 10, true, CAST((SELECT count(*) + 1 FROM inodes) + n + 1 AS VARCHAR), 'inodes with a snapshot' FROM k
UNION ALL SELECT 11, true, CAST(count(*) + 1 AS VARCHAR), 'inodes without it' FROM inodes
UNION ALL SELECT 12, true, CAST(sum(refcount) AS VARCHAR), 'references' FROM chunks"""


def new_session(s) -> session.Session:
    """A session over the store, with an empty folder of snapshots."""
    new = s.spark.createDataFrame([(1, ".snapshots", SNAPSHOTS_INO, KIND_DIR, 493, 0, 0)], "parent long, name string, ino long, kind int, perm int, uid long, gid long")
    return session.Session(dml.create(s.tables, new, 5).stored(), stored(s.chunks), s.snapshots.limit(0))


@query(SESSION_SQL)
def m11_m12_control(s):
    """A dialogue of the control protocol over the whole store: responses, and what a snapshot adds and its deletion takes away."""
    own = new_session(s)
    control, inodes = Control(own.operations()), []
    lines = ['{"op": "snapshot_create", "name": "monday"}', '{"op": "snapshot_list"}', '{"op": "snapshot_create", "name": "monday"}', '{"op": "snapshot_create", "name": "a/b"}', '{"op": "snapshot_list"}', '{"op": "snapshot_delete", "name": "monday"}', '{"op": "snapshot_delete", "name": "monday"}', '{"op": "snapshot_list"}', '{"op": "snapshot_create"}', "no JSON"]
    kinds = {"EEXIST": "exists", "EINVAL": "invalid", "invalid": "invalid", "ENOENT": "missing"}
    out = []
    for pos, answer in enumerate(map(json.loads, control.serve(lines))):
        error = next((v for k, v in kinds.items() if k in answer["error"]), answer["error"])
        out.append((pos, answer["ok"], ",".join(answer["names"]), error))
        inodes.append(own.tables.inodes)
    counts = [(10, True, str(inodes[4].count()), "inodes with a snapshot"), (11, True, str(inodes[-1].count()), "inodes without it"), (12, True, str(own.chunks.agg(F.sum("refcount")).first()[0]), "references")]
    return s.spark.createDataFrame(out + counts, "pos int, ok boolean, names string, error string")
