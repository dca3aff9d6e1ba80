"""The store's logical tables, derived from the driver's tables.

Documents are files under /lang/source/doc_id, pages are unreferenced blobs, all whole.  A few
deterministic faults (lost inodes, lost chunks, wrong counts) give audits something to find.
SQL has the same tables for the oracle: ``WITH`` + PRELUDE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.blocks import split_blocks
from ..operators.dml import Tables
from .tables import table

#: Block size for the driver's texts, which are far below the default of 1 MiB.
BLOCK = 1024
FILE0, LINK0 = 1_000_000, 20_000_000
PACKS = 24

PRELUDE = f"""
f AS (SELECT doc_id, {FILE0} + doc_id AS ino, text, lang, source, octet_length(encode(text)) AS n FROM documents),
langs AS (SELECT lang, 10 + row_number() OVER (ORDER BY lang) AS ino FROM (SELECT DISTINCT lang FROM documents)),
srcs AS (SELECT lang, source, 1000 + row_number() OVER (ORDER BY lang, source) AS ino FROM (SELECT DISTINCT lang, source FROM documents)),
inodes AS (
  SELECT 1 AS ino, 2 AS kind, 493 AS perm, 0 AS uid, 0 AS gid, CAST(2 + (SELECT count(*) FROM langs) AS BIGINT) AS nlink, CAST(0 AS BIGINT) AS size, CAST(1700000000 AS BIGINT) AS mtime, 0 AS flags
  UNION ALL SELECT ino, 2, 493, 0, 0, 2 + (SELECT count(*) FROM srcs WHERE srcs.lang = langs.lang), 0, 1700000001, 0 FROM langs
  UNION ALL SELECT ino, 2, 493, 0, 0, 2, 0, 1700000002, CASE WHEN source = 'src7' THEN 2 ELSE 0 END FROM srcs
  UNION ALL SELECT ino, 1, CASE doc_id % 4 WHEN 0 THEN 420 WHEN 1 THEN 416 WHEN 2 THEN 384 ELSE 292 END, 1000 + doc_id % 5, 100 + doc_id % 3, CASE WHEN doc_id % 50 = 0 THEN 2 ELSE 1 END, n, 1700000000 + doc_id * 37,
    CASE WHEN doc_id % 11 = 0 THEN 1 ELSE 0 END + CASE WHEN source = 'src7' THEN 2 ELSE 0 END FROM f WHERE doc_id % 97 <> 13
  UNION ALL SELECT {LINK0} + doc_id, 3, 511, 1000, 100, 1, length(lang || source) + 3 + length(CAST(doc_id AS VARCHAR)), 1700000003, 0 FROM f WHERE doc_id % 60 = 7),
symlinks AS (SELECT {LINK0} + doc_id AS ino, '/' || lang || '/' || source || '/' || doc_id AS target FROM f WHERE doc_id % 60 = 7),
dirents AS (
  SELECT 1 AS parent, lang AS name, ino, 2 AS kind FROM langs
  UNION ALL SELECT l.ino, s.source, s.ino, 2 FROM srcs s JOIN langs l ON l.lang = s.lang
  UNION ALL SELECT s.ino, CAST(doc_id AS VARCHAR), f.ino, 1 FROM f JOIN srcs s ON s.lang = f.lang AND s.source = f.source
  UNION ALL SELECT 1, 'link-' || doc_id, ino, 1 FROM f WHERE doc_id % 50 = 0
  UNION ALL SELECT 1, 'sym-' || doc_id, {LINK0} + doc_id, 3 FROM f WHERE doc_id % 60 = 7),
xattrs AS (SELECT ino, 'user.lang' AS name, lang AS value FROM f UNION ALL SELECT ino, 'user.source', source FROM f),
raw AS (SELECT ino, n, hex(encode(text)) AS h FROM f),
raw_pages AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS n, hex(encode(html)) AS h FROM pages),
extents AS (SELECT ino, i AS block_idx, least({BLOCK}, n - i * {BLOCK}) AS used, md5(unhex(rpad(substr(h, i * {2 * BLOCK} + 1, {2 * BLOCK}), {2 * BLOCK}, '0'))) AS hash
  FROM (SELECT *, unnest(range(0, (n + {BLOCK - 1}) // {BLOCK})) AS i FROM raw)),
loose AS (SELECT md5(unhex(rpad(substr(h, i * {2 * BLOCK} + 1, {2 * BLOCK}), {2 * BLOCK}, '0'))) AS hash, least({BLOCK}, n - i * {BLOCK}) AS used
  FROM (SELECT *, unnest(range(0, (n + {BLOCK - 1}) // {BLOCK})) AS i FROM raw_pages)),
held AS (SELECT hash, count(*) AS n, max(used) AS used FROM extents GROUP BY hash UNION ALL SELECT hash, 0, max(used) FROM loose WHERE hash NOT IN (SELECT hash FROM extents) GROUP BY hash),
chunks AS (SELECT hash, CAST(n + CASE WHEN hash LIKE 'a0%' THEN 1 ELSE 0 END AS BIGINT) AS refcount, CAST(('0x' || substr(hash, 1, 4)) AS INTEGER) % {PACKS} + 1 AS pack_id,
  CASE WHEN used + 16 < {BLOCK} THEN 1 ELSE 0 END AS codec, CAST({BLOCK} AS BIGINT) AS ulen, CAST(least({BLOCK}, used + 16) AS BIGINT) AS clen FROM held WHERE hash NOT LIKE '0f%'),
entries AS (SELECT pack_id, hash, codec, ulen, clen FROM chunks UNION ALL SELECT pack_id % {PACKS} + 1, hash, codec, ulen, clen FROM chunks WHERE hash LIKE 'b%' UNION ALL SELECT pack_id, hash, codec, ulen, clen FROM chunks WHERE hash LIKE 'c1%'),
pack_index AS (SELECT pack_id, seq, hash, CAST(coalesce(sum(32 + clen) OVER (PARTITION BY pack_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset", codec, ulen, clen
  FROM (SELECT *, row_number() OVER (PARTITION BY pack_id ORDER BY hash) AS seq FROM entries)),
discards AS (SELECT CAST(1 AS BIGINT) AS epoch, pack_id, hash, clen AS bytes FROM chunks WHERE refcount = 0 UNION ALL SELECT 2, pack_id, hash, clen + 1 FROM chunks WHERE refcount = 0 AND hash LIKE '%7'),
snapshots AS (SELECT * FROM (VALUES ('daily-2026-02-20', 2001, 1771545600), ('before-upgrade', 2002, 1771000000), ('empty', 2003, 1771632000)) AS t(name, root_ino, created))"""


class Store:
    """The tables as DataFrames; each is a lazy plan over the driver's tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        documents = table(spark, sf_dir, "documents")
        self.documents = documents
        self.files = documents.select("doc_id", (F.col("doc_id") + FILE0).alias("ino"), "text", "lang", "source", F.octet_length(F.encode("text", "UTF-8")).cast("bigint").alias("n"))
        # names of folders: a few distinct values, numbered in one partition
        self.langs = documents.select("lang").distinct().withColumn("ino", F.row_number().over(Window.orderBy("lang")) + 10)
        self.srcs = documents.select("lang", "source").distinct().withColumn("ino", F.row_number().over(Window.orderBy("lang", "source")) + 1000)

    @property
    def inodes(self) -> DataFrame:
        names = ["ino", "kind", "perm", "uid", "gid", "nlink", "size", "mtime", "flags"]
        kinds = ["bigint", "int", "int", "bigint", "bigint", "bigint", "bigint", "bigint", "int"]
        shape = lambda df, *e: df.selectExpr(*(f"cast({x} as {k}) as {n}" for x, k, n in zip(e, kinds, names, strict=True)))
        below = self.srcs.groupBy("lang").agg(F.count("*").alias("n"))
        vault = "case when source = 'src7' then 2 else 0 end"
        parts = [
            shape(self.langs.agg(F.count("*").alias("n")), "1", "2", "493", "0", "0", "2 + n", "0", "1700000000", "0"),
            shape(self.langs.join(below, "lang"), "ino", "2", "493", "0", "0", "2 + n", "0", "1700000001", "0"),
            shape(self.srcs, "ino", "2", "493", "0", "0", "2", "0", "1700000002", vault),
            shape(self.files.where("doc_id % 97 <> 13"), "ino", "1", "case doc_id % 4 when 0 then 420 when 1 then 416 when 2 then 384 else 292 end", "1000 + doc_id % 5", "100 + doc_id % 3", "case when doc_id % 50 = 0 then 2 else 1 end", "n", "1700000000 + doc_id * 37", f"case when doc_id % 11 = 0 then 1 else 0 end + {vault}"),
            shape(self.files.where("doc_id % 60 = 7"), f"{LINK0} + doc_id", "3", "511", "1000", "100", "1", "length(lang || source) + 3 + length(cast(doc_id as string))", "1700000003", "0"),
        ]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    @property
    def symlinks(self) -> DataFrame:
        return self.files.where("doc_id % 60 = 7").selectExpr(f"{LINK0} + doc_id as ino", "'/' || lang || '/' || source || '/' || doc_id as target")

    @property
    def dirents(self) -> DataFrame:
        srcs = self.srcs.withColumnRenamed("ino", "src_ino")
        parts = [
            self.langs.selectExpr("1L as parent", "lang as name", "cast(ino as bigint) as ino", "2 as kind"),
            srcs.join(self.langs, "lang").selectExpr("cast(ino as bigint) as parent", "source as name", "cast(src_ino as bigint) as ino", "2 as kind"),
            self.files.join(srcs, ["lang", "source"]).selectExpr("cast(src_ino as bigint) as parent", "cast(doc_id as string) as name", "ino", "1 as kind"),
            self.files.where("doc_id % 50 = 0").selectExpr("1L as parent", "'link-' || doc_id as name", "ino", "1 as kind"),
            self.files.where("doc_id % 60 = 7").selectExpr("1L as parent", "'sym-' || doc_id as name", f"{LINK0} + doc_id as ino", "3 as kind"),
        ]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    @property
    def xattrs(self) -> DataFrame:
        return self.files.selectExpr("ino", "inline(array(struct('user.lang' as name, lang as value), struct('user.source' as name, source as value)))")

    @property
    def blocks(self) -> DataFrame:
        """(ino, block_idx, used, data): padded blocks of the files."""
        return split_blocks(self.files.select("ino", F.encode("text", "UTF-8").alias("data")), "ino", "data", BLOCK)

    @property
    def page_blocks(self) -> DataFrame:
        """(page_id, block_idx, used, data): padded blocks of the pages, which no file refers to."""
        html = F.encode(F.col("html"), "UTF-8")
        return split_blocks(table(self.spark, self.sf_dir, "pages").select("page_id", html.alias("data")), "page_id", "data", BLOCK)

    @property
    def payloads(self) -> DataFrame:
        """(hash, data): each distinct block of files and pages."""
        both = self.blocks.select("data").unionByName(self.page_blocks.select("data"))
        return both.select(F.md5("data").alias("hash"), "data").dropDuplicates(["hash"])

    @property
    def extents(self) -> DataFrame:
        return self.blocks.select("ino", "block_idx", "used", F.md5("data").alias("hash"))

    @property
    def chunks(self) -> DataFrame:
        loose = self.page_blocks
        rows = self.extents.select("hash", "used", F.lit(1).alias("n")).unionByName(loose.select(F.md5("data").alias("hash"), "used", F.lit(0).alias("n")))
        held = rows.groupBy("hash").agg(F.sum("n").alias("n"), F.max("used").alias("used")).where("hash not like '0f%'")
        return held.selectExpr("hash", "n + case when hash like 'a0%' then 1 else 0 end as refcount", f"cast(conv(substring(hash, 1, 4), 16, 10) as int) % {PACKS} + 1 as pack_id", f"case when used + 16 < {BLOCK} then 1 else 0 end as codec", f"{BLOCK}L as ulen", f"cast(least({BLOCK}, used + 16) as bigint) as clen")

    @property
    def entries(self) -> DataFrame:
        """Records of the packs: chunks, some of them twice or in another pack as well."""
        copies = F.when(F.col("hash").like("b%"), F.array(F.lit(0), F.lit(1))).when(F.col("hash").like("c1%"), F.array(F.lit(0), F.lit(0))).otherwise(F.array(F.lit(0)))
        return self.chunks.withColumn("shift", F.explode(copies)).selectExpr(f"case when shift = 1 then pack_id % {PACKS} + 1 else pack_id end as pack_id", "hash", "codec", "ulen", "clen")

    @property
    def pack_index(self) -> DataFrame:
        from ..operators.packs import with_offsets

        numbered = self.entries.withColumn("seq", F.row_number().over(Window.partitionBy("pack_id").orderBy("hash")))
        return with_offsets(numbered).select("pack_id", "seq", "hash", "offset", "codec", "ulen", "clen")

    @property
    def discards(self) -> DataFrame:
        dead = self.chunks.where("refcount = 0")
        return dead.selectExpr("1L as epoch", "pack_id", "hash", "clen as bytes").unionByName(dead.where("hash like '%7'").selectExpr("2L as epoch", "pack_id", "hash", "clen + 1 as bytes"))

    @property
    def tables(self) -> Tables:
        """The namespace as one version."""
        return Tables(self.dirents, self.inodes, self.extents.select("ino", "block_idx", "hash"), self.xattrs, self.symlinks)

    @property
    def snapshots(self) -> DataFrame:
        return self.spark.createDataFrame([("daily-2026-02-20", 2001, 1771545600), ("before-upgrade", 2002, 1771000000), ("empty", 2003, 1771632000)], "name string, root_ino long, created long")
