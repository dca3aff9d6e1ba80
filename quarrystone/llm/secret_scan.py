"""Incremental secret scanning over a ledger of content-addressed blobs.

Every version of every path is addressed by the SHA-256 of its text.  Only
(blob, rule version) pairs that the ledger doesn't hold are scanned, and findings
are joined back to all versions with that blob.

Texts are scanned where they lie: only addresses and findings are shuffled.  The
unseen addresses are found by an anti-join of addresses alone; they pick the texts to scan
through a bitmap of fixed size where it can tell them apart, through a join where it can't.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import FILTER_BITS, map_arrow, possibly_in, written
from .words import string_buffers

#: Changes with RULES: a blob scanned by other rules counts as unseen.
RULE_VERSION = "1"

# Base kinds in listed order, each with its least length.
BASE = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(r"[0-9a-f]{24,}"), 0, 24),  # runs of 24 and more are the leftmost matches that stay
}
#: Kinds of our own: private key headers, tokens with a vendor's prefix, JSON web tokens, credentials in URLs.
ADDED = {
    "pem": re.compile(r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    "prefixed": re.compile(r"\b(?:gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,})", re.A),
    # begins a run of its characters, so that each run is read three times at most
    "jwt": re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"),
    "url": re.compile(r"\b[a-z][a-z0-9+.-]{1,15}://[^\x00-\x20:/@]{1,64}:[^\x00-\x20:/@]{3,64}@", re.A),
}
ORDER = {k: n for n, k in enumerate([*BASE, *ADDED])}
#: A text without any of these byte strings (lower case) has no match of the kind.
HINTS = {"assign": (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key"), "access": (b"akia",), "pem": (b"private key-----",), "prefixed": (b"ghp_", b"gho_", b"ghu_", b"ghs_", b"ghr_", b"xox", b"sk_live_"), "jwt": (b"eyj",), "url": (b"://",)}
HEX_RUN = re.compile(rb"[0-9a-f]{24}")


def scan_text(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then kind as listed."""
    raw = text.encode("utf-8", "replace")
    low = raw.lower()
    hit = {k for k, words in HINTS.items() if any(w in low for w in words)}
    out = []
    for kind, (rule, group, least) in BASE.items():
        if kind in hit or kind == "hex" and HEX_RUN.search(raw):
            out += [(kind, m.start(), m.end()) for m in rule.finditer(text) if m.end(group) - m.start(group) >= least]
    for kind, rule in ADDED.items():
        if kind in hit:
            out += [(kind, m.start(), m.end()) for m in rule.finditer(text)]
    return sorted(out, key=lambda x: (x[1], ORDER[x[0]]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


FINDINGS = "blob string, rule_version string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def blob_id(text: str = "text") -> Column:
    """Content address; a null text is the empty blob."""
    return F.sha2(F.coalesce(F.col(text), F.lit("")), 256)


#: Blobs that a task remembers having scanned.
REMEMBERED = 1 << 18


def _scan(blobs: DataFrame) -> DataFrame:
    """Findings of rows (blob, rule_version, text), a row for each blob; a task scans a blob once."""
    names = [c.split(" ")[0] for c in FINDINGS.split(", ")]

    def make():
        seen: set[str] = set()

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            if len(seen) >= REMEMBERED:
                seen.clear()
            new = {b: i for i, b in enumerate(batch.column("blob").to_pylist()) if b not in seen}
            seen.update(new)
            batch = batch.take(pa.array(sorted(new.values()), pa.int64()))
            texts = batch.column("text")
            data, offsets = string_buffers(texts)
            whole = data[offsets[0] : offsets[-1]].tobytes() if len(data) else b""
            low = whole.lower()
            any_hint = {k: any(w in low for w in words) for k, words in HINTS.items()}
            found = [scan_text(t.as_py() or "") for t in texts] if any(any_hint.values()) or HEX_RUN.search(whole) else [[] for _ in texts]
            base = [[s for s in spans if s[0] in BASE] for spans in found]
            count = [[sum(s[0] == k for s in spans) for spans in base] for k in BASE]
            return pa.RecordBatch.from_arrays([batch.column("blob"), batch.column("rule_version"), *(pa.array(c, pa.int64()) for c in count), pa.array([hashlib.sha256(joined(s).encode()).hexdigest() for s in base], pa.string()), pa.array([joined(s) for s in found], pa.string())], names)

        return apply

    return map_arrow(blobs.select("blob", "rule_version", "text"), make, FINDINGS).dropDuplicates(["blob"])


def scan_unseen(versions: DataFrame, ledger: DataFrame | None = None, rule_version: str = RULE_VERSION) -> DataFrame:
    """The ledger's new rows: one for each (blob, rule version) in ``versions`` that ``ledger`` lacks.

    ``versions`` has a column text (and whatever else); a null text is the empty blob.  Blobs without
    findings get a row too, as they needn't be scanned again.
    """
    rows = versions.select(blob_id().alias("blob"), F.lit(rule_version).alias("rule_version"), F.coalesce("text", F.lit("")).alias("text"))
    if ledger is None:
        return _scan(rows)
    seen = ledger.where(F.col("rule_version") == rule_version).select("blob")
    unseen = written(rows.select("blob").distinct().join(seen, "blob", "left_anti"), "unseen")
    if unseen.count() > FILTER_BITS // 8:
        return _scan(rows.join(unseen, "blob", "left_semi"))
    named = rows.withColumn("__key", F.xxhash64("blob"))
    found = _scan(possibly_in(named, "__key", unseen.select(F.xxhash64("blob").alias("__key"))))
    return found.join(unseen, "blob", "left_semi")


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FINDINGS).parquet(path)


def update_ledger(versions: DataFrame, path: str, rule_version: str = RULE_VERSION) -> DataFrame:
    """The ledger at ``path`` (a Parquet table, made by the first call) after appending what ``versions`` adds.

    A repeated call appends nothing; rows that a broken-off one left twice don't matter to findings().
    """
    spark = versions.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    scan_unseen(versions, read_ledger(spark, path) if exists else None, rule_version).write.mode("append").parquet(path)
    return read_ledger(spark, path)


def findings(versions: DataFrame, ledger: DataFrame, keep: list[str], rule_version: str = RULE_VERSION) -> DataFrame:
    """The findings of each version's blob beside the columns ``keep``; one row for each row of ``versions``.

    Findings are null where the ledger lacks the blob under these rules.  Repeated ledger rows count once.
    """
    of = ledger.where(F.col("rule_version") == rule_version).drop("rule_version").withColumnRenamed("blob", "__blob").dropDuplicates(["__blob"])
    of = of.repartition(F.xxhash64("__blob"))  # apart from that aggregation, so that the join may split the versions of one blob
    return versions.select(*keep, blob_id().alias("__blob")).join(of, "__blob", "left").drop("__blob")


def oracle_sql() -> str:
    """The same findings of every row of ``documents`` in DuckDB's SQL."""
    either = lambda words: "(" + "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w.replace("?", "")).replace("_", "_?") for w in words) + ")"
    rules = {"assign": either(["password", "passwd", "secret", "token", "api_key"]) + BASE["assign"][0].pattern.split(")", 1)[1]}
    rules |= {k: r.pattern for k, (r, *_) in BASE.items() if k != "assign"} | {k: r.pattern for k, r in ADDED.items()}
    run = "[A-Za-z0-9_-]"
    rules["jwt"] = f"(?:^|[^A-Za-z0-9_-])(eyJ{run}{{8,}}[.]eyJ{run}{{8,}}[.]{run}{{8,}})"  # no look-behind here: the character before is matched too, and not counted
    each, columns = [], []
    for n, (kind, rule) in enumerate(rules.items()):
        quoted = rule.replace("'", "''")
        group, least = BASE[kind][1:] if kind in BASE else (int(kind == "jwt"), 1)
        before = f"length(m{n}[i]) - length(g{n}[i])" if kind == "jwt" else "0"
        columns.append(f"regexp_extract_all(t, '{quoted}') AS m{n}, regexp_extract_all(t, '{quoted}', {group}) AS g{n}, string_split_regex(t, '{quoted}') AS s{n}")
        each.append(f"[{{'a': list_sum([length(x) for x in s{n}[1:i]]) + coalesce(list_sum([length(x) for x in m{n}[1:i - 1]]), 0) + {before}, 'k': {n}, 'kind': '{kind}', 'n': length(m{n}[i]) - ({before})}} for i in range(1, len(m{n}) + 1) if length(g{n}[i]) >= {least}]")
    told = lambda x: f"array_to_string([s.kind || ':' || CAST(s.a AS BIGINT) || ':' || CAST(s.a + s.n AS BIGINT) for s in {x}], ',')"
    count = ", ".join(f"CAST(len([s for s in spans if s.kind = '{k}']) AS BIGINT) AS n_{k}" for k in BASE)
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS (SELECT doc_id, {", ".join(columns)} FROM t),
f AS (SELECT doc_id, list_sort({" || ".join(each)}) AS spans FROM m)
SELECT doc_id, {count}, sha256({told(f"[s for s in spans if s.k < {len(BASE)}]")}) AS base_sha256, {told("spans")} AS spans FROM f"""
