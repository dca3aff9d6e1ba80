"""Incremental collection of unreferenced chunks, with its state in tables.

A commit writes the tables that changed and then, last, a row set ``sys`` that names the current version of
each table beside the phase, the scan's cursor and the epoch.  A new object over the same folder goes on from there.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SCAN_BATCH, Settings
from ..operators import gc, packs

SCAN, REWRITE = "0", "1"
TABLES = ("chunks", "discards", "index")


@dataclass
class Collection:
    """``active`` is the pack that is being written; ``packs_at_once`` packs at most are rewritten in a cycle (None: all that qualify)."""

    spark: SparkSession
    root: str
    active: int
    settings: Settings = Settings()
    batch: int = SCAN_BATCH
    packs_at_once: int | None = 1

    def _folder(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def state(self) -> dict[str, str]:
        """The last complete commit's row set; empty before the first."""
        files, path = self._folder("sys")
        if not files.exists(path):
            return {}
        done = [f.getPath() for f in files.listStatus(path)]
        done = [p.toString() for p in done if files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return {r.name: r.value for r in self.spark.read.parquet(max(done)).collect()} if done else {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.state()[f"table.{name}"])

    def commit(self, changed: dict[str, DataFrame], **values: str) -> dict[str, str]:
        state = self.state()
        version = int(state.get("version", 0)) + 1
        for name, df in changed.items():
            path = f"{self.root}/{name}/v{version:012d}"
            df.write.mode("overwrite").parquet(path)  # what a broken-off commit left is replaced
            state[f"table.{name}"] = path
        state |= {k.replace("_", "."): v for k, v in values.items()} | {"version": str(version)}
        self.spark.createDataFrame([*state.items()], "name string, value string").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/sys/v{version:012d}")
        return state

    def start(self, chunks: DataFrame, discards: DataFrame, index: DataFrame) -> None:
        self.commit({"chunks": chunks, "discards": discards, "index": index}, gc_phase=SCAN, gc_cursor="", gc_epoch=str(discards.agg(F.coalesce(F.max("epoch"), F.lit(0))).first()[0]))

    def step(self, idle: bool = True) -> str:
        """One cycle, which is one commit; nothing happens unless the store is idle.

        A scan that reaches the end starts rewriting, rewriting that finds no pack starts scanning anew.
        """
        if not idle:
            return "busy"
        state = self.state()
        return self._scan(state) if state["gc.phase"] == SCAN else self._rewrite()

    def _scan(self, state: dict[str, str]) -> str:
        chunks, cursor = self.table("chunks"), state["gc.cursor"]
        page = chunks if not cursor else chunks.where(F.col("hash") > cursor)
        page = page.select("hash", "refcount", "pack_id", "clen").orderBy("hash").limit(self.batch)
        n, last, dead = page.agg(F.count("*"), F.max("hash"), F.count_if(F.col("refcount") == 0)).first()
        more = {"gc_cursor": last} if n >= self.batch else {"gc_cursor": "", "gc_phase": REWRITE}
        if not dead:
            self.commit({}, **more)
            return "scanned"
        # the page again as a range of keys, which needs no sort and reaches the scan
        found = chunks.where((F.col("hash") > cursor) & (F.col("hash") <= last) & (F.col("refcount") == 0))
        epoch = int(state["gc.epoch"]) + 1
        records = found.select(F.lit(epoch).cast("long").alias("epoch"), "pack_id", "hash", F.col("clen").alias("bytes"))
        log = self.table("discards")
        self.commit({"chunks": gc.delete_candidates(chunks, found), "discards": log.unionByName(records.select(*log.columns))}, gc_epoch=str(epoch), **more)
        return "scanned"

    def _rewrite(self) -> str:
        log, index, own = self.table("discards"), self.table("index"), self.settings
        worth = gc.worth_rewriting(gc.dead_bytes(log, index), self.active, own.gc_pack_rewrite_min_reclaim_bytes, own.gc_pack_rewrite_min_reclaim_percent)
        chosen = worth.select("pack_id").orderBy("pack_id")
        chosen = chosen if self.packs_at_once is None else chosen.limit(self.packs_at_once)
        if chosen.isEmpty():
            self.commit({}, gc_phase=SCAN)
            return "done"
        moved = packs.compacted(index.join(chosen, "pack_id", "left_semi"), gc.live_hashes(self.table("chunks")), self.active)
        kept = index.join(chosen, "pack_id", "left_anti").select(*moved.columns)
        self.commit({"index": kept.unionByName(moved), "discards": gc.without_packs(log, chosen).select(*log.columns)})
        return "rewritten"

    def until_stable(self) -> int:
        """Offline: rewrites until no pack qualifies; the number of cycles."""
        self.commit({}, gc_phase=REWRITE)
        cycles = 1
        while self.step() == "rewritten":
            cycles += 1
        return cycles
