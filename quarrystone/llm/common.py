"""What several operators need: shared storage, batches of texts, connected components."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import shared_dir
from ..ship import ship


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Within, a query's shuffle files go as soon as its result is stored (in shared storage, so nothing needs them again)."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def new_path(spark: SparkSession, name: str) -> str:
    """Where a table of that name may be written in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: The tables that a thread wrote since it entered each tables_dropped() that it is in.
_within = threading.local()


def written(df: DataFrame, name: str, instead_of: list[str] | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage is cut, and executors may be lost.

    The table takes the place of that in ``instead_of``, which is deleted.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    with shuffles_dropped(spark):
        df.write.parquet(path)
    for made in getattr(_within, "open", [])[-1:]:
        made.append(path)
    if instead_of is not None:
        drop_tables(spark, instead_of)
        instead_of[:] = [path]
    return spark.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession, paths: list[str]) -> None:
    for path in map(spark._jvm.org.apache.hadoop.fs.Path, paths):
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def tables_dropped(spark: SparkSession, but: list[str]):
    """Tables that are written() within are deleted at the end, but for those in the list ``but``; what depends on the others must be stored by then."""
    _within.open = [*getattr(_within, "open", []), []]
    try:
        yield
    finally:
        drop_tables(spark, [x for x in _within.open.pop() if x not in but])


#: Rows of an Arrow batch of texts; Spark's default suits short rows.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Sends texts to Python in small batches, unless the session has its own number: a worker then holds a few MB of them."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def map_arrow(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | Iterator[pa.RecordBatch]]], schema: T.StructType | str) -> DataFrame:
    """mapInArrow with per-task state: ``make`` runs once a task and returns what is applied to each batch."""
    ship(df.sparkSession)
    small_batches(df.sparkSession)

    def run(batches):
        apply = make()
        for batch in batches:
            if batch.num_rows:
                got = apply(batch)
                yield from [got] if isinstance(got, pa.RecordBatch) else got

    return df.mapInArrow(run, schema)


#: Bits of a membership filter: 8 MB in all, whatever the number of members.
FILTER_BITS = 1 << 26


def possibly_in(df: DataFrame, key: str, members: DataFrame) -> DataFrame:
    """Rows of ``df`` whose key may be among ``members`` (a column of that name): no member is missed.

    Hashed members set bits of a bitmap of fixed size, which is broadcast.  With more members than bits it
    lets more through; it only spares a shuffle join, which must follow, most of its rows.
    """
    place = F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(FILTER_BITS))
    bucket, bit = F.bitmap_bucket_number(F.col("__place")), F.bitmap_bit_position(F.col("__place"))
    bits = members.select(place.alias("__place")).groupBy(bucket.alias("__bucket")).agg(F.bitmap_construct_agg(bit).alias("__bits"))
    byte = F.conv(F.hex(F.substring("__bits", F.floor(F.col("__bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = df.withColumn("__place", place).withColumn("__bit", bit).withColumn("__at", bucket).join(F.broadcast(bits), F.col("__at") == F.col("__bucket"))
    return found.where(byte.bitwiseAND(F.pow(F.lit(2), F.col("__bit") % 8).cast("int")) != 0).select(*df.columns)


def connected_components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, root): the least node reachable from each node that has an edge to another.

    Alternates large-star and small-star steps until nothing changes.  A step is
    two aggregations and two joins on the node; stars with a hot centre are
    rows of an ordinary skew join.  Loops, nulls and repeated edges are ignored.
    """
    last: list[str] = []
    e = written(edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).where("u <> v").distinct(), "edges", last)

    def large(e: DataFrame) -> DataFrame:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))

    def small(e: DataFrame) -> DataFrame:
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        moved = e.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.union(low.select("u", F.col("m").alias("v"))).distinct()

    def mark(e: DataFrame) -> tuple:
        row = e.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        return tuple(row)

    before = mark(e)
    while True:
        e = written(small(large(e)), "edges", last)
        after = mark(e)
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
