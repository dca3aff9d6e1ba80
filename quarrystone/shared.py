"""Storage that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of applications on a local master that name none.
_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a local master (as in tests) gets a temporary one; a cluster has no folder that would do.
    """
    own = spark.conf.get("spark.checkpoint.dir", None)
    if not own:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = _local.get(spark.sparkContext.applicationId) or tempfile.mkdtemp(prefix="shared-")
        _local[spark.sparkContext.applicationId] = own
    return own


def new_path(spark: SparkSession, name: str) -> str:
    """Where a table or folder of that name may be written in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "rows") -> DataFrame:
    """Rows computed once, as a Parquet table in the shared folder; executors may be lost."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
