"""python -m quarrystone TABLES COMMAND: queries over a folder of the driver's tables.

Commands: list, stats, snapshots, gc, query NAME, control (requests of the control protocol from the standard input).
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from . import catalog
from .control import Control
from .sources.store import Store

COMMANDS = {"stats": "k10_stats_report", "snapshots": "o1_m1_snapshot_names", "gc": "k11_a12_o6_offline_report"}


def main(args: list[str]) -> int:
    if len(args) == 2 and args[1] == "list":
        print("\n".join(sorted(catalog.QUERIES)))
        return 0
    if len(args) == 2 and args[1] == "control":
        spark = SparkSession.builder.appName("quarrystone").getOrCreate()
        own = catalog.new_session(Store(spark, args[0]))
        for answer in Control(own.operations()).serve(sys.stdin):
            print(answer, flush=True)
        return 0
    name = args[2] if len(args) == 3 and args[1] == "query" else COMMANDS.get(args[1]) if len(args) == 2 else None
    if name not in catalog.QUERIES:
        print(__doc__, file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("quarrystone").getOrCreate()
    catalog.QUERIES[name](spark, args[0]).show(1000, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
