"""Where plans are cut, and joins whose small side is counted first."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Rows of a join side that may be broadcast (at about 100 bytes a row: 40 MB).
BROADCAST_ROWS = 400_000
#: Rows of a partition of a table that is known to be small, and the partitions that it keeps at least.
COMPACT_ROWS, COMPACT_PARTS = 1 << 16, 8
#: Rows of a weighed side that may be broadcast whole; of a larger one only its heaviest keys are, fewer than as many.
WEIGHED_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``, or a temporary one in local mode.

    Raises where none is set and executors are separate processes, for a folder made here would be the driver's alone.
    """
    sc = spark.sparkContext
    set_dir = sc._jsc.sc().getCheckpointDir()
    if set_dir.isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir is not set: a cluster needs a folder that its driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="quarrystone-"))
        set_dir = sc._jsc.sc().getCheckpointDir()
    return set_dir.get()


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Writes ``df`` to the shared checkpoint folder and goes on from there.

    ``rows`` is a bound of its rows, where the caller knows one and the last step is cheap: partitions are then
    merged to about COMPACT_ROWS each, so that rounds over a small table write no file for each shuffle partition.
    """
    shared_dir(df.sparkSession)
    if rows is not None:
        df = df.coalesce(max(COMPACT_PARTS, -(-rows // COMPACT_ROWS)))
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """``df`` as a Parquet table in the shared folder, and what deletes it; for loops, whose plans would carry all earlier constraints along."""
    path, drop = stored(df)
    return df.sparkSession.read.schema(df.schema).parquet(path), drop


def stored(df: DataFrame, *by: str, **options) -> tuple[str, Callable[[], None]]:
    """The folder of ``df`` as a Parquet table, in folders ``by`` some columns, in the shared one, and what deletes it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.options(**{"compression": "zstd"} | options).partitionBy(*by).parquet(path)
    jvm = spark._jvm

    def drop() -> None:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)

    return path, drop


def tidy(plan: Callable) -> Callable:
    """While ``plan``, whose first argument is a table, runs, the files of a write's shuffles are deleted when it ends, not at some later collection of garbage.

    For plans that write out what they return.
    """
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    @functools.wraps(plan)
    def run(first: DataFrame, *more, **named):
        conf = first.sparkSession.conf
        before = conf.get(setting, "false")
        conf.set(setting, "true")
        try:
            return plan(first, *more, **named)
        finally:
            conf.set(setting, before)

    return run


def join_bounded(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner", rows: int = BROADCAST_ROWS) -> DataFrame:
    """Joins ``left`` with a materialised ``right``: by broadcast if it has at most ``rows`` rows, else by a shuffled join."""
    small = right.count() <= rows
    return left.join(F.broadcast(right) if small else right.hint("merge"), on, how)


def join_weighed(left: DataFrame, right: DataFrame, on: str, weight: str, how: str = "inner", rows: int = WEIGHED_ROWS, size: tuple[int, int] | None = None) -> DataFrame:
    """Joins ``left`` with a materialised ``right`` (one row per key) whose column ``weight`` tells how many rows of ``left`` have the key.

    A small ``right`` is broadcast. Of a large one only the heaviest keys are: those with over a
    100,000th of all rows, of which there can be no more than 100,000. What they do not take goes on
    to a shuffled join, so no key brings more rows than that to one task. Rows of ``left`` with a null
    key match nothing and are not shuffled; ``how`` is inner or left. ``weight`` is left out. ``size``
    gives bounds of the rows of ``right`` and of their weights where the caller knows them.
    """
    n, total = size or right.agg(F.count("*"), F.coalesce(F.sum(weight), F.lit(0))).first()
    if n <= rows:
        return left.join(F.broadcast(right.drop(weight)), on, how)
    heavy = F.col(weight) > max(1000.0, total / 100_000)
    names = left.columns + [c for c in right.columns if c not in (on, weight)]
    hot = right.where(heavy).drop(weight)
    first = left.join(F.broadcast(hot), on).select(names)
    rest = left.join(F.broadcast(hot.select(on)), on, "left_anti")
    out = first.unionByName(rest.where(F.col(on).isNotNull()).join(right.where(~heavy).drop(weight).hint("merge"), on, how).select(names))
    return out if how == "inner" else out.unionByName(rest.where(F.col(on).isNull()), allowMissingColumns=True)
