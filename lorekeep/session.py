"""Session helpers: cutting lineage in the shared folder."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable

from pyspark import InheritableThread
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# what is broadcast has at most so many bytes
SMALL_BYTES = 8 << 20


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder: the one that is set, else that of ``spark.checkpoint.dir``.

    Only a session with neither (a local test) gets a folder of its own.
    """
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = os.path.join(tempfile.gettempdir(), f"lorekeep-checkpoints-{os.getuid()}")
    sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder; what follows reads it from there and survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def if_small(df: DataFrame, width: Column) -> DataFrame:
    """``df`` marked for a broadcast if its rows, each of ``width`` bytes, come to at most ``SMALL_BYTES``, else as it is.

    ``df`` should be cheap to read: it is summed up once here. Without the mark the join shuffles; rows are the same.
    """
    size = df.agg(F.sum(width.cast("long")).alias("n")).collect()[0]["n"] or 0
    return F.broadcast(df) if size <= SMALL_BYTES else df


def together(*steps: Callable[[], DataFrame]) -> list[DataFrame]:
    """The results of steps that do not need each other, run at the same time, so that the end of one does not leave cores idle."""
    done: dict[int, DataFrame] = {}
    failed: list[BaseException] = []

    def run(i: int) -> None:
        try:
            done[i] = steps[i]()
        except BaseException as e:
            failed.append(e)

    threads = [InheritableThread(target=run, args=(i,)) for i in range(len(steps))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    if failed:
        raise failed[0]
    return [done[i] for i in range(len(steps))]
