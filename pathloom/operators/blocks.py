"""Even blocks of a totally ordered table.

Work that follows the order of time within a key (runs, neighbours, sessions, path lengths) is usually
written as a window over ``partitionBy(key)``; a key with a third of all rows then makes one task as long
as all others together. Here the whole table is range-partitioned on (key, time) instead, so blocks are even
whatever the sizes of the keys, and a key may span many blocks. What crosses a block's edge travels as small
summaries: each block reports a bounded number of rows, the driver combines one report per block (a prefix
scan), and a second pass over the same blocks gets its neighbours' rows and the carried state.

The blocks are a reliable checkpoint in the shared folder, so both passes see the same cut and a lost
executor costs only its tasks. Reports are bounded by the number of blocks times a constant.
"""

from __future__ import annotations

import math
import re
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = "_block"
ROWS_PER_BLOCK = 150_000


_CLEAN = "spark.cleaner.referenceTracking.cleanCheckpoints"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names (``spark.checkpoint.dir`` of the session), which also holds checkpoints. A folder
    of its own is taken only where none is named and all of Spark is one process (tests); elsewhere that is an error,
    because one machine's folder is not another's."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not sc.getCheckpointDir():
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="pathloom-"))
    return named or sc.getCheckpointDir()


def reliable(df: DataFrame) -> DataFrame:
    """Checkpoint in the shared folder. The files go when nothing refers to them any more."""
    shared_folder(df.sparkSession)
    conf = df.sparkSession.sparkContext._jsc.sc().conf()
    before = conf.get(_CLEAN, "false")
    conf.set(_CLEAN, "true")  # read when the checkpoint is written
    try:
        return df.checkpoint()
    finally:
        conf.set(_CLEAN, before)


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


class OrderedBlocks:
    """``df`` sorted by ``place + ties``; rows equal in ``place`` are always in one block.

    The number of blocks follows the number of rows: at least the session's shuffle partitions, and no block grows
    with the table.
    """

    def __init__(self, df: DataFrame, place: list[str], ties: list[str], keep: list[str] | None = None, rows_per_block: int = ROWS_PER_BLOCK):
        rows = df.count()
        # the parallelism of the session for a small table, but no block under a few thousand rows
        n = max(math.ceil(rows / rows_per_block), min(shuffle_partitions(df), math.ceil(rows / 4000)), 1)
        self.columns = keep or df.columns
        self.data = reliable(
            df.repartitionByRange(n, *place)
            .sortWithinPartitions(*place, *ties)
            .select(*self.columns, F.spark_partition_id().alias(BLOCK))
        )

    def reports(self, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> pd.DataFrame:
        """One pass; ``fn`` gets a whole block and returns a bounded number of rows, which reach the driver."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            got = [b for b in batches if len(b)]
            if got:
                block = pd.concat(got, ignore_index=True)
                out = fn(block)
                out.insert(0, BLOCK, block[BLOCK].iloc[0])
                yield out

        out = self.data.mapInPandas(run, f"{BLOCK} int, {schema}").toPandas()
        return out.sort_values(BLOCK, kind="stable").reset_index(drop=True)

    def map(self, fn: Callable[[pd.DataFrame, int], pd.DataFrame], schema: str) -> DataFrame:
        """The second pass: ``fn`` gets a whole block and its number."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            got = [b for b in batches if len(b)]
            if got:
                block = pd.concat(got, ignore_index=True)
                yield fn(block, int(block[BLOCK].iloc[0]))

        return self.data.mapInPandas(run, schema)


def edges(block: pd.DataFrame, h: int) -> pd.DataFrame:
    """The first and last ``h`` rows of a block, marked by ``_side`` (``a`` first, ``z`` last)."""
    return pd.concat([block.iloc[:h].assign(_side="a"), block.iloc[-h:].assign(_side="z")], ignore_index=True)


class halos:  # noqa: N801
    """``halos(report, h)[block]``: the ``h`` rows before and after a block, from the edges of as many neighbours as needed.

    All edges lie in two flat tables (``2 h`` rows per block); a task cuts out its own.
    """

    def __init__(self, report: pd.DataFrame, h: int):
        cols = [c for c in report.columns if c not in (BLOCK, "_side")]
        report = report.sort_values(BLOCK, kind="stable")
        self.h, self.side, self.at = h, {}, {}
        self.ids = report[BLOCK].drop_duplicates().to_numpy()
        for name in ("a", "z"):
            part = report[report["_side"] == name]
            self.side[name] = part[cols].reset_index(drop=True)
            self.at[name] = np.searchsorted(part[BLOCK].to_numpy(), self.ids).tolist() + [len(part)]

    def _rows(self, name: str, i: int) -> pd.DataFrame:
        return self.side[name].iloc[self.at[name][i] : self.at[name][i + 1]]

    def __getitem__(self, block: int) -> tuple[pd.DataFrame, pd.DataFrame]:
        here = int(np.searchsorted(self.ids, block))
        before, after = [self.side["z"].iloc[:0]], [self.side["a"].iloc[:0]]
        i, have = here - 1, 0
        while i >= 0 and have < self.h:
            before.insert(0, self._rows("z", i))
            have += len(before[0])
            i -= 1
        i, have = here + 1, 0
        while i < len(self.ids) and have < self.h:
            after.append(self._rows("a", i))
            have += len(after[-1])
            i += 1
        join = lambda parts: pd.concat([p for p in parts if len(p)] or parts[:1], ignore_index=True)
        return join(before).iloc[-self.h :].reset_index(drop=True), join(after).iloc[: self.h]
