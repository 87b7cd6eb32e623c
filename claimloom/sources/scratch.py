"""Cuts lineage by checkpoints in the folder that the cluster shares."""

from __future__ import annotations

import tempfile

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in ``spark.checkpoint.dir``; a folder of this machine is set only for a local session without one, as in tests."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        at = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not at and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(at or tempfile.mkdtemp(prefix="claimloom-"))
    return df.checkpoint()


def read_once(rows: DataFrame, by: list[str], keep: Column | None = None, **read: Column) -> DataFrame:
    """``rows`` with the columns ``read``, which are computed once for each distinct ``by``, and without rows that ``keep``, a condition on them, turns down.

    The cut comes before the condition, which would be asked of every row otherwise.
    """
    once = cut(rows.select(*by).distinct().select(*(F.col(c).alias(f"_{c}") for c in by), *(c.alias(name) for name, c in read.items())))
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by))
    return rows.join(once if keep is None else once.filter(keep), same).drop(*(f"_{c}" for c in by))
