"""Helpers the operators share: shared scratch tables, byte-balanced slices, fixed word rules."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of bytes outside this set, in every operator with a words contract.
SPACES = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

_scratch: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``); a local one is set only where that is unset, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        checkpoint = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = checkpoint.get() if checkpoint.isDefined() else None
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="claimloom-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/claimloom/{name}-{uuid.uuid4().hex}"
    if not _scratch:
        atexit.register(release)
    _scratch.append((spark, path))
    return path


def release() -> None:
    """Deletes every scratch table of this driver; frames still built on them can't be read any more."""
    while _scratch:
        spark, path = _scratch.pop()
        try:
            jvm = spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001  the session has ended; the folder goes with it
            return


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes the frame as Parquet to the shared folder and reads it again."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices_by_bytes(sizes, limit: int):
    """Yields (from, to) so that each slice holds about ``limit`` bytes; a larger item stands alone."""
    lo = total = 0
    for i, n in enumerate(sizes):
        if i > lo and total + n > limit:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(sizes):
        yield lo, len(sizes)


def text_bytes(column) -> list[bytes]:
    """The UTF-8 of an Arrow string column; null counts as empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words_of(text) -> "F.Column":
    """The words of a text column as an array (null text: none)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES + "+"), lambda w: w != "")


def splitmix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer, so that the low bits of a polynomial hash are usable."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def local_file(name: str) -> str:
    """Where the installed public tokenizer files have ``name``; the same on driver and executors."""
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))
