"""What several operators need: the shared folder of the cluster, and words of raw UTF-8 bytes."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: A-Z to a-z, all other bytes as they are.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or on a local master a new temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tarnlake-")
        spark.conf.set("spark.checkpoint.dir", found)
        _written.append(found)
    return found.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: lineage ends there, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def unstage(spark: SparkSession, df: DataFrame | None) -> None:
    """Deletes what stage() wrote, once nothing reads it any more."""
    path = getattr(df, "_staged_path", None)
    if path:
        _delete(spark, path)
        _written.remove(path)


def release(spark: SparkSession) -> None:
    """Lets go of the shuffle files of finished jobs: Spark deletes them once nothing refers to their plans."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        for path in _written:
            try:
                _delete(spark, path)
            except Exception:  # noqa: BLE001, PERF203  the JVM may be gone by now
                return


def give_back() -> None:
    """Hands memory that is free in a Python worker back to the machine: workers live on, idle, beside those of later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def neutral(docs: DataFrame, *needed: str) -> DataFrame:
    """docs with all columns but the needed ones renamed by their place, so that no name can clash; toDF(*docs.columns) undoes it."""
    return docs.toDF(*(n if n in needed else f"column_{i}" for i, n in enumerate(docs.columns)))


def raw(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    return column.cast(pa.binary()).to_pylist()


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser: spreads the bits of unsigned 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
