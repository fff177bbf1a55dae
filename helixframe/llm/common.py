"""What several operators share: the folder that all executors see, shipping of this package, Arrow helpers."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = Path(__file__).resolve().parents[2]
#: Text of one Arrow slice that a kernel handles at a time.
SLICE_BYTES = 4 << 20


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below spark.checkpoint.dir. Only where that is unset (tests, one machine) a temporary folder is
    taken. What is written there is removed when the driver ends."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        base = tempfile.mkdtemp(prefix="helixframe-")
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the context is gone: the cluster's own cleaning takes over
        pass


def cores(spark: SparkSession) -> int:
    return max(1, spark.sparkContext.defaultParallelism)


def tasks(spark: SparkSession, size: int) -> int:
    """How many tasks so many bytes are worth: one for 1 MB, up to four for each core, or one for 16 MB; never more than the session's width. (What
    the planner can't tell is very large.)"""
    return max(1, min(4 * cores(spark), size >> 20), min(size >> 24, width(spark)))


def stored(df: DataFrame, name: str, size: int | None = None) -> DataFrame:
    """The rows of df, written to the shared folder and read again: it cuts the lineage and survives lost executors. size: a bound on its bytes, if
    known: no more files are written than that is worth."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    (df if size is None else df.coalesce(tasks(spark, size))).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Make this package importable on the executors where PYTHONPATH doesn't do so."""
    root = str(ROOT)
    if root in os.environ.get("PYTHONPATH", "").split(":") or getattr(spark.sparkContext, "_helixframe_shipped", False):
        return
    out = Path(tempfile.mkdtemp(prefix="helixframe-")) / "helixframe.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted((ROOT / "helixframe").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    spark.sparkContext.addPyFile(str(out))
    spark.sparkContext._helixframe_shipped = True


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def in_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInArrow(f, schema)


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each slice holds about `most` bytes of the column, or one longer value."""
    for b in batches:
        if not b.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False)
        start = size = 0
        for i, n in enumerate(sizes.tolist()):
            if i > start and size + n > most:
                yield b.slice(start, i - start)
                start, size = i, 0
            size += n
        yield b.slice(start)


def planned_bytes(df: DataFrame) -> int:
    """What the planner knows of df's size, without reading it; for a scan of files their size."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def total_bytes(df: DataFrame, column: str = "text") -> tuple[int, int]:
    """Rows, and bytes of a column."""
    n, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()
    return int(n), int(size)


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
