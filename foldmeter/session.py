"""Session helpers: where scratch tables live, when a side may be broadcast."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of at most so many rows and bytes may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 << 20

#: Rows in a partition of one of several jobs that share the cores.
SHARED_ROWS = 500_000


def scratch_dir(spark: SparkSession) -> str:
    """A fresh folder name under ``spark.checkpoint.dir``, the folder all executors share.

    Only where the setting is empty and all runs in this one process (local tests) a temporary folder stands in.
    """
    base = spark.conf.get("spark.checkpoint.dir", "") or None
    if base is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set: executors and driver need a folder that all of them share")
        base = tempfile.mkdtemp(prefix="foldmeter-")
        spark.conf.set("spark.checkpoint.dir", base)
    folder = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
    for made in _recorded:
        made.append(folder)
    return folder


#: Scratch tables made since recording began, where somebody records them.
_recorded: list[list[str]] = []


@contextmanager
def recorded_scratch() -> Iterator[list[str]]:
    """The scratch folders handed out inside, for ``drop_scratch`` once nothing reads them any more."""
    made: list[str] = []
    _recorded.append(made)
    try:
        yield made
    finally:
        _recorded.remove(made)


def drop_scratch(spark: SparkSession, folders: list[str]) -> None:
    """Delete recorded scratch folders: only names that ``scratch_dir`` made, by the file system that holds them."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
    folders.clear()


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_cleaning, _cleaning_lock = [0], threading.Lock()


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside are deleted as it ends, not at some later garbage collection of the driver."""
    with _cleaning_lock:
        _cleaning[0] += 1
        spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        with _cleaning_lock:
            _cleaning[0] -= 1
            if not _cleaning[0]:
                spark.conf.unset(_CLEANUP)


def cut_lineage(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back.

    The reliable way to end a long lineage: the files outlive lost executors, and nothing needs the shuffles before them any more.
    """
    path = scratch_dir(df.sparkSession)
    with _shuffles_dropped(df.sparkSession):
        df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def has_at_most(df: DataFrame, rows: int) -> bool:
    return df.limit(rows + 1).count() <= rows


def _width(name: str, kind) -> Column:
    """Bytes of one value, about as Spark holds it in a row."""
    col = F.col(f"`{name}`")
    if kind.typeName() in ("string", "binary"):
        return F.coalesce(F.octet_length(col), F.lit(0)) + 8
    if kind.typeName() in ("array", "map"):
        return F.greatest(F.size(col), F.lit(0)) * 16 + 16
    return F.lit(8)


def row_bytes(df: DataFrame) -> Column:
    """Bytes of a row of ``df``, about as Spark holds it."""
    return sum((_width(f.name, f.dataType) for f in df.schema.fields), F.lit(16))


def fits_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Measure ``df``, reading it once: neither its rows nor its bytes are too many."""
    n, total = df.agg(F.count("*"), F.sum(row_bytes(df))).first()
    return n <= rows and (total or 0) <= size


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Mark ``df`` for broadcasting only after measuring that neither its rows nor its bytes are too many.

    The measure reads ``df`` once: hand in a table, or something as cheap.
    """
    return F.broadcast(df) if fits_broadcast(df, rows, size) else df


def write_and_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` written once (see ``cut_lineage``), measured there, and marked for broadcasting if it is small."""
    return broadcast_if_small(cut_lineage(df), rows, size)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread_small(df: DataFrame) -> DataFrame:
    """Deal out the rows of a table too small for one scan split per core, so that work inside rows uses all cores.

    Measured by the size of the files or tables under ``df``; anything larger stays where it is read and is not shuffled.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    total = sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    return df.repartition(cores) if total < split * cores else df


def share_cores(df: DataFrame, jobs: int) -> DataFrame:
    """``df`` for one of ``jobs`` jobs that run side by side: in no more partitions than its share of the cores, unless they
    would hold over ``SHARED_ROWS`` rows.  Reads ``df`` once: hand in something cached or as cheap."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.coalesce(max(-(-cores // jobs), -(-df.count() // SHARED_ROWS)))
