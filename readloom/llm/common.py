"""What the operators of this subpackage share: scratch tables and null-safe columns."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The white space of every contract here: space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: The key of a row among those of its table, where a stage carries one.
ROW = "readloom_row"
_FILE, _PLACE = "readloom_file", "readloom_place"

_own_dir: str | None = None
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    A private temporary folder stands in only where the setting is absent and the master is a
    single local process (tests); on a cluster the absence is an error.
    """
    global _own_dir
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _own_dir is None:
        _own_dir = "file://" + tempfile.mkdtemp(prefix="readloom-")
    return _own_dir


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/readloom-{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, tag)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._readloom_path = path
    _written.append(path)
    return table


def delete_path(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables of materialize() that nothing reads any more."""
    for table in tables:
        if path := table.__dict__.get("_readloom_path"):
            delete_path(table.sparkSession, path)
            _written.remove(path)


def discard_since(spark: SparkSession, mark: int, keep: DataFrame | None = None) -> None:
    """Delete the scratch that came after scratch_mark() returned ``mark``, but for the table ``keep``.

    Spark deletes the shuffle files of queries that nothing refers to any more when the driver's JVM collects its garbage, hence now.
    """
    kept = None if keep is None else keep.__dict__.get("_readloom_path")
    for path in _written[mark:]:
        if path != kept:
            delete_path(spark, path)
    _written[mark:] = [] if kept is None else [kept]
    spark._jvm.System.gc()


def scratch_mark() -> int:
    return len(_written)


def note_scratch(path: str) -> str:
    """Have discard_since() delete this folder too."""
    _written.append(path)
    return path


def with_row_key(docs: DataFrame) -> DataFrame:
    """``docs`` with a unique key per row in column ROW.

    Rows of Parquet files have one in the number of their file and their place in it. Else the table is written with a key once, as a
    key that is computed again may differ.
    """
    if ROW in docs.columns:
        return docs
    try:
        files_alone = docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation"
        own = docs.select("*", F.col("_metadata.file_path").alias(_FILE), F.col("_metadata.row_index").alias(_PLACE)) if files_alone else None
    except AnalysisException:  # files without row numbers
        own = None
    if own is None:
        return materialize(docs.withColumn(ROW, F.monotonically_increasing_id()), "keyed")
    files = own.select(_FILE).distinct()
    number = F.row_number().over(W.orderBy(_FILE))  # one row per file
    files = materialize(files.select(_FILE, F.shiftleft(number.cast("long"), 40).alias(ROW)), "files")
    sent = F.broadcast(files) if files.count() <= 1 << 16 else files
    return own.join(sent, _FILE).withColumn(ROW, F.col(ROW) + F.col(_PLACE)).drop(_FILE, _PLACE)


def portions(b: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The rows of a batch a few at a time, so that what is made of them, here and in the JVM, stays small."""
    return (b.slice(at, rows) for at in range(0, b.num_rows, rows))


def releasing(run: Callable) -> Callable:
    """``run`` over batches; when it is through, the memory that it used goes back to the system, as the Python worker lives on with the next task."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release_memory()

    return wrapped


def release_memory() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of so many rows for what is run within; for rows that hold whole texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("")).cast("string")


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
