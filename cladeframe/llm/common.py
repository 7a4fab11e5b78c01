"""Shared pieces: the scratch folder, Arrow slices and word splitting on bytes."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Text handled at once inside a Python worker, in bytes; one longer text is a slice of its own.
SLICE_BYTES = 8 << 20
#: Rows that pass between the JVM and a worker at once, in bytes; one larger row is a batch of its own.
BATCH_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor sees, spark.checkpoint.dir. A session in one process may leave it unset, and a
    folder is made; on a cluster that raises RuntimeError."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="cladeframe-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def lean(spark: SparkSession, size: int = BATCH_BYTES) -> SparkSession:
    """Batches of so many bytes at most between the JVM and Python, in place of Spark's 64 MB."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
    return spark


_held: dict = {}


def held(key, make: Callable):
    """What make() gives, kept in this worker until another key is asked for: a worker holds one table at a time."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def let_go() -> None:
    """For tasks that keep nothing: drop what tasks of another kind have left in this worker."""
    _held.clear()


def tidy(run: Callable) -> Callable:
    """run, a generator over batches, with freed memory given back to the system before it begins and when it ends."""

    @wraps(run)
    def wrapped(*args):
        _trim()
        yield from run(*args)
        _trim()

    return wrapped


def _trim() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not glibc
        pass


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write df once into the shared folder and read it back, so that later steps start from files."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._stash_path = path
    return back


def stash_by(df: DataFrame, key: str, buckets: int, name: str) -> DataFrame:
    """stash(), dealt by key into buckets, so that a join on key need not move these rows again."""
    spark = df.sparkSession
    label = f"cladeframe_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.bucketBy(buckets, key).format("parquet").option("compression", "zstd").option("path", path)
    writer.saveAsTable(label)
    back = spark.table(label)
    back.schema
    spark.sql(f"DROP TABLE {label}")  # its files stay
    back._stash_path = path
    return back


def unstash(df: DataFrame) -> None:
    """Delete what stash() wrote for df; only once nothing reads it any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._stash_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES, field: str | None = None) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch whose texts, in a column or in a field of one, sum to about limit bytes."""
    if not batch.num_rows:
        return
    texts = batch.column(column) if field is None else pc.struct_field(batch.column(column), field)
    size = np.asarray(pc.fill_null(pc.cast(pc.binary_length(texts), pa.int64()), 0))
    group = (np.cumsum(size) - size) // limit
    cuts = np.flatnonzero(np.diff(group)) + 1
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
        yield batch.slice(int(a), int(b - a))


def flat_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row, and where each begins; null is empty."""
    texts = pc.fill_null(pc.cast(texts, pa.large_string()), "")
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def byte_words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes marked by the 256-entry table inside, never across two texts.

    Returns the words, the index of each text's first word (one more at the end), and each
    word's first byte and end in data. Bytes above 127 must be all in or all out.
    """
    n = len(data)
    mask = inside[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(n + 1, dtype=bool)
    before[0], before[1:] = False, mask
    after = np.empty(n + 1, dtype=bool)
    after[n], after[:n] = False, mask
    start = np.flatnonzero(after & (~before | edge))
    end = np.flatnonzero(before & (~after | edge))
    kept = data[mask]
    bounds = np.zeros(len(start) + 1, dtype=np.int64)
    np.cumsum(end - start, out=bounds[1:])
    words = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(kept)))
    return words, np.searchsorted(start, offsets, side="left"), start, end


def ragged(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions that spell out, for each code in turn, its run [starts, starts + lengths); and the runs' lengths."""
    n = lengths[codes]
    total = int(n.sum())
    ends = np.cumsum(n)
    at = np.arange(total, dtype=np.int64) + np.repeat(starts[codes] - (ends - n), n)
    return at, n
