"""Aligned FASTA by windows of columns: an index of where each window of a record lies, and its reader.

The index is made in one pass over the files, in ranges of bytes that any executor can scan; a record belongs
to the range in which its header begins. No row ever holds more than a window of a sequence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe.scratch import written
from cladeframe.sources.text import read_fasta, same_width

#: Bytes of a file that one task scans or reads, and bytes taken at a time.
RANGE, CHUNK = 64 << 20, 1 << 20
#: Columns of a window.
WIDTH = 20_000
_BLANKS = bytes(range(33))
INDEX = "file string, at long, name string, n_bases long, window int, start long, end long"


def _open(file: str) -> pa.NativeFile:
    """A file by its URI, as Spark lists it."""
    uri = "file://" + file[len("file:") :] if file.startswith("file:/") and not file.startswith("file://") else file
    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)


def _next_header(f: pa.NativeFile, lo: int) -> int | None:
    """The first byte from lo on at which a > begins a line."""
    f.seek(max(lo - 1, 0))
    at, fresh = max(lo - 1, 0), lo == 0
    while data := f.read(CHUNK):
        if fresh and data[:1] == b">":
            return at
        found = data.find(b"\n>")
        if found >= 0:
            return at + found + 1
        fresh = data.endswith(b"\n")
        at += len(data)
    return None


def _header(f: pa.NativeFile, at: int) -> tuple[str, int]:
    """The name of the record at a byte, up to its first blank, and where its bases begin."""
    f.seek(at)
    line = b""
    while b"\n" not in line and (data := f.read(1024)):
        line += data
    end = line.find(b"\n")
    line = line if end < 0 else line[:end]
    words = line[1:].decode(errors="replace").split(maxsplit=1)
    name = words[0] if words and not line[1:2].isspace() else ""
    return name, at + len(line) + (end >= 0)


def _body(f: pa.NativeFile, at: int, width: int) -> tuple[list[int], int, int, int | None]:
    """The bytes at which a record's windows begin, where its bases end, their number, and the next header."""
    f.seek(at)
    starts: list[int] = []
    n, fresh = 0, True
    while data := f.read(CHUNK):
        cut = 0 if fresh and data[:1] == b">" else (data.find(b"\n>") + 1 or None)
        places = np.flatnonzero(np.frombuffer(data[:cut], dtype=np.uint8) > 32)
        starts += (at + places[-n % width :: width]).tolist()
        n += len(places)
        if cut is not None:
            return starts, at + cut, n, at + cut
        fresh = data.endswith(b"\n")
        at += len(data)
    return starts, at, n, None


def _records(file: str, lo: int, hi: int, width: int) -> Iterator[tuple]:
    """Rows of INDEX of the records whose headers begin in a range of bytes."""
    with _open(file) as f:
        at = _next_header(f, lo)
        while at is not None and at < hi:
            name, begin = _header(f, at)
            starts, end, n, following = _body(f, begin, width)
            starts = starts or [end]
            yield from ((file, at, name, n, k, a, b) for k, (a, b) in enumerate(zip(starts, [*starts[1:], end])))
            at = following


def _scan(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, lo, hi in zip(*(batch.column(c).to_pylist() for c in ("file", "lo", "hi"))):
                for rows in _grouped(_records(file, lo, hi, width), lambda r: 1, 1 << 14):
                    yield _batch(rows, _SCHEMA)

    return run


def _grouped(rows: Iterator[tuple], size, most: int) -> Iterator[list[tuple]]:
    """rows in lists whose sizes sum up to `most` or a little more."""
    held, total = [], 0
    for r in rows:
        held.append(r)
        total += size(r)
        if total >= most:
            yield held
            held, total = [], 0
    if held:
        yield held


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


_SCHEMA = pa.schema(
    [("file", pa.string()), ("at", pa.int64()), ("name", pa.string()), ("n_bases", pa.int64()), ("window", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]
)
_TEXT = pa.schema([("name", pa.string()), ("window", pa.int32()), ("seq", pa.string())])


def index_fasta(spark: SparkSession, path: str, width: int = WIDTH, size: int = RANGE) -> DataFrame:
    """file, at (of the header), name, n_bases, window (from 0), start and end (bytes) of every window of `width`
    columns of every record; lines may have any length, a record without bases has one empty window, a name that
    comes again replaces the one before. Files are scanned in ranges of `size` bytes."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length").where("length > 0")
    lo = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(size).cast("bigint"))).alias("lo")
    ranges = files.select("file", lo).withColumn("hi", F.col("lo") + size)
    found = written(ranges.repartition(max(1, ranges.count()), "file", "lo").mapInArrow(_scan(width), INDEX))
    last = found.groupBy("name").agg(F.max(F.struct("file", "at")).alias("x")).select("name", "x.file", "x.at")
    return found.join(last, ["name", "file", "at"], "left_semi").select([f.name for f in _SCHEMA])


def _texts(rows: Iterator[tuple]) -> Iterator[tuple[str, int, str]]:
    """name, window and bases of (name, window, file, start, end), one file open at a time."""
    name, f = None, None
    try:
        for who, window, file, start, end in rows:
            if file != name:
                if f is not None:
                    f.close()
                name, f = file, _open(file)
            f.seek(start)
            yield who, window, f.read(end - start).translate(None, _BLANKS).decode()
    finally:
        if f is not None:
            f.close()


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    columns = ("name", "window", "file", "start", "end")
    rows = (r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in columns)))
    for held in _grouped(_texts(rows), lambda r: len(r[2]), 4 << 20):
        yield _batch(held, _TEXT)


def read_index(index: DataFrame, windows: list[int] | None = None) -> DataFrame:
    """name, window and seq of the windows of an index, all or those listed; only their bytes are read."""
    rows = index if windows is None else index.where(F.col("window").isin(windows))
    total = rows.agg(F.sum(F.col("end") - F.col("start"))).first()[0] or 0
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-total // RANGE))
    return rows.repartition(tasks, "file", "start").sortWithinPartitions("file", "start").mapInArrow(_read, "name string, window int, seq string")


def cut(rows: DataFrame, width: int = WIDTH) -> DataFrame:
    """name, window and seq of whole sequences (name, seq); an empty one has one empty window."""
    last = F.greatest(F.ceil(F.length("seq") / width).cast("int") - 1, F.lit(0))
    each = rows.select("name", "seq", F.explode(F.sequence(F.lit(0), last)).alias("window"))
    return each.select("name", "window", F.substring("seq", F.col("window") * width + 1, F.lit(width)).alias("seq"))


def read_windows(spark: SparkSession, path: str, width: int = WIDTH) -> DataFrame:
    """name, window and seq of every record of aligned FASTA; ValueError where records differ in length. Files in gzip,
    which cannot be read from the middle, are read whole and then cut."""
    packed = spark.read.format("binaryFile").load(path).where(F.lower("path").endswith(".gz")).select("path")
    if not packed.isEmpty():
        return cut(same_width(read_fasta(spark, path)), width)
    index = written(index_fasta(spark, path, width))
    sizes = index.agg(F.min("n_bases"), F.max("n_bases")).first()
    if sizes[0] != sizes[1]:
        raise ValueError(f"sequences of different lengths: {sizes[0]} and {sizes[1]}")
    return read_index(index)
