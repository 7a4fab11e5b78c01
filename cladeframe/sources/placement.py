"""Placement records in their binary form: a protobuf message of a tree's newick and a list of mutations for
every node in pre-order. A message may be cut between fields, so each node's list is a record of its own."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Keys (field number and wire type) of the message and of a mutation.
NEWICK, LIST, MUTATION = 0x0A, 0x12, 0x0A
POSITION, REF, PARENT, NUCS = 0x08, 0x10, 0x18, 0x22
#: Bytes that pass through the driver at once.
CHUNK = 1 << 20

_RECORD = pa.schema([("tree_id", pa.int32()), ("preorder_idx", pa.int32()), ("record", pa.binary())])
_ROW = pa.schema([("tree_id", pa.int32()), ("preorder_idx", pa.int32()), ("position", pa.int64()), ("ref_nuc", pa.int32()), ("par_nuc", pa.int32()), ("mut_nuc", pa.list_(pa.int32()))])
_ROW_DDL = "tree_id int, preorder_idx int, position bigint, ref_nuc int, par_nuc int, mut_nuc array<int>"


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def field(key: int, body: bytes) -> bytes:
    return bytes([key]) + varint(len(body)) + body


def mutation(position: int, ref: int, parent: int, nucs: list[int]) -> bytes:
    """Fields that are 0, and no bases, are left out."""
    numbers = b"".join(bytes([k]) + varint(v) for k, v in ((POSITION, position), (REF, ref), (PARENT, parent)) if v)
    return field(MUTATION, numbers + (field(NUCS, b"".join(map(varint, nucs))) if nucs else b""))


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Key and value, a number or bytes, of every field; ValueError for another wire type or a cut field."""
    at, end = 0, len(data)

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            if at >= end:
                raise ValueError("a field is cut")
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < end:
        key = number()
        if key & 7 == 0:
            yield key, number()
        elif key & 7 == 2:
            size = number()
            if at + size > end:
                raise ValueError("a field is cut")
            yield key, data[at : at + size]
            at += size
        else:
            raise ValueError(f"wire type {key & 7}")


def mutations_in(record: bytes) -> Iterator[tuple[int, int, int, list[int]]]:
    """Position, reference, parent and bases of every mutation of one node's list."""
    for key, body in fields(record):
        if key == MUTATION:
            found, nucs = dict.fromkeys((POSITION, REF, PARENT), 0), []
            for k, v in fields(body):
                if k == NUCS:
                    nucs += unpacked(v)
                elif k == NUCS & ~7:
                    nucs.append(v)
                elif k in found:
                    found[k] = v
            yield found[POSITION], found[REF], found[PARENT], nucs


def unpacked(packed: bytes) -> list[int]:
    """Numbers that stand one after another."""
    out, value, shift = [], 0, 0
    for byte in packed:
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            out.append(value)
            value = shift = 0
    if shift:
        raise ValueError("a field is cut")
    return out


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, body, done = None, bytearray(), []

    def give() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), _RECORD)], schema=_RECORD)
        done.clear()
        return batch

    for batch in batches:
        for tree, pre, position, ref, parent, nucs in zip(*(batch.column(n).to_pylist() for n in _ROW.names)):
            if (tree, pre) != now:
                if now is not None:
                    done.append((*now, field(LIST, bytes(body))))
                now, body = (tree, pre), bytearray()
            if position is not None:
                body += mutation(position, ref, parent, nucs)
        if done:
            yield give()
    if now is not None:
        done.append((*now, field(LIST, bytes(body))))
        yield give()


def records(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """tree_id, preorder_idx and record, the bytes of its list, of every node, from placement rows (_ROW); a node
    without rows has an empty list. A list is in order of position."""
    every = nodes.select("tree_id", F.col("pre").alias("preorder_idx"), *[F.lit(None).cast(t).alias(c) for c, t in (("position", "bigint"), ("ref_nuc", "int"), ("par_nuc", "int"), ("mut_nuc", "array<int>"))])
    own = rows.select("tree_id", "preorder_idx", F.col("position").cast("bigint").alias("position"), F.col("ref_nuc").cast("int").alias("ref_nuc"), F.col("par_nuc").cast("int").alias("par_nuc"), F.col("mut_nuc").cast("array<int>").alias("mut_nuc"))
    dealt = every.unionByName(own).repartitionByRange("tree_id", "preorder_idx").sortWithinPartitions("tree_id", "preorder_idx", "position", "ref_nuc", "par_nuc")
    return dealt.mapInArrow(_encode, "tree_id int, preorder_idx int, record binary")


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [
            (tree, pre, *found)
            for tree, pre, record in zip(*(batch.column(n).to_pylist() for n in _RECORD.names))
            for key, body in fields(record) if key == LIST
            for found in mutations_in(body)
        ]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _ROW)], schema=_ROW)


def rows_of(kept: DataFrame) -> DataFrame:
    """The placement rows of records(); those of different nodes may come in any order and files."""
    return kept.select(*_RECORD.names).mapInArrow(_decode, _ROW_DDL)


def write_file(newick: str, kept: DataFrame, path: str) -> None:
    """One tree's message as a file, gzip if the name ends in .gz: the driver passes the records' bytes on, a partition at
    a time, to the store that the path names."""
    spark = kept.sparkSession
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    press = zlib.compressobj(wbits=31) if path.endswith(".gz") else None

    def put(data: bytes) -> None:
        data = data if press is None else press.compress(data)
        if data:
            out.write(bytearray(data))

    held = bytearray(field(NEWICK, newick.encode()))
    for row in kept.orderBy("preorder_idx").select("record").toLocalIterator():
        held += row.record
        if len(held) >= CHUNK:
            put(bytes(held))
            held.clear()
    put(bytes(held))
    if press is not None:
        out.write(bytearray(press.flush()))
    out.close()


def read_file(spark: SparkSession, path: str, tree_id: int = 0) -> DataFrame:
    """Placement rows of a message's file, plain or gzip. A message has no index, so one task reads a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                data = content.as_py()
                data = zlib.decompress(data, 31) if data[:2] == b"\x1f\x8b" else data
                lists = (body for key, body in fields(data) if key == LIST)
                for pre, body in enumerate(lists):
                    out = [(tree_id, pre, *found) for found in mutations_in(body)]
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _ROW)], schema=_ROW)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, _ROW_DDL)
