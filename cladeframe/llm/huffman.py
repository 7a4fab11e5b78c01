"""Token files: canonical length-limited Huffman codes of ids, made from their counts over the whole table.

A shard is one self-contained binary value:

    b"HUFT" | u32 version | u32 longest code | u32 vocabulary | u64 ids | u32 ids a block | u32 documents
    | u32 packed length of the code lengths | those lengths, one byte an id, deflated
    | u64 bit offset of each block | u64 ids of each document | the codes, first bit highest

Blocks hold a fixed number of ids and begin at the noted bits, so that any can be read alone; the
reader decodes all blocks of a shard side by side, one id of each per step, through one table.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import lean, slices, stash, tidy, unstash

MAGIC = b"HUFT"
HEAD = struct.Struct("<4sIIIQIII")
#: Longest code; the decoding table has two to this power entries.
LIMIT = 20
#: Text that is encoded at once, in bytes; larger slices repeat fewer words.
SLICE = 24 << 20
#: Ids a block and ids a shard (a longer document makes its shard longer).
BLOCK_IDS = 512
SHARD_IDS = 1 << 20


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most limit bits by package-merge; 0 for ids that never occur."""
    lengths = np.zeros(len(counts), dtype=np.uint8)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids do not fit codes of {limit} bits")
    used = used[np.argsort(counts[used], kind="stable")]
    weights = counts[used].astype(np.float64)
    packages = np.zeros(0)
    leaves_before: list[np.ndarray] = []
    for _ in range(limit):
        merged = np.concatenate([weights, packages])
        order = np.argsort(merged, kind="stable")
        leaves_before.append(np.concatenate([[0], np.cumsum(order < len(weights))]))
        merged = merged[order]
        packages = merged[0 : len(merged) // 2 * 2 : 2] + merged[1 : len(merged) // 2 * 2 : 2]
    take = 2 * len(used) - 2
    depth = np.zeros(len(used), dtype=np.uint8)
    for before in reversed(leaves_before):
        leaves = before[take]
        depth[:leaves] += 1
        take = 2 * (take - leaves)
    lengths[used] = depth
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then id."""
    codes = np.zeros(len(lengths), dtype=np.uint64)
    used = np.flatnonzero(lengths)
    if not len(used):
        return codes
    used = used[np.argsort(lengths[used], kind="stable")]
    longest = int(lengths[used[-1]])
    width = np.uint64(1) << (longest - lengths[used].astype(np.int64)).astype(np.uint64)
    start = np.cumsum(width) - width
    codes[used] = start // width
    return codes


def write_shard(ids: np.ndarray, doc_sizes: np.ndarray, lengths: np.ndarray, every: int = BLOCK_IDS) -> bytes:
    """One shard; doc_sizes sum to len(ids), and every id has a code."""
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    at = ends - size
    bits = int(ends[-1]) if len(ends) else 0
    shift = (32 - size - (at & 7)).astype(np.uint64)
    value = canonical(lengths)[ids] << shift
    out = np.zeros(bits // 8 + 5)
    for k in range(4):
        part = ((value >> np.uint64(24 - 8 * k)) & np.uint64(255)).astype(np.float64)
        out += np.bincount((at >> 3) + k, weights=part, minlength=len(out))[: len(out)]
    table = zlib.compress(lengths.tobytes())
    head = HEAD.pack(MAGIC, 1, int(lengths.max(initial=0)), len(lengths), len(ids), every, len(doc_sizes), len(table))
    return b"".join(
        [head, table, at[::every].astype("<u8").tobytes(), doc_sizes.astype("<u8").tobytes(), out.astype(np.uint8).tobytes()[: (bits + 7) // 8]]
    )


def read_shard(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a shard, and how many each of its documents has."""
    magic, version, longest, vocabulary, n, every, docs, packed = HEAD.unpack_from(data)
    if magic != MAGIC or version != 1:
        raise ValueError("not a shard of this format")
    at = HEAD.size
    lengths = np.frombuffer(zlib.decompress(data[at : at + packed]), dtype=np.uint8)
    blocks = -(-n // every)
    offsets = np.frombuffer(data, dtype="<u8", count=blocks, offset=at + packed).astype(np.int64)
    sizes = np.frombuffer(data, dtype="<u8", count=docs, offset=at + packed + 8 * blocks).astype(np.int64)
    if not n:
        return np.zeros(0, np.uint32), sizes
    body = np.frombuffer(data, dtype=np.uint8, offset=at + packed + 8 * (blocks + docs))
    body = np.concatenate([body, np.zeros(8, np.uint8)]).astype(np.uint32)
    words = body[:-3] << 24 | body[1:-2] << 16 | body[2:-1] << 8 | body[3:]
    used = np.flatnonzero(lengths)
    used = used[np.argsort(lengths[used], kind="stable")]
    symbol = np.zeros(1 << longest, dtype=np.uint32)
    step = np.ones(1 << longest, dtype=np.int64)
    span = np.int64(1) << (longest - lengths[used].astype(np.int64))
    symbol[: span.sum()] = np.repeat(used, span)
    step[: span.sum()] = np.repeat(lengths[used], span)
    out = np.empty((every, blocks), dtype=np.uint32)
    place = offsets.copy()
    last = len(words) - 1
    mask = (1 << longest) - 1
    for k in range(min(every, n)):
        window = (words[np.minimum(place >> 3, last)] >> (32 - longest - (place & 7)).astype(np.uint32)) & np.uint32(mask)
        out[k] = symbol[window]
        place += step[window]
    return out.T.reshape(-1)[:n], sizes


def _kind(path: str) -> str:
    """Two bytes an id where the vocabulary allows, else four."""
    return "<u2" if len(bpe.pieces_of(path)) <= 1 << 16 else "<u4"


def _tokenise(path: str, end_id: int, kind: str):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.UnitEncoder.of(path)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                ids, first = bpe.encode_texts(part.column("text"), encoder)
                ids = np.insert(ids, first[1:], end_id).astype(kind)
                first = first + np.arange(len(first))
                values = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), len(first) - 1, [None, pa.py_buffer(first * ids.itemsize), pa.py_buffer(ids)]
                )
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(first)), values.cast(pa.binary())], names=["doc_id", "n_tokens", "ids"]
                )

    return run


def _count(kind: str):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for part in slices(batch, "ids"):
                got = np.bincount(_ids(part.column("ids"), kind)[0], minlength=len(total))
                got[: len(total)] += total
                total = got
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["id", "n"])

    return run


def _ids(values: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = bpe.flat_bytes_of_binary(values.cast(pa.large_binary()))
    ids = np.frombuffer(data, dtype=kind)
    return ids, offsets // ids.itemsize


def _write(lengths: np.ndarray, shard_ids: int, every: int, kind: str):
    """Sorted documents to shards; one shard's ids are in memory at a time."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start, held = TaskContext.get().partitionId(), 0, []

        def shard() -> pa.RecordBatch:
            nonlocal start
            ids = np.concatenate([h[1] for h in held])
            sizes = np.concatenate([h[2] for h in held])
            doc_ids = pa.array([i for h in held for i in h[0].to_pylist()], pa.int64())
            listed = pa.ListArray.from_arrays(pa.array([0, len(doc_ids)], pa.int32()), doc_ids)
            out = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([start], pa.int64()), pa.array([len(ids)], pa.int64()), listed, pa.array([write_shard(ids, sizes, lengths, every)], pa.binary())],
                names=["part", "local_start", "n_ids", "doc_ids", "shard"],
            )
            start += len(ids)
            held.clear()
            return out

        n = 0
        for batch in batches:
            for piece in slices(batch, "ids", 4 * shard_ids):
                ids, first = _ids(piece.column("ids"), kind)
                held.append((piece.column("doc_id"), ids.copy(), np.diff(first)))
                n += len(ids)
                if n >= shard_ids:
                    yield shard()
                    n = 0
        if held:
            yield shard()

    return run


_SHARDS = "part int, local_start bigint, n_ids bigint, doc_ids array<bigint>, shard binary"


def write_tokens(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 0,
    limit: int = LIMIT,
    shard_ids: int = SHARD_IDS,
    every: int = BLOCK_IDS,
    partitions: int | None = None,
) -> DataFrame:
    """Encode every whole text, append end_id, and write shards in ascending order of id into the shared folder.

    Returns the written table: part, local_start (ids before the shard in its part), n_ids, doc_ids
    and shard. Parts follow each other in order of id; rows of one id are ordered by their tokens, so
    that a frequent id can lie in several parts. Null ids come first, a null text has the end id only;
    other columns are not read; an empty table writes no shard. Only the counts of the vocabulary's
    ids, at most its size, reach the driver.
    """
    spark = lean(docs.sparkSession, SLICE)
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    kind = _kind(path)
    tokens = stash(texts.mapInArrow(_tokenise(path, end_id, kind), "doc_id bigint, n_tokens bigint, ids binary"), "token-rows")
    counts = tokens.select("ids").mapInArrow(_count(kind), "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect()
    seen = np.zeros(max([r.id for r in counts], default=-1) + 1, dtype=np.int64)
    for r in counts:
        seen[r.id] = r.n
    lengths = code_lengths(seen, limit)
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = tokens.select("doc_id", F.xxhash64("ids").alias("h"), "ids")
    ordered = keyed.repartitionByRange(partitions, "doc_id", "h").sortWithinPartitions("doc_id", "h", "ids")
    shards = stash(ordered.drop("h").mapInArrow(_write(lengths, shard_ids, every, kind), _SHARDS), "token-shards")
    unstash(tokens)
    return shards


def read_tokens(shards: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (little-endian unsigned 32-bit
    integers) of every document, decoded from the shards, null and repeated ids as they were written; no
    shard gives no row. The driver sums the sizes of the parts, of which there are as many as partitions
    were written."""
    sizes = shards.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    before, total = {}, 0
    for r in sizes:
        before[r.part] = total
        total += r.n

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, n = read_shard(batch.column("shard")[row].as_py())
                ends = np.zeros(len(n) + 1, dtype=np.int64)
                np.cumsum(n, out=ends[1:])
                start = before[batch.column("part")[row].as_py()] + batch.column("local_start")[row].as_py()
                raw = ids.astype("<u4")
                values = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(ends * 4), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_ids")[row].values, pa.array(start + ends[:-1]), pa.array(n), values.cast(pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )

    return shards.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids binary")
