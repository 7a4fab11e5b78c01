"""Byte-level BPE through a table of distinct words.

A *unit* is a stretch of text that begins at a text's start, at a single space between two non-blank
characters, or at an ASCII sign behind an ASCII letter. The pre-tokeniser never joins characters
across such a place, so the ids of a text are the ids of its units in a row, whatever stands around.

encode_docs() splits documents into blocks of units coded by position, sends each block's distinct
units to the partition that owns them by hash, encodes every distinct unit there once, and joins the
ids back by position. decode_ids() joins ids with their pieces.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, flat_bytes, held, lean, let_go, ragged, slices, stash_by, tidy

#: Distinct units that one worker keeps encoded: as many used lately, and as many before them.
CACHE_UNITS = 400_000
#: Text in one block, in bytes; larger blocks repeat fewer words but take more memory.
BLOCK_BYTES = 8 << 20

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
#: First bytes of the characters above U+007F among which blanks are found.
_LEAD = np.zeros(256, dtype=bool)
_LEAD[[0xC2, 0xE1, 0xE2, 0xE3]] = True
#: ASCII letters (1) and signs (2); not the bar, which stands inside the name of a special token.
_SORT = np.zeros(256, dtype=np.uint8)
_SORT[65:91] = _SORT[97:123] = 1
_SORT[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) != "|"]] = 2


def split_units(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All units of all texts in order, and the index of each text's first one (one more at the end)."""
    data, offsets = flat_bytes(texts)
    n = len(data)
    at = np.flatnonzero(data == 32)
    at = at[(at > 0) & (at < n - 1)]
    before, after = data[at - 1], data[at + 1]
    ok = ~_BLANK[before] & ~_BLANK[after] & ~_LEAD[after]
    ok &= ~((before >= 128) & (_LEAD[data[np.maximum(at - 2, 0)]] | _LEAD[data[np.maximum(at - 3, 0)]]))
    mark = np.zeros(n + 1, dtype=bool)
    mark[offsets] = True
    mark[at[ok]] = True
    sort = _SORT[data]
    mark[1:n] |= (sort[:-1] == 1) & (sort[1:] == 2)
    bounds = np.flatnonzero(mark)
    units = pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data)))
    return units, np.searchsorted(bounds, offsets)


class UnitEncoder:
    """Encodes units with the tokenizers library; most of them many to a call, parted by newlines."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        gap = self._plain(["\n"])[0]
        self.gap = int(gap[0]) if len(gap) == 1 else None

    @classmethod
    def of(cls, path: str) -> UnitEncoder:
        """The worker's own encoder for a file, with what it has encoded so far."""
        return held(("units", path), lambda: cls(path))

    def forget(self) -> None:
        self.recent, self.older = {}, {}

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def fresh(self, units: list[str]) -> list[bytes]:
        """Ids of each unit as little-endian unsigned 32-bit integers."""
        out: list[bytes | None] = [None] * len(units)
        easy = [
            i
            for i, u in enumerate(units)
            if self.gap is not None and "\n" not in u and u and not u[-1].isspace() and not u[:2].isspace() and (u[0] == " " or not u[0].isspace())
        ]
        groups = [easy[i : i + 1000] for i in range(0, len(easy), 1000)]
        for group, ids in zip(groups, self._plain(["\n".join([units[i] for i in g]) for g in groups])):
            ends = np.flatnonzero(ids == self.gap)
            if len(ends) == len(group) - 1:
                raw, bounds = ids.tobytes(), [0, *(4 * (ends + 1)).tolist(), 4 * (len(ids) + 1)]
                for k, i in enumerate(group):
                    out[i] = raw[bounds[k] : bounds[k + 1] - 4]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, ids in zip(rest, self._plain([units[i] for i in rest])):
            out[i] = ids.tobytes()
        return out

    def encode(self, units: list[str]) -> list[bytes]:
        recent, older = self.recent, self.older
        out = [recent.get(u) for u in units]
        missing = [i for i, x in enumerate(out) if x is None]
        if len(recent) + len(missing) > CACHE_UNITS and recent:
            self.older, self.recent = recent, {}
        new = []
        for i in missing:
            out[i] = older.get(units[i])
            if out[i] is None:
                new.append(i)
        for i, ids in zip(new, self.fresh([units[i] for i in new])):
            out[i] = ids
        if self.recent is recent:
            recent.update((units[i], out[i]) for i in missing)
        else:
            self.recent.update(zip(units, out))
        return out


def spelled(codes: np.ndarray, ids: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of coded units in a row, and how many each unit has."""
    lengths = np.array([len(x) for x in ids], dtype=np.int64) // 4
    flat = np.frombuffer(b"".join(ids), dtype=np.uint32)
    at, n = ragged(codes, np.cumsum(lengths) - lengths, lengths)
    return flat[at], n


def encode_texts(texts: pa.Array, encoder: UnitEncoder) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row, and where each text's begin (one more at the end)."""
    units, first = split_units(texts)
    coded = pc.dictionary_encode(units)
    ids, n = spelled(coded.indices.to_numpy(), encoder.encode(coded.dictionary.to_pylist()))
    ends = np.zeros(len(n) + 1, dtype=np.int64)
    np.cumsum(n, out=ends[1:])
    return ids, ends[first]


def byte_table() -> dict[str, int]:
    """The byte that each character of a byte-level piece stands for."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def pieces_of(path: str) -> list[bytes]:
    """Bytes of each id's piece; the vocabulary file bounds their number."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    table = byte_table()
    names = {i: piece for piece, i in spec["model"]["vocab"].items()} | {a["id"]: a["content"] for a in spec["added_tokens"]}
    out = [b""] * (max(names) + 1)
    for i, piece in names.items():
        out[i] = bytes(table[c] for c in piece) if all(c in table for c in piece) else piece.encode()
    return out


def _packed(*arrays: bytes) -> bytes:
    head = np.array([len(a) for a in arrays], dtype=np.uint32).tobytes()
    return zstandard.ZstdCompressor(level=6).compress(head + b"".join(arrays))


def _rank_bytes(ranks: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Small numbers in one byte: seven bits and a flag, then eight bits more, then 32 where those are full."""
    large = ranks >= 128
    first = np.where(large, ranks & 127 | 128, ranks).astype(np.uint8)
    high = ranks[large] >> 7
    return first.tobytes(), np.minimum(high, 255).astype(np.uint8).tobytes(), high[high >= 255].astype("<u4").tobytes()


def _ranks(first: memoryview, second: memoryview, third: memoryview) -> np.ndarray:
    head = np.frombuffer(first, dtype=np.uint8)
    high = np.frombuffer(second, dtype=np.uint8).astype(np.int64)
    high[high == 255] = np.frombuffer(third, dtype="<u4")
    ranks = (head & 127).astype(np.int64)
    ranks[head >= 128] += high << 7
    return ranks


def _unpacked(data: bytes, n: int) -> list[memoryview]:
    raw = memoryview(zstandard.ZstdDecompressor().decompress(data))
    sizes = np.frombuffer(raw[: 4 * n], dtype=np.uint32)
    ends = np.cumsum(sizes) + 4 * n
    return [raw[int(e - s) : int(e)] for s, e in zip(sizes, ends)]


_BLOCK = pa.schema(
    [
        ("block", pa.string()),
        ("doc_ids", pa.list_(pa.int64())),
        ("codes", pa.binary()),
        ("owners", pa.binary()),
        ("parts", pa.list_(pa.struct([("bucket", pa.int32()), ("words", pa.binary())]))),
    ]
)
_BLOCK_DDL = "block string, doc_ids array<bigint>, codes binary, owners binary, parts array<struct<bucket:int,words:binary>>"


def _code_blocks(buckets: int):
    """Documents to blocks: units coded by rank of frequency, and the distinct units dealt out to buckets."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            for part in slices(batch, "text", BLOCK_BYTES):
                units, first = split_units(part.column("text"))
                coded = pc.dictionary_encode(units)
                codes, words = coded.indices.to_numpy(), coded.dictionary
                order = np.argsort(-np.bincount(codes, minlength=len(words)), kind="stable")
                rank = np.empty(len(words), dtype=np.uint32)
                rank[order] = np.arange(len(words), dtype=np.uint32)
                words = words.take(pa.array(order))
                owner = np.array([zlib.crc32(w.as_buffer()) for w in words], dtype=np.int64) % buckets
                dealt = np.argsort(owner, kind="stable")
                cuts = np.searchsorted(owner[dealt], np.arange(buckets + 1))
                parts = []
                for b in np.flatnonzero(np.diff(cuts)):
                    data, bounds = flat_bytes(words.take(pa.array(dealt[cuts[b] : cuts[b + 1]])))
                    parts.append({"bucket": int(b), "words": _packed(np.diff(bounds).astype(np.uint32).tobytes(), data.tobytes())})
                yield pa.RecordBatch.from_pylist(
                    [
                        {
                            "block": uuid.uuid4().hex,
                            "doc_ids": part.column("doc_id").to_pylist(),
                            "codes": _packed(np.diff(first).astype(np.uint32).tobytes(), *_rank_bytes(rank[codes])),
                            "owners": _packed(owner.astype(np.uint16).tobytes()),
                            "parts": parts,
                        }
                    ],
                    schema=_BLOCK,
                )

    return run


def _encode_words(path: str):
    """Each row holds one block's distinct units of one bucket; each distinct unit is encoded once."""
    schema = pa.schema([("block", pa.string()), ("bucket", pa.int32()), ("ids", pa.binary())])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = UnitEncoder.of(path)
        for batch in batches:
            out = []
            for words in batch.column("words"):
                sizes, data = _unpacked(words.as_buffer(), 2)
                bounds = np.concatenate([[0], np.cumsum(np.frombuffer(sizes, dtype=np.uint32), dtype=np.int64)])
                units = pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds), pa.py_buffer(bytes(data)))
                ids = encoder.encode(units.to_pylist())
                lengths = np.array([len(x) // 4 for x in ids], dtype=np.uint32)
                out.append(_packed(lengths.tobytes(), b"".join(ids)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("block"), batch.column("bucket"), pa.array(out, pa.binary())], schema=schema
            )
        encoder.forget()  # no other task of this stage owns these units

    return run


@tidy
def _join_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with the ids of their distinct units to documents with theirs."""
    let_go()
    for batch in batches:
        for row in range(batch.num_rows):
            block = {c: batch.column(c)[row].as_py() for c in ("doc_ids", "codes", "owners", "replies")}
            counts, *coded = _unpacked(block["codes"], 4)
            codes = _ranks(*coded)
            owner = np.frombuffer(_unpacked(block["owners"], 1)[0], dtype=np.uint16)
            dealt = np.argsort(owner, kind="stable")
            lengths, flats = [], []
            for reply in sorted(block["replies"] or [], key=lambda r: r["bucket"]):
                n, flat = _unpacked(reply["ids"], 2)
                lengths.append(np.frombuffer(n, dtype=np.uint32))
                flats.append(np.frombuffer(flat, dtype=np.uint32))
            by_bucket = np.concatenate([*lengths, np.zeros(0, np.uint32)]).astype(np.int64)
            flat = np.concatenate([*flats, np.zeros(0, np.uint32)])
            n_ids, starts = np.empty_like(by_bucket), np.empty_like(by_bucket)
            n_ids[dealt], starts[dealt] = by_bucket, np.cumsum(by_bucket) - by_bucket
            at, n = ragged(codes, starts, n_ids)
            unit_ends = np.zeros(len(n) + 1, dtype=np.int64)
            np.cumsum(n, out=unit_ends[1:])
            first = np.concatenate([[0], np.cumsum(np.frombuffer(counts, dtype=np.uint32), dtype=np.int64)])
            bounds = unit_ends[first]
            ids = pa.LargeBinaryArray.from_buffers(
                pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds * 4), pa.py_buffer(flat[at].astype("<u4"))]
            )
            yield pa.RecordBatch.from_arrays(
                [pa.array(block["doc_ids"], pa.int64()), pa.array(np.diff(bounds)), ids.cast(pa.binary())],
                names=["doc_id", "n_tokens", "ids"],
            )


def encode_docs(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit integers) of every row, as the tokenizers
    library gives them for the whole text without special tokens added.

    Words go to `buckets` owners by hash, twice the session's shuffle partitions unless given. What
    moves is coded and packed: per block its distinct units to their owners, their ids back, and the
    coded positions not at all, for they are written bucketed by block. A null text is empty; null and repeated ids pass through; other columns
    are not read; an empty table gives an empty result.
    """
    spark = lean(docs.sparkSession, BLOCK_BYTES)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = min(buckets or max(64, 2 * partitions), 1 << 16)
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    blocks = stash_by(texts.mapInArrow(_code_blocks(buckets), _BLOCK_DDL), "block", partitions, "bpe-blocks")
    words = blocks.select("block", F.inline("parts"))
    replies = words.repartition("bucket").mapInArrow(_encode_words(path), "block string, bucket int, ids binary")
    replies = replies.groupBy("block").agg(F.collect_list(F.struct("bucket", "ids")).alias("replies"))
    joined = blocks.drop("parts").join(replies, "block", "left")
    return joined.mapInArrow(_join_ids, "doc_id bigint, n_tokens bigint, ids binary")


def decode_ids(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """encoded with a column decoded: the text of the ids, each joined with its piece. The join is a lookup
    by id in the table of pieces, which is as large as the vocabulary file, whatever the data, and is
    sent to every worker. Ids without a piece add nothing; bytes that are no UTF-8 become U+FFFD; null ids
    give an empty text; a column named decoded is replaced; an empty table gives an empty result."""
    pieces = encoded.sparkSession.sparkContext.broadcast(pieces_of(path))
    names = [c for c in encoded.columns if c != "decoded"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema if f.name != "decoded")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = np.array([len(p) for p in pieces.value], dtype=np.int64)
        flat = np.frombuffer(b"".join(pieces.value), dtype=np.uint8)
        starts = np.cumsum(lengths) - lengths
        for batch in batches:
            for part in slices(batch, ids_col, SLICE_BYTES // 8):
                raw = pc.fill_null(pc.cast(part.column(ids_col), pa.large_binary()), b"")
                data, offsets = flat_bytes_of_binary(raw)
                ids = np.frombuffer(data, dtype="<u4").astype(np.int64)
                ids[ids >= len(lengths)] = len(lengths)
                at, n = ragged(ids, np.append(starts, 0), np.append(lengths, 0))
                ends = np.zeros(len(n) + 1, dtype=np.int64)
                np.cumsum(n, out=ends[1:])
                bounds = ends[offsets // 4]
                out = flat[at]
                text = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(out)]
                )
                try:
                    text = text.cast(pa.large_string()).cast(pa.string())
                except pa.ArrowInvalid:
                    text = pa.array([b.decode("utf-8", "replace") for b in text.to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], text], names=[*names, "decoded"])

    return encoded.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(run, f"{schema}, decoded string")


def flat_bytes_of_binary(values: pa.Array) -> tuple[bytes, np.ndarray]:
    """The bytes of all values in a row, and where each begins."""
    buffers = values.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[values.offset : values.offset + len(values) + 1]
    data = memoryview(buffers[2]) if buffers[2] is not None else memoryview(b"")
    return data[int(offsets[0]) : int(offsets[-1])], offsets - offsets[0]
