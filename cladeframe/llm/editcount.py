"""Token counts that follow edits: a segment tree over each document's pre-tokens.

A leaf holds a stretch of whole units (see bpe) with its characters and tokens; inner nodes hold sums.
An edit re-splits and re-encodes the leaves that it touches and one on either side, because a unit's
bounds depend on the characters next to it, and then updates the sums above them.

grow_trees() makes the trees of documents as rows (the text, and each leaf's characters and tokens)
that can be written and read again; edit_trees() takes such rows and gives them as edits leave them,
so that later edits start from kept counts and never encode a document anew.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import lean, slices, stash, tidy

#: Characters in a leaf as it is built, and at most, in more than one unit, before leaves are parted anew.
LEAF_CHARS, MOST_CHARS = 96, 4096

EDITS = "array<struct<seq:bigint,start:bigint,stop:bigint,text:string>>"


def _sums(level: list[int]) -> list[int]:
    """Nodes of a tree over leaves, whose number is a power of two: the root at 1, the children of i at 2i and 2i + 1."""
    out = level
    while len(level) > 1:
        level = [a + b for a, b in zip(level[::2], level[1::2])]
        out = level + out
    return [0, *out]


class CountTree:
    """Token count of one text under edits. encode gives each of a list of units its ids."""

    def __init__(self, leaves: list[str], tokens: list[int], encode):
        self.encode = encode
        self.reencoded = 0
        self._build(leaves, tokens)

    def _build(self, leaves: list[str], tokens: list[int]) -> None:
        self.size = 1 << max(0, len(leaves) - 1).bit_length()
        pad = self.size - len(leaves)
        self.leaves = leaves + [""] * pad
        self.chars = _sums([len(x) for x in self.leaves])
        self.tokens = _sums(tokens + [0] * pad)

    def _sum(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def text(self) -> str:
        return "".join(self.leaves)

    def _find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character at (the last for one past the end), and the characters before it."""
        i, before = 1, 0
        while i < self.size:
            i *= 2
            if at - before >= self.chars[i] and self.chars[i + 1]:
                before += self.chars[i]
                i += 1
        return i - self.size, before

    def _near(self, leaf: int, step: int) -> int:
        """The next leaf that holds text in the direction of step, or the last one there is."""
        at = leaf + step
        while 0 <= at < self.size and not self.leaves[at]:
            at += step
        return min(max(at, 0), self.size - 1)

    def edit(self, start: int, stop: int, text: str) -> None:
        """Replace characters [start, stop), clipped to the text as it is now."""
        edit_together([(self, start, stop, text)], self.encode)

    def opened(self, start: int, stop: int, text: str) -> tuple[int, int, str]:
        """The leaves that an edit touches, with one on either side, and what they are to hold."""
        length = self.chars[1]
        start = min(max(start, 0), length)
        stop = min(max(stop, start), length)
        first, before = self._find(start)
        last, _ = self._find(max(start, stop - 1))
        low, high = self._near(first, -1), self._near(last, 1)
        before -= sum(self.chars[self.size + k] for k in range(low, first))
        old = "".join(self.leaves[low : high + 1])
        return low, high, old[: start - before] + text + old[stop - before :]

    def closed(self, low: int, high: int, units: list[str], counts: list[int]) -> None:
        """Put units with their tokens in place of what leaves low to high hold."""
        self.reencoded += len(units)
        room = high - low + 1
        ends = list(accumulate(map(len, units)))
        share = max(1, -(-(ends[-1] if ends else 0) // room))
        bounds = [0, *(bisect_left(ends, k * share) for k in range(1, room)), len(units)]
        for k in range(room):
            a, b = bounds[k], bounds[k + 1]
            self.leaves[low + k] = "".join(units[a:b])
            self.chars[self.size + low + k] = len(self.leaves[low + k])
            self.tokens[self.size + low + k] = sum(counts[a:b])
        touched = {(self.size + k) // 2 for k in range(low, high + 1)}
        while touched and touched != {0}:
            for i in touched:
                self._sum(i)
            touched = {i // 2 for i in touched if i > 1}
        sizes = self.chars[self.size + low : self.size + high + 1]
        if any(size > MOST_CHARS and bounds[k + 1] - bounds[k] > 1 for k, size in enumerate(sizes)):
            self._part(low, high, units, counts)

    def _part(self, low: int, high: int, units: list[str], counts: list[int]) -> None:
        """Build the tree over finer leaves from low to high, whose units and counts are known; nothing is encoded."""
        leaves, tokens = [], []
        for text, n in zip(units, counts):
            if leaves and len(leaves[-1]) + len(text) <= LEAF_CHARS:
                leaves[-1] += text
                tokens[-1] += n
            else:
                leaves.append(text)
                tokens.append(n)
        old = [(x, self.tokens[self.size + k]) for k, x in enumerate(self.leaves) if x and not low <= k <= high]
        front = sum(1 for x in self.leaves[:low] if x)
        full = [*old[:front], *zip(leaves, tokens), *old[front:]] or [("", 0)]
        self._build([x for x, _ in full], [n for _, n in full])

    def parts(self) -> tuple[str, list[int], list[int]]:
        """The text, and the characters and tokens of its leaves that hold some."""
        kept = [k for k, x in enumerate(self.leaves) if x]
        return self.text(), [len(self.leaves[k]) for k in kept], [self.tokens[self.size + k] for k in kept]

    @classmethod
    def of(cls, text: str, chars: list[int], tokens: list[int], encode) -> CountTree:
        """The tree that parts() has come from."""
        ends = list(accumulate(chars, initial=0))
        return cls([text[a:b] for a, b in zip(ends, ends[1:])] or [""], tokens or [0], encode)


def edit_together(edits: list[tuple[CountTree, int, int, str]], encode) -> None:
    """One edit (tree, start, stop, text) of each of several trees, with all their units split and encoded together."""
    opened = [tree.opened(start, stop, text) for tree, start, stop, text in edits]
    # a line break behind each text keeps a unit's bounds from the next one
    units, first = bpe.split_units(pa.array([x for _, _, new in opened for x in (new, "\n")], pa.string()))
    coded = pc.dictionary_encode(units)
    words = coded.dictionary.to_pylist()
    per = [len(x) // 4 for x in encode(words)]
    codes = coded.indices.to_pylist()
    first = first.tolist()
    for (tree, *_), (low, high, _), a, b in zip(edits, opened, first[::2], first[1::2]):
        tree.closed(low, high, [words[c] for c in codes[a:b]], [per[c] for c in codes[a:b]])


def _leaves(texts: pa.Array, encoder: bpe.UnitEncoder) -> Iterator[tuple[list[int], list[int]]]:
    """Characters and tokens of the leaves of each text, with all units of a slice encoded together."""
    units, first = bpe.split_units(texts)
    coded = pc.dictionary_encode(units)
    per = np.array([len(x) // 4 for x in encoder.encode(coded.dictionary.to_pylist())], dtype=np.int64)
    tokens = np.concatenate([[0], np.cumsum(per[coded.indices.to_numpy()] if len(units) else per[:0])])
    chars = np.concatenate([[0], np.cumsum(pc.utf8_length(units).to_numpy(zero_copy_only=False))]).astype(np.int64)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if a == b:
            yield [], []
            continue
        at = chars[a : b + 1] - chars[a]
        cuts = np.searchsorted(at, np.arange(0, at[-1] + LEAF_CHARS, LEAF_CHARS)).clip(0, b - a)
        cuts = cuts[np.append(True, cuts[1:] != cuts[:-1])]
        yield np.diff(at[cuts]).tolist(), np.diff(tokens[a + cuts]).tolist()


def _trees(texts: pa.Array, encoder: bpe.UnitEncoder) -> Iterator[CountTree]:
    """A tree for each text."""
    for text, (chars, tokens) in zip(texts.to_pylist(), _leaves(texts, encoder)):
        yield CountTree.of(text, chars, tokens, encoder.encode)


TREE = "doc_id bigint, text string, leaf_chars array<int>, leaf_tokens array<int>"
_INTS = pa.list_(pa.int32())


def _grow(path: str):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.UnitEncoder.of(path)
        for batch in batches:
            for part in slices(batch, "text", bpe.BLOCK_BYTES):
                chars, tokens = [], []
                for c, n in _leaves(part.column("text"), encoder):
                    chars.append(c)
                    tokens.append(n)
                columns = [part.column("doc_id"), part.column("text"), pa.array(chars, _INTS), pa.array(tokens, _INTS)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text", "leaf_chars", "leaf_tokens"])

    return run


def _edit(path: str):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.UnitEncoder.of(path)
        for batch in batches:
            for part in slices(batch, "text", bpe.BLOCK_BYTES):
                columns = [part.column(c).to_pylist() for c in ("text", "leaf_chars", "leaf_tokens", "edits")]
                trees = [CountTree.of(text, chars, tokens, encoder.encode) for text, chars, tokens in zip(*columns[:3])]
                steps = [x or [] for x in columns[3]]
                # the edits of one text follow each other; the k-th ones of all texts are encoded together
                for k in range(max(map(len, steps), default=0)):
                    now = [(tree, x[k]["start"] or 0, x[k]) for tree, x in zip(trees, steps) if k < len(x)]
                    edit_together([(tree, a, a if e["stop"] is None else e["stop"], e["text"] or "") for tree, a, e in now], encoder.encode)
                rows = [tree.parts() for tree in trees]
                after, changes, again = [tree.total for tree in trees], [len(x) for x in steps], [tree.reencoded for tree in trees]
                before = [sum(x) for x in columns[2]]
                texts, chars, tokens = zip(*rows)
                out = [part.column("doc_id"), pa.array(texts, pa.string()), pa.array(chars, _INTS), pa.array(tokens, _INTS)]
                out += [pa.array(c, pa.int64()) for c in (before, after, changes, again)]
                names = ["doc_id", "text", "leaf_chars", "leaf_tokens", "n_tokens", "n_tokens_edited", "n_edits", "n_units_again"]
                yield pa.RecordBatch.from_arrays(out, names=names)

    return run


def grow_trees(docs: DataFrame, path: str, edits: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, leaf_chars and leaf_tokens of every row: its tree, to be written and kept. With edits, a
    column of docs of type EDITS, these stand beside it in order of seq, then of their other fields.

    Null texts are empty; null and repeated ids pass through; other columns are not read; an empty table
    gives an empty result.
    """
    lean(docs.sparkSession)
    columns = [F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")]
    if edits is None:
        return docs.select(*columns).mapInArrow(_grow(path), TREE)
    steps = F.array_sort(F.filter(edits, lambda e: e.isNotNull())).cast(EDITS)
    grown = docs.select(*columns, steps.alias("edits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", bpe.BLOCK_BYTES):
                for made in _grow(path)(iter([part.select(["doc_id", "text"])])):
                    yield pa.RecordBatch.from_arrays([*made.columns, part.column("edits")], names=[*made.schema.names, "edits"])

    return grown.mapInArrow(run, f"{TREE}, edits {EDITS}")


def edit_trees(trees: DataFrame, path: str, edits: str = "edits") -> DataFrame:
    """Trees as the edits in a column of theirs leave them, with n_tokens (before), n_tokens_edited, n_edits and
    n_units_again (units that were encoded for the edits, those around them included).

    An edit replaces code points [start, stop) of the text as the edits before have left it; bounds are
    clipped, a null start is 0, a null stop the start, a null text empty. A null list has no edits.
    """
    lean(trees.sparkSession)
    rows = trees.select("doc_id", "text", "leaf_chars", "leaf_tokens", F.col(edits).alias("edits"))
    return rows.mapInArrow(_edit(path), f"{TREE}, n_tokens bigint, n_tokens_edited bigint, n_edits bigint, n_units_again bigint")


def count_tokens(
    docs: DataFrame, path: str, edits: Column | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_tokens, n_tokens_edited, n_edits and n_units_again of every row, by trees that are written once
    and edited as edit_trees() says; nulls, repeated ids and empty tables as in grow_trees()."""
    steps = F.array().cast(EDITS) if edits is None else edits
    trees = stash(grow_trees(docs, path, steps, id_col, text_col), "count-trees")
    return edit_trees(trees, path).select("doc_id", "n_tokens", "n_tokens_edited", "n_edits", "n_units_again")


def attach_edits(docs: DataFrame, edits: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs with a column edits: the rows (id, seq, start, stop, text) of the table edits for each id. The
    edits of one document depend on each other and so meet in one row; rows of edits without a
    document are left out, a document without edits has null. All columns of docs stay, whatever their
    names, but one named edits is refused with ValueError."""
    row = F.struct(F.col("seq").cast("bigint").alias("seq"), F.col("start").cast("bigint").alias("start"), F.col("stop").cast("bigint").alias("stop"), "text")
    grouped = edits.groupBy(F.col(id_col).alias("__id")).agg(F.collect_list(row).alias("edits"))
    if "edits" in docs.columns:
        raise ValueError("docs has a column edits already")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("key"))
    found = packed.join(grouped, packed["key"] == grouped["__id"], "left")
    return found.select(*[F.col("row")[c].alias(c) for c in docs.columns], "edits")


def sample_edits(text: Column) -> Column:
    """Three edits that any text can take: a lead at the front, a changed span after a third, a cut after two thirds."""
    n = F.length(F.coalesce(text, F.lit(""))).cast("bigint")

    def edit(seq: int, start: Column, stop: Column, new: str) -> Column:
        return F.struct(F.lit(seq).cast("bigint").alias("seq"), start.alias("start"), stop.alias("stop"), F.lit(new).alias("text"))

    third = F.floor(n / 3)
    return F.array(
        edit(1, F.lit(0).cast("bigint"), F.lit(0).cast("bigint"), "Note: "),
        edit(2, third, third + 20, " changed by hand, "),
        edit(3, 2 * third, 2 * third + 15, ""),
    )
