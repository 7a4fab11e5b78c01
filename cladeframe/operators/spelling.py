"""Texts of nodes, spelled where a walk over a stretch of the pre-order passes them.

A task holds the columns of a tree's blocks once, as one array of bytes. A node's mutations are written
into it when the walk enters the node and taken back when it leaves its subtree, so that a node costs its own
mutations and the text that it gives. Only mutations, consensus texts and gaps are shuffled; a spelled text is the
last thing a task makes, and what is derived from it (pieces, places, records) is made in the same task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cladeframe.functions.codes import BASES, COMPLEMENT_FROM, COMPLEMENT_TO
from cladeframe.operators import replay
from cladeframe.operators.order import BUCKET

#: Places in pre-order that one task spells; each stretch is sent the consensus texts and the path above it.
STRETCH = 512
#: Bytes of text, and rows, that go out at once.
OUT_BYTES, OUT_ROWS = 8 << 20, 10_000
#: Records of a compared text that go out at once.
RECORDS = 1 << 17
GAP = ord("-")
#: Columns, as a power of two, whose bases are counted together.
COUNTED = 12
_TURNED = np.arange(256, dtype=np.uint8)
for _c in BASES[1:]:
    _TURNED[ord(_c)] = ord("N")
for _a, _b in zip(COMPLEMENT_FROM, COMPLEMENT_TO):
    _TURNED[ord(_a)] = ord(_b)
#: Sides of events that only spelling has: consensus texts, gaps, a tree's reference text, a node to be spelled and a point asked of it.
_CONSENSUS, _GAPS, _REFERENCE, _TOLD, _POINT = -5, -4, -3, 2, 3


class Columns:
    """All columns of a tree's blocks in order of block as bytes, in forward direction, and the path of the node at hand."""

    def __init__(self, consensus: dict[int, str], gaps: list[tuple[int, int, int]]):
        self.ids = np.array(sorted(consensus), dtype=np.int64)
        texts = [np.frombuffer(consensus[b].encode("latin-1"), np.uint8) for b in self.ids.tolist()]
        self.sizes = np.array([len(t) for t in texts], dtype=np.int64)
        self.main = np.cumsum(self.sizes) - self.sizes
        number = {b: k for k, b in enumerate(self.ids.tolist())}
        held = sorted((number[b] << 32 | pos, n) for b, pos, n in gaps if b in number)
        self.gap_keys = np.array([k for k, _ in held], dtype=np.int64)
        self.gap_sums = np.concatenate([[0], np.cumsum(np.array([n for _, n in held], dtype=np.int64))]).astype(np.int64)
        starts = self.main + self.gap_sums[np.searchsorted(self.gap_keys, np.arange(len(self.ids)) << 32)]
        self.bounds = np.append(starts, self.sizes.sum() + self.gap_sums[-1]).tolist()
        self.text = np.full(self.bounds[-1], GAP, dtype=np.uint8)
        for k, t in enumerate(texts):
            self.text[self._at(np.full(len(t), k), np.arange(len(t)), np.full(len(t), -1))] = t
        self.number = number
        self.blocks: dict[int, bool] = {}
        self.open: list[tuple[int, list, list]] = []
        #: Bases of every 2^COUNTED columns, kept up to date from the first question for them on.
        self.counts: np.ndarray | None = None

    def _at(self, block: np.ndarray, pos: np.ndarray, gap: np.ndarray) -> np.ndarray:
        """Columns of places by number of block; gap columns stand before their main base."""
        inside = gap >= 0
        key = block << 32 | pos
        ahead = np.where(inside, np.searchsorted(self.gap_keys, key), np.searchsorted(self.gap_keys, key, side="right"))
        return self.main[block] + np.where(inside, np.minimum(pos, self.sizes[block]) + gap, pos) + self.gap_sums[ahead]

    def enter(self, pre: int, post: int) -> None:
        """Leave all subtrees that end before pre, and go into the one up to post."""
        while self.open and self.open[-1][0] < pre:
            _, writes, turns = self.open.pop()
            for at, old in reversed(writes):
                self._put(at, old)
            for block, old in reversed(turns):
                if old is None:
                    self.blocks.pop(block, None)
                else:
                    self.blocks[block] = old
        self.open.append((post, [], []))

    def turn(self, block: int, kind: str) -> None:
        """A block mutation: an insertion sets presence and strand, a flip turns, a deletion ends."""
        old = self.blocks.get(block)
        new = (None if old is None else not old) if kind == "inv" else {"ins": True, "ins_inv": False}.get(kind)
        self.open[-1][2].append((block, old))
        if new is None:
            self.blocks.pop(block, None)
        else:
            self.blocks[block] = new

    def write(self, block: np.ndarray, pos: np.ndarray, gap: np.ndarray, base: np.ndarray) -> None:
        """Bases in order, of which a later one at a place stands; blocks that the tree lacks have no columns."""
        if not len(self.ids):
            return
        k = np.minimum(np.searchsorted(self.ids, block), len(self.ids) - 1)
        known = self.ids[k] == block
        at = self._at(k[known], pos[known], gap[known])
        self.open[-1][1].append((at, self.text[at]))
        self._put(at, base[known])

    def _put(self, at: np.ndarray, base: np.ndarray) -> None:
        if self.counts is None:
            self.text[at] = base
            return
        at, last = np.unique(at[::-1], return_index=True)
        base = base[::-1][last]
        more = (base != GAP).astype(np.int8) - (self.text[at] != GAP)
        changed = np.flatnonzero(more)
        np.add.at(self.counts, at[changed] >> COUNTED, more[changed])
        self.text[at] = base

    def bases_before(self) -> Callable[[int], int]:
        """A function that counts the bases of all columns ahead of one, whether their blocks are there or not, as they stand now."""
        if self.counts is None:
            self.counts = np.add.reduceat(self.text != GAP, np.arange(0, len(self.text), 1 << COUNTED), dtype=np.int64) if len(self.text) else np.zeros(0, np.int64)
        ahead = np.append(0, np.cumsum(self.counts))
        return lambda c: int(ahead[c >> COUNTED]) + int(np.count_nonzero(self.text[c >> COUNTED << COUNTED : c] != GAP))

    def block(self, k: int) -> np.ndarray | None:
        """The text of block number k as it stands, or None where it is absent."""
        forward = self.blocks.get(int(self.ids[k]))
        if forward is None:
            return None
        text = self.text[self.bounds[k] : self.bounds[k + 1]]
        return text if forward else _TURNED[text[::-1]]

    def parts(self) -> list[np.ndarray | None]:
        return [self.block(k) for k in range(len(self.ids))]

    def blank(self, k: int) -> np.ndarray:
        return np.full(self.bounds[k + 1] - self.bounds[k], GAP, dtype=np.uint8)

    def laid(self, rot_block: int, inverted: bool, parts: list | None = None) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Texts of all blocks, absent ones as gaps, and of those that are there, from the block of rotation on and turned."""
        parts = self.parts() if parts is None else parts
        there = [k for k, p in enumerate(parts) if p is not None]
        every = [self.blank(k) if p is None else p for k, p in enumerate(parts)]
        own = [parts[k] for k in there]
        if 0 < rot_block < len(there):
            first = there[rot_block]
            every, own = every[first:] + every[:first], own[rot_block:] + own[:rot_block]
        return (every[::-1], own[::-1]) if inverted else (every, own)

    def in_order(self) -> np.ndarray:
        """All columns in order of block, absent blocks as gaps."""
        return _joined([self.blank(k) if p is None else p for k, p in enumerate(self.parts())])


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint8)


def _text(codes: np.ndarray) -> str:
    return codes.tobytes().decode("latin-1")


def _plain(own: list[np.ndarray], offset: int) -> str:
    """Bases from the circular offset on."""
    text = _joined(own)
    text = text[text != GAP]
    at = offset % len(text) if len(text) else 0
    return _text(np.concatenate([text[at:], text[:at]])) if at else _text(text)


def _walk(batches: Iterator[pa.RecordBatch], told: Callable, asked: Callable | None = None) -> Iterator[tuple]:
    """Rows that told(columns, row, reference) gives for every node to be spelled, and asked(columns, row, places) for the points of
    one node, an array of (block_id, pos)."""
    at, columns, consensus, gaps, reference = None, None, {}, [], None
    point, points = None, []

    def settled() -> Iterator[tuple]:
        nonlocal point
        if point is not None:
            yield from asked(columns, point, np.array(points, dtype=np.int64).reshape(-1, 2))
            point = None
            points.clear()

    for batch in batches:
        number = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("tree_id", "stretch", "pre", "post", "node_id", "side")}
        change = np.zeros(batch.num_rows, dtype=bool)
        for c in ("tree_id", "stretch", "pre", "side"):
            change[1:] |= number[c][1:] != number[c][:-1]
        edges = np.append(np.append(0, np.flatnonzero(change)), batch.num_rows).tolist()
        for lo, hi in zip(edges, edges[1:]):
            if lo == hi:
                continue
            key, side = (int(number["tree_id"][lo]), int(number["stretch"][lo])), int(number["side"][lo])
            rows = batch.slice(lo, hi - lo)
            if key != at:
                yield from settled()
                at, columns, consensus, gaps, reference = key, None, {}, [], None
            field = lambda c, rows=rows: rows.column(c).to_pylist()
            if side == _CONSENSUS:
                consensus.update(zip(field("block_id"), field("base")))
            elif side == _GAPS:
                gaps.extend(zip(field("block_id"), field("pos"), field("gap_pos")))
            elif side == _REFERENCE:
                reference = np.frombuffer(field("base")[0].encode("latin-1"), np.uint8)
            else:
                columns = Columns(consensus, gaps) if columns is None else columns
                if side != _POINT:
                    yield from settled()
                if side == -1:
                    columns.enter(int(number["pre"][lo]), int(number["post"][lo]))
                elif side == 0:
                    for block, kind in zip(field("block_id"), field("base")):
                        columns.turn(block, kind)
                elif side == 1:
                    place = (rows.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("block_id", "pos", "gap_pos"))
                    columns.write(*place, np.frombuffer("".join(field("base")).encode("latin-1"), np.uint8))
                elif side == _TOLD:
                    yield from told(columns, rows.slice(0, 1).to_pylist()[0], reference)
                else:
                    point = rows.slice(0, 1).to_pylist()[0]
                    points.extend(zip(field("block_id"), field("pos")))
    yield from settled()


def _out(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of rows, cut by rows and by bytes of text."""
    held, size = [], 0
    pack = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, str))
        if size >= OUT_BYTES or len(held) >= OUT_ROWS:
            yield pack()
            held, size = [], 0
    if held:
        yield pack()


_FIELDS = ("side", "ord", "block_id", "pos", "gap_pos", "type", "base")


def _placed(rows: DataFrame, side: int, keys: list[str], **values) -> DataFrame:
    """Rows of an event's fields: the given ones, null elsewhere."""
    return rows.select(*keys, F.lit(side).alias("side"), *[values.get(c, F.lit(None)).alias(c) for c in _FIELDS[1:]])


def on_paths(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted nodes (tree_id, node_id) and all above them: those whose next wanted node in pre-order is in their
    subtree. Buckets of places are looked through side by side; a place that was cut away does no harm."""
    key = ["tree_id", "node_id"]
    mark = wanted.select(*key).distinct().withColumn("__own", F.lit(True))
    marked = nodes.join(mark, key, "left").withColumn("__at", F.when(F.col("__own"), F.col("pre"))).withColumn("__bucket", F.floor(F.col("pre") / BUCKET))
    behind = Window.partitionBy("tree_id").orderBy(F.desc("__bucket")).rowsBetween(Window.unboundedPreceding, -1)
    later = marked.groupBy("tree_id", "__bucket").agg(F.min("__at").alias("__first")).select("tree_id", "__bucket", F.min("__first").over(behind).alias("__later"))
    inside = Window.partitionBy("tree_id", "__bucket").orderBy(F.desc("pre")).rowsBetween(Window.unboundedPreceding, 0)
    following = marked.withColumn("__next", F.min("__at").over(inside)).join(later, ["tree_id", "__bucket"])
    return following.where(F.least("__next", "__later") <= F.col("post")).select(nodes.columns)


def _events(net: dict[str, DataFrame], told: DataFrame, reference: DataFrame | None = None, stretch: int | None = None) -> DataFrame:
    """Events of a walk with a tree's consensus texts and gaps ahead of each stretch, and what is told of nodes behind their mutations."""
    ahead = _placed(net["block"], _CONSENSUS, ["tree_id"], block_id=F.col("block_id"), base=F.col("consensus"))
    ahead = ahead.unionByName(_placed(net["gap"], _GAPS, ["tree_id"], block_id=F.col("block_id"), pos=F.col("pos"), gap_pos=F.col("len")))
    if reference is not None:
        ahead = ahead.unionByName(_placed(reference, _REFERENCE, ["tree_id"], base=F.col("seq")))
    before = {"pre": F.lit(-1), "post": F.lit(-1), "node_id": F.lit(-1), "carried": F.lit(True), "asked": F.lit(False)}
    return replay.events(net, reference=ahead.withColumns(before), stretch=stretch or STRETCH, told=told)


def _told(net: dict[str, DataFrame], wanted: DataFrame | None, bounds: DataFrame | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """The network down to the wanted nodes, and an event for each: its name, start, turn and bounds."""
    key = ["tree_id", "node_id"]
    node = net["node"] if wanted is None else on_paths(net["node"], wanted)
    asked = net["node"] if wanted is None else net["node"].join(wanted.select(*key).distinct(), key, "left_semi")
    rows = asked.select(*key, "name").join(net["seq_meta"].select(*key, "circ_offset", "rot_block", "inverted"), key, "left")
    rows = rows.withColumns({"lo": F.lit(None), "hi": F.lit(None)}) if bounds is None else rows.join(F.broadcast(bounds.select("tree_id", "lo", "hi")), "tree_id")  # one row a tree
    turned = F.when(F.coalesce("inverted", F.lit(False)), "inverted")
    return {**net, "node": node}, _placed(rows, _TOLD, key, ord=F.col("circ_offset"), block_id=F.col("rot_block"), pos=F.col("lo"), gap_pos=F.col("hi"), type=turned, base=F.col("name"))


#: After how many rows a writer of Parquet first looks at what it holds. By itself it waits for 100, which may be a gigabyte of texts.
_WRITER = {"parquet.page.size.row.check.min": "1"}


def _looked_at(spark: SparkSession) -> None:
    """Let the session's writers bound their memory by bytes of text; what the user has set stays."""
    for key, rows in _WRITER.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, rows)


def spelled(net: dict[str, DataFrame], wanted: DataFrame | None = None, aligned: bool = True, plain: bool = True, bounds: DataFrame | None = None) -> DataFrame:
    """tree_id, node_id, name, aligned and seq of the wanted nodes (tree_id, node_id; all by default): blocks in order of id
    after the sequence's rotation and inversion, absent ones as gaps in aligned and left out in seq, which has no
    gaps and begins at the circular offset. The one that is not asked for is null. With bounds (tree_id, lo, hi, columns
    from 0, both inclusive) aligned is cut to them, and trees without bounds have no rows."""
    _looked_at(net["node"].sparkSession)
    down, told = _told(net, wanted, bounds)
    schema = pa.schema([("tree_id", pa.int32()), ("node_id", pa.int32()), ("name", pa.string()), ("aligned", pa.string()), ("seq", pa.string())])

    def give(columns: Columns, row: dict, _) -> Iterator[tuple]:
        every, own = columns.laid(row["block_id"] or 0, row["type"] is not None)
        whole = None
        if aligned:
            codes = _joined(every)
            whole = _text(codes if row["pos"] is None else codes[row["pos"] : row["gap_pos"] + 1])
        yield row["tree_id"], row["node_id"], row["base"], whole, _plain(own, row["ord"] or 0) if plain else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _out(_walk(batches, give), schema)

    return _events(down, told).mapInArrow(run, "tree_id int, node_id int, name string, aligned string, seq string")


def block_texts(net: dict[str, DataFrame], wanted: DataFrame | None = None) -> DataFrame:
    """tree_id, node_id, block_id, forward and aligned text of every present block of the wanted nodes."""
    down, told = _told(net, wanted)
    schema = pa.schema([("tree_id", pa.int32()), ("node_id", pa.int32()), ("block_id", pa.int32()), ("forward", pa.bool_()), ("text", pa.string())])

    def give(columns: Columns, row: dict, _) -> Iterator[tuple]:
        for k, block in enumerate(columns.ids.tolist()):
            text = columns.block(k)
            if text is not None:
                yield row["tree_id"], row["node_id"], block, columns.blocks[block], _text(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _out(_walk(batches, give), schema)

    return _events(down, told).mapInArrow(run, "tree_id int, node_id int, block_id int, forward boolean, text string")


def pieces(net: dict[str, DataFrame], wanted: DataFrame, width: int) -> DataFrame:
    """tree_id, block_id, node_id, part, chunk and piece: the texts of all present blocks of the wanted nodes (tree_id, node_id,
    to, part) in forward direction, cut into stretches of width columns, under the node's number `to` and its part."""
    key = ["tree_id", "node_id"]
    told = _placed(wanted, _TOLD, key, ord=F.col("part"), block_id=F.col("to"))
    down = {**net, "node": on_paths(net["node"], wanted)}
    schema = pa.schema([("tree_id", pa.int32()), ("block_id", pa.int32()), ("node_id", pa.int32()), ("part", pa.int32()), ("chunk", pa.int32()), ("piece", pa.binary())])

    def give(columns: Columns, row: dict, _) -> Iterator[tuple]:
        for k, block in enumerate(columns.ids.tolist()):
            if block in columns.blocks:
                text = columns.text[columns.bounds[k] : columns.bounds[k + 1]].tobytes()
                for chunk in range(-(-len(text) // width)):
                    yield row["tree_id"], block, row["block_id"], row["ord"], chunk, text[chunk * width : (chunk + 1) * width]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _out(_walk(batches, give), schema)

    return _events(down, told).mapInArrow(run, "tree_id int, block_id int, node_id int, part int, chunk int, piece binary")


def compared(net: dict[str, DataFrame], wanted: DataFrame, reference: DataFrame, differences: Callable, by_column: bool = False) -> DataFrame:
    """tree_id, tip, pos, ref and alt: what differences(ref, alt) gives for the aligned text of wanted nodes against that of their
    tree's reference (tree_id, seq): rows, or with by_column three arrays, which go out as they are."""
    down, told = _told(net, wanted)
    schema = pa.schema([("tree_id", pa.int32()), ("tip", pa.string()), ("pos", pa.int32()), ("ref", pa.string()), ("alt", pa.string())])

    def give(columns: Columns, row: dict, ref: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        if ref is not None:
            found = differences(ref, _joined(columns.laid(row["block_id"] or 0, row["type"] is not None)[0]))
            pos, *texts = found if by_column else zip(*found) if found else ([], [], [])
            tree, tip = (pa.repeat(pa.scalar(x, f.type), len(pos)) for x, f in zip((row["tree_id"], row["base"]), schema))
            batch = pa.RecordBatch.from_arrays([tree, tip, *(pa.array(c, f.type) for c, f in zip((pos, *texts), list(schema)[2:]))], schema=schema)
            yield from (batch.slice(at, RECORDS) for at in range(0, batch.num_rows, RECORDS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _walk(batches, give)

    return _events(down, told, reference).mapInArrow(run, "tree_id int, tip string, pos int, ref string, alt string")


def _points(net: dict[str, DataFrame], points: DataFrame, block, number) -> tuple[dict[str, DataFrame], DataFrame]:
    key = ["tree_id", "node_id"]
    rows = points.where(number.between(0, 2**31 - 2)).select(*key, block.cast("int").alias("b"), number.cast("int").alias("n")).distinct()
    return {**net, "node": on_paths(net["node"], rows)}, _placed(rows, _POINT, key, block_id=F.col("b"), pos=F.col("n"))


def base_places(net: dict[str, DataFrame], points: DataFrame) -> DataFrame:
    """points (tree_id, node_id, nth: a base's number from 1) with block_id, at (its place in the block's columns) and column (in
    the alignment, blocks in order of id). Points without such a base go."""
    down, told = _points(net, points, F.lit(0), F.col("nth"))
    fields = ("tree_id", "node_id", "nth", "block_id", "at", "column")
    schema = pa.schema([(c, pa.int32()) for c in fields])

    def give(columns: Columns, row: dict, places: np.ndarray) -> Iterator[tuple]:
        bases = np.flatnonzero(columns.in_order() != GAP)
        nth = places[:, 1][(places[:, 1] >= 1) & (places[:, 1] <= len(bases))]
        column = bases[nth - 1]
        k = np.searchsorted(columns.bounds, column, side="right") - 1
        at = column - np.asarray(columns.bounds)[k]
        for values in zip(nth.tolist(), columns.ids[k].tolist(), at.tolist(), column.tolist()):
            yield row["tree_id"], row["node_id"], *values

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _out(_walk(batches, None, give), schema)

    found = _events(down, told).mapInArrow(run, ", ".join(f"`{c}` int" for c in fields))
    return points.join(found, ["tree_id", "node_id", "nth"]).select(*points.columns, "block_id", "at", "column")


def bases_up_to(net: dict[str, DataFrame], points: DataFrame) -> DataFrame:
    """points (tree_id, node_id, block_id, at) with base, the character there, and n_bases, the bases up to and with it, blocks in
    order of id. Points outside the block go."""
    down, told = _points(net, points, F.col("block_id"), F.col("at"))
    schema = pa.schema([("tree_id", pa.int32()), ("node_id", pa.int32()), ("block_id", pa.int32()), ("at", pa.int32()), ("base", pa.string()), ("n_bases", pa.int64())])

    def give(columns: Columns, row: dict, places: np.ndarray) -> Iterator[tuple]:
        if not len(columns.ids):
            return
        k = np.minimum(np.searchsorted(columns.ids, places[:, 0]), len(columns.ids) - 1)
        starts = np.asarray(columns.bounds)
        inside = (columns.ids[k] == places[:, 0]) & (places[:, 1] < starts[k + 1] - starts[k])
        # a node costs its points and a count for each block: its text is not put together
        before = columns.bases_before()
        edges = [before(c) for c in columns.bounds]
        own = [hi - lo if b in columns.blocks else 0 for b, lo, hi in zip(columns.ids.tolist(), edges, edges[1:])]
        ahead = np.append(0, np.cumsum(own)).tolist()
        for (block, i), n in zip(places[inside].tolist(), k[inside].tolist()):
            lo, hi, forward = columns.bounds[n], columns.bounds[n + 1], columns.blocks.get(block)
            if forward is None:
                yield row["tree_id"], row["node_id"], block, i, chr(GAP), ahead[n]
            elif forward:
                yield row["tree_id"], row["node_id"], block, i, chr(columns.text[lo + i]), ahead[n] + before(lo + i + 1) - edges[n]
            else:
                yield row["tree_id"], row["node_id"], block, i, chr(_TURNED[columns.text[hi - 1 - i]]), ahead[n] + edges[n + 1] - before(hi - 1 - i)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _out(_walk(batches, None, give), schema)

    found = _events(down, told).mapInArrow(run, "tree_id int, node_id int, block_id int, at int, base string, n_bases bigint")
    return points.join(found, ["tree_id", "node_id", "block_id", "at"]).select(*points.columns, "base", "n_bases")
