"""What stands on the path above every node, by walks over stretches of the pre-order.

Nodes of STRETCH places in pre-order go into one task, with the mutations of the path above the first of
them; an ancestor of any other node is on that path or in the stretch. A task walks its nodes in order with
the path's bases and blocks in two tables, and takes back what a node wrote when it leaves its subtree. So
no node meets all its ancestors' mutations, and no place of the genome is one group.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeframe.operators.mutations import unpack
from cladeframe.operators.tree import closure

#: Places in pre-order that one task walks.
STRETCH = 4096

_EVENT = "tree_id int, stretch int, pre int, post int, node_id int, carried boolean, asked boolean, side int, ord int, block_id int, pos int, gap_pos int, type string, base string"


def events(net: dict[str, DataFrame], asked: DataFrame | None = None, reference: DataFrame | None = None, stretch: int | None = None, told: DataFrame | None = None) -> DataFrame:
    """Rows of _EVENT dealt by stretch and in order: for every node one of side -1, its block mutations (side 0, the
    kind in base) and its bases (side 1). Those of the path above a stretch are carried; asked marks nodes of a table
    (tree_id, node_id). Rows of `reference`, by tree, go before each of its stretches, and other trees are left out.
    Rows of `told` (tree_id, node_id, side and what follows it in _EVENT) stand in their nodes' places."""
    stretch = stretch or STRETCH
    nodes = net["node"].select("tree_id", "node_id", "pre", "post").withColumn("stretch", F.floor(F.col("pre") / stretch).cast("int"))
    first = nodes.groupBy("tree_id", "stretch").agg(F.min_by("node_id", "pre").alias("node_id"))
    below = first.join(net["node"].where("parent_id is not null").select("tree_id", "node_id"), ["tree_id", "node_id"])
    # where every tree is one stretch nothing stands above
    up = below.limit(0).withColumns({"anc_id": F.lit(0), "dist": F.lit(0)}) if below.isEmpty() else closure(net["node"], start=below).where("dist > 0").join(first, ["tree_id", "node_id"])
    up = up.select("tree_id", F.col("anc_id").alias("node_id"), "stretch").join(nodes.drop("stretch"), ["tree_id", "node_id"])
    wanted = F.lit(False) if asked is None else F.coalesce("asked", F.lit(False))
    own = nodes if asked is None else nodes.join(asked.select("tree_id", "node_id").distinct().withColumn("asked", F.lit(True)), ["tree_id", "node_id"], "left")
    own = own.withColumn("carried", F.lit(False)).withColumn("asked", wanted)
    places = own.unionByName(up.withColumn("carried", F.lit(True)).withColumn("asked", F.lit(False)))
    base = unpack(net["nuc_mut"]).withColumn("side", F.lit(1))
    block = net["block_mut"].select("tree_id", "node_id", "ord", "block_id", F.lit(None).cast("int").alias("pos"), F.lit(None).cast("int").alias("gap_pos"), F.lit(None).cast("string").alias("type"), F.col("kind").alias("base"), F.lit(0).alias("side"))
    # a small file of runs may hold many bases: they must not go to the driver for a broadcast
    rows = places.join(base.unionByName(block).hint("merge"), ["tree_id", "node_id"])
    blank = {"side": F.lit(-1), **{c: F.lit(None) for c in ("ord", "block_id", "pos", "gap_pos", "type", "base")}}
    fields = [f.split(" ") for f in _EVENT.split(", ")]
    full = rows.select(*[F.col(c).cast(t).alias(c) for c, t in fields]).unionByName(places.select(*[blank.get(c, F.col(c)).cast(t).alias(c) for c, t in fields]))
    if reference is not None:
        dealt = reference.join(first.select("tree_id", "stretch"), "tree_id")
        full = full.unionByName(dealt.select(*[F.col(c).cast(t).alias(c) for c, t in fields]))
    if told is not None:
        said = own.join(told, ["tree_id", "node_id"])
        full = full.unionByName(said.select(*[F.col(c).cast(t).alias(c) for c, t in fields]))
    return full.repartition("tree_id", "stretch").sortWithinPartitions("tree_id", "stretch", "pre", "side", "ord")


class Walk:
    """The path of the node at hand: `bases` by (block, pos, gap_pos) and `blocks`, which are there and forward."""

    def __init__(self):
        self.bases: dict[tuple, str] = {}
        self.blocks: dict[int, bool] = {}
        self.open: list[tuple[int, list]] = []

    def enter(self, pre: int, post: int) -> None:
        """Leave all subtrees that end before pre, and go into the one up to post."""
        while self.open and self.open[-1][0] < pre:
            for table, key, old in reversed(self.open.pop()[1]):
                self._put(table, key, old)
        self.open.append((post, []))

    def _put(self, table: dict, key, value) -> None:
        if value is None:
            table.pop(key, None)
        else:
            table[key] = value

    def write(self, table: dict, key, value) -> None:
        self.open[-1][1].append((table, key, table.get(key)))
        self._put(table, key, value)

    def written_over(self, keys: list[tuple], values: list[str]) -> list[str | None]:
        """What stood where bases are written, one after another."""
        if len(set(keys)) < len(keys):
            return [x for k, v in zip(keys, values) for x in self.written_over([k], [v])]
        old = [self.bases.get(k) for k in keys]
        self.open[-1][1].extend((self.bases, k, x) for k, x in zip(keys, old))
        self.bases.update(zip(keys, values))
        return old

    def turn(self, block: int, kind: str) -> None:
        """A block mutation: an insertion sets presence and strand, a flip turns, a deletion ends."""
        if kind == "inv":
            if block in self.blocks:
                self.write(self.blocks, block, not self.blocks[block])
        else:
            self.write(self.blocks, block, {"ins": True, "ins_inv": False}.get(kind))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        names = batch.schema.names
        for values in zip(*(batch.column(c).to_pylist() for c in names)):
            yield dict(zip(names, values))


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 10_000) -> Iterator[pa.RecordBatch]:
    for part in iter(lambda: list(islice(rows, size)), []):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), schema)], schema=schema)


_CHANGE = pa.schema([("tree_id", pa.int32()), ("node_id", pa.int32()), ("block_id", pa.int32()), ("pos", pa.int32()), ("gap_pos", pa.int32()), ("ord", pa.int32()), ("type", pa.string()), ("new", pa.string()), ("old", pa.string())])


def _old_bases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, walk = None, Walk()
    for batch in batches:
        number = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("tree_id", "stretch", "pre", "post", "side", "carried")}
        block, pos, gap, base = (batch.column(c).to_pylist() for c in ("block_id", "pos", "gap_pos", "base"))
        change = np.zeros(max(batch.num_rows - 1, 0), dtype=bool)
        for c in ("tree_id", "stretch", "pre", "side"):
            change |= number[c][1:] != number[c][:-1]
        edges = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        kept, old = [], []
        for lo, hi in zip(edges, edges[1:]):
            if lo == hi:
                continue
            key, side = (number["tree_id"][lo], number["stretch"][lo]), number["side"][lo]
            if at != key:
                at, walk = key, Walk()
            if side < 0:
                walk.enter(number["pre"][lo], number["post"][lo])
            elif side == 0:
                for b, kind in zip(block[lo:hi], base[lo:hi]):
                    walk.turn(b, kind)
            else:
                before = walk.written_over(list(zip(block[lo:hi], pos[lo:hi], gap[lo:hi])), base[lo:hi])
                if not number["carried"][lo]:
                    held = [k for k, b in enumerate(block[lo:hi]) if b in walk.blocks]
                    kept.extend(lo + k for k in held)
                    old.extend(before[k] for k in held)
        if kept:
            rows = batch.take(pa.array(kept, pa.int64()))
            fields = ("tree_id", "node_id", "block_id", "pos", "gap_pos", "ord", "type", "base")
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in fields), pa.array(old, pa.string())], schema=_CHANGE)


def old_bases(net: dict[str, DataFrame]) -> DataFrame:
    """tree_id, node_id, block_id, pos, gap_pos, ord, type, new, and old, what the nearest ancestor has written there, or
    null, of every base mutation whose block is there at its node."""
    schema = "tree_id int, node_id int, block_id int, pos int, gap_pos int, ord int, type string, new string, old string"
    return events(net).mapInArrow(_old_bases, schema)


_NEAREST = pa.schema([("tree_id", pa.int32()), ("node_id", pa.int32()), ("mark", pa.string())])


def _nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def found() -> Iterator[tuple]:
        at, walk, now = None, Walk(), None
        for row in _rows(batches):
            if now is not None and row["side"] < 0:
                yield (now["tree_id"], now["node_id"], walk.bases.get(0))
            if at != (row["tree_id"], row["stretch"]):
                at, walk = (row["tree_id"], row["stretch"]), Walk()
            if row["side"] < 0:
                walk.enter(row["pre"], row["post"])
                now = None if row["carried"] else row
            else:
                walk.write(walk.bases, 0, row["base"])
        if now is not None:
            yield (now["tree_id"], now["node_id"], walk.bases.get(0))

    yield from _batches(found(), _NEAREST)


def nearest(nodes: DataFrame, marks: DataFrame) -> DataFrame:
    """tree_id, node_id and mark, that of the nearest node at or above which has one, or null, of every node; marks has
    tree_id, node_id and mark, a text, one a node."""
    place = [F.lit(0).alias(c) for c in ("ord", "block_id", "pos")]
    rows = marks.select("tree_id", "node_id", *place, F.lit(-1).alias("gap_pos"), F.lit("S").alias("type"), F.lit(1).alias("len"), F.lit("N").alias("chars"))
    none = nodes.limit(0).select("tree_id", "node_id", F.lit(0).alias("ord"), F.lit(0).alias("block_id"), F.lit("").alias("kind"))
    dealt = events({"node": nodes, "nuc_mut": rows, "block_mut": none})
    told = dealt.join(marks, ["tree_id", "node_id"], "left").withColumn("base", F.when(F.col("side") == 1, F.col("mark")))
    ordered = told.select(*[f.split(" ")[0] for f in _EVENT.split(", ")]).repartition("tree_id", "stretch").sortWithinPartitions("tree_id", "stretch", "pre", "side", "ord")
    return ordered.mapInArrow(_nearest, "tree_id int, node_id int, mark string")


class Compared(Walk):
    """A walk that knows at which keys its path and a reference's path differ."""

    def __init__(self):
        super().__init__()
        self.ref_bases: dict[tuple, str] = {}
        self.ref_blocks: dict[int, bool] = {}
        self.apart_bases: set[tuple] = set()
        self.apart_blocks: set[int] = set()

    def compare(self, table: dict, key, value) -> None:
        """A base or a block of the reference; all come before the walk begins."""
        (self.ref_bases if table is self.bases else self.ref_blocks)[key] = value
        (self.apart_bases if table is self.bases else self.apart_blocks).add(key)

    def _put(self, table: dict, key, value) -> None:
        super()._put(table, key, value)
        ref, apart = (self.ref_bases, self.apart_bases) if table is self.bases else (self.ref_blocks, self.apart_blocks)
        if table.get(key) == ref.get(key):
            apart.discard(key)
        else:
            apart.add(key)


_APART = pa.schema([("tree_id", pa.int32()), ("node_id", pa.int32()), ("plain", pa.bool_()), ("block_id", pa.int32()), ("pos", pa.int32()), ("gap_pos", pa.int32()), ("base", pa.string())])


def _apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def found() -> Iterator[tuple]:
        at, walk, now = None, Compared(), None

        def settled() -> Iterator[tuple]:
            if now is not None:
                plain = not walk.apart_blocks
                yield (now["tree_id"], now["node_id"], plain, None, None, None, None)
                for key in walk.apart_bases if plain else ():
                    yield (now["tree_id"], now["node_id"], True, *key, walk.bases.get(key))

        for row in _rows(batches):
            if at != (row["tree_id"], row["stretch"]):
                yield from settled()
                at, walk, now = (row["tree_id"], row["stretch"]), Compared(), None
            key = (row["block_id"], row["pos"], row["gap_pos"])
            if row["side"] == -3:
                walk.compare(walk.blocks, row["block_id"], row["base"] == "ins")
            elif row["side"] == -2:
                walk.compare(walk.bases, key, row["base"])
            elif row["side"] == -1:
                yield from settled()
                walk.enter(row["pre"], row["post"])
                now = row if row["asked"] else None
            elif row["side"] == 0:
                walk.turn(row["block_id"], row["base"])
            else:
                walk.write(walk.bases, key, row["base"])
        yield from settled()

    yield from _batches(found(), _APART)


def apart(net: dict[str, DataFrame], asked: DataFrame, blocks: DataFrame, bases: DataFrame) -> DataFrame:
    """Where the paths of the asked nodes (tree_id, node_id) and one of their tree, a reference, have not written the
    same: tree_id, node_id, plain, block_id, pos, gap_pos and base, what the node's path has written there or null.
    A node has a row without a place that says whether it has the reference's blocks on the same strands
    (plain); those of other blocks have no more rows. The reference has blocks (tree_id, block_id,
    forward) and bases (tree_id, block_id, pos, gap_pos, base)."""
    null = F.lit(None)
    before = {"pre": F.lit(-1), "post": F.lit(-1), "node_id": F.lit(-1), "carried": F.lit(True), "asked": F.lit(False), "ord": F.lit(0), "type": null}
    block = blocks.select("tree_id", F.lit(-3).alias("side"), "block_id", null.alias("pos"), null.alias("gap_pos"), F.when(F.col("forward"), "ins").otherwise("ins_inv").alias("base"))
    base = bases.select("tree_id", F.lit(-2).alias("side"), "block_id", "pos", "gap_pos", "base")
    return events(net, asked, reference=block.unionByName(base).withColumns(before)).mapInArrow(
        _apart, "tree_id int, node_id int, plain boolean, block_id int, pos int, gap_pos int, base string"
    )
