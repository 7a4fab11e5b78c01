"""Ancestral states by Fitch and Sankoff parsimony.

A tree is cut in pre-order: subtrees of at most PART nodes, which have no such subtree above them, are dealt
into parts of neighbours, and the nodes above them make the crown. A kernel takes one part and a stretch of
columns and works on all its columns at once. Where a tree has a crown, the parts first send up what their
topmost nodes come to for each crown node, the crown is solved in narrower stretches, and its states go
back to the parts, which then go down as well. That takes the same few shuffles for a tree of any size
and depth; a tree of one part needs the last step only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeframe.functions.codes import BASES, lowest_bit
from cladeframe.scratch import written

#: Columns that one kernel call takes, and nodes of a subtree that is not parted; a part holds twice as many at most.
COLUMNS = 1024
PART = 1 << 14
#: Bytes that a kernel works on at once; a cell of a node and a column takes about so many.
WORK_BYTES, CELL_BYTES = 256 << 20, {"fitch": 40, "sankoff": 512}
#: Cells of nodes and columns whose changes go out at once.
OUT_CELLS = 1 << 18
#: Cost of a state that cannot be.
INFINITE = 100_000_001

_CODE = np.zeros(256, dtype=np.uint8)
for _i, _c in enumerate(BASES[1:], 1):
    _CODE[ord(_c)] = _i
_BASE = np.frombuffer(BASES.encode(), dtype=np.uint8)
#: Number of the one bit of a state, -1 without one.
_BIT = np.full(1 << 16, -1, dtype=np.int8)
_BIT[1 << np.arange(16)] = np.arange(16)
MUTATION = "tree_id int, block_id int, node_id int, site int, type string, base string"
_ROW = "tree_id int, block_id int, part int, chunk int, role string, node_id int, at int, data binary, more binary, tree array<struct<node:int,up:int>>"


def fitch_up(parent: np.ndarray, sets: np.ndarray, sent: tuple | None = None) -> np.ndarray:
    """Sets of states of all nodes in pre-order; sets has the leaves' rows filled, 0 where unknown. A node that
    is its own parent has none here. A parent has what its children share, or else all they have; an unknown
    child shares nothing. sent has the nodes with children elsewhere, and what these share and have."""
    shared = np.full_like(sets, np.iinfo(sets.dtype).max)
    inner = np.zeros(len(parent), dtype=bool)
    inner[parent[parent != np.arange(len(parent))]] = True
    if sent is not None:
        at, both, all_ = sent
        np.bitwise_and.at(shared, at, both)
        np.bitwise_or.at(sets, at, all_)
        inner[at] = True
    for i in range(len(parent) - 1, -1, -1):
        if inner[i]:
            sets[i] = np.where(shared[i] != 0, shared[i], sets[i])
        if parent[i] != i:
            shared[parent[i]] &= sets[i]
            sets[parent[i]] |= sets[i]
    return sets


def fitch_down(parent: np.ndarray, sets: np.ndarray, root: np.ndarray | None = None, over: dict | None = None) -> np.ndarray:
    """One state a node: the parent's where the set has it, else the lowest. A node without a parent here
    takes over[node] for its parent's, or else is the root, whose state is given or the lowest."""
    states = np.empty_like(sets)
    low = sets & (~sets + 1)
    over = over or {}
    for i in range(len(parent)):
        above = states[parent[i]] if parent[i] != i else over.get(i)
        if above is None:
            states[i] = low[i] if root is None else root
        else:
            states[i] = np.where(sets[i] & above != 0, above, low[i])
    return states


def _least(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What a child adds to its parent's costs, and where it is known."""
    best = cost.min(axis=0)
    finite = best < INFINITE
    return np.where(finite, np.minimum(cost, best + 1), 0), finite


def sankoff_up(parent: np.ndarray, leaves: np.ndarray, states: int, sent: tuple | None = None) -> np.ndarray:
    """Least numbers of changes, node x state x column; leaves holds state numbers, -1 for unknown or inner
    nodes. sent has the nodes with children elsewhere, what these add and where they are known."""
    cost = np.zeros((len(parent), states, leaves.shape[1]), dtype=np.int64)
    known = np.zeros(leaves.shape, dtype=bool)
    inner = np.zeros(len(parent), dtype=bool)
    inner[parent[parent != np.arange(len(parent))]] = True
    if sent is not None:
        at, added, seen = sent
        np.add.at(cost, at, added)
        np.logical_or.at(known, at, seen)
        inner[at] = True
    for i in range(len(parent) - 1, -1, -1):
        if not inner[i]:
            cost[i] = np.where(np.arange(states)[:, None] == leaves[i], 0, INFINITE)
            known[i] = leaves[i] >= 0
        cost[i][:, ~known[i]] = INFINITE
        if parent[i] != i:
            added, finite = _least(cost[i])
            cost[parent[i]] += added
            known[parent[i]] |= finite
    return cost


def sankoff_down(parent: np.ndarray, cost: np.ndarray, root: np.ndarray | None = None, over: dict | None = None) -> np.ndarray:
    """State numbers by least cost, the lowest of equals; -1 where nothing is possible, and below. over as in fitch_down()."""
    states = np.empty((cost.shape[0], cost.shape[2]), dtype=np.int64)
    order = np.arange(cost.shape[1])[:, None]
    over = over or {}
    for i in range(len(parent)):
        above = states[parent[i]] if parent[i] != i else over.get(i)
        total = cost[i] if above is None else cost[i] + (order != above)
        best = total.argmin(axis=0)
        best = np.where(total.min(axis=0) >= INFINITE, -1, best)
        if above is None and root is not None:
            best = root
        states[i] = best if above is None else np.where(above < 0, -1, best)
    return states


def _up(method: str, parent: np.ndarray, place: np.ndarray, own: np.ndarray, sent: tuple | None = None) -> np.ndarray:
    """Sets or costs of all nodes from the codes `own` of the nodes `place`."""
    if method == "fitch":
        sets = np.zeros((len(parent), own.shape[1]), dtype=np.uint16)
        sets[place] = np.uint16(1) << own.astype(np.uint16)
        return fitch_up(parent, sets, sent)
    leaves = np.full((len(parent), own.shape[1]), -1, dtype=np.int64)
    leaves[place] = own
    return sankoff_up(parent, leaves, 16, sent)


def _down(method: str, parent: np.ndarray, found: np.ndarray, root: np.ndarray | None, over: dict) -> np.ndarray:
    """Code of every node, -1 where it is unknown; root and over hold codes."""
    if method != "fitch":
        return sankoff_down(parent, found, root, over).astype(np.int8)
    bit = lambda code: np.where(code < 0, 0, np.uint16(1) << np.maximum(code, 0).astype(np.uint16)).astype(np.uint16)
    states = fitch_down(parent, found, None if root is None else bit(root), {i: bit(c) for i, c in over.items()})
    return _BIT[states]


def _offer(method: str, found: np.ndarray, tops: np.ndarray, above: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each parent elsewhere what its children here share and have, or add and know: one row a parent."""
    order = np.argsort(above, kind="stable")
    tops, above = tops[order], above[order]
    head = np.flatnonzero(np.append(True, above[1:] != above[:-1]))
    if method == "fitch":
        return above[head], np.bitwise_and.reduceat(found[tops], head), np.bitwise_or.reduceat(found[tops], head)
    sums, seen = [], []
    for a, b in zip(head.tolist(), np.append(head[1:], len(tops)).tolist()):
        added, known = 0, np.zeros(found.shape[2], dtype=bool)
        for i in tops[a:b].tolist():
            more, finite = _least(found[i])
            added, known = added + more, known | finite
        sums.append(added)
        seen.append(known)
    return above[head], np.stack(sums), np.stack(seen)


class _Task:
    """The rows of one part, or of a crown, and a stretch of columns."""

    def __init__(self, batches: Iterator[pa.RecordBatch], method: str, memory: int):
        table = pa.Table.from_batches(batches)
        role = table.column("role").to_numpy(zero_copy_only=False)
        pick = lambda name: table.take(pa.array(np.flatnonzero(role == name)))
        self.method, self.memory = method, memory
        links = pick("tree").column("tree").combine_chunks().flatten()
        self.node, up = np.asarray(links.field("node")), np.asarray(links.field("up"))
        place = np.minimum(np.searchsorted(self.node, up), len(self.node) - 1)
        here = self.node[place] == up
        self.parent = np.where(here, place, np.arange(len(up)))
        self.tops = np.flatnonzero(~here & (up >= 0))
        self.above = up[self.tops]
        tips = pick("tip")
        rows = [np.frombuffer(x.as_buffer(), dtype=np.uint8) for x in tips.column("data")]
        self.place = np.searchsorted(self.node, tips.column("node_id").to_numpy())
        heads = {r: pick(r).column("data").to_pylist() for r in ("consensus", "fixed")}
        code = lambda found: _CODE[np.frombuffer(found[0], dtype=np.uint8)] if found else None
        self.consensus, self.fixed = code(heads["consensus"]), code(heads["fixed"])
        self.sent, self.given = pick("sent"), pick("above")
        self.width = pick("tree").column("at")[0].as_py()
        if any(len(x) != self.width for x in rows):
            raise ValueError("sequences of different lengths")
        self.codes = _CODE[np.stack(rows)] if rows else np.zeros((0, self.width), dtype=np.uint8)
        self.over: dict[int, np.ndarray] = {}
        if len(self.given):
            ids, at = self.given.column("node_id").to_numpy(), self.given.column("at").to_numpy()
            for i, a, x in zip(ids.tolist(), at.tolist(), self.given.column("data").to_pylist()):
                piece = np.frombuffer(x, dtype=np.int8)
                self.over.setdefault(i, np.full(self.width, -1, dtype=np.int8))[a : a + len(piece)] = piece

    def stretches(self) -> Iterator[tuple[int, int]]:
        most = max(1, self.memory // (CELL_BYTES[self.method] * max(len(self.parent), 1)))
        for a in range(0, self.width, most):
            yield a, min(a + most, self.width)

    def offers(self, a: int, b: int) -> np.ndarray:
        found = _up(self.method, self.parent, self.place, self.codes[:, a:b])
        return _offer(self.method, found, self.tops, self.above)

    def received(self, a: int, b: int) -> tuple | None:
        if not len(self.sent):
            return None
        at = np.searchsorted(self.node, self.sent.column("node_id").to_numpy())
        kinds = ((np.uint16, (self.width,)), (np.uint16, (self.width,))) if self.method == "fitch" else ((np.int64, (16, self.width)), (bool, (self.width,)))
        both = [np.stack([np.frombuffer(x.as_buffer(), dtype=k).reshape(shape) for x in self.sent.column(c)]) for c, (k, shape) in zip(("data", "more"), kinds)]
        return at, both[0][..., a:b], both[1][..., a:b]

    def states(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Code of every node and of what stands above it."""
        found = _up(self.method, self.parent, self.place, self.codes[:, a:b], self.received(a, b))
        over = {int(i): self.over[int(n)][a:b].astype(np.int64) for i, n in zip(self.tops, self.above)}
        code = _down(self.method, self.parent, found, None if self.fixed is None else self.fixed[a:b].astype(np.int64), over)
        above = code[self.parent]
        for i, x in over.items():
            above[i] = x
        if self.consensus is not None:
            above[0] = self.consensus[a:b]
        return code, above


_CHANGED = pa.schema([("tree_id", pa.int32()), ("block_id", pa.int32()), ("node_id", pa.int32()), ("site", pa.int32()), ("type", pa.string()), ("base", pa.string())])


def _changes(tree: int, block: int, node: np.ndarray, code: np.ndarray, above: np.ndarray, first: int) -> Iterator[pa.RecordBatch]:
    """Where a branch changes the state: I where the parent has a gap, D where the node has, else S. Cells are looked at
    OUT_CELLS at a time, so that what is held does not grow with a part's changes."""
    rows = max(1, OUT_CELLS // max(code.shape[1], 1))
    for a in range(0, len(code), rows):
        part, up = code[a : a + rows], above[a : a + rows]
        i, site = np.nonzero((part != up) & (part >= 0) & (up >= 0))
        new, old = part[i, site], up[i, site]
        kind = np.where(old == 0, 0, np.where(new == 0, 1, 2)).astype(np.int8)
        one = lambda x, n=len(i): pa.array(np.full(n, x, dtype=np.int32))
        columns = [one(tree), one(block), pa.array(node[i + a].astype(np.int32)), pa.array((site + first).astype(np.int32)), pa.array(["I", "D", "S"]).take(pa.array(kind)), pa.array(list(BASES)).take(pa.array(new.astype(np.int8)))]
        yield pa.RecordBatch.from_arrays(columns, schema=_CHANGED)


def _solve(method: str, columns: int, memory: int):
    """Mutations of a part."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = _Task(batches, method, memory)
        for a, b in task.stretches():
            code, above = task.states(a, b)
            yield from _changes(key[0].as_py(), key[1].as_py(), task.node, code, above, a + key[3].as_py() * columns)

    return run


def _send(method: str, columns: int, width: int, memory: int):
    """What a part's topmost nodes come to for their parents, in stretches of width columns."""
    schema = pa.schema([("tree_id", pa.int32()), ("block_id", pa.int32()), ("part", pa.int32()), ("chunk", pa.int32()), ("node_id", pa.int32()), ("data", pa.binary()), ("more", pa.binary())])

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = _Task(batches, method, memory)
        if not len(task.tops) or not task.width:
            return
        found = [task.offers(a, b) for a, b in task.stretches()]
        above = found[0][0]
        both = [np.concatenate([f[k] for f in found], axis=-1) for k in (1, 2)]
        for a in range(0, task.width, width):
            data = [[np.ascontiguousarray(x[i, ..., a : a + width]).tobytes() for i in range(len(above))] for x in both]
            n = len(above)
            fixed = [pa.array([v] * n, pa.int32()) for v in (key[0].as_py(), key[1].as_py(), -1, key[3].as_py() * (columns // width) + a // width)]
            yield pa.RecordBatch.from_arrays([*fixed, pa.array(above.astype(np.int32)), pa.array(data[0], pa.binary()), pa.array(data[1], pa.binary())], schema=schema)

    return run


def _crown(method: str, columns: int, width: int, memory: int):
    """Mutations of the crown, and the codes of its nodes as rows of role "above"."""
    extra = [("chunk", pa.int32()), ("at", pa.int32()), ("data", pa.binary())]

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = _Task(batches, method, memory)
        tree, block, stretch = key[0].as_py(), key[1].as_py(), key[3].as_py()
        first = stretch * width
        for a, b in task.stretches():
            code, above = task.states(a, b)
            for found in _changes(tree, block, task.node, code, above, first + a):
                none = [pa.nulls(found.num_rows, t) for _, t in extra]
                yield pa.RecordBatch.from_arrays([*found.columns, *none], schema=pa.schema([*_CHANGED, *extra]))
            n = len(task.node)
            same = lambda v: pa.array(np.full(n, v, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [same(tree), same(block), pa.array(task.node.astype(np.int32)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.string()), pa.nulls(n, pa.string()),
                 same((first + a) // columns), same((first + a) % columns), pa.array([x.tobytes() for x in np.ascontiguousarray(code)], pa.binary())],
                schema=pa.schema([*_CHANGED, *extra]),
            )

    return run


def _leading(rows: list[tuple]) -> list[tuple]:
    """Of rows (name, role, text bytes) of one stretch those that a consensus can need: rows that are first by
    name to have a base in some column, blank elsewhere, and the first row of each role."""
    rows.sort(key=lambda r: r[0])
    out, roles, free = [], set(), None
    for name, role, text in rows:
        if role is not None:
            if role not in roles:
                roles.add(role)
                out.append((name, role, text))
            if role == "baseline":
                continue
        free = np.ones(len(text), dtype=bool) if free is None else free
        if len(text) != len(free):
            raise ValueError("sequences of different lengths")
        fresh = free & (_CODE[text] != 0)
        if fresh.any():
            out.append((name, None, np.where(fresh, text, ord("-")).astype(np.uint8)))
            free &= ~fresh
    return out


def _candidates(columns: int):
    """_leading() of whole sequences, a batch at a time, cut into stretches; a stretch that holds nothing of a row goes
    without it, but each tree and block keeps all stretches of one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets: dict[tuple, list] = {}
            for tree, block, name, role, seq in zip(*(batch.column(c) for c in ("tree_id", "block_id", "name", "role", "seq"))):
                sets.setdefault((tree.as_py(), block.as_py()), []).append((name.as_py(), role.as_py(), np.frombuffer(seq.as_buffer(), dtype=np.uint8)))
            found = []
            for (tree, block), rows in sets.items():
                width = len(rows[0][2])
                for name, role, text in [*_leading(rows), ("", "blank", np.full(width, ord("-"), dtype=np.uint8))]:
                    for k in range(0, width, columns):
                        piece = text[k : k + columns]
                        if role is not None or _CODE[piece].any():
                            found.append((tree, block, k // columns, name, role, piece.tobytes()))
            if found:
                kinds = (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=["tree_id", "block_id", "chunk", "name", "role", "data"])

    return run


def _settle(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """consensus and fixed (the reference's text, or null) of a stretch."""
    table = pa.Table.from_batches(batches)
    rows = [(n, r, np.frombuffer(x, dtype=np.uint8)) for n, r, x in zip(*(table.column(c).to_pylist() for c in ("name", "role", "data")))]
    if len({len(x) for _, _, x in rows}) > 1:
        raise ValueError("sequences of different lengths")
    first = {r: x for _, r, x in reversed(sorted((r for r in rows if r[1] is not None), key=lambda r: r[0]))}
    consensus = np.zeros(len(rows[0][2]), dtype=np.uint8)
    for _, role, text in _leading([r for r in rows if r[1] is None]):
        consensus = np.where(consensus == 0, _CODE[text], consensus)
    fixed = first.get("reference")
    if "baseline" in first:
        consensus = _CODE[first["baseline"]]
    elif fixed is not None:
        consensus = np.where(_CODE[fixed] != 0, _CODE[fixed], consensus)
    shown = [_BASE[consensus].tobytes().decode(), None if fixed is None else fixed.tobytes().decode()]
    yield pa.RecordBatch.from_arrays([*(pa.array([k.as_py()], pa.int32()) for k in key), *(pa.array([x], pa.string()) for x in shown)], names=["tree_id", "block_id", "chunk", "consensus", "fixed"])


def _sizes(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """tree_id, node_id, up (the parent, -1 at the root) and part of every node, null in the crown."""
    size = F.col("post") - F.col("pre") + 1
    own = nodes.select("tree_id", "node_id", F.coalesce("parent_id", F.lit(-1)).alias("up"), "pre", "post", (size > PART).alias("crown"))
    over = own.select("tree_id", F.col("node_id").alias("up"), F.col("crown").alias("above"))
    rows = own.join(over, ["tree_id", "up"], "left")
    top = ~F.col("crown") & F.coalesce("above", F.lit(True))
    # the one subtree that goes on over a multiple of PART belongs to the part where it begins
    bucket = lambda c: F.floor(F.col(c) / PART).cast("int")
    across = rows.where(top & (bucket("pre") != bucket("post"))).select("tree_id", bucket("post").alias("bucket"), F.col("post").alias("till"))
    dealt = rows.withColumn("bucket", bucket("pre")).join(across, ["tree_id", "bucket"], "left")
    part = F.when(~F.col("crown"), F.col("bucket") - F.when(F.col("pre") <= F.col("till"), 1).otherwise(0)).cast("int")
    return dealt.select("tree_id", "node_id", "up", part.alias("part"))


def infer(nodes: DataFrame, msa: DataFrame, method: str = "fitch", reference: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Mutations (tree_id, node_id, site, type, base) and consensus chunks (tree_id, site, base) of
    aligned sequences (tree_id, name, seq). Nodes are numbered in pre-order.

    A branch has a mutation where its state differs from its parent's: I where the parent has a gap, D
    where the node has, else S; the root is compared with the consensus, the first base of a column by
    name. The root takes the states of the sequence whose name holds `reference`, if given. Tips without
    a sequence are unknown, sequences without a tip count for the consensus only. Sequences move as
    stretches of columns, never base by base.
    """
    role = F.lit(None).cast("string") if reference is None else F.when(F.col("name").contains(reference), "reference")
    rows = msa.select("tree_id", F.lit(0).alias("block_id"), "name", "seq", role.alias("role"))
    found = _infer(nodes, rows, method).drop("block_id")
    return found.where("node_id is not null"), found.where("node_id is null").select("tree_id", "site", "base")


def infer_windows(nodes: DataFrame, windows: DataFrame, width: int, method: str = "sankoff", reference: str | None = None) -> tuple[DataFrame, DataFrame]:
    """What infer() gives, of sequences in windows of `width` columns (tree_id, name, window, seq), none of which is
    ever put together."""
    role = F.lit(None).cast("string") if reference is None else F.when(F.col("name").contains(reference), "reference")
    rows = windows.select("tree_id", F.col("window").alias("block_id"), "name", "seq", role.alias("role"))
    found = _infer(nodes, rows, method).withColumn("site", (F.col("block_id") * width + F.col("site")).cast("int")).drop("block_id")
    return found.where("node_id is not null"), found.where("node_id is null").select("tree_id", "site", "base")


def infer_by_block(
    nodes: DataFrame, texts: DataFrame, baseline: DataFrame, reference: str | None = None, method: str = "fitch", part_of_name: bool = False, pieces: Callable | None = None
) -> DataFrame:
    """Mutations (tree_id, block_id, node_id, site, type, base) of texts (tree_id, name, block_id, seq). The root is
    compared with baseline (tree_id, block_id, seq) and takes the states of the tip `reference`, if given; with
    part_of_name, of the first one by name whose name holds it. With pieces, which gives the texts of tips (tree_id, node_id,
    name, part) in stretches of COLUMNS (tree_id, block_id, node_id, part, chunk, piece), texts need the reference's only."""
    named = F.col("name").contains(reference) if part_of_name else F.col("name") == reference
    role = F.lit(None).cast("string") if reference is None else F.when(named, "reference")
    rows = texts.select("tree_id", "block_id", "name", "seq", role.alias("role"))
    base = baseline.select("tree_id", "block_id", F.lit("").alias("name"), "seq", F.lit("baseline").alias("role"))
    return _infer(nodes, rows.unionByName(base), method, base=True, pieces=pieces).where("node_id is not null")


def _pieces(text: str, width: int) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{width}}}"), 0)


def _rows(df: DataFrame, **columns) -> DataFrame:
    """df in the columns of _ROW; those that are not given are null."""
    fields = [f.strip().split(" ", 1) for f in _ROW.replace("node:int,up", "node:int;up").split(",")]
    return df.select(*[columns.get(n, F.lit(None)).cast(t.replace(";", ",")).alias(n) for n, t in fields])


def _infer(nodes: DataFrame, rows: DataFrame, method: str, base: bool = False, pieces: Callable | None = None) -> DataFrame:
    rows = rows.where(F.length("seq") > 0)
    # a baseline is the consensus, so that no other text is looked at for it
    leading = rows.where("role is not null") if base else rows
    found = leading.select("tree_id", "block_id", "name", "role", "seq").mapInArrow(_candidates(COLUMNS), "tree_id int, block_id int, chunk int, name string, role string, data binary")
    heads = written(found.groupBy("tree_id", "block_id", "chunk").applyInArrow(_settle, "tree_id int, block_id int, chunk int, consensus string, fixed string"))
    sizes = written(_sizes(nodes))
    names = nodes.where("is_leaf").select("tree_id", "node_id", "name")
    tips = names.join(sizes.select("tree_id", "node_id", "part"), ["tree_id", "node_id"])
    col, lit = F.col, F.lit
    if pieces is None:
        # one pass over a sequence cuts all its stretches
        own = rows.where("role is null or role <> 'baseline'").join(tips, ["tree_id", "name"])
        own = own.select("tree_id", "block_id", "node_id", "part", F.posexplode(_pieces("seq", COLUMNS)).alias("chunk", "piece"))
    else:
        own = pieces(tips)
    place = {"tree_id": col("tree_id"), "block_id": col("block_id"), "part": col("part"), "chunk": col("chunk")}
    work = _rows(own, **place, role=lit("tip"), node_id=col("node_id"), data=col("piece"))
    links = F.array_sort(F.collect_list(F.struct(col("node_id").alias("node"), "up"))).alias("links")
    lower = sizes.where("part is not null").groupBy("tree_id", "part").agg(links, F.min("up").alias("least"))
    dealt = lower.join(heads, "tree_id")
    work = work.unionByName(_rows(dealt, **place, role=lit("tree"), at=F.length("consensus"), tree=col("links")))
    rooted = dealt.where("least = -1")
    for role in ("consensus", "fixed"):
        work = work.unionByName(_rows(rooted.where(col(role).isNotNull()), **place, role=lit(role), data=col(role)))
    group = ["tree_id", "block_id", "part", "chunk"]
    chunks = heads.select("tree_id", "block_id", lit(None).cast("int").alias("node_id"), (col("chunk") * COLUMNS).alias("site"), lit("C").alias("type"), col("consensus").alias("base"))

    crown = sizes.where("part is null")
    most = crown.groupBy("tree_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    if most is None:
        return work.groupBy(group).applyInArrow(_solve(method, COLUMNS, WORK_BYTES), MUTATION).unionByName(chunks)
    width = 1 << min(COLUMNS.bit_length() - 1, max(WORK_BYTES // (CELL_BYTES[method] * most), 1).bit_length() - 1)
    tall = crown.select("tree_id").distinct()
    sent_schema = "tree_id int, block_id int, part int, chunk int, node_id int, data binary, more binary"
    sent = work.join(tall, "tree_id", "left_semi").groupBy(group).applyInArrow(_send(method, COLUMNS, width, WORK_BYTES), sent_schema)
    top = _rows(sent, **place, role=lit("sent"), node_id=col("node_id"), data=col("data"), more=col("more"))
    cut = heads.select("tree_id", "block_id", col("chunk").alias("whole"), F.posexplode(_pieces("consensus", width)).alias("k", "consensus"), "fixed")
    cut = cut.withColumn("chunk", (col("whole") * (COLUMNS // width) + col("k")).cast("int")).withColumn("fixed", F.substring("fixed", col("k") * width + 1, lit(width)))
    cut = crown.groupBy("tree_id").agg(links).join(cut, "tree_id").withColumn("part", lit(-1))
    top = top.unionByName(_rows(cut, **place, role=lit("tree"), at=F.length("consensus"), tree=col("links")))
    for role in ("consensus", "fixed"):
        top = top.unionByName(_rows(cut.where(col(role).isNotNull()), **place, role=lit(role), data=col(role)))
    solved = written(top.groupBy(group).applyInArrow(_crown(method, COLUMNS, width, WORK_BYTES), MUTATION + ", chunk int, at int, data binary"))
    asks = sizes.where("part is not null").join(crown.select("tree_id", col("node_id").alias("up")), ["tree_id", "up"]).select("tree_id", col("up").alias("node_id"), "part").distinct()
    above = solved.where("data is not null").join(asks, ["tree_id", "node_id"])
    work = work.unionByName(_rows(above, **place, role=lit("above"), node_id=col("node_id"), at=col("at"), data=col("data")))
    below = work.groupBy(group).applyInArrow(_solve(method, COLUMNS, WORK_BYTES), MUTATION)
    return below.unionByName(solved.where("data is null").select("tree_id", "block_id", "node_id", "site", "type", "base")).unionByName(chunks)


def fitch_levels(nodes: DataFrame, leaves: DataFrame, key: list[str], write_from: int = 5) -> DataFrame:
    """Sets of states of every node as a join per level: nodes (node_id, parent_id, level), leaves (*key,
    node_id, state). Each level starts from the one below only; in trees of write_from levels or more
    each is written, so that plans do not grow."""
    deepest = nodes.agg(F.max("level")).first()[0] or 0
    places = nodes.select("node_id", "parent_id", "level")
    known = leaves.join(places, "node_id").select(*key, "node_id", "level", F.col("state").alias("sets"))
    levels, up = [], None
    for level in range(deepest, -1, -1):
        here = known.where(F.col("level") == level).select(*key, "node_id", "sets")
        here = here if up is None else here.unionByName(up)
        here = written(here) if deepest >= write_from else here
        levels.append(here)
        above = places.where(F.col("level") == level).select("node_id", "parent_id")
        up = here.join(above, "node_id").groupBy(*key, F.col("parent_id").alias("node_id")).agg(combine("sets").alias("sets"))
    out = levels[0]
    for here in levels[1:]:
        out = out.unionByName(here)
    return out


def combine(state: str) -> Column:
    """What the children's sets share, or else all they have."""
    shared = F.bit_and(state)
    return F.when(shared != 0, shared).otherwise(F.bit_or(state))


def fitch_step_down(sets: Column, above: Column) -> Column:
    """A child's state: the parent's where the set has it, else the lowest bit."""
    return F.when(sets.bitwiseAND(above) != 0, above).otherwise(lowest_bit(sets))


def mutation_type(new: Column, old: Column, gap) -> Column:
    """I, D or S for a changed state, null where nothing changed."""
    return F.when(new == old, F.lit(None).cast("string")).when(old == gap, "I").when(new == gap, "D").otherwise("S")


def sankoff_costs(children: DataFrame, key: list[str], states: int) -> DataFrame:
    """(*key, node, state, cost) of parents from rows (*key, parent, child, state, cost) of their
    children, which hold possible states only: per child the least over its states of cost, one more
    where it differs; summed over the children."""
    targets = F.explode(F.array(*[F.lit(i) for i in range(states)]))
    per_child = children.withColumn("target", targets).groupBy(*key, "parent", "child", "target")
    least = per_child.agg(F.min(F.col("cost") + (F.col("state") != F.col("target")).cast("bigint")).alias("cost"))
    return least.groupBy(*key, F.col("parent").alias("node"), F.col("target").alias("state")).agg(F.sum("cost").alias("cost"))


def sankoff_choice(costs: DataFrame, key: list[str], above: str | None = None) -> DataFrame:
    """The cheapest state of each node, the lowest of equals; with `above`, a column of the parent's state."""
    total = F.col("cost") if above is None else F.col("cost") + (F.col("state") != F.col(above)).cast("bigint")
    return costs.groupBy(*key, "node").agg(F.min(F.struct(total.alias("cost"), F.col("state"))).alias("x")).select(
        *key, "node", F.col("x.state").alias("state")
    )
