"""Sequences of nodes: replay of mutations, text in block order, coordinates and slices."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeframe.functions.codes import BASES, COMPLEMENT_FROM, COMPLEMENT_TO, strip_gaps
from cladeframe.operators import spelling
from cladeframe.operators.mutations import fold_blocks, unpack
from cladeframe.operators.tree import closure
from cladeframe.scratch import written

#: Stretches that a tree's bases are dealt into where places are looked up.
BUCKETS = 4096
#: Columns of a stretch of the index of coordinates.
STRETCH = 512
_TURNED = {ord(c): "N" for c in BASES[1:]} | {ord(a): b for a, b in zip(COMPLEMENT_FROM, COMPLEMENT_TO)}


def block_states(nodes: DataFrame, block_mut: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """tree_id, node_id, block_id and forward of every block that is there at a node, by the block
    mutations on its path from the root in order."""
    paths = closure(nodes) if paths is None else paths
    on_path = paths.join(block_mut.withColumnRenamed("node_id", "anc_id"), ["tree_id", "anc_id"])
    steps = F.array_sort(F.collect_list(F.struct((-F.col("dist")).alias("d"), "ord", "kind")))
    folded = on_path.groupBy("tree_id", "node_id", "block_id").agg(fold_blocks(F.transform(steps, lambda x: x["kind"])).alias("x"))
    return folded.where("x.exists").select("tree_id", "node_id", "block_id", F.col("x.forward").alias("forward"))


def last_writes(paths: DataFrame, nuc_mut: DataFrame) -> DataFrame:
    """For each node and base, what the last mutation on its path left there: tree_id, node_id,
    block_id, pos, gap_pos, base, and dist of the node that wrote it."""
    on_path = paths.join(unpack(nuc_mut).withColumnRenamed("node_id", "anc_id"), ["tree_id", "anc_id"])
    order = F.struct((-F.col("dist")).alias("d"), F.col("ord"))
    last = on_path.groupBy("tree_id", "node_id", "block_id", "pos", "gap_pos").agg(F.max_by(F.struct("base", "dist"), order).alias("x"))
    return last.select("tree_id", "node_id", "block_id", "pos", "gap_pos", "x.base", "x.dist")


def patched(rows: DataFrame, keep: list[str]) -> DataFrame:
    """The columns keep and text, all columns of a block in order, of rows that have consensus, gaps (array
    of pos, len), writes (array of pos, gap_pos, base) and forward."""
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.select(keep).dtypes)
    return rows.select(*keep, F.struct("consensus", "gaps", "writes", "forward").alias("__b")).mapInArrow(_patch(keep), f"{schema}, text string")


def _patch(keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [_text(**row) for row in batch.column("__b").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(texts, pa.string())], names=[*keep, "text"])

    return run


def _text(consensus: str, gaps: list | None, writes: list | None, forward: bool) -> str:
    main = list(consensus)
    columns = {g["pos"]: ["-"] * g["len"] for g in gaps or []}
    for w in writes or []:
        if w["gap_pos"] < 0:
            main[w["pos"]] = w["base"]
        else:
            columns[w["pos"]][w["gap_pos"]] = w["base"]
    parts, at = [], 0
    for pos in sorted(columns):
        parts += main[at:pos] + columns[pos]
        at = pos
    text = "".join(parts + main[at:])
    return text if forward else text[::-1].translate(_TURNED)


def block_texts(net: dict[str, DataFrame], wanted: DataFrame | None = None, paths: DataFrame | None = None) -> DataFrame:
    """tree_id, node_id, block_id, forward and aligned text of every present block of the wanted nodes
    (tree_id, node_id; all by default), whose closure is `paths` where it is known.

    Texts are spelled on walks over the pre-order (see spelling); where the paths are known, which is for
    a few nodes, their mutations are looked up one by one.
    """
    if paths is None:
        return spelling.block_texts(net, wanted)
    states = block_states(net["node"], net["block_mut"], paths)
    writes = last_writes(paths, net["nuc_mut"]).groupBy("tree_id", "node_id", "block_id").agg(
        F.collect_list(F.struct("pos", "gap_pos", "base")).alias("writes")
    )
    gaps = net["gap"].groupBy("tree_id", "block_id").agg(F.collect_list(F.struct("pos", "len")).alias("gaps"))
    blocks = net["block"].join(gaps, ["tree_id", "block_id"], "left")
    joined = states.join(writes, ["tree_id", "node_id", "block_id"], "left").join(blocks, ["tree_id", "block_id"])
    return patched(joined, ["tree_id", "node_id", "block_id", "forward"])


def widths(net: dict[str, DataFrame]) -> DataFrame:
    """tree_id, block_id and the number of columns of each block."""
    gaps = net["gap"].groupBy("tree_id", "block_id").agg(F.sum("len").alias("n"))
    return net["block"].join(gaps, ["tree_id", "block_id"], "left").select(
        "tree_id", "block_id", (F.length("consensus") + F.coalesce("n", F.lit(0))).cast("int").alias("width")
    )


def circular_shift(seq: Column, offset: Column) -> Column:
    """seq from character offset on, then what stands before it."""
    n = F.length(seq)
    at = F.when(n > 0, F.pmod(offset, F.greatest(n, F.lit(1)))).otherwise(0)
    return F.concat(F.substring(seq, at + 1, n), F.substring(seq, F.lit(1), at))


def rotated(ordered: Column, start: Column) -> Column:
    """An array turned so that element `start` (from 0) comes first."""
    n = F.size(ordered)
    at = F.when(n > 0, F.pmod(start, F.greatest(n, F.lit(1)))).otherwise(0)
    return F.concat(F.slice(ordered, at + 1, n), F.slice(ordered, F.lit(1), at))


def sequences(net: dict[str, DataFrame], wanted: DataFrame | None = None, aligned: bool = False) -> DataFrame:
    """tree_id, node_id, name and seq of the wanted nodes: blocks in order of id, after the sequence's
    rotation and inversion; without gaps and from its circular offset unless aligned, where blocks
    that are absent give gaps."""
    found = spelling.spelled(net, wanted, aligned=aligned, plain=not aligned)
    return found.select("tree_id", "node_id", "name", F.col("aligned" if aligned else "seq").alias("seq"))


def coordinates(net: dict[str, DataFrame], wanted: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """Every column of the wanted nodes in order: tree_id, node_id, block_id, at (its number in the
    block), base, column (its number in the alignment, from 0) and n_bases (bases up to it).

    Running counts go over each node's columns: sums by block first, then inside the blocks."""
    grid = wanted.select("tree_id", "node_id").distinct().join(widths(net), "tree_id")
    texts = block_texts(net, wanted, paths).select("tree_id", "node_id", "block_id", "text")
    full = grid.join(texts, ["tree_id", "node_id", "block_id"], "left")
    full = full.withColumn("text", F.coalesce("text", F.repeat(F.lit("-"), F.col("width"))))
    order = Window.partitionBy("tree_id", "node_id").orderBy("block_id").rowsBetween(Window.unboundedPreceding, -1)
    full = full.withColumn("before", F.coalesce(F.sum("width").over(order), F.lit(0)))
    full = full.withColumn("bases", F.coalesce(F.sum(F.length(strip_gaps(F.col("text")))).over(order), F.lit(0)))
    each = full.select("tree_id", "node_id", "block_id", "before", "bases", F.posexplode(F.split("text", "")).alias("at", "base")).where("base <> ''")
    inside = Window.partitionBy("tree_id", "node_id", "block_id").orderBy("at")
    n = F.sum((F.col("base") != "-").cast("int")).over(inside)
    return each.select("tree_id", "node_id", "block_id", "at", "base", (F.col("before") + F.col("at")).alias("column"), (F.col("bases") + n).alias("n_bases"))


def coordinate_index(net: dict[str, DataFrame], wanted: DataFrame) -> DataFrame:
    """The aligned text of wanted nodes (tree_id, node_id) in stretches of at most STRETCH columns of a block: tree_id,
    node_id, block_id, k (the stretch's number in the block), text, column (of its first character), before and n
    (bases ahead of it and in it). A text is cut as it stands, and sums go over stretches, not over bases."""
    key = ["tree_id", "node_id"]
    grid = wanted.select(*key).distinct().join(widths(net), "tree_id")
    texts = block_texts(net, wanted).select(*key, "block_id", "text")
    full = grid.join(texts, [*key, "block_id"], "left").withColumn("text", F.coalesce("text", F.repeat(F.lit("-"), F.col("width"))))
    pieces = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{STRETCH}}}"), 0)
    cut = full.select(*key, "block_id", F.posexplode(pieces).alias("k", "text")).withColumn("n", F.length(strip_gaps(F.col("text"))))
    order = Window.partitionBy(*key).orderBy("block_id", "k").rowsBetween(Window.unboundedPreceding, -1)
    ahead = lambda c: F.coalesce(F.sum(c).over(order), F.lit(0))
    return cut.withColumn("column", ahead(F.length("text"))).withColumn("before", ahead(F.col("n")))


def base_places(index: DataFrame, points: DataFrame) -> DataFrame:
    """points (tree_id, node_id, nth: a base's number from 1) with block_id, at (its place in the block's columns) and
    column (in the alignment). Points without such a base go. A point meets the stretches that hold a base of its own
    STRETCH numbers, and one of these is searched."""
    bucket = lambda c: F.floor(c / STRETCH)
    x = F.struct("k", "text", "column", "before", "n").alias("__x")
    reach = F.explode(F.sequence(bucket(F.col("before")), bucket(F.col("before") + F.col("n") - 1))).alias("__b")
    dealt = index.where("n > 0").select("tree_id", "node_id", "block_id", x, reach)
    hit = points.withColumn("__b", bucket(F.col("nth") - 1)).join(dealt, ["tree_id", "node_id", "__b"])
    nth = F.col("nth") - F.col("__x.before")
    held = F.filter(F.sequence(F.lit(1), F.length("__x.text")), lambda i: F.substring("__x.text", i, F.lit(1)) != "-")
    inside = F.get(held, (nth - 1).cast("int")) - 1
    hit = hit.where((nth > 0) & (nth <= F.col("__x.n")))
    return hit.select(*points.columns, "block_id", (F.col("__x.k") * STRETCH + inside).alias("at"), (F.col("__x.column") + inside).alias("column"))


def bases_up_to(index: DataFrame, points: DataFrame) -> DataFrame:
    """points (tree_id, node_id, block_id, at) with base, the character there, and n_bases, the bases up to and with it."""
    key = ["tree_id", "node_id", "block_id", "__k"]
    stretches = index.select("tree_id", "node_id", "block_id", F.col("k").alias("__k"), F.struct("text", "before").alias("__x"))
    hit = points.withColumn("__k", F.floor(F.col("at") / STRETCH).cast("int")).join(stretches, key)
    inside = (F.col("at") - F.col("__k") * STRETCH + 1).cast("int")
    hit = hit.where(inside.between(1, F.length("__x.text")))
    n = F.col("__x.before") + F.length(strip_gaps(F.substring("__x.text", F.lit(1), inside)))
    return hit.select(*points.columns, F.substring("__x.text", inside, F.lit(1)).alias("base"), n.alias("n_bases"))


def base_bounds(net: dict[str, DataFrame], reference: DataFrame, start: int, end: int) -> DataFrame:
    """tree_id, lo and hi: the columns of bases start and end (from 1, both inclusive) of nodes (tree_id, node_id), one a
    tree; an end behind the last base is that base. Nodes without a base in the range have no row."""
    index = written(coordinate_index(net, reference))
    total = index.groupBy("tree_id", "node_id").agg(F.sum("n").alias("total"))
    lo, hi = F.greatest(F.lit(start), F.lit(1)).cast("bigint"), F.least(F.lit(end), F.col("total")).cast("bigint")
    points = total.where(lo <= hi).select("tree_id", "node_id", F.explode(F.array(lo, hi)).alias("nth")).distinct()
    return base_places(index, points).groupBy("tree_id").agg(F.min("column").alias("lo"), F.max("column").alias("hi"))


def prefix_counts(rows: DataFrame, partition: list[str], order: list[str], is_base: Column, name: str = "n_bases") -> DataFrame:
    """rows with the running number of bases up to each."""
    window = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(name, F.sum(is_base.cast("bigint")).over(window))


def at_or_after(a: Column, b: Column, forward: Column) -> Column:
    """Whether place a, a struct of block, pos and gap (-1 for a main base, which comes behind its gap
    columns), does not come before b; turned round on the reverse strand."""
    rank = lambda x: F.struct(x["block"], x["pos"], F.when(x["gap"] < 0, 2**31 - 1).otherwise(x["gap"]))
    return F.when(forward, rank(a) >= rank(b)).otherwise(rank(a) <= rank(b))


def ungapped(points: DataFrame, msa: DataFrame) -> DataFrame:
    """points (name, column from 0) with at, the bases of the named aligned sequence before the column."""
    joined = points.join(msa.select("name", "seq"), "name")
    return joined.withColumn("at", F.length(strip_gaps(F.substring("seq", F.lit(1), F.col("column"))))).drop("seq")


def slice_columns(net: dict[str, DataFrame], reference: DataFrame, start: int, end: int) -> tuple[DataFrame, DataFrame]:
    """Bases start..end (from 1, both inclusive) of the reference node (tree_id, node_id) as columns of
    the alignment, (tree_id, lo, hi), and every tip's aligned text there: tree_id, node_id, name, seq."""
    bounds = base_bounds(net, reference, start, end)
    tips = net["node"].where("is_leaf").select("tree_id", "node_id")
    cut = spelling.spelled(net, tips, plain=False, bounds=bounds)
    return bounds, cut.select("tree_id", "node_id", "name", F.col("aligned").alias("seq"))


def clip_runs(records: DataFrame, start: Column, end: Column) -> DataFrame:
    """Records of main bases inside [start, end]; runs that reach over a bound are cut and positions count from start."""
    last = F.col("pos") + F.col("len") - 1
    lo, hi = F.greatest("pos", start), F.least(last, end)
    kept = records.where((last >= start) & (F.col("pos") <= end))
    return kept.withColumn("chars", F.substring("chars", lo - F.col("pos") + 1, hi - lo + 1)).withColumn("len", (hi - lo + 1).cast("int")).withColumn("pos", (lo - start).cast("int"))


def segment(net: dict[str, DataFrame], first_block: int, start: int, last_block: int, end: int) -> dict[str, DataFrame]:
    """The network cut to the genome from base start of first_block to base end of last_block, both
    inclusive; blocks are numbered from 0 again."""
    lo = F.when(F.col("block_id") == first_block, F.lit(start)).otherwise(F.lit(0))
    inside = F.col("block_id").between(first_block, last_block)
    shift = (F.col("block_id") - first_block).alias("block_id")
    hi = F.when(F.col("block_id") == last_block, F.lit(end)).otherwise(F.lit(2**31 - 2))
    block = net["block"].where(inside).select("tree_id", shift, F.substring("consensus", lo + 1, hi - lo + 1).alias("consensus"))
    gap = net["gap"].where(inside & F.col("pos").between(lo, hi)).select("tree_id", shift, (F.col("pos") - lo).cast("int").alias("pos"), "len")
    muts = net["nuc_mut"].where(inside)
    main = clip_runs(muts.where("gap_pos = -1"), lo, hi)
    side = muts.where((F.col("gap_pos") >= 0) & F.col("pos").between(lo, hi)).withColumn("pos", (F.col("pos") - lo).cast("int"))
    nuc = main.unionByName(side).withColumn("block_id", F.col("block_id") - first_block)
    block_mut = net["block_mut"].where(inside).withColumn("block_id", F.col("block_id") - first_block)
    return {**net, "block": block, "gap": gap, "nuc_mut": nuc, "block_mut": block_mut}


def to_block_coordinate(lengths: DataFrame, points: DataFrame) -> DataFrame:
    """points (tree_id, at: base number from 0) with their block_id and pos, by the running sums of
    lengths (tree_id, block_id, n). A tree's bases are dealt into BUCKETS stretches; points and blocks meet
    in those that they reach into."""
    order = Window.partitionBy("tree_id").orderBy("block_id").rowsBetween(Window.unboundedPreceding, -1)
    starts = lengths.withColumn("lo", F.coalesce(F.sum("n").over(order), F.lit(0)))
    wide = lengths.groupBy("tree_id").agg(F.greatest(F.ceil(F.sum("n") / BUCKETS), F.lit(1)).cast("bigint").alias("__w"))
    place = lambda x: F.floor(x / F.col("__w"))
    reach = F.explode(F.sequence(place(F.col("lo")), place(F.col("lo") + F.col("n") - 1))).alias("__b")
    dealt = starts.where("n > 0").join(wide, "tree_id").select("tree_id", "block_id", "n", "lo", reach)
    asked = points.join(wide, "tree_id").withColumn("__b", place(F.col("at")))
    hit = asked.join(dealt, ["tree_id", "__b"]).where((F.col("at") >= F.col("lo")) & (F.col("at") < F.col("lo") + F.col("n")))
    return hit.select(*points.columns, "block_id", (F.col("at") - F.col("lo")).alias("pos"))
