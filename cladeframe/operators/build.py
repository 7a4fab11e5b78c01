"""Building networks of blocks: from graph paths (GFA), from PanGraph files, and anew for a tree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cladeframe.operators import graph, mutations, parsimony
from cladeframe.scratch import written

#: Characters of a block's states: absent, forward, reverse.
ABSENT, FORWARD, REVERSE = "-", "A", "C"


def block_mutations(nodes: DataFrame, states: DataFrame, reference: str | None = None, method: str = "fitch") -> DataFrame:
    """Block mutations of states (tree_id, name, block_id, forward) of the tips that have a block. The root is
    compared with absence, and takes it where it can unless it is given by `reference`.

    A tip is spelled as a text with a character for each block, - where it is absent, and the parsimony of
    texts does the rest: its first state is absence, the lowest of equals."""
    key = ["tree_id", "name"]
    tips = nodes.where("is_leaf").select(*key)
    width = states.groupBy("tree_id").agg((F.max("block_id") + 1).alias("width"))
    held = states.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("block_id", F.when(F.col("forward"), FORWARD).otherwise(REVERSE).alias("c")))).alias("x"))
    before = lambda i: F.when(i > 0, F.get("x", i - 1)["block_id"]).otherwise(-1)
    spelled = F.array_join(F.transform("x", lambda b, i: F.concat(F.repeat(F.lit(ABSENT), b["block_id"] - before(i) - 1), b["c"])), "")
    rows = tips.join(width, "tree_id").join(held, key, "left")
    texts = rows.select(*key, F.lit(0).alias("block_id"), F.rpad(F.coalesce(spelled, F.lit("")), F.col("width"), F.lit(ABSENT)).alias("seq"))
    blank = width.select("tree_id", F.lit(0).alias("block_id"), F.repeat(F.lit(ABSENT), F.col("width")).alias("seq"))
    found = parsimony.infer_by_block(nodes, texts, blank, reference, method, part_of_name=True)
    kind = F.when(F.col("type") == "D", "del").when(F.col("type") == "S", "inv").when(F.col("base") == FORWARD, "ins").otherwise("ins_inv")
    return found.select("tree_id", "node_id", F.col("site").alias("ord"), F.col("site").alias("block_id"), kind.alias("kind"))


def infer_blocks(
    nodes: DataFrame, states: DataFrame, texts: DataFrame, block: DataFrame, gap: DataFrame, reference: str | None = None, method: str = "fitch", pieces: Callable | None = None
) -> dict[str, DataFrame]:
    """node, nuc_mut and block_mut of trees for known tips: states as in block_mutations(), texts (tree_id,
    name, block_id, forward, text) with all columns of a block. Main bases start from the block's
    consensus, gap columns from gaps; tips without a block are unknown in its columns. pieces as in infer_by_block(),
    in forward direction."""
    from cladeframe.operators.sequence import patched
    from cladeframe.operators.variants import _own_positions

    turned = F.reverse(F.translate("text", "ACGTRYSWKMBDHVN", "TGCAYRSWMKVHDBN"))
    forward = texts.select("tree_id", "name", "block_id", F.when(F.col("forward"), F.col("text")).otherwise(turned).alias("seq"))
    gaps = gap.groupBy("tree_id", "block_id").agg(F.collect_list(F.struct("pos", "len")).alias("gaps"))
    blank = block.join(gaps, ["tree_id", "block_id"], "left").select(
        "tree_id", "block_id", F.lit(True).alias("forward"), "consensus", "gaps",
        F.array().cast("array<struct<pos:int,gap_pos:int,base:string>>").alias("writes"),
    )
    base = patched(blank, ["tree_id", "block_id"]).withColumnRenamed("text", "seq")
    muts = parsimony.infer_by_block(nodes, forward, base, reference, method, pieces=pieces)
    places = _own_positions({"block": block, "gap": gap})
    placed = muts.join(places.withColumnRenamed("at", "site"), ["tree_id", "block_id", "site"])
    nuc = mutations.pack(placed.select("tree_id", "node_id", "block_id", "pos", "gap_pos", "type", "base"))
    return {"node": nodes, "nuc_mut": nuc, "block_mut": block_mutations(nodes, states, reference, method)}


def from_gfa(nodes: DataFrame, segments: DataFrame, steps: DataFrame, guided: bool = False) -> dict[str, DataFrame]:
    """A network of whole segments from one tree's nodes and graph paths (path, step, segment, forward);
    every place of the paths' common order is a block. Paths are chained by name, or in the tree's order if guided."""
    spark = nodes.sparkSession
    from cladeframe.network import empty

    tree_id = nodes.select("tree_id").first()[0]
    paths = steps.select(F.lit(tree_id).cast("int").alias("tree_id"), "path", "step", F.col("segment").alias("block"), "forward")
    placed = written(graph.order_blocks(paths, nodes if guided else None))
    block = placed.select("tree_id", "at", "block").distinct().join(segments.withColumnRenamed("segment", "block"), "block")
    states = placed.select("tree_id", F.col("path").alias("name"), F.col("at").alias("block_id"), "forward")
    return {
        "node": nodes, "block": block.select("tree_id", F.col("at").alias("block_id"), F.col("seq").alias("consensus")),
        "block_mut": block_mutations(nodes, states), "gap": empty(spark, "gap"), "nuc_mut": empty(spark, "nuc_mut"),
        "seq_meta": empty(spark, "seq_meta"), "complex_mut": empty(spark, "complex_mut"),
    }


def edited(block: DataFrame, gaps: DataFrame, subs: DataFrame, ins: DataFrame, dels: DataFrame, uses: DataFrame) -> DataFrame:
    """path, block, occ and text (all columns of the block) of every use (path, block, occ) of a block: its
    consensus with the use's substitutions and deletions (positions from 1) and insertions put in."""
    from cladeframe.operators.sequence import patched

    key = ["block", "path", "occ"]
    each_del = dels.select(*key, F.explode(F.sequence(F.col("pos") - 1, F.col("pos") + F.col("len") - 2)).alias("pos"), F.lit(-1).alias("gap_pos"), F.lit("-").alias("base"))
    each_ins = ins.select(*key, "pos", "gap", F.posexplode(F.split("text", "")).alias("k", "base")).where("base <> ''").select(*key, "pos", (F.col("gap") + F.col("k")).alias("gap_pos"), "base")
    each_sub = subs.select(*key, (F.col("pos") - 1).alias("pos"), F.lit(-1).alias("gap_pos"), F.upper("base").alias("base"))
    writes = each_sub.unionByName(each_ins).unionByName(each_del).groupBy(key).agg(F.collect_list(F.struct("pos", "gap_pos", "base")).alias("writes"))
    lists = gaps.groupBy("block").agg(F.collect_list(F.struct("pos", "len")).alias("gaps"))
    rows = uses.join(block, "block").join(lists, "block", "left").join(writes, key, "left")
    return patched(rows.select(*key, F.lit(True).alias("forward"), F.col("seq").alias("consensus"), "gaps", "writes"), key)


def from_pangraph(nodes: DataFrame, tables: dict[str, DataFrame], reference: str | None = None, guided: bool = False) -> dict[str, DataFrame]:
    """A network from one tree's nodes and the tables of read_pangraph(). Circular paths are turned to fit
    the first one, all are chained into a common order of blocks, by name or in the tree's order if guided, and block and base mutations are
    inferred: by Sankoff where the tree has a node of more than two children, else by Fitch."""
    from cladeframe.network import empty
    from cladeframe.operators.tree import polytomies

    spark = nodes.sparkSession
    tree_id = nodes.select("tree_id").first()[0]
    method = "fitch" if polytomies(nodes).isEmpty() else "sankoff"
    use = tables["path"].select(F.lit(tree_id).cast("int").alias("tree_id"), "path", "step", "block", "forward", "occ", "circular")
    plain = use.drop("occ", "circular")
    circular = plain.join(use.where("circular").select("path").distinct(), "path", "left_semi")
    straight = plain.join(use.where("circular").select("path").distinct(), "path", "left_anti")
    turned = graph.rotate_paths(circular.select("tree_id", "path", "step", "block", "forward")).unionByName(straight.select("tree_id", "path", "step", "block", "forward"))
    placed = written(graph.order_blocks(turned, nodes if guided else None))
    nth = F.row_number().over(Window.partitionBy("path", "block").orderBy("at"))
    placed = placed.withColumn("occ", nth)
    block = placed.select("tree_id", "at", "block").distinct().join(tables["block"], "block").select("tree_id", F.col("at").alias("block_id"), F.col("seq").alias("consensus"))
    gap = placed.select("tree_id", "at", "block").distinct().join(tables["gap"], "block").select("tree_id", F.col("at").alias("block_id"), "pos", "len")
    texts = edited(tables["block"], tables["gap"], tables["sub"], tables["ins"], tables["del"], use.select("path", "block", "occ"))
    named = placed.select("tree_id", F.col("path").alias("name"), F.col("at").alias("block_id"), "forward", "block", "occ")
    full = named.join(texts.withColumnRenamed("path", "name"), ["name", "block", "occ"]).select("tree_id", "name", "block_id", F.lit(True).alias("forward"), "text")
    found = infer_blocks(nodes, named.select("tree_id", "name", "block_id", "forward"), full, block, gap, reference, method)
    offsets = tables["path"].select(F.col("path").alias("name"), "offset").distinct().join(nodes.where("is_leaf").select("tree_id", "node_id", "name"), "name")
    meta = offsets.select("tree_id", "node_id", F.col("offset").alias("circ_offset"), F.lit(0).alias("rot_block"), F.lit(False).alias("inverted"))
    return {**found, "block": block, "gap": gap, "seq_meta": meta, "complex_mut": empty(spark, "complex_mut")}
