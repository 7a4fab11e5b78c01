"""Records of mutations: runs, ordered folds, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeframe.functions.codes import merged_type
from cladeframe.schemas import MAX_RUN

BASE = ["tree_id", "node_id", "block_id", "pos", "gap_pos"]


def runs(rows: DataFrame, partition: list[str], at: str, same: list[str], longest: int | None = None) -> DataFrame:
    """rows with run, a number in its partition of rows that follow each other: at goes up by one and
    the columns `same` stay; with longest, a run is cut after so many rows."""
    order = Window.partitionBy(*partition).orderBy(at)
    follows = F.col(at) == F.lag(at).over(order) + 1
    for c in same:
        follows = follows & F.col(c).eqNullSafe(F.lag(c).over(order))
    marked = rows.withColumn("__new", (~F.coalesce(follows, F.lit(False))).cast("int"))
    islands = marked.withColumn("__island", F.sum("__new").over(order))
    inside = Window.partitionBy(*partition, "__island").orderBy(at)
    nth = F.row_number().over(inside) - 1
    cut = islands.withColumn("__cut", (nth % longest == 0).cast("int") if longest else F.col("__new"))
    return cut.withColumn("run", F.sum("__cut").over(order)).drop("__new", "__island", "__cut")


def pack(mutations: DataFrame, longest: int = MAX_RUN) -> DataFrame:
    """Base mutations (tree_id, node_id, block_id, pos, gap_pos, type, base) to records of up to six
    neighbours of one type: main bases next to each other, or gap columns next to each other.

    A node's mutations meet once and are sorted twice, by lane and for their numbers; a record's first base takes the others
    from the rows behind it, so that nothing is grouped."""
    main = F.col("gap_pos") == -1
    keyed = mutations.select(*BASE, "type", "base", F.when(main, F.lit(-1)).otherwise(F.col("pos")).alias("__lane"), F.when(main, F.col("pos")).otherwise(F.col("gap_pos")).alias("__at"))
    order = Window.partitionBy("tree_id", "node_id", "block_id", "__lane").orderBy("__at")
    follows = (F.col("__at") == F.lag("__at").over(order) + 1) & F.col("type").eqNullSafe(F.lag("type").over(order))
    begun = keyed.repartition("tree_id", "node_id").withColumn("__new", ~F.coalesce(follows, F.lit(False)))
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begun = begun.withColumn("__first", F.last(F.when(F.col("__new"), F.col("__at")), ignorenulls=True).over(upto))
    heads = begun.withColumn("__head", (F.col("__at") - F.col("__first")) % longest == 0)
    chars, goes_on = [F.col("base")], F.lit(True)
    for k in range(1, longest):
        goes_on = goes_on & ~F.coalesce(F.lead("__new", k).over(order), F.lit(True))
        chars.append(F.when(goes_on, F.lead("base", k).over(order)).otherwise(""))
    packed = heads.withColumn("chars", F.concat(*chars)).where("__head")
    numbered = Window.partitionBy("tree_id", "node_id").orderBy("block_id", "pos", "gap_pos", "type")
    return packed.select(
        "tree_id", "node_id", (F.row_number().over(numbered) - 1).alias("ord"), "block_id", "pos", "gap_pos", "type", F.length("chars").alias("len"), "chars"
    )


def unpack(records: DataFrame) -> DataFrame:
    """One row a base of packed records: tree_id, node_id, ord, block_id, pos, gap_pos, type, base."""
    each = records.select("*", F.posexplode(F.split("chars", "")).alias("__i", "base")).where(F.col("base") != "")
    main = F.col("gap_pos") == -1
    return each.select(
        "tree_id", "node_id", "ord", "block_id",
        F.when(main, F.col("pos") + F.col("__i")).otherwise(F.col("pos")).alias("pos"),
        F.when(main, F.lit(-1)).otherwise(F.col("gap_pos") + F.col("__i")).alias("gap_pos"),
        "type", "base",
    )


def fold_types(ordered: Column) -> Column:
    """Type and base that a base's mutations in order (array of struct(type, base)) come to; null type where they cancel."""
    empty = F.struct(F.lit(None).cast("string").alias("type"), F.lit(None).cast("string").alias("base"))

    def step(acc: Column, e: Column) -> Column:
        kind = F.when(acc["type"].isNull(), e["type"]).otherwise(merged_type(acc["type"], e["type"]))
        return F.struct(kind.alias("type"), e["base"].alias("base"))

    return F.aggregate(ordered, empty, step)


def consolidate(mutations: DataFrame, order: list[str]) -> DataFrame:
    """One mutation a node and base out of several in order; those that cancel are gone.
    Takes and returns base mutations; a later one is merged into what the earlier ones came to."""
    steps = F.array_sort(F.collect_list(F.struct(*order, "type", "base")))
    folded = mutations.groupBy(BASE).agg(fold_types(F.transform(steps, lambda x: F.struct(x["type"], x["base"]))).alias("x"))
    return folded.select(*BASE, F.col("x.type").alias("type"), F.col("x.base").alias("base")).where("type is not null")


def fold_blocks(ordered: Column) -> Column:
    """exists and forward of a block after its mutations in order (array of kinds): an insertion sets
    both, a flip turns the strand, a deletion resets."""
    start = F.struct(F.lit(False).alias("exists"), F.lit(True).alias("forward"))

    def step(acc: Column, kind: Column) -> Column:
        exists = F.when(kind.isin("ins", "ins_inv"), True).when(kind == "del", False).otherwise(acc["exists"])
        forward = F.when(kind == "ins", True).when(kind == "ins_inv", False).when(kind == "del", True).otherwise(~acc["forward"])
        return F.struct(exists.alias("exists"), forward.alias("forward"))

    return F.aggregate(ordered, start, step)


def merge_blocks(ordered: Column) -> Column:
    """The one mutation that a block's mutations in order come to, or null: an insertion takes in flips
    and is cancelled by a deletion; a deletion takes in earlier flips; two flips cancel."""

    def step(acc: Column, kind: Column) -> Column:
        return (
            F.when(acc == "", kind)
            .when(acc.isin("ins", "ins_inv") & (kind == "inv"), F.when(acc == "ins", "ins_inv").otherwise("ins"))
            .when(acc.isin("ins", "ins_inv") & (kind == "del"), "")
            .when((acc == "inv") & (kind == "inv"), "")
            .when((acc == "inv") & (kind == "del"), "del")
            .otherwise(kind)
        )

    return F.nullif(F.aggregate(ordered, F.lit(""), step), F.lit(""))


def present(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Rows whose block is there at their node (blocks: tree_id, node_id, block_id)."""
    return rows.join(blocks, ["tree_id", "node_id", "block_id"], "left_semi")


def count_by_type(records: DataFrame, type_col: str = "type") -> DataFrame:
    return records.groupBy(type_col).agg(F.count("*").alias("n"))


def branch_counts(nodes: DataFrame, nuc_mut: DataFrame) -> DataFrame:
    """tree_id, node_id, name, type and n, the bases that a branch changes, of every branch and type with some."""
    counts = nuc_mut.groupBy("tree_id", "node_id", "type").agg(F.sum(F.col("len").cast("bigint")).alias("n"))
    return counts.join(nodes.select("tree_id", "node_id", "name"), ["tree_id", "node_id"]).select("tree_id", "node_id", "name", "type", "n")


def block_totals(block_mut: DataFrame) -> DataFrame:
    """Insertions, deletions and flips of blocks over whole trees, the root's included; an inverted insertion counts as both."""
    kind = F.col("kind")
    return block_mut.groupBy("tree_id").agg(
        F.count_if(kind.isin("ins", "ins_inv")).alias("block_insertions"),
        F.count_if(kind == "del").alias("block_deletions"),
        F.count_if(kind.isin("inv", "ins_inv")).alias("block_inversions"),
    )


def summary(nodes: DataFrame, nuc_mut: DataFrame, block_mut: DataFrame) -> DataFrame:
    """Nodes, samples, records of each kind and leaf depths of every tree. Mutation records are counted
    without the root's, and blocks count with insertions and deletions; the totals of blocks have the root's."""
    roots = nodes.where("parent_id is null").select("tree_id", "node_id")
    by_tree = nodes.groupBy("tree_id").agg(
        F.count("*").alias("nodes"),
        F.count_if("is_leaf").alias("samples"),
        F.max(F.when(F.col("is_leaf"), F.col("level"))).alias("max_depth"),
        F.avg(F.when(F.col("is_leaf"), F.col("level"))).alias("mean_depth"),
    )
    nucs = nuc_mut.join(roots, ["tree_id", "node_id"], "left_anti").groupBy("tree_id").agg(
        *[F.count_if(F.col("type") == t).alias(f"nuc_{t}") for t in "SID"]
    )
    below = block_totals(block_mut.join(roots, ["tree_id", "node_id"], "left_anti")).toDF("tree_id", "bi", "bd", "bn")
    joined = by_tree.join(nucs, "tree_id", "left").join(below, "tree_id", "left").join(block_totals(block_mut), "tree_id", "left").na.fill(0)
    return joined.select(
        "tree_id", "nodes", "samples", F.col("nuc_S").alias("substitutions"),
        (F.col("nuc_I") + F.col("bi")).alias("insertions"), (F.col("nuc_D") + F.col("bd")).alias("deletions"),
        F.col("bn").alias("inversions"), "max_depth", "mean_depth", "block_insertions", "block_deletions", "block_inversions",
    )


def copies(states: DataFrame, blocks: DataFrame, nodes: DataFrame) -> DataFrame:
    """duplications and translocations of every tree. states: tree_id, node_id, block_id of present
    blocks. A block that is new at a node counts once: as a duplication where another block of equal
    consensus stands before and after, else as a translocation where it stood before and not after."""
    twins = blocks.alias("a").join(blocks.alias("b"), (F.col("a.tree_id") == F.col("b.tree_id")) & (F.col("a.consensus") == F.col("b.consensus")) & (F.col("a.block_id") != F.col("b.block_id")))
    twins = twins.select(F.col("a.tree_id").alias("tree_id"), F.col("a.block_id").alias("block_id"), F.col("b.block_id").alias("twin"))
    up = nodes.where("parent_id is not null").select("tree_id", "node_id", "parent_id")
    here = states.join(up, ["tree_id", "node_id"])
    before = states.select("tree_id", F.col("node_id").alias("parent_id"), "block_id")
    new = here.join(before, ["tree_id", "parent_id", "block_id"], "left_anti").join(twins, ["tree_id", "block_id"])
    stood = before.select("tree_id", "parent_id", F.col("block_id").alias("twin"), F.lit(True).alias("stood"))
    stands = states.select("tree_id", "node_id", F.col("block_id").alias("twin"), F.lit(True).alias("stands"))
    seen = new.join(stood, ["tree_id", "parent_id", "twin"]).join(stands, ["tree_id", "node_id", "twin"], "left")
    per_block = seen.groupBy("tree_id", "node_id", "block_id").agg(F.min_by(F.coalesce("stands", F.lit(False)), "twin").alias("dup"))
    return per_block.groupBy("tree_id").agg(F.count_if("dup").alias("duplications"), F.count_if(~F.col("dup")).alias("translocations"))
