"""Edits of networks: subtrees, new roots, splits, and the trees that complex mutations make."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeframe.operators import build, mutations, parsimony, replay, sequence, spelling, tree
from cladeframe.operators.order import ranked
from cladeframe.scratch import written


def _carried(net: dict[str, DataFrame], mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mutations of bases and blocks moved to the new nodes of mapping (tree_id, old_id, node_id, dist)
    and consolidated, those of farther ancestors first."""
    old = mapping.select("tree_id", "old_id", F.col("node_id").alias("to"), (-F.col("dist")).alias("d"))
    bases = mutations.unpack(net["nuc_mut"]).withColumnRenamed("node_id", "old_id").join(old, ["tree_id", "old_id"])
    bases = bases.withColumnRenamed("to", "node_id")
    nuc = mutations.pack(mutations.consolidate(bases, ["d", "ord"]))
    blocks = net["block_mut"].withColumnRenamed("node_id", "old_id").join(old, ["tree_id", "old_id"])
    steps = F.array_sort(F.collect_list(F.struct("d", "ord", "kind")))
    merged = blocks.groupBy("tree_id", F.col("to").alias("node_id"), "block_id").agg(mutations.merge_blocks(F.transform(steps, lambda x: x["kind"])).alias("kind"))
    merged = merged.where("kind is not null").withColumn("ord", F.col("block_id"))
    return nuc, merged.select("tree_id", "node_id", "ord", "block_id", "kind")


def _meta(net: dict[str, DataFrame], mapping: DataFrame) -> DataFrame:
    own = mapping.where("dist = 0").select("tree_id", "old_id", "node_id")
    return net["seq_meta"].withColumnRenamed("node_id", "old_id").join(own, ["tree_id", "old_id"]).select(net["seq_meta"].columns)


def subnet(net: dict[str, DataFrame], requested: DataFrame, protected: DataFrame | None = None) -> dict[str, DataFrame]:
    """The network that the requested nodes (tree_id, name) span; nodes of complex mutations in those trees
    are asked for too and stay unmerged. An unknown name raises ValueError."""
    unknown = requested.join(net["node"], ["tree_id", "name"], "left_anti")
    if not unknown.isEmpty():
        raise ValueError(f"unknown nodes: {[r.name for r in unknown.limit(5).collect()]}")
    events = net["complex_mut"]
    named = [events.select(F.col(f"tree{i}").alias("tree_id"), F.col(f"seq{i}").alias("name")) for i in (1, 2, 3)]
    held = named[0].unionByName(named[1]).unionByName(named[2]).distinct().join(requested.select("tree_id").distinct(), "tree_id")
    held = held if protected is None else held.unionByName(protected.select("tree_id", "name"))
    nodes, mapping = tree.contract(net["node"], requested.select("tree_id", "name").unionByName(held.select("tree_id", "name")), held)
    mapping = written(mapping)
    nuc, block_mut = _carried(net, mapping)
    kept = nodes.select("tree_id").distinct()
    return {
        **net, "node": nodes, "nuc_mut": nuc, "block_mut": block_mut, "seq_meta": _meta(net, mapping),
        "block": net["block"].join(kept, "tree_id"), "gap": net["gap"].join(kept, "tree_id"),
    }


def reroot(network, tip: str):
    """The network with a root above the tip, all mutations inferred anew by Fitch with the root in the tip's state."""
    net = network.tables
    nodes = written(tree.reroot(net["node"], tip))
    tips = net["node"].where("is_leaf").select("tree_id", "node_id")
    names = net["node"].select("tree_id", "node_id", "name")
    states = sequence.block_states(net["node"], net["block_mut"]).join(names, ["tree_id", "node_id"]).join(tips, ["tree_id", "node_id"], "left_semi")
    # tips are spelled where they are cut for inference, under their new numbers; as texts only the reference's blocks are needed
    first = names.where(F.col("name") == tip).join(tips, ["tree_id", "node_id"], "left_semi")
    texts = sequence.block_texts(net, first).join(names, ["tree_id", "node_id"])
    cut = lambda to: spelling.pieces(net, names.join(to.withColumnRenamed("node_id", "to"), ["tree_id", "name"]), parsimony.COLUMNS)
    trees = nodes.select("tree_id").distinct()
    part = {k: v.join(trees, "tree_id") if k != "complex_mut" else v for k, v in net.items()}
    again = build.infer_blocks(nodes, states.join(trees, "tree_id"), texts.join(trees, "tree_id"), part["block"], part["gap"], tip, pieces=cut)
    again["nuc_mut"] = written(again["nuc_mut"])
    # nodes are numbered anew, and a tip's start and direction go with its name
    own = part["seq_meta"].join(names, ["tree_id", "node_id"]).drop("node_id").join(nodes.select("tree_id", "node_id", "name"), ["tree_id", "name"])
    again["seq_meta"] = own.select(net["seq_meta"].columns)
    rest = {k: v.join(trees, "tree_id", "left_anti") for k, v in net.items() if k != "complex_mut"}
    return type(network)({**net, **{k: rest[k].unionByName(again[k]) for k in ("node", "nuc_mut", "block_mut", "seq_meta")}})


def split(net: dict[str, DataFrame], name: str, new_tree: int) -> dict[str, DataFrame]:
    """The subtree at the named node as tree new_tree, whose root has all mutations of its path
    consolidated; the rest stays, with an inner node that loses its last child left as it is."""
    top = tree.find(net["node"], name).select("tree_id", "node_id").first()
    if top is None:
        raise ValueError(f"no node {name!r}")
    kept, part = tree.split(net["node"], name, new_tree)
    paths = tree.closure(net["node"], start=tree.find(net["node"], name))
    onto = paths.select("tree_id", F.col("anc_id").alias("old_id"), "node_id", "dist")
    inside = part.where("parent_id is not null").select(F.lit(top.tree_id).alias("tree_id"), F.col("node_id").alias("old_id"), "node_id", F.lit(0).alias("dist"))
    nuc, block_mut = _carried(net, onto.unionByName(inside))
    moved = lambda df: df.withColumn("tree_id", F.lit(new_tree).cast("int"))
    gone = part.select(F.lit(top.tree_id).alias("tree_id"), "node_id")
    own = lambda df: df.join(gone, ["tree_id", "node_id"], "left_anti")
    same = F.col("tree_id") == top.tree_id
    out = {
        "node": kept.unionByName(part),
        "nuc_mut": own(net["nuc_mut"]).unionByName(moved(nuc)),
        "block_mut": own(net["block_mut"]).unionByName(moved(block_mut)),
        "seq_meta": own(net["seq_meta"]).unionByName(moved(net["seq_meta"].join(gone, ["tree_id", "node_id"]))),
        "block": net["block"].unionByName(moved(net["block"].where(same))),
        "gap": net["gap"].unionByName(moved(net["gap"].where(same))),
    }
    return {**net, **out}


def create_network(net: dict[str, DataFrame], events: DataFrame) -> dict[str, DataFrame]:
    """Apply complex mutations (see schemas.COMPLEX_MUT) in order of their rows.

    An event counts if its three nodes are there and, where a parent and the child share a tree, the
    child is not the parent's ancestor or the parent itself. Its child becomes the root of a tree of its
    own; later events find their nodes in whichever tree these are by then. Of nodes of one name the first by tree and
    number is taken.

    Which events count is found in rounds over all events at once: one whose child stands above a parent
    counts when an earlier one that counts has cut between them, so that a round settles whatever the rounds
    before allow. All cuts are made together at the end, and plans do not grow with the events.
    """
    nodes = net["node"]
    listed = written(ranked(written(events.withColumn("__k", F.monotonically_increasing_id())), ["__k"], "i").drop("__k"))
    names = nodes.groupBy("name").agg(F.min(F.struct("tree_id", "node_id", "pre", "post", "parent_id")).alias("x"))
    known = listed
    for k in (1, 2, 3):
        known = known.join(names.select(F.col("name").alias(f"seq{k}"), F.col("x").alias(f"n{k}")), f"seq{k}")
    known = written(known)
    child = F.col("n3")
    under = lambda p: (p["tree_id"] == child["tree_id"]) & p["pre"].between(child["pre"], child["post"])
    sides = [known.select("i", F.col(f"n{k}.tree_id").alias("tree_id"), F.col(f"n{k}.node_id").alias("node_id"), F.lit(k).alias("side"), under(F.col(f"n{k}")).alias("under"), F.col("n3.pre").alias("top")) for k in (1, 2)]
    parents = sides[0].unionByName(sides[1])
    # the children of other events at or above a parent, where their cuts may part it from its tree
    cuts = known.select(F.col("i").alias("j"), F.col("n3.tree_id").alias("tree_id"), F.col("n3.node_id").alias("anc_id"), F.col("n3.pre").alias("cut_pre"), F.col("n3.parent_id").isNull().alias("is_root"))
    paths = _paths(nodes, parents.select("tree_id", "node_id"))
    met = written(parents.join(paths, ["tree_id", "node_id"]).join(cuts, ["tree_id", "anc_id"]).where("j < i and not is_root"))
    between = met.where("under and cut_pre > top").select("i", "side", "j")
    needs = parents.where("under").groupBy("i").agg(F.count("*").alias("n"))
    good = written(known.select("i").join(needs, "i", "left_anti"))
    while True:
        now = between.join(good.select(F.col("i").alias("j")), "j", "left_semi").groupBy("i").agg(F.countDistinct("side").alias("have"))
        more = now.join(needs, "i").where("have = n").select("i").join(good, "i", "left_anti")
        if more.isEmpty():
            break
        good = written(good.unionByName(more))

    counted = written(known.join(good, "i", "left_semi"))
    first = counted.where("n3.parent_id is not null").groupBy(F.col("n3.tree_id").alias("tree_id"), F.col("n3.node_id").alias("node_id")).agg(F.min("i").alias("i"), F.min("n3.pre").alias("pre"))
    after = int(nodes.agg(F.max("tree_id")).first()[0]) + 1
    made = written(ranked(first, ["i"], "__new").select("tree_id", "node_id", "i", "pre", (F.col("__new") + after).cast("int").alias("new_tree")))

    # the tree of a parent when its event comes is that of the nearest cut above it by then
    cut_by = met.join(made.select("tree_id", F.col("node_id").alias("anc_id"), F.col("i").alias("done"), "new_tree"), ["tree_id", "anc_id"]).where("done < i")
    then = cut_by.groupBy("i", "side").agg(F.min_by("new_tree", "dist").alias("t"))
    rows = counted
    for k in (1, 2):
        rows = rows.join(then.where(F.col("side") == k).select("i", F.col("t").alias(f"t{k}")), "i", "left").withColumn(f"tree{k}", F.coalesce(f"t{k}", F.col(f"n{k}.tree_id")).cast("int"))
    home = made.select(F.struct("tree_id", "node_id").alias("own"), "new_tree")
    rows = rows.withColumn("own", F.struct(F.col("n3.tree_id").alias("tree_id"), F.col("n3.node_id").alias("node_id"))).join(home, "own", "left")
    rows = rows.withColumn("tree3", F.coalesce("new_tree", F.col("n3.tree_id")).cast("int")).select(events.columns)
    done = {**net, "complex_mut": written(net["complex_mut"].unionByName(rows))}
    return done if made.isEmpty() else {**done, **_cut(net, made)}


def _paths(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """The closure of wanted nodes, written once."""
    return written(tree.closure(nodes, start=wanted.distinct()))


def _cut(net: dict[str, DataFrame], made: DataFrame) -> dict[str, DataFrame]:
    """The network with the subtree at every node of made (tree_id, node_id, new_tree) as a tree of its own, less what
    is cut below it; the root of a new tree has all mutations of its path consolidated."""
    nodes = net["node"]
    at = replay.nearest(nodes, made.select("tree_id", "node_id", F.col("new_tree").cast("string").alias("mark")))
    moved = written(at.where("mark is not null").select("tree_id", "node_id", F.col("mark").cast("int").alias("new_tree")))
    tops = made.select("tree_id", "node_id", F.lit(True).alias("top"))
    key = ["tree_id", "node_id"]
    goes = lambda df: df.join(moved, key, "left").withColumn("tree_id", F.coalesce("new_tree", "tree_id")).select(df.columns)
    placed = nodes.join(tops, key, "left").withColumn("parent_id", F.when(F.col("top").isNull(), F.col("parent_id")))
    placed = placed.withColumn("branch_len", F.when(F.col("top").isNull(), F.col("branch_len")).otherwise(F.lit(0.0)).cast("float")).select(nodes.columns)
    stays = lambda df: goes(df.join(tops, key, "left_anti"))
    onto = _paths(nodes, made.select(key)).select("tree_id", F.col("anc_id").alias("old_id"), "node_id", "dist")
    nuc, block_mut = _carried(net, onto)
    homes = made.select("tree_id", "new_tree").distinct()
    copied = lambda df: df.unionByName(df.join(homes, "tree_id").withColumn("tree_id", F.col("new_tree")).select(df.columns))
    return {
        "node": written(goes(placed)), "nuc_mut": written(stays(net["nuc_mut"]).unionByName(goes(nuc))), "block_mut": written(stays(net["block_mut"]).unionByName(goes(block_mut))),
        "seq_meta": written(goes(net["seq_meta"])), "block": copied(net["block"]), "gap": copied(net["gap"]),
    }


def event_coordinates(net: dict[str, DataFrame]) -> DataFrame:
    """Complex mutations with their bounds, which count the bases of the parents, as (block_id, column in the block)."""
    events = net["complex_mut"].withColumn("__i", F.monotonically_increasing_id())
    names = net["node"].select("tree_id", "node_id", F.col("name").alias("seq"))
    points = [(f"{side}{i}", i) for i in (1, 2) for side in ("s", "e")]
    wanted = events.select(F.explode(F.array(*[F.struct(F.col(f"tree{i}").alias("tree_id"), F.col(f"seq{i}").alias("seq"), F.col(p).alias("n"), F.lit(p).alias("p"), "__i") for p, i in points])).alias("x")).select("x.*")
    wanted = wanted.join(names, ["tree_id", "seq"])
    index = sequence.coordinate_index(net, wanted.select("tree_id", "node_id").distinct())
    hit = sequence.base_places(index, wanted.withColumn("nth", F.col("n") + 1))
    wide = hit.groupBy("__i").pivot("p", [p for p, _ in points]).agg(F.first(F.struct("block_id", "at")))
    return events.select("__i", "type", "tree1", "seq1", "tree2", "seq2", "tree3", "seq3").join(wide, "__i", "left").drop("__i")
