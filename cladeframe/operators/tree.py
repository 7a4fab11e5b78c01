"""Trees as tables: nested sets, ancestors, counts and edits of topology."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeframe.operators.order import ranked, subtree_sums
from cladeframe.scratch import written

KEY = ["tree_id", "node_id"]


def is_ancestor(a_pre: Column, a_post: Column, pre: Column) -> Column:
    """True where a node with [a_pre, a_post] is an ancestor of, or is, the node at pre."""
    return (a_pre <= pre) & (pre <= a_post)


def closure(nodes: DataFrame, rounds: int | None = None, start: DataFrame | None = None) -> DataFrame:
    """(tree_id, node_id, anc_id, dist) for every node, or those of start (tree_id, node_id), and each of
    its ancestors, itself at 0.

    Paths double in length each round, so that a tree of depth d takes log2(d) equi-joins and no range
    join; rounds defaults to what the deepest node needs.
    """
    if rounds is None:
        deepest = nodes.agg(F.max("level")).first()[0] or 0
        rounds = max(1, int(deepest).bit_length())
    first = nodes if start is None else start.select(*KEY).distinct()
    paths = first.select(*KEY, F.col("node_id").alias("anc_id"), F.lit(0).alias("dist"))
    jump = nodes.where("parent_id is not null").select(*KEY, F.col("parent_id").alias("to"))
    step = 1
    for _ in range(rounds):
        moved = paths.join(jump.select("tree_id", F.col("node_id").alias("anc_id"), "to"), ["tree_id", "anc_id"])
        paths = paths.unionByName(moved.select("tree_id", "node_id", F.col("to").alias("anc_id"), (F.col("dist") + step).alias("dist")))
        if step * 2 > 1 << (rounds - 1):
            break
        paths = written(paths)
        onward = jump.select("tree_id", F.col("node_id").alias("to"), F.col("to").alias("further"))
        jump = written(jump.join(onward, ["tree_id", "to"]).select(*KEY, F.col("further").alias("to")))
        step *= 2
    return paths


def path_above(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """What closure() gives for wanted nodes (tree_id, node_id), one or a few of a tree: every node of a tree is
    looked at once for each of them."""
    own = wanted.select(*KEY).distinct().join(nodes, KEY).select("tree_id", "node_id", F.col("pre").alias("__pre"), F.col("level").alias("__level"))
    up = nodes.select("tree_id", F.col("node_id").alias("anc_id"), "pre", "post", "level").join(own, "tree_id")
    return up.where(is_ancestor(F.col("pre"), F.col("post"), F.col("__pre"))).select(*KEY, "anc_id", (F.col("__level") - F.col("level")).alias("dist"))


def leaves(nodes: DataFrame) -> DataFrame:
    return nodes.where("is_leaf")


def leaves_by_antijoin(nodes: DataFrame) -> DataFrame:
    """Nodes that are nobody's parent."""
    parents = nodes.select("tree_id", F.col("parent_id").alias("node_id")).where("node_id is not null").distinct()
    return nodes.join(parents, KEY, "left_anti")


def find(nodes: DataFrame, name: str) -> DataFrame:
    return nodes.where(F.col("name") == name)


def with_annotation(nodes: DataFrame, value: str) -> DataFrame:
    return nodes.where(F.array_contains("annotations", value))


def tips_under(nodes: DataFrame, name: str) -> DataFrame:
    """Leaves at or below the named node."""
    top = find(nodes, name).select("tree_id", F.col("pre").alias("lo"), F.col("post").alias("hi"))
    return nodes.join(top, "tree_id").where(F.col("is_leaf") & is_ancestor(F.col("lo"), F.col("hi"), F.col("pre"))).select(nodes.columns)


def polytomies(nodes: DataFrame) -> DataFrame:
    """Parents of more than two children, with their number."""
    return nodes.where("parent_id is not null").groupBy("tree_id", "parent_id").agg(F.count("*").alias("n_children")).where("n_children > 2")


def depth_stats(nodes: DataFrame) -> DataFrame:
    return leaves(nodes).groupBy("tree_id").agg(F.max("level").alias("max_depth"), F.avg("level").alias("mean_depth"))


def subtree_leaf_counts(nodes: DataFrame) -> DataFrame:
    """Leaves at or below each node."""
    return subtree_sums(nodes, {"n_leaves": F.col("is_leaf").cast("bigint")})


def level_order(nodes: DataFrame) -> DataFrame:
    return nodes.orderBy("tree_id", "level", "pre")


def annotate(nodes: DataFrame, annotations: DataFrame) -> DataFrame:
    """nodes with the values of a table (name, ord, value) appended in order of ord; unknown names have no effect."""
    values = annotations.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("ord", "value"))).alias("__v"))
    joined = nodes.join(values, "name", "left")
    added = F.coalesce(F.transform("__v", lambda x: x["value"]), F.array().cast("array<string>"))
    return joined.withColumn("annotations", F.concat(F.coalesce("annotations", F.array().cast("array<string>")), added)).select(nodes.columns)


def numbered(nodes: DataFrame) -> DataFrame:
    """nodes with pre, post, level, is_leaf and child_ord worked out anew from parent_id and the old child_ord
    (then node_id), and node_id set to pre; several roots of a tree follow each other.

    A tree is walked as a list: a step into each node and one out of it, each of which knows the step before.
    Steps are summed by pointer doubling, so that n nodes take log2(2n) joins, whatever the tree's shape, and no
    task has more than its share of them.
    """
    none = F.lit(-(1 << 31))
    rows = nodes.withColumn("__up", F.coalesce("parent_id", none))
    rows = written(ranked(rows, ["tree_id", "__up", "child_ord", "node_id"], "__rank"))
    family = rows.groupBy("tree_id", "__up").agg(F.min("__rank").alias("__first"), F.max("__rank").alias("__last"), F.count("*").alias("__n"))
    above = rows.select("tree_id", F.col("node_id").alias("__up"), F.col("__rank").alias("__above"))
    below = family.select("tree_id", F.col("__up").alias("node_id"), F.col("__last").alias("__below"))
    linked = rows.select("tree_id", "node_id", "__up", "__rank").join(family.select("tree_id", "__up", "__first"), ["tree_id", "__up"])
    linked = written(linked.join(above, ["tree_id", "__up"], "left").join(below, KEY, "left"))
    # step 2r goes into the node of rank r, step 2r + 1 out of it
    enter = F.when(F.col("__rank") == F.col("__first"), F.col("__above") * 2).otherwise(F.col("__rank") * 2 - 1)
    leave = F.coalesce(F.col("__below") * 2 + 1, F.col("__rank") * 2)
    both = F.inline(F.array(
        F.struct((F.col("__rank") * 2).alias("id"), enter.alias("before"), F.lit(1).cast("bigint").alias("into"), F.lit(0).cast("bigint").alias("out")),
        F.struct((F.col("__rank") * 2 + 1).alias("id"), leave.alias("before"), F.lit(0).cast("bigint").alias("into"), F.lit(1).cast("bigint").alias("out")),
    ))
    steps = linked.select(both)
    longest = linked.groupBy("tree_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    for k in range((2 * longest).bit_length()):
        steps = written(steps) if k % 2 == 0 else steps
        further = steps.select(F.col("id").alias("__to"), F.col("before").alias("__next"), F.col("into").alias("__in"), F.col("out").alias("__out"))
        # a list's first step looks for a key of its own, which nothing has, so that these do not meet in one task
        asked = steps.withColumn("__to", F.coalesce("before", -1 - F.col("id"))).join(further, "__to", "left")
        steps = asked.select("id", F.col("__next").alias("before"), (F.col("into") + F.coalesce("__in", F.lit(0))).alias("into"), (F.col("out") + F.coalesce("__out", F.lit(0))).alias("out"))
    went_in = F.col("id") % 2 == 0
    places = steps.groupBy(F.shiftright("id", 1).alias("__rank")).agg(
        (F.max(F.when(went_in, F.col("into"))) - 1).cast("int").alias("__pre"),
        (F.max(F.when(~went_in, F.col("into"))) - 1).cast("int").alias("__post"),
        (F.max(F.when(went_in, F.col("into") - F.col("out"))) - 1).cast("int").alias("__level"),
    )
    places = written(places.join(linked.select("__rank", "__first", "__above", "__below"), "__rank"))
    parents = places.select(F.col("__rank").alias("__above"), F.col("__pre").alias("__parent"))
    full = rows.join(places, "__rank").join(parents, "__above", "left")
    new = {
        "node_id": F.col("__pre"), "pre": F.col("__pre"), "post": F.col("__post"), "level": F.col("__level"), "parent_id": F.col("__parent"),
        "child_ord": (F.col("__rank") - F.col("__first")).cast("int"), "is_leaf": F.col("__below").isNull(),
    }
    return full.select(*[new.get(c, F.col(c)).alias(c) for c in nodes.columns])


def contract(nodes: DataFrame, requested: DataFrame, protected: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The subtree that the requested leaves or nodes (tree_id, name) span.

    Keeps every ancestor of a requested node, then merges each node with a single kept child into
    that child, unless one of the two is protected (tree_id, name): the child's name stays and lengths
    add up. Returns the renumbered nodes and a table (tree_id, old_id, node_id, dist) that says into
    which new node each kept old one went and how far above it stood.
    """
    wanted = nodes.join(requested.select("tree_id", "name").distinct(), ["tree_id", "name"])
    marked = closure(nodes, start=wanted).select("tree_id", F.col("anc_id").alias("node_id")).distinct()
    kept = written(nodes.join(marked, KEY))
    up = written(closure(kept))
    n_kept = kept.where("parent_id is not null").groupBy("tree_id", F.col("parent_id").alias("node_id")).agg(F.count("*").alias("n"))
    flagged = kept.join(n_kept, KEY, "left")
    if protected is not None:
        held = protected.select("tree_id", "name").distinct().withColumn("held", F.lit(True))
        flagged = flagged.join(held, ["tree_id", "name"], "left")
    else:
        flagged = flagged.withColumn("held", F.lit(None).cast("boolean"))
    flagged = flagged.withColumn("held", F.coalesce("held", F.lit(False)))
    child = flagged.select("tree_id", F.col("parent_id").alias("node_id"), F.col("held").alias("child_held"))
    child = child.where("node_id is not null").groupBy("tree_id", "node_id").agg(F.max("child_held").alias("child_held"))
    state = flagged.join(child, KEY, "left").withColumn("merges", (F.col("n") == 1) & ~F.col("held") & ~F.coalesce("child_held", F.lit(False)))
    state = written(state.withColumn("merges", F.coalesce("merges", F.lit(False))))
    stays = state.where(~F.col("merges")).select("tree_id", "node_id")
    # the nearest kept ancestor of each stayer is its new parent; those between merge into it
    above = up.join(stays, KEY).join(state.select("tree_id", F.col("node_id").alias("anc_id"), "merges", "branch_len"), ["tree_id", "anc_id"])
    nearest = above.where((F.col("dist") > 0) & ~F.col("merges")).groupBy(KEY).agg(F.min("dist").alias("stop"), F.min_by("anc_id", "dist").alias("new_parent"))
    nearest = written(nearest)
    chain = above.join(nearest, KEY, "left").where(F.col("stop").isNull() | (F.col("dist") < F.col("stop")))
    lengths = chain.groupBy(KEY).agg(F.sum("branch_len").cast("float").alias("new_len"))
    base = state.where(~F.col("merges")).select(nodes.columns)
    joined = base.join(lengths, KEY).join(nearest.select(*KEY, "new_parent"), KEY, "left")
    fresh = joined.withColumn("branch_len", F.when(F.col("new_parent").isNull(), F.lit(0.0)).otherwise(F.col("new_len")).cast("float"))
    fresh = fresh.withColumn("parent_id", F.col("new_parent")).withColumn("child_ord", F.col("pre"))
    marked_old = fresh.withColumn("annotations", F.concat(F.array(F.col("node_id").cast("string")), F.coalesce("annotations", F.array().cast("array<string>"))))
    numbered_ = written(numbered(marked_old.select(nodes.columns)))
    ids = numbered_.select("tree_id", F.col("annotations")[0].cast("int").alias("stay_id"), F.col("node_id").alias("new_id"))
    where = chain.select("tree_id", F.col("node_id").alias("stay_id"), F.col("anc_id").alias("old_id"), "dist")
    mapping = where.join(ids, ["tree_id", "stay_id"]).select("tree_id", "old_id", F.col("new_id").alias("node_id"), "dist")
    clean = numbered_.withColumn("annotations", F.slice("annotations", 2, F.greatest(F.size("annotations") - 1, F.lit(1))))
    return clean.select(nodes.columns), mapping


def reroot(nodes: DataFrame, tip: str) -> DataFrame:
    """The tree with a new root above the named tip; ValueError if there is no such tip.

    Where the tip hangs on the root already the topology stays. Else the new root has two children:
    the tip at length 0 and the rest, whose links on the way from the tip's parent to the old root
    are turned round; an old root that is left with one child goes.
    """
    row = nodes.where((F.col("name") == tip) & F.col("is_leaf")).select("tree_id", "node_id", "pre", "parent_id").first()
    if row is None:
        raise ValueError(f"no tip {tip!r}")
    tree = nodes.where(F.col("tree_id") == row.tree_id)
    on_path = is_ancestor(F.col("pre"), F.col("post"), F.lit(row.pre)) & (F.col("node_id") != row.node_id)
    path = tree.where(on_path).orderBy(F.desc("level")).select("node_id", "branch_len", "name").collect()
    if len(path) <= 1:
        return tree
    n_root = tree.where(F.col("parent_id") == path[-1].node_id).count()
    # the child of each path node on the path becomes its parent, at the child's old length
    turned = {path[0].node_id: (-1, float(1.0 if path[0].branch_len == 0 else path[0].branch_len))}
    for below, here in zip(path, path[1:]):
        turned[here.node_id] = (below.node_id, float(below.branch_len))
    gone = None
    if n_root == 2:
        gone = path[-1].node_id
        inner = path[-2].node_id
        other = tree.where((F.col("parent_id") == gone) & (F.col("node_id") != inner)).select("node_id", "branch_len").first()
        turned.pop(gone)
        turned[other.node_id] = (inner, float(other.branch_len) + float(path[-2].branch_len))
    turned[row.node_id] = (-1, 0.0)
    spark = nodes.sparkSession
    links = spark.createDataFrame([(i, to, size) for i, (to, size) in turned.items()], "node_id int, __parent int, __len float")
    rest = tree.where(F.lit(True) if gone is None else F.col("node_id") != gone).join(links, "node_id", "left")
    rest = rest.withColumn("parent_id", F.coalesce("__parent", "parent_id")).withColumn("branch_len", F.coalesce("__len", "branch_len"))
    rest = rest.withColumn("child_ord", F.when(F.col("node_id") == row.node_id, F.lit(-1)).otherwise(F.col("pre")).cast("int")).select(nodes.columns)
    top = spark.createDataFrame([(row.tree_id, -1, "new_root", None, 0, 0, 0, 0, 0.0, False, [])], nodes.schema)
    return numbered(rest.unionByName(top))


def split(nodes: DataFrame, name: str, new_tree: int) -> tuple[DataFrame, DataFrame]:
    """The tree without the subtree at the named node, and that subtree as tree new_tree."""
    top = find(nodes, name).select("tree_id", F.col("pre").alias("lo"), F.col("post").alias("hi")).first()
    if top is None:
        raise ValueError(f"no node {name!r}")
    inside = (F.col("tree_id") == top.tree_id) & is_ancestor(F.lit(top.lo), F.lit(top.hi), F.col("pre"))
    part = nodes.where(inside).withColumn("tree_id", F.lit(new_tree).cast("int"))
    part = part.withColumn("parent_id", F.when(F.col("pre") == top.lo, F.lit(None)).otherwise(F.col("parent_id")).cast("int"))
    part = part.withColumn("branch_len", F.when(F.col("pre") == top.lo, F.lit(0.0)).otherwise(F.col("branch_len")).cast("float"))
    return nodes.where(~inside), part
