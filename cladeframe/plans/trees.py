"""Queries of trees and parsimony over a hierarchy: world, regions, nations, suppliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from cladeframe.operators import parsimony, tree
from cladeframe.plans.registry import query, table
from cladeframe.scratch import written
from cladeframe.sources import newick

#: The hierarchy as numbered nodes: 0 the world, then regions from 1, nations from 100, suppliers from 1000.
_NODES = """n AS (SELECT 0 AS node_id, CAST(NULL AS INTEGER) AS parent_id, 0 AS level, 'world' AS name
UNION ALL SELECT 1 + r_regionkey, 0, 1, r_name FROM region UNION ALL SELECT 100 + n_nationkey, 1 + n_regionkey, 2, n_name FROM nation
UNION ALL SELECT CAST(1000 + s_suppkey AS INTEGER), 100 + s_nationkey, 3, s_name FROM supplier)"""
_UP = """u AS (SELECT node_id, node_id AS anc_id, 0 AS dist FROM n UNION ALL SELECT n.node_id, n.parent_id, 1 FROM n WHERE parent_id IS NOT NULL
UNION ALL SELECT a.node_id, b.parent_id, 2 FROM n a JOIN n b ON a.parent_id = b.node_id WHERE b.parent_id IS NOT NULL
UNION ALL SELECT a.node_id, c.parent_id, 3 FROM n a JOIN n b ON a.parent_id = b.node_id JOIN n c ON b.parent_id = c.node_id WHERE c.parent_id IS NOT NULL)"""


def hierarchy(spark, sf_dir):
    """Nodes of the hierarchy; rows of SCHEMA node without numbering in pre-order."""
    row = lambda i, p, lv, name, leaf: [i.cast("int").alias("node_id"), p.cast("int").alias("parent_id"), F.lit(lv).alias("level"), name.alias("name"), F.lit(leaf).alias("is_leaf")]
    top = spark.range(1).select(*row(F.lit(0), F.lit(None), 0, F.lit("world"), False))
    region = table(spark, sf_dir, "region").select(*row(F.col("r_regionkey") + 1, F.lit(0), 1, F.col("r_name"), False))
    nation = table(spark, sf_dir, "nation").select(*row(F.col("n_nationkey") + 100, F.col("n_regionkey") + 1, 2, F.col("n_name"), False))
    supplier = table(spark, sf_dir, "supplier").select(*row(F.col("s_suppkey") + 1000, F.col("s_nationkey") + 100, 3, F.col("s_name"), True))
    return top.unionByName(region).unionByName(nation).unionByName(supplier).withColumn("tree_id", F.lit(0))


@query(f"WITH {_NODES}, {_UP} SELECT node_id, anc_id, dist FROM u")
def ancestor_closure(spark, sf_dir):
    return tree.closure(hierarchy(spark, sf_dir), rounds=2).select("node_id", "anc_id", "dist")


@query(f"WITH {_NODES}, {_UP} SELECT u.anc_id AS node_id, count(*) AS n_leaves FROM u JOIN n ON u.node_id = n.node_id WHERE n.level = 3 GROUP BY u.anc_id")
def subtree_leaf_counts(spark, sf_dir):
    nodes = hierarchy(spark, sf_dir)
    up = tree.closure(nodes, rounds=2).join(nodes.where("is_leaf").select("tree_id", "node_id"), ["tree_id", "node_id"])
    return up.groupBy(F.col("anc_id").alias("node_id")).agg(F.count("*").alias("n_leaves"))


@query("""WITH o AS (SELECT n_nationkey, n_regionkey, row_number() OVER (ORDER BY n_regionkey, n_nationkey) AS pre FROM nation),
r AS (SELECT n_regionkey, min(pre) AS lo, max(pre) AS hi FROM o GROUP BY n_regionkey)
SELECT r.n_regionkey, o.n_nationkey FROM r JOIN o ON o.pre BETWEEN r.lo AND r.hi""")
def preorder_interval_join(spark, sf_dir):
    from pyspark.sql import Window

    order = F.row_number().over(Window.orderBy("n_regionkey", "n_nationkey"))  # 25 nations
    o = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").alias("own"), order.alias("pre"))
    r = o.groupBy(F.col("own").alias("n_regionkey")).agg(F.min("pre").alias("lo"), F.max("pre").alias("hi"))
    return o.join(F.broadcast(r), tree.is_ancestor(F.col("lo"), F.col("hi"), F.col("pre"))).select("n_regionkey", "n_nationkey")


@query(f"WITH {_NODES} SELECT parent_id, count(*) AS n_children FROM n WHERE parent_id IS NOT NULL GROUP BY parent_id HAVING count(*) > 2")
def polytomy_check(spark, sf_dir):
    return tree.polytomies(hierarchy(spark, sf_dir)).select("parent_id", "n_children")


@query(f"WITH {_NODES} SELECT max(level) AS max_depth, avg(level) AS mean_depth FROM n WHERE level = 3")
def depth_stats(spark, sf_dir):
    return tree.depth_stats(hierarchy(spark, sf_dir)).select("max_depth", "mean_depth")


@query(f"WITH {_NODES} SELECT node_id, name FROM n WHERE node_id NOT IN (SELECT parent_id FROM n WHERE parent_id IS NOT NULL)")
def childless_nodes(spark, sf_dir):
    return tree.leaves_by_antijoin(hierarchy(spark, sf_dir)).select("node_id", "name")


def leaf_states(spark, sf_dir):
    """State of a supplier at a site (line number): one of five bits, by its number of lines."""
    counted = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s"), F.col("l_linenumber").alias("site")).agg((F.count("*") % 5).cast("int").alias("k"))
    return counted.select((F.col("s") + 1000).cast("int").alias("node_id"), "site", F.call_function("shiftleft", F.lit(1), F.col("k")).alias("state"))


_LEAF = "l AS (SELECT CAST(1000 + l_suppkey AS INTEGER) AS node_id, l_linenumber AS site, CAST(1 << CAST(count(*) % 5 AS INTEGER) AS INTEGER) AS state FROM lineitem GROUP BY l_suppkey, l_linenumber)"
_COMBINE = "CASE WHEN bit_and(f.sets) <> 0 THEN bit_and(f.sets) ELSE bit_or(f.sets) END"
_FITCH = f"""{_NODES}, {_LEAF},
f3 AS (SELECT site, node_id, state AS sets FROM l),
f2 AS (SELECT f.site, n.parent_id AS node_id, {_COMBINE} AS sets FROM f3 f JOIN n ON f.node_id = n.node_id GROUP BY f.site, n.parent_id),
f1 AS (SELECT f.site, n.parent_id AS node_id, {_COMBINE} AS sets FROM f2 f JOIN n ON f.node_id = n.node_id GROUP BY f.site, n.parent_id),
f0 AS (SELECT f.site, n.parent_id AS node_id, {_COMBINE} AS sets FROM f1 f JOIN n ON f.node_id = n.node_id GROUP BY f.site, n.parent_id),
f AS (SELECT * FROM f3 UNION ALL SELECT * FROM f2 UNION ALL SELECT * FROM f1 UNION ALL SELECT * FROM f0)"""
_STEP = "CASE WHEN f.sets & s.state <> 0 THEN s.state ELSE f.sets & -f.sets END"
_DOWN = f"""{_FITCH},
s0 AS (SELECT site, node_id, sets & -sets AS state FROM f0),
s1 AS (SELECT f.site, f.node_id, {_STEP} AS state FROM f1 f JOIN n ON f.node_id = n.node_id JOIN s0 s ON s.site = f.site AND s.node_id = n.parent_id),
s2 AS (SELECT f.site, f.node_id, {_STEP} AS state FROM f2 f JOIN n ON f.node_id = n.node_id JOIN s1 s ON s.site = f.site AND s.node_id = n.parent_id),
s3 AS (SELECT f.site, f.node_id, {_STEP} AS state FROM f3 f JOIN n ON f.node_id = n.node_id JOIN s2 s ON s.site = f.site AND s.node_id = n.parent_id),
s AS (SELECT * FROM s0 UNION ALL SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3)"""


@query(f"WITH {_FITCH} SELECT site, node_id, sets FROM f")
def fitch_up(spark, sf_dir):
    return parsimony.fitch_levels(hierarchy(spark, sf_dir), leaf_states(spark, sf_dir), ["site"]).select("site", "node_id", "sets")


def _states(spark, sf_dir):
    """Sets and chosen states of all nodes, from the root down level by level."""
    nodes = hierarchy(spark, sf_dir)
    sets = written(parsimony.fitch_levels(nodes, leaf_states(spark, sf_dir), ["site"]).join(nodes.select("node_id", "parent_id", "level"), "node_id"))
    here = sets.where("level = 0").select("site", "node_id", F.lit(None).cast("int").alias("parent_id"), parsimony.lowest_bit(F.col("sets")).alias("state"))
    out = here
    for level in range(1, 4):
        above = here.select("site", F.col("node_id").alias("parent_id"), F.col("state").alias("above"))
        below = sets.where(F.col("level") == level).join(above, ["site", "parent_id"])
        here = below.select("site", "node_id", "parent_id", parsimony.fitch_step_down(F.col("sets"), F.col("above")).alias("state"))
        out = out.unionByName(here)
    return out


@query(f"WITH {_DOWN} SELECT site, node_id, state FROM s")
def fitch_down(spark, sf_dir):
    return _states(spark, sf_dir).select("site", "node_id", "state")


@query(f"""WITH {_DOWN} SELECT c.site, c.node_id, p.state AS old, c.state AS new, CASE WHEN p.state = 1 THEN 'I' WHEN c.state = 1 THEN 'D' ELSE 'S' END AS type
FROM s c JOIN n ON c.node_id = n.node_id JOIN s p ON p.site = c.site AND p.node_id = n.parent_id WHERE c.state <> p.state""")
def fitch_mutations(spark, sf_dir):
    states = _states(spark, sf_dir)
    above = states.select("site", F.col("node_id").alias("parent_id"), F.col("state").alias("old"))
    rows = states.join(above, ["site", "parent_id"]).withColumn("type", parsimony.mutation_type(F.col("state"), F.col("old"), F.lit(1)))
    return rows.where("type is not null").select("site", "node_id", "old", F.col("state").alias("new"), "type")


_COST = """c AS (SELECT CAST(1000 + l_suppkey AS INTEGER) AS node, l_linenumber AS site, CAST(count(*) % 5 AS INTEGER) AS state, CAST(0 AS BIGINT) AS cost FROM lineitem GROUP BY l_suppkey, l_linenumber),
q AS (SELECT CAST(k AS INTEGER) AS state FROM range(0, 5) r(k)),
c2 AS (SELECT site, parent AS node, target AS state, CAST(sum(cost) AS BIGINT) AS cost FROM (SELECT c.site, n.parent_id AS parent, c.node, q.state AS target, min(c.cost + CASE WHEN c.state <> q.state THEN 1 ELSE 0 END) AS cost
 FROM c JOIN n ON c.node = n.node_id CROSS JOIN q GROUP BY c.site, n.parent_id, c.node, q.state) GROUP BY site, parent, target),
c1 AS (SELECT site, parent AS node, target AS state, CAST(sum(cost) AS BIGINT) AS cost FROM (SELECT c.site, n.parent_id AS parent, c.node, q.state AS target, min(c.cost + CASE WHEN c.state <> q.state THEN 1 ELSE 0 END) AS cost
 FROM c2 c JOIN n ON c.node = n.node_id CROSS JOIN q GROUP BY c.site, n.parent_id, c.node, q.state) GROUP BY site, parent, target),
c0 AS (SELECT site, parent AS node, target AS state, CAST(sum(cost) AS BIGINT) AS cost FROM (SELECT c.site, n.parent_id AS parent, c.node, q.state AS target, min(c.cost + CASE WHEN c.state <> q.state THEN 1 ELSE 0 END) AS cost
 FROM c1 c JOIN n ON c.node = n.node_id CROSS JOIN q GROUP BY c.site, n.parent_id, c.node, q.state) GROUP BY site, parent, target)"""


def _sankoff(spark, sf_dir):
    nodes = hierarchy(spark, sf_dir).select(F.col("node_id").alias("child"), F.col("parent_id").alias("parent"))
    costs = leaf_states(spark, sf_dir).select("site", F.col("node_id").alias("child"), (F.length(F.bin("state")) - 1).alias("state"), F.lit(0).cast("bigint").alias("cost"))
    levels = []
    for _ in range(3):
        up = parsimony.sankoff_costs(costs.join(nodes, "child"), ["site"], 5)
        levels.append(up)
        costs = up.withColumnRenamed("node", "child")
    return levels


@query(f"WITH {_NODES}, {_COST} SELECT * FROM c2 UNION ALL SELECT * FROM c1 UNION ALL SELECT * FROM c0")
def sankoff_up(spark, sf_dir):
    two, one, top = _sankoff(spark, sf_dir)
    return two.unionByName(one).unionByName(top).select("site", "node", "state", "cost")


@query(f"""WITH {_NODES}, {_COST}, s0 AS (SELECT site, node, min(cost * 10 + state) % 10 AS state FROM c0 GROUP BY site, node),
s1 AS (SELECT c.site, c.node, min((c.cost + CASE WHEN c.state <> s.state THEN 1 ELSE 0 END) * 10 + c.state) % 10 AS state FROM c1 c JOIN n ON c.node = n.node_id JOIN s0 s ON s.site = c.site AND s.node = n.parent_id GROUP BY c.site, c.node)
SELECT site, node, CAST(state AS INTEGER) AS state FROM s0 UNION ALL SELECT site, node, CAST(state AS INTEGER) FROM s1""")
def sankoff_down(spark, sf_dir):
    _, one, top = _sankoff(spark, sf_dir)
    root = parsimony.sankoff_choice(top, ["site"])
    up = hierarchy(spark, sf_dir).select(F.col("node_id").alias("node"), F.col("parent_id").alias("p"))
    above = root.select("site", F.col("node").alias("p"), F.col("state").alias("above"))
    regions = parsimony.sankoff_choice(one.join(up, "node").join(above, ["site", "p"]), ["site"], "above")
    return root.unionByName(regions).select("site", "node", "state")


@query("""WITH l AS (SELECT c_nationkey, year(o_orderdate) AS y, CASE max(o_orderstatus) WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 4 END AS state, c_custkey FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey, year(o_orderdate), c_custkey)
SELECT c_nationkey, CAST(y AS BIGINT) AS y, CASE WHEN bit_and(state) <> 0 THEN bit_and(state) ELSE bit_or(state) END AS sets FROM l GROUP BY c_nationkey, y""")
def block_fitch(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    last = F.max("o_orderstatus")
    tips = rows.groupBy("c_nationkey", F.year("o_orderdate").cast("bigint").alias("y"), "c_custkey").agg(F.when(last == "F", 1).when(last == "O", 2).otherwise(4).alias("state"))
    return tips.groupBy("c_nationkey", "y").agg(parsimony.combine("state").alias("sets"))


@query("""WITH k AS (SELECT n_regionkey, '(' || string_agg(n_name || ':' || printf('%.6f', 1.0), ',' ORDER BY n_nationkey) || ')' AS t FROM nation GROUP BY n_regionkey)
SELECT 0 AS tree_id, '(' || string_agg(t || r_name || ':' || printf('%.6f', 1.0), ',' ORDER BY r_regionkey) || ')world:0.000000;' AS newick FROM region JOIN k ON n_regionkey = r_regionkey""")
def newick_write(spark, sf_dir):
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    from pyspark.sql import Window

    listed = nation.select(F.col("n_regionkey").alias("r"), F.col("n_nationkey").alias("n"), F.col("n_name").alias("name"))
    both = listed.unionByName(region.select(F.col("r_regionkey").alias("r"), F.lit(-1).alias("n"), F.col("r_name").alias("name")))
    both = both.unionByName(spark.range(1).select(F.lit(-1).alias("r"), F.lit(-1).alias("n"), F.lit("world").alias("name")))
    pre = (F.row_number().over(Window.orderBy("r", "n")) - 1).cast("int")  # 31 rows
    nodes = both.withColumn("pre", pre).withColumn("is_leaf", F.col("n") >= 0).withColumn("level", F.when(F.col("r") < 0, 0).when(F.col("n") < 0, 1).otherwise(2))
    ends = nodes.groupBy("r").agg(F.max("pre").alias("last"), F.min("pre").alias("first"))
    nodes = nodes.join(ends, "r")
    final = nodes.select(
        F.lit(0).alias("tree_id"), "name", "pre", F.when(F.col("level") == 0, F.lit(30)).when(F.col("level") == 1, F.col("last")).otherwise(F.col("pre")).alias("post"), "level", "is_leaf",
        F.when(F.col("level") == 0, 0.0).otherwise(1.0).alias("branch_len"), F.when(F.col("level") == 0, F.lit(None)).otherwise(0).cast("int").alias("parent_id"),
        F.when(F.col("level") == 2, F.col("pre") - F.col("first") - 1).when(F.col("level") == 1, F.col("r")).otherwise(0).cast("int").alias("child_ord"),
    )
    return newick.write_newick(final)


@query(f"""WITH {_NODES}, {_UP}, p AS (SELECT anc_id AS node_id FROM u WHERE node_id = (SELECT min(node_id) FROM n WHERE level = 3) AND dist > 0)
SELECT n.node_id, CASE WHEN n.node_id IN (SELECT node_id FROM p) THEN (SELECT min(c.node_id) FROM n c WHERE c.parent_id = n.node_id AND (c.node_id IN (SELECT node_id FROM p) OR c.node_id = (SELECT min(node_id) FROM n WHERE level = 3))) ELSE n.parent_id END AS parent_id FROM n""")
def reroot_path_swap(spark, sf_dir):
    nodes = hierarchy(spark, sf_dir)
    tip = nodes.where("is_leaf").agg(F.min("node_id").alias("tip"))
    path = tree.closure(nodes, rounds=2).join(F.broadcast(tip), F.col("node_id") == F.col("tip")).select(F.col("anc_id").alias("node_id"), "dist")
    below = path.select("node_id", (F.col("dist") + 1).alias("dist")).withColumnRenamed("node_id", "turned")
    swapped = path.join(below, "dist").select("node_id", "turned")
    return nodes.join(swapped, "node_id", "left").select("node_id", F.coalesce("turned", "parent_id").alias("parent_id"))


@query(f"WITH {_NODES}, {_UP} SELECT node_id, name FROM n WHERE node_id NOT IN (SELECT node_id FROM u WHERE anc_id = 3)")
def split_subtree(spark, sf_dir):
    nodes = hierarchy(spark, sf_dir)
    gone = tree.closure(nodes, rounds=2).where("anc_id = 3").select("tree_id", "node_id")
    return nodes.join(gone, ["tree_id", "node_id"], "left_anti").select("node_id", "name")


@query(f"""WITH {_NODES}, {_UP}, w AS (SELECT CAST(1000 + min(s_suppkey) AS INTEGER) AS node_id FROM supplier GROUP BY s_nationkey % 4),
k AS (SELECT DISTINCT u.anc_id AS node_id FROM u JOIN w ON u.node_id = w.node_id), d AS (SELECT n.parent_id AS node_id, count(*) AS n_kept FROM n JOIN k ON n.node_id = k.node_id GROUP BY n.parent_id)
SELECT k.node_id, coalesce(d.n_kept, 0) AS n_kept, coalesce(d.n_kept, 0) = 1 AS merges FROM k LEFT JOIN d ON k.node_id = d.node_id""")
def subtree_contract(spark, sf_dir):
    nodes = hierarchy(spark, sf_dir)
    wanted = table(spark, sf_dir, "supplier").groupBy((F.col("s_nationkey") % 4).alias("g")).agg((F.min("s_suppkey") + 1000).cast("int").alias("node_id")).select("node_id")
    kept = tree.closure(nodes, rounds=2).join(wanted, "node_id").select(F.col("anc_id").alias("node_id")).distinct()
    n_kept = nodes.join(kept, "node_id").where("parent_id is not null").groupBy(F.col("parent_id").alias("node_id")).agg(F.count("*").alias("n"))
    joined = kept.join(n_kept, "node_id", "left").select("node_id", F.coalesce("n", F.lit(0)).alias("n_kept"))
    return joined.withColumn("merges", F.col("n_kept") == 1)


@query(f"WITH {_NODES} SELECT 0 AS tree_id, count(*) AS n_nodes FROM n UNION ALL SELECT 1, count(*) FROM customer")
def network_union(spark, sf_dir):
    first = hierarchy(spark, sf_dir).select("tree_id", "node_id")
    second = table(spark, sf_dir, "customer").select(F.lit(1).alias("tree_id"), F.col("c_custkey").cast("int").alias("node_id"))
    return first.unionByName(second).groupBy("tree_id").agg(F.count("*").alias("n_nodes"))
