"""Queries that run the operators of networks over a tree and an alignment made of the driver's tables.

The tree is the world, its regions, nations and suppliers; a tip is a supplier, whose aligned sequence
has a column for each month of seven years: the number of its line items there, modulo 5, is a gap or
one of four bases. The last column is a gap everywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeframe.network import Network
from cladeframe.operators import edits, graph, mutations, parsimony, sequence, spelling, tree, variants
from cladeframe.plans.registry import query, table
from cladeframe.schemas import NODE
from cladeframe.scratch import place, written
from cladeframe.sources import newick, placement, sinks, windows

#: Columns of the alignment; months count modulo one less.
WIDTH = 85

_SITE = f"(year(l_shipdate) * 12 + month(l_shipdate)) % {WIDTH - 1}"
_NODES = """o AS (SELECT CAST(NULL AS BIGINT) AS r, CAST(NULL AS BIGINT) AS n, CAST(NULL AS BIGINT) AS s, 'world' AS name, 0.0 AS len
UNION ALL SELECT r_regionkey, NULL, NULL, r_name, 1.0 FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation JOIN supplier ON s_nationkey = n_nationkey)
UNION ALL SELECT n_regionkey, n_nationkey, NULL, n_name, 2.0 FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier)
UNION ALL SELECT n_regionkey, n_nationkey, s_suppkey, s_name, 0.5 + s_suppkey % 4 FROM supplier JOIN nation ON s_nationkey = n_nationkey),
i AS (SELECT CAST(row_number() OVER (ORDER BY r NULLS FIRST, n NULLS FIRST, s NULLS FIRST) - 1 AS INTEGER) AS id, *, CASE WHEN r IS NULL THEN 0 WHEN n IS NULL THEN 1 WHEN s IS NULL THEN 2 ELSE 3 END AS level FROM o),
n AS (SELECT a.id, a.s, a.n AS nation, a.name, a.len, a.level, p.id AS parent FROM i a LEFT JOIN i p ON p.level = a.level - 1 AND (p.level = 0 OR p.r = a.r AND (p.level = 1 OR p.n = a.n))),
up AS (SELECT id, id AS anc, 0 AS dist FROM n UNION ALL SELECT id, parent, 1 FROM n WHERE level >= 1
UNION ALL SELECT a.id, b.parent, 2 FROM n a JOIN n b ON b.id = a.parent WHERE a.level >= 2 UNION ALL SELECT a.id, 0, 3 FROM n a WHERE a.level = 3)"""
_SITES = f"""cells AS (SELECT l_suppkey AS s, {_SITE} AS site, count(*) % 5 AS k FROM lineitem GROUP BY 1, 2),
m AS (SELECT n.id, n.name, CAST(q.site AS INTEGER) AS site, CAST(coalesce(k, 0) AS INTEGER) AS k, substr('-ACGT', CAST(coalesce(k, 0) AS INTEGER) + 1, 1) AS base FROM n CROSS JOIN range(0, {WIDTH}) q(site) LEFT JOIN cells c ON c.s = n.s AND c.site = q.site WHERE n.level = 3),
cons AS (SELECT site, arg_min(base, name) FILTER (WHERE base <> '-') AS base, row_number() OVER (ORDER BY site) - 1 AS col FROM m GROUP BY site HAVING bool_or(base <> '-'))"""
_COMBINE = "CASE WHEN bit_and(f.sets) <> 0 THEN bit_and(f.sets) ELSE bit_or(f.sets) END"
_DOWN = "CASE WHEN f.sets & s.st <> 0 THEN s.st ELSE f.sets & -f.sets END"
_LEVELS = ",\n".join(f"f{k} AS (SELECT f.site, n.parent AS id, {_COMBINE} AS sets FROM f{k + 1} f JOIN n ON n.id = f.id GROUP BY 1, 2)" for k in (2, 1, 0))
_STEPS = ",\n".join(f"s{k} AS (SELECT f.site, f.id, {_DOWN} AS st FROM f{k} f JOIN n ON n.id = f.id JOIN s{k - 1} s ON s.site = f.site AND s.id = n.parent)" for k in (1, 2, 3))
_ALL = "SELECT site, id, substr('-ACGT', CAST(log2(st) AS INTEGER) + 1, 1) AS base FROM (SELECT * FROM s0 UNION ALL SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3)"
_STATES = f"""f3 AS (SELECT site, id, 1 << k AS sets FROM m),
{_LEVELS},
s0 AS (SELECT site, id, sets & -sets AS st FROM f0),
{_STEPS},
st AS ({_ALL})"""
_CHANGES = """ch AS (SELECT a.id, a.site, coalesce(b.base, cons.base, '-') AS old, a.base AS new FROM st a JOIN n ON n.id = a.id LEFT JOIN st b ON b.site = a.site AND b.id = n.parent LEFT JOIN cons ON cons.site = a.site AND n.parent IS NULL),
mut AS (SELECT *, CASE WHEN old = '-' THEN 'I' WHEN new = '-' THEN 'D' ELSE 'S' END AS type FROM ch WHERE old <> new)"""
_ROOT = """root AS (SELECT cons.site, cons.col, st.base, CAST(sum(CASE WHEN st.base <> '-' THEN 1 ELSE 0 END) OVER (ORDER BY cons.site) AS BIGINT) AS nb FROM cons JOIN st ON st.site = cons.site AND st.id = 0),
br AS (SELECT mut.*, root.col, root.base AS root_base, root.nb FROM mut JOIN root ON root.site = mut.site)"""
_BASE = f"WITH RECURSIVE {_NODES}, {_SITES}, {_STATES}, {_CHANGES}, {_ROOT}"
_TREE = f"WITH {_NODES}"

_kept: dict = {}


def _once(spark, sf_dir: str, name: str, make) -> DataFrame:
    """A table that several queries of a session need, written once."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _kept:
        _kept[key] = written(make())
    return _kept[key]


def nodes_of(spark, sf_dir: str) -> DataFrame:
    """The tree's nodes, numbered in pre-order; a tip's annotation is the half that its nation is in."""
    nation, supplier = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    used = nation.join(supplier, nation.n_nationkey == supplier.s_nationkey, "left_semi")
    region = table(spark, sf_dir, "region").join(used, F.col("r_regionkey") == F.col("n_regionkey"), "left_semi")
    none = F.array().cast("array<string>")

    def rows(df, node, parent, name, length, notes=none):
        return df.select(
            F.lit(0).alias("tree_id"), node.cast("int").alias("node_id"), name.alias("name"), parent.cast("int").alias("parent_id"), F.lit(0).alias("child_ord"), F.lit(0).alias("pre"),
            F.lit(0).alias("post"), F.lit(0).alias("level"), length.cast("float").alias("branch_len"), F.lit(False).alias("is_leaf"), notes.alias("annotations"),
        )

    half = F.array(F.when(F.col("s_nationkey") % 2 == 0, "African").otherwise("Non-African"))
    both = rows(spark.range(1), F.lit(0), F.lit(None), F.lit("world"), F.lit(0.0))
    both = both.unionByName(rows(region, F.col("r_regionkey") + 1, F.lit(0), F.col("r_name"), F.lit(1.0)))
    both = both.unionByName(rows(used, F.col("n_nationkey") + 100, F.col("n_regionkey") + 1, F.col("n_name"), F.lit(2.0)))
    both = both.unionByName(rows(supplier, F.col("s_suppkey") + 1000, F.col("s_nationkey") + 100, F.col("s_name"), F.lit(0.5) + F.col("s_suppkey") % 4, half))
    return _once(spark, sf_dir, "nodes", lambda: spark.createDataFrame([], NODE).unionByName(tree.numbered(both)))


def alignment_of(spark, sf_dir: str) -> DataFrame:
    """tree_id, name and seq of every tip."""
    site = ((F.year("l_shipdate") * 12 + F.month("l_shipdate")) % (WIDTH - 1)).cast("int")
    cells = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey"), site.alias("site")).agg((F.count("*") % 5).cast("int").alias("k"))
    maps = cells.groupBy("s_suppkey").agg(F.map_from_entries(F.collect_list(F.struct("site", F.substring(F.lit("-ACGT"), F.col("k") + 1, F.lit(1))))).alias("c"))
    full = table(spark, sf_dir, "supplier").join(maps, "s_suppkey", "left")
    bases = F.transform(F.sequence(F.lit(0), F.lit(WIDTH - 1)), lambda i: F.coalesce(F.try_element_at("c", i), F.lit("-")))
    return full.select(F.lit(0).alias("tree_id"), F.col("s_name").alias("name"), F.array_join(bases, "").alias("seq"))


def network_of(spark, sf_dir: str) -> Network:
    from cladeframe.schemas import TABLES

    parts: dict = {}

    def make(name):
        if not parts:
            parts.update(Network.from_msa(nodes_of(spark, sf_dir), _once(spark, sf_dir, "msa", lambda: alignment_of(spark, sf_dir))).tables)
        return parts[name]

    return Network({name: _once(spark, sf_dir, f"net-{name}", lambda name=name: make(name)) for name in TABLES})


def named(df: DataFrame, nodes: DataFrame) -> DataFrame:
    return df.join(nodes.select("tree_id", "node_id", "name"), ["tree_id", "node_id"])


@query(f"{_BASE} SELECT n.name, mut.site, mut.type, mut.new AS base FROM mut JOIN n ON n.id = mut.id")
def net_infer_fitch(spark, sf_dir):
    nodes = nodes_of(spark, sf_dir)
    return named(parsimony.infer(nodes, alignment_of(spark, sf_dir))[0], nodes).select("name", "site", "type", "base")


@query(f"{_BASE} SELECT n.name, mut.site, mut.type, mut.new AS base FROM mut JOIN n ON n.id = mut.id")
def net_infer_windows(spark, sf_dir):
    """The alignment as FASTA files, read again in windows of 32 columns by their index."""
    nodes, folder = nodes_of(spark, sf_dir), place(spark)
    sinks.fasta_records(alignment_of(spark, sf_dir)).select("record").write.text(folder)
    rows = windows.read_windows(spark, folder, 32).withColumn("tree_id", F.lit(0))
    return named(parsimony.infer_windows(nodes, rows, 32, "fitch")[0], nodes).select("name", "site", "type", "base")


_COSTS = ",\n".join(  # a child adds its least cost and one, or what it costs to have the parent's state
    f"""b{k + 1} AS (SELECT site, id, min(cost) + 1 AS b FROM c{k + 1} GROUP BY 1, 2),
u{k} AS (SELECT b.site, n.parent AS id, sum(b) AS total FROM b{k + 1} b JOIN n ON n.id = b.id GROUP BY 1, 2),
r{k} AS (SELECT c.site, n.parent AS id, c.state, sum(greatest(b - cost, 0)) AS off FROM c{k + 1} c JOIN b{k + 1} b ON b.site = c.site AND b.id = c.id JOIN n ON n.id = c.id GROUP BY 1, 2, 3),
c{k} AS (SELECT u.site, u.id, u.state, CAST(total - coalesce(off, 0) AS BIGINT) AS cost FROM (SELECT site, id, total, unnest([0, 1, 2, 3, 4]) AS state FROM u{k}) u
 LEFT JOIN r{k} r ON r.site = u.site AND r.id = u.id AND r.state = u.state)""" for k in (2, 1, 0)
)
_CHOICES = ",\n".join(
    f"""t{k} AS (SELECT c.site, c.id, CAST(min((c.cost + CASE WHEN c.state <> t.state THEN 1 ELSE 0 END) * 10 + c.state) % 10 AS INTEGER) AS state FROM c{k} c JOIN n ON n.id = c.id JOIN t{k - 1} t ON t.site = c.site AND t.id = n.parent GROUP BY 1, 2)"""
    for k in (1, 2, 3)
)


@query(f"""WITH {_NODES}, {_SITES}, c3 AS (SELECT site, id, k AS state, CAST(0 AS BIGINT) AS cost FROM m),
{_COSTS}, t0 AS (SELECT site, id, CAST(min(cost * 10 + state) % 10 AS INTEGER) AS state FROM c0 GROUP BY 1, 2), {_CHOICES},
st AS (SELECT site, id, substr('-ACGT', state + 1, 1) AS base FROM (SELECT * FROM t0 UNION ALL SELECT * FROM t1 UNION ALL SELECT * FROM t2 UNION ALL SELECT * FROM t3)), {_CHANGES}
SELECT n.name, mut.site, mut.type, mut.new AS base FROM mut JOIN n ON n.id = mut.id""")
def net_infer_sankoff(spark, sf_dir):
    nodes = nodes_of(spark, sf_dir)
    return named(parsimony.infer(nodes, alignment_of(spark, sf_dir), "sankoff")[0], nodes).select("name", "site", "type", "base")


@query(f"{_BASE} SELECT n.name, string_agg(st.base, '' ORDER BY st.site) AS aligned, translate(string_agg(st.base, '' ORDER BY st.site), '-', '') AS seq FROM st JOIN n ON n.id = st.id JOIN cons ON cons.site = st.site GROUP BY n.name")
def net_sequences(spark, sf_dir):
    net = network_of(spark, sf_dir).tables
    return spelling.spelled(net).select("name", "aligned", "seq")


_TIPS = "tips AS (SELECT m.id, m.name, string_agg(m.base, '' ORDER BY m.site) AS seq FROM m JOIN cons ON cons.site = m.site GROUP BY m.id, m.name)"


def first_tip(net: Network) -> str:
    return net["node"].where("is_leaf").agg(F.min("name")).first()[0]


@query(f"""{_BASE}, {_TIPS}, a AS (SELECT cons.col, sum(CASE WHEN m.base <> '-' THEN 1 ELSE 0 END) OVER (ORDER BY cons.col) AS nb, m.base FROM m JOIN cons ON cons.site = m.site WHERE m.name = (SELECT min(name) FROM tips)),
b AS (SELECT min(col) AS lo, max(col) AS hi FROM a WHERE base <> '-' AND nb BETWEEN 5 AND 40)
SELECT name, substr(seq, CAST(lo + 1 AS BIGINT), CAST(hi - lo + 1 AS BIGINT)) AS seq FROM tips, b""")
def net_range_query(spark, sf_dir):
    net = network_of(spark, sf_dir)
    return net.index(first_tip(net), 5, 40).select("name", "seq")


_RECORDS = f"""{_TIPS}, ref AS (SELECT seq FROM tips ORDER BY name LIMIT 1),
al AS (SELECT t.id, t.name, row_number() OVER (PARTITION BY t.id ORDER BY j) AS r, a, b FROM (SELECT tips.id, tips.name, unnest(range(1, length(tips.seq) + 1)) AS j, unnest(string_split(ref.seq, '')) AS a, unnest(string_split(tips.seq, '')) AS b FROM tips, ref) t WHERE a <> '-' OR b <> '-'),
pl AS (SELECT *, sum(CASE WHEN a <> '-' THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY r) AS place, count(*) OVER (PARTITION BY id) AS n FROM al),
df AS (SELECT *, r - row_number() OVER (PARTITION BY id ORDER BY r) AS g FROM pl WHERE a <> b),
isl AS (SELECT id, name, g, min(r) AS s, max(r) + 1 AS e, any_value(n) AS n, translate(string_agg(a, '' ORDER BY r), '-', '') AS ra, translate(string_agg(b, '' ORDER BY r), '-', '') AS xb,
 arg_min(a, r) = '-' AS ga, arg_min(b, r) = '-' AS gb, min(place) FILTER (WHERE r = r) AS p0, arg_min(place, r) AS ps FROM df GROUP BY id, name, g),
num AS (SELECT isl.*, row_number() OVER (PARTITION BY isl.id ORDER BY s) AS k, pb.a AS before, pb.place AS before_at, pe.a AS behind, pe.place AS behind_at FROM isl LEFT JOIN pl pb ON pb.id = isl.id AND pb.r = s - 1 LEFT JOIN pl pe ON pe.id = isl.id AND pe.r = e),
walk AS (SELECT num.*, CASE WHEN (ga OR gb) AND s > 1 THEN 1 WHEN ra = '' AND e <= n THEN 2 ELSE 3 END AS how FROM num WHERE k = 1
 UNION ALL SELECT num.*, CASE WHEN (num.ga OR num.gb) AND NOT (walk.how = 2 AND walk.e = num.s - 1) THEN 1 WHEN num.ra = '' AND num.e <= num.n THEN 2 ELSE 3 END FROM walk JOIN num ON num.id = walk.id AND num.k = walk.k + 1),
rec AS (SELECT name AS tip, CAST(CASE how WHEN 1 THEN before_at WHEN 2 THEN behind_at ELSE ps + CASE WHEN ga THEN 1 ELSE 0 END END AS INTEGER) AS pos,
 CASE how WHEN 1 THEN before || ra WHEN 2 THEN behind ELSE ra END AS ref, CASE how WHEN 1 THEN before || xb WHEN 2 THEN xb || behind ELSE xb END AS alt FROM walk)"""


@query(f"{_BASE}, {_RECORDS} SELECT * FROM rec")
def net_variant_records(spark, sf_dir):
    net = network_of(spark, sf_dir)
    own = written(sequence.sequences(net.tables, net.node_ids([first_tip(net)]), aligned=True))
    return spelling.compared(net.tables, net.node_ids(tips=True), own, variants.differing).select("tip", "pos", "ref", "alt")


@query(f"""{_BASE}, {_RECORDS}, gr AS (SELECT pos, ref, list_sort(list(DISTINCT alt)) AS alts FROM rec GROUP BY pos, ref),
calls AS (SELECT gr.pos, gr.ref, string_agg(CAST(coalesce(list_position(alts, rec.alt), 0) AS VARCHAR), chr(9) ORDER BY tips.name) AS c FROM gr CROSS JOIN tips LEFT JOIN rec ON rec.pos = gr.pos AND rec.ref = gr.ref AND rec.tip = tips.name GROUP BY gr.pos, gr.ref),
dot AS (SELECT pos, ref, array_to_string(list_transform(alts, lambda x: CASE WHEN x = '' THEN '.' ELSE x END), ',') AS a FROM gr)
SELECT CAST(pos AS BIGINT) AS at, '.' || chr(9) || pos || chr(9) || '.' || chr(9) || CASE WHEN ref = '' THEN '.' ELSE ref END || chr(9) || a || repeat(chr(9) || '.', 4) || chr(9) || c AS line FROM calls JOIN dot USING (pos, ref)
UNION ALL SELECT -4, '##fileformat=VCFv4.2' UNION ALL SELECT -2, '##reference=' || (SELECT min(name) FROM tips)
UNION ALL SELECT -1, array_to_string(['#CHROM', 'POS', 'ID', 'REF', 'ALT', 'QUAL', 'FILTER', 'INFO', 'FORMAT'], chr(9)) || chr(9) || (SELECT string_agg(name, chr(9) ORDER BY name) FROM tips)""")
def net_vcf(spark, sf_dir):
    """All lines but the one with today's date."""
    net = network_of(spark, sf_dir)
    return net.vcf(first_tip(net)).where("at <> -3")


@query(f"""{_BASE} SELECT n.name, br.type, string_agg(CASE WHEN br.root_base = '-' THEN 'g' ELSE '' END || old || nb || new, ',' ORDER BY col) AS mutations
FROM br JOIN n ON n.id = br.id WHERE n.parent IS NOT NULL AND (br.type <> 'S' OR old <> '-') GROUP BY n.name, br.type""")
def net_mutation_list(spark, sf_dir):
    return network_of(spark, sf_dir).mutations().select("name", "type", "mutations")


_PLACED = f"""{_BASE} SELECT id AS preorder_idx, CAST(col + 1 AS INTEGER) AS position, CAST(CASE root_base WHEN '-' THEN 0 WHEN 'A' THEN 1 WHEN 'C' THEN 2 WHEN 'G' THEN 4 ELSE 8 END AS INTEGER) AS ref_nuc,
CAST(CASE old WHEN '-' THEN 0 WHEN 'A' THEN 1 WHEN 'C' THEN 2 WHEN 'G' THEN 4 ELSE 8 END AS INTEGER) AS par_nuc, [CAST(instr('ACGT', new) - 1 AS INTEGER)] AS mut_nuc FROM br WHERE new <> '-'"""


@query(_PLACED)
def net_placement(spark, sf_dir):
    return network_of(spark, sf_dir).placement().select("preorder_idx", F.col("position").cast("int").alias("position"), "ref_nuc", "par_nuc", "mut_nuc")


@query(f"""{_BASE}, g AS (SELECT anc AS id, count(*) FILTER (WHERE nation % 2 = 0) AS a, count(*) FILTER (WHERE nation % 2 = 1) AS b FROM up JOIN n USING (id) WHERE n.level = 3 GROUP BY anc),
w AS (SELECT *, col - row_number() OVER (PARTITION BY id, type ORDER BY col) AS run FROM br), runs AS (SELECT id, type, run, min(nb) AS pos, count(*) AS len FROM w GROUP BY id, type, run),
f AS (SELECT runs.*, CASE WHEN t.a > 0 THEN g.a / t.a ELSE 0.0 END AS fa, CASE WHEN t.b > 0 THEN g.b / t.b ELSE 0.0 END AS fb FROM runs JOIN g USING (id), (SELECT a, b FROM g WHERE id = 0) t)
SELECT id AS node_id, pos, type, len, round(fa, 9) AS frac_a, round(fb, 9) AS frac_b, round(fa / (fb + 0.0001), 6) AS ratio FROM f""")
def net_ratio_test(spark, sf_dir):
    rows = network_of(spark, sf_dir).ratio_test()
    return rows.select("node_id", F.col("pos").cast("bigint").alias("pos"), "type", "len", F.round("frac_a", 9).alias("frac_a"), F.round("frac_b", 9).alias("frac_b"), F.round("ratio", 6).alias("ratio"))


@query(f"""{_BASE}, w AS (SELECT *, col - row_number() OVER (PARTITION BY id, type ORDER BY col) AS run FROM br WHERE id <> 0),
rec AS (SELECT id, type, run, (row_number() OVER (PARTITION BY id, type, run ORDER BY col) - 1) // 6 AS part FROM w), c AS (SELECT type, count(*) AS k FROM (SELECT DISTINCT * FROM rec) GROUP BY type)
SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM n WHERE level = 3) AS samples, (SELECT coalesce(max(k), 0) FROM c WHERE type = 'S') AS substitutions, (SELECT coalesce(max(k), 0) FROM c WHERE type = 'I') AS insertions,
(SELECT coalesce(max(k), 0) FROM c WHERE type = 'D') AS deletions, 0 AS inversions, 3 AS max_depth, CAST(3 AS DOUBLE) AS mean_depth, 1 AS block_insertions""")
def net_summary(spark, sf_dir):
    whole = network_of(spark, sf_dir).summary()
    return whole.select("nodes", "samples", "substitutions", "insertions", "deletions", F.col("inversions").cast("int").alias("inversions"), "max_depth", "mean_depth", F.col("block_insertions").cast("int").alias("block_insertions"))


def wanted_tips(spark, sf_dir) -> DataFrame:
    """Every seventh tip, and each of the nation of the first."""
    rows = table(spark, sf_dir, "supplier")
    first = rows.agg(F.min_by("s_nationkey", "s_name").alias("k"))
    chosen = rows.crossJoin(F.broadcast(first)).where((F.col("s_suppkey") % 7 == 0) | (F.col("s_nationkey") == F.col("k")))  # one row
    return chosen.select(F.lit(0).alias("tree_id"), F.col("s_name").alias("name"))


_WANTED = "wt AS (SELECT n.id FROM n JOIN supplier ON s_suppkey = n.s WHERE s_suppkey % 7 = 0 OR s_nationkey = (SELECT arg_min(s_nationkey, s_name) FROM supplier))"


@query(f"""{_TREE}, {_WANTED}, kept AS (SELECT DISTINCT anc AS id FROM up JOIN wt USING (id)), nk AS (SELECT n.parent AS id, count(*) AS k FROM n JOIN kept USING (id) WHERE n.parent IS NOT NULL GROUP BY 1),
stay AS (SELECT kept.id FROM kept LEFT JOIN nk USING (id) WHERE coalesce(k, 0) <> 1), np AS (SELECT up.id, min(dist) AS stop FROM up JOIN stay a ON a.id = up.id JOIN stay b ON b.id = up.anc WHERE dist > 0 GROUP BY up.id)
SELECT n.name, p.name AS parent, CAST(CASE WHEN np.stop IS NULL THEN 0 ELSE (SELECT sum(x.len) FROM up u JOIN n x ON x.id = u.anc WHERE u.id = n.id AND u.dist < np.stop) END AS FLOAT) AS branch_len, n.level = 3 AS is_leaf
FROM stay JOIN n USING (id) LEFT JOIN np USING (id) LEFT JOIN up ON up.id = n.id AND up.dist = np.stop LEFT JOIN n p ON p.id = up.anc""")
def net_subtree(spark, sf_dir):
    found = tree.contract(nodes_of(spark, sf_dir), wanted_tips(spark, sf_dir))[0]
    above = found.select(F.col("node_id").alias("parent_id"), F.col("name").alias("parent"))
    return found.join(above, "parent_id", "left").select("name", "parent", "branch_len", "is_leaf")


@query(f"{_BASE}, {_TIPS}, {_WANTED} SELECT name, translate(seq, '-', '') AS seq FROM tips JOIN wt USING (id)")
def net_subnet_sequences(spark, sf_dir):
    part = network_of(spark, sf_dir).subnet(wanted_tips(spark, sf_dir))
    return part.sequences().select("name", "seq")


@query(f"""{_TREE}, tip AS (SELECT id, parent FROM n WHERE name = (SELECT min(name) FROM n WHERE level = 3)), path AS (SELECT up.anc AS id, up.dist FROM up JOIN tip USING (id) WHERE dist > 0),
turned AS (SELECT p.id, q.id AS to_id, n.len FROM path p JOIN path q ON q.dist = p.dist - 1 JOIN n ON n.id = q.id)
SELECT 'new_root' AS name, NULL AS parent, CAST(0 AS FLOAT) AS branch_len UNION ALL
SELECT n.name, CASE WHEN n.id = (SELECT id FROM tip) OR n.id = (SELECT parent FROM tip) THEN 'new_root' WHEN t.id IS NOT NULL THEN b.name ELSE p.name END,
CAST(CASE WHEN n.id = (SELECT id FROM tip) THEN 0 WHEN n.id = (SELECT parent FROM tip) THEN n.len WHEN t.id IS NOT NULL THEN t.len ELSE n.len END AS FLOAT)
FROM n LEFT JOIN n p ON p.id = n.parent LEFT JOIN turned t ON t.id = n.id LEFT JOIN n b ON b.id = t.to_id""")
def net_reroot(spark, sf_dir):
    nodes = nodes_of(spark, sf_dir)
    found = tree.reroot(nodes, nodes.where("is_leaf").agg(F.min("name")).first()[0])
    above = found.select(F.col("node_id").alias("parent_id"), F.col("name").alias("parent"))
    return found.join(above, "parent_id", "left").select("name", "parent", "branch_len")


@query(f"{_BASE}, {_TIPS} SELECT tips.name, CAST(CASE WHEN n.parent IN (SELECT id FROM n WHERE parent = (SELECT id FROM n WHERE name = (SELECT max(name) FROM n WHERE level = 1))) THEN 7 ELSE 0 END AS INTEGER) AS tree_id, translate(seq, '-', '') AS seq FROM tips JOIN n USING (id)")
def net_split_sequences(spark, sf_dir):
    net = network_of(spark, sf_dir)
    top = net["node"].where("level = 1").agg(F.max("name")).first()[0]
    return net.split(top, 7).sequences().select("name", "tree_id", "seq")


@query(f"""{_BASE}, {_TIPS}, c AS (SELECT tips.id, tips.name AS path, k * 32 AS step, translate(substr(seq, CAST(k * 32 + 1 AS BIGINT), 32), '-', '') AS seq FROM tips, range(0, (SELECT CAST(count(*) AS BIGINT) + 31 FROM cons) // 32) q(k)),
u AS (SELECT step, seq, row_number() OVER (PARTITION BY step ORDER BY seq) AS rank FROM (SELECT DISTINCT step, seq FROM c WHERE seq <> ''))
SELECT path, CAST(step AS BIGINT) AS step, CAST(step * 16777216 + rank AS BIGINT) AS segment, seq FROM c JOIN u USING (step, seq)""")
def net_gfa_segments(spark, sf_dir):
    segments, steps = graph.base_steps(network_of(spark, sf_dir).tables)
    return steps.join(segments, ["tree_id", "segment"]).select("path", F.col("step").cast("bigint").alias("step"), "segment", "seq")


@query(f"{_BASE}, {_TIPS} SELECT name AS path, translate(seq, '-', '') AS seq FROM tips")
def net_gfa_paths(spark, sf_dir):
    """What the paths of the graph of unitigs spell."""
    segments, steps = graph.unitigs(*graph.base_steps(network_of(spark, sf_dir).tables))
    parts = F.array_sort(F.collect_list(F.struct("step", "seq")))
    return steps.join(segments, ["tree_id", "segment"]).groupBy("path").agg(F.array_join(F.transform(parts, lambda x: x["seq"]), "").alias("seq"))


@query(f"""{_BASE}, {_TIPS} SELECT CAST(-1 AS INTEGER) AS grp, '##maf version=1' AS line UNION ALL SELECT 0, 'a' || chr(10) || string_agg('s' || chr(9) || name || chr(9) || 0 || chr(9) || length(translate(seq, '-', '')) || chr(9) || '+' || chr(9) || length(translate(seq, '-', '')) || chr(9) || seq, chr(10) ORDER BY name) || chr(10) FROM tips""")
def net_maf(spark, sf_dir):
    return network_of(spark, sf_dir).maf().select(F.col("group").alias("grp"), "line")


@query(f"{_TREE} SELECT n.id AS node_id, count(*) AS n_leaves FROM n JOIN up ON up.anc = n.id JOIN n t ON t.id = up.id WHERE t.level = 3 GROUP BY n.id")
def net_leaf_counts(spark, sf_dir):
    return tree.subtree_leaf_counts(nodes_of(spark, sf_dir)).select("node_id", "n_leaves")


@query(f"{_TREE} SELECT up.id AS node_id, up.anc AS anc_id, dist FROM up")
def net_closure(spark, sf_dir):
    return tree.closure(nodes_of(spark, sf_dir)).select("node_id", "anc_id", "dist")


@query(f"{_TREE} SELECT t.name FROM n JOIN up ON up.anc = n.id JOIN n t ON t.id = up.id WHERE t.level = 3 AND n.name = (SELECT max(name) FROM n WHERE level = 1)")
def net_tips_under(spark, sf_dir):
    net = network_of(spark, sf_dir)
    return net.tips(net["node"].where("level = 1").agg(F.max("name")).first()[0]).select("name")


@query(f"{_TREE} SELECT name FROM n WHERE level = 3 AND nation % 2 = 0")
def net_annotation_search(spark, sf_dir):
    return network_of(spark, sf_dir).search("African").select("name")


@query(f"""{_TREE}, a AS (SELECT n_name AS name, string_agg(c_name, ';' ORDER BY c_custkey) AS notes FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name)
SELECT n.name, CASE WHEN level = 3 THEN CASE WHEN nation % 2 = 0 THEN 'African' ELSE 'Non-African' END ELSE coalesce(notes, '') END AS notes FROM n LEFT JOIN a USING (name)""")
def net_annotate(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    notes = rows.select(F.col("n_name").alias("name"), F.col("c_custkey").cast("int").alias("ord"), F.col("c_name").alias("value"))
    return network_of(spark, sf_dir).annotate(notes)["node"].select("name", F.array_join("annotations", ";").alias("notes"))


@query(f"{_BASE} SELECT n.name, string_agg(br.type || old || CAST(w.at AS VARCHAR) || new || ',', '' ORDER BY br.col) AS mutations FROM br JOIN n ON n.id = br.id JOIN (SELECT cons.col, sum(CASE WHEN m.base <> '-' THEN 1 ELSE 0 END) OVER (ORDER BY cons.col) AS at FROM cons JOIN m ON m.site = cons.site WHERE m.name = (SELECT min(name) FROM m)) w ON w.col = br.col GROUP BY n.name")
def net_mutations_against(spark, sf_dir):
    net = network_of(spark, sf_dir)
    ref = sequence.sequences(net.tables, net.node_ids([first_tip(net)]), aligned=True).first()["seq"]
    return net.mutations_against(ref).select("name", "mutations")


@query(f"""{_TREE}, k AS (SELECT a.id, '(' || string_agg(t.name || ':' || printf('%.6f', t.len), ',' ORDER BY t.id) || ')' || a.name || ':' || printf('%.6f', a.len) AS x, any_value(a.parent) AS parent FROM n a JOIN n t ON t.parent = a.id WHERE a.level = 2 GROUP BY a.id, a.name, a.len),
r AS (SELECT a.id, '(' || string_agg(k.x, ',' ORDER BY k.id) || ')' || a.name || ':' || printf('%.6f', a.len) AS x FROM n a JOIN k ON k.parent = a.id GROUP BY a.id, a.name, a.len)
SELECT 0 AS tree_id, '(' || string_agg(x, ',' ORDER BY id) || ')world:0.000000;' AS newick FROM r""")
def net_newick(spark, sf_dir):
    return newick.write_newick(nodes_of(spark, sf_dir))


@query(f"{_BASE} SELECT n.name, mut.type, count(*) AS n FROM mut JOIN n ON n.id = mut.id GROUP BY n.name, mut.type")
def net_branch_counts(spark, sf_dir):
    net = network_of(spark, sf_dir)
    return mutations.branch_counts(net["node"], net["nuc_mut"]).select("name", "type", "n")


def two_trees(spark, sf_dir: str) -> Network:
    """Trees 0 and 1, of the suppliers of nations of even and odd numbers, each right below its root."""
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), (F.col("s_nationkey") % 2).cast("int").alias("tree_id"), F.col("s_suppkey").cast("int").alias("node_id"))
    tops = supplier.select("tree_id").distinct().select(F.concat(F.lit("root "), F.col("tree_id").cast("string")).alias("name"), "tree_id", F.lit(-1).alias("node_id"))
    none = {"child_ord": F.lit(0), "pre": F.lit(0), "post": F.lit(0), "level": F.lit(0), "branch_len": F.lit(1.0), "is_leaf": F.lit(False), "annotations": F.array().cast("array<string>")}
    rows = supplier.withColumn("parent_id", F.lit(-1)).unionByName(tops.withColumn("parent_id", F.lit(None).cast("int"))).withColumns(none)
    fields = [f.split(" ") for f in NODE.split(", ")]
    nodes = written(tree.numbered(rows.select(*[F.col(c).cast(t).alias(c) for c, t in fields])))
    msa = written(alignment_of(spark, sf_dir).drop("tree_id").join(supplier.select("name", "tree_id"), "name"))  # inference reads it twice, and each reader of its mutations again
    made = Network.from_msa(nodes, msa).tables
    return Network({**made, "nuc_mut": written(made["nuc_mut"]), "block": written(made["block"])})


@query(f"""WITH {_NODES}, {_SITES}, w AS (SELECT m.id, m.name, CAST(n.nation % 2 AS INTEGER) AS tree_id, m.site, m.base FROM m JOIN n ON n.id = m.id),
cc AS (SELECT tree_id, site FROM w GROUP BY 1, 2 HAVING bool_or(base <> '-')), size AS (SELECT tree_id, count(*) AS n FROM cc GROUP BY 1),
tt AS (SELECT w.tree_id, w.name AS path, string_agg(base, '' ORDER BY w.site) AS seq FROM w JOIN cc ON cc.tree_id = w.tree_id AND cc.site = w.site GROUP BY 1, 2),
c AS (SELECT tt.tree_id, path, k * 32 AS step, translate(substr(seq, CAST(k * 32 + 1 AS BIGINT), 32), '-', '') AS seq FROM tt JOIN size USING (tree_id), range(0, {WIDTH} // 32 + 1) q(k) WHERE k * 32 < n),
u AS (SELECT tree_id, step, seq, row_number() OVER (PARTITION BY tree_id, step ORDER BY seq) AS rank FROM (SELECT DISTINCT tree_id, step, seq FROM c WHERE seq <> ''))
SELECT tree_id, path, CAST(step AS BIGINT) AS step, CAST(step * 16777216 + rank AS BIGINT) AS segment, seq FROM c JOIN u USING (tree_id, step, seq)""")
def net_gfa_two_trees(spark, sf_dir):
    segments, steps = graph.base_steps(two_trees(spark, sf_dir).tables)
    return steps.join(segments, ["tree_id", "segment"]).select("tree_id", "path", F.col("step").cast("bigint").alias("step"), "segment", "seq")


@query(f"""WITH {_NODES}, {_SITES}, w AS (SELECT m.name, CAST(n.nation % 2 AS INTEGER) AS tree_id, m.site, m.base FROM m JOIN n ON n.id = m.id)
SELECT tree_id, name, translate(string_agg(base, '' ORDER BY site), '-', '') AS seq FROM w GROUP BY 1, 2""")
def net_two_trees_sequences(spark, sf_dir):
    return two_trees(spark, sf_dir).sequences().select("tree_id", "name", "seq")


@query(_PLACED)
def net_placement_binary(spark, sf_dir):
    """Placement rows as the binary records give them again."""
    rows = placement.rows_of(network_of(spark, sf_dir).placement_records())
    return rows.select("preorder_idx", F.col("position").cast("int").alias("position"), "ref_nuc", "par_nuc", "mut_nuc")


@query(f"""{_BASE}, w AS (SELECT *, col - row_number() OVER (PARTITION BY id ORDER BY col) AS run FROM br WHERE type = 'D'), d AS (SELECT id, run, min(nb) AS pos, count(*) AS len FROM w GROUP BY id, run)
SELECT t.name, a.name AS ancestor, up.dist, d.pos, d.len FROM up JOIN n t ON t.id = up.id JOIN n a ON a.id = up.anc JOIN d ON d.id = up.anc WHERE t.level = 3""")
def net_path_deletions(spark, sf_dir):
    net = network_of(spark, sf_dir)
    rows = variants.path_deletions(net.tables, net.node_ids(tips=True))
    above = net["node"].select("tree_id", F.col("node_id").alias("anc_id"), F.col("name").alias("ancestor"))
    return named(rows, net["node"]).join(above, ["tree_id", "anc_id"]).select("name", "ancestor", "dist", F.col("pos").cast("bigint").alias("pos"), "len")


from cladeframe.plans import blocks  # noqa: E402, F401  (its queries stand on this module)
