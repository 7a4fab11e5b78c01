"""Queries over a network of many blocks, made of the driver's tables by rule, with SQL of its own.

The tree is that of `networks`. Parts are dealt into twelve blocks, of which the bases are one a part; two more
blocks repeat blocks 3 and 4. Blocks come, go and turn at all levels of the tree, customers change bases of
nations and line items those of suppliers, gap columns hold bases of some, and every supplier has an offset, a
first block and a direction of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeframe.network import Network
from cladeframe.operators import graph, mutations, sequence, spelling, variants
from cladeframe.operators.order import ranked
from cladeframe.operators.tree import closure
from cladeframe.plans.networks import _NODES, _RECORDS, _once, named, nodes_of
from cladeframe.plans.registry import query, table
from cladeframe.schemas import TABLES

#: Blocks of parts; each of the repeats that follow has the consensus of the block REPEAT before it.
BLOCKS, REPEATS, REPEAT = 12, 2, 9

#: Block mutations of the keyed nodes (level, r, n, s): nodes that have one, block, number on the branch, kind.
_EVENTS = [
    ("level = 0 AND b < 11 AND b % 4 <> 1", "b", 0, "ins"),
    ("level = 0 AND b < 11 AND b % 4 = 1", "b", 0, "ins_inv"),
    ("level = 1 AND b < 11 AND (b + r) % 3 = 0", "b", 0, "inv"),
    ("level = 2 AND b = n % 5", "b", 0, "del"),
    ("level = 2 AND n % 3 = 0 AND b = 12", "b", 0, "ins"),
    ("level = 2 AND n % 4 = 1 AND b = 13", "b", 0, "ins_inv"),
    ("level = 3 AND b = 5 + s % 6", "b", 0, "inv"),
    ("level = 3 AND s % 8 = 1 AND b = 5 + s % 6", "b", 1, "inv"),
    ("level = 3 AND s % 4 = 0 AND b = 5 + (s + 2) % 6", "b", 0, "del"),
    ("level = 3 AND s % 2 = 0 AND b = 11", "b", 0, "ins"),
    ("level = 3 AND s % 3 = 0 AND b = n % 5", "b", 0, "ins"),
]
_PART = f"CAST(p_partkey % {BLOCKS} AS INTEGER)"
_BASE = "CASE WHEN p_size % 25 = 0 THEN 'N' ELSE substr('ACGT', CAST((p_size + p_partkey) % 4 AS INTEGER) + 1, 1) END"
#: Start and turn of a tip's sequence.
_META = {"circ_offset": "s % 50", "rot_block": "s % 3", "inverted": "s % 5 = 0"}


def _fixture(kept: str = "TRUE", first: int = 0) -> str:
    """SQL of the tree, the states of blocks (st), columns (cols) and the text of every block at every node (tx), of what
    lies in the columns that satisfy `kept`; blocks are numbered from `first`."""
    events = " UNION ALL ".join(f"SELECT id, {block} AS b, {nth} AS ord, '{kind}' AS kind FROM i CROSS JOIN range(0, {BLOCKS + REPEATS}) q(b) WHERE {where}" for where, block, nth, kind in _EVENTS)
    return f"""WITH RECURSIVE {_NODES},
pt AS (SELECT p_partkey, {_PART} AS b, row_number() OVER (PARTITION BY {_PART} ORDER BY p_partkey) - 1 AS pos, {_BASE} AS base FROM part),
src AS (SELECT b, CASE WHEN b < {BLOCKS} THEN b ELSE b - {REPEAT} END AS src FROM range(0, {BLOCKS + REPEATS}) q(b)),
whole AS (SELECT src.b, pt.pos, -1 AS gap, pt.base FROM src JOIN pt ON pt.b = src.src
UNION ALL SELECT src.b, src.b, g, '-' FROM src JOIN range(0, 3) q(g) ON g < 1 + src.b % 3
UNION ALL SELECT src.b, count(*), g, '-' FROM src JOIN pt ON pt.b = src.src CROSS JOIN range(0, 2) q(g) GROUP BY src.b, g),
cols AS (SELECT * FROM whole WHERE {kept}),
ev AS ({events}),
pe AS (SELECT up.id, ev.b, kind, row_number() OVER (PARTITION BY up.id, ev.b ORDER BY dist DESC, ord) AS k FROM up JOIN ev ON ev.id = up.anc),
se AS (SELECT id, b, max(k) FILTER (WHERE kind <> 'inv') AS k0 FROM pe GROUP BY id, b),
st AS (SELECT pe.id, pe.b, (max(kind) FILTER (WHERE k = k0) = 'ins') = (count(*) FILTER (WHERE k > k0) % 2 = 0) AS forward FROM pe JOIN se ON se.id = pe.id AND se.b = pe.b
 WHERE pe.b IN (SELECT b FROM cols) GROUP BY pe.id, pe.b HAVING max(kind) FILTER (WHERE k = k0) <> 'del'),
wr AS (SELECT i.id, pt.b, pt.pos, -1 AS gap, arg_max(substr('-ACGT', CAST(c_custkey % 5 AS INTEGER) + 1, 1), c_custkey) AS base
 FROM customer JOIN pt ON p_partkey = 1 + c_custkey % (SELECT count(*) FROM part) JOIN i ON level = 2 AND i.n = c_nationkey GROUP BY i.id, pt.b, pt.pos
UNION ALL SELECT i.id, pt.b, pt.pos, -1, substr('-ACGT', CAST(sum(l_quantity) AS BIGINT) % 5 + 1, 1) FROM lineitem JOIN pt ON p_partkey = l_partkey JOIN i ON level = 3 AND i.s = l_suppkey GROUP BY i.id, pt.b, pt.pos
UNION ALL SELECT id, s % {BLOCKS}, s % {BLOCKS}, 0, substr('ACGT', CAST(s % 4 AS INTEGER) + 1, 1) FROM i WHERE level = 3
UNION ALL SELECT id, (n + 1) % {BLOCKS}, (SELECT count(*) FROM pt WHERE pt.b = (n + 1) % {BLOCKS}), 1, 'G' FROM i WHERE level = 2),
lw AS (SELECT up.id, b, pos, gap, arg_min(base, dist) AS base FROM up JOIN wr ON wr.id = up.anc GROUP BY up.id, b, pos, gap),
sp AS (SELECT st.id, st.b - {first} AS b, forward, string_agg(coalesce(lw.base, cols.base), '' ORDER BY cols.pos, CASE WHEN cols.gap < 0 THEN 9 ELSE cols.gap END) AS t
 FROM st JOIN cols ON cols.b = st.b LEFT JOIN lw ON lw.id = st.id AND lw.b = cols.b AND lw.pos = cols.pos AND lw.gap = cols.gap GROUP BY st.id, st.b, forward),
tx AS (SELECT id, b, forward, CASE WHEN forward THEN t ELSE translate(reverse(t), 'ACGT', 'TGCA') END AS t FROM sp),
wd AS (SELECT b - {first} AS b, count(*) AS w FROM cols GROUP BY b),
meta AS (SELECT id, {", ".join(f"CASE WHEN level = 3 THEN {e} END AS {c}" for c, e in _META.items())} FROM i),
held AS (SELECT id, list(b ORDER BY b) AS bs, list(t ORDER BY b) AS ts FROM tx GROUP BY id),
grid AS (SELECT i.id, list(coalesce(t, repeat('-', w)) ORDER BY wd.b) AS ts FROM i CROSS JOIN wd LEFT JOIN tx ON tx.id = i.id AND tx.b = wd.b GROUP BY i.id),
turn AS (SELECT i.id, i.name, i.level, coalesce(circ_offset, 0) AS off, coalesce(inverted, false) AS inverted, held.ts AS own, grid.ts AS every,
 CASE WHEN coalesce(rot_block, 0) < len(bs) THEN coalesce(rot_block, 0) ELSE 0 END AS rot, CASE WHEN coalesce(rot_block, 0) = 0 OR rot_block >= len(bs) THEN 0 ELSE bs[rot_block + 1] END AS rot_every
 FROM i JOIN meta ON meta.id = i.id JOIN held ON held.id = i.id JOIN grid ON grid.id = i.id),
laid AS (SELECT id, name, level, off, CASE WHEN inverted THEN list_reverse(own[rot + 1:] || own[:rot]) ELSE own[rot + 1:] || own[:rot] END AS own,
 CASE WHEN inverted THEN list_reverse(every[rot_every + 1:] || every[:rot_every]) ELSE every[rot_every + 1:] || every[:rot_every] END AS every FROM turn),
joined AS (SELECT id, name, level, off, array_to_string(every, '') AS aligned, translate(array_to_string(own, ''), '-', '') AS plain FROM laid),
seqs AS (SELECT id, name, level, aligned, CASE WHEN plain = '' THEN '' ELSE substr(plain, off % length(plain) + 1) || substr(plain, 1, off % length(plain)) END AS seq FROM joined)"""


def _keyed(spark, sf_dir: str) -> DataFrame:
    """tree_id, node_id, level and the keys r, n and s of region, nation and supplier of every node."""
    nation, supplier = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    keys = table(spark, sf_dir, "region").select(F.lit(1).alias("level"), F.col("r_name").alias("name"), F.col("r_regionkey").cast("bigint").alias("r"), F.lit(None).cast("bigint").alias("n"), F.lit(None).cast("bigint").alias("s"))
    keys = keys.union(nation.select(F.lit(2), "n_name", F.col("n_regionkey").cast("bigint"), F.col("n_nationkey").cast("bigint"), F.lit(None).cast("bigint")))
    keys = keys.union(supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.lit(3), "s_name", F.col("n_regionkey").cast("bigint"), F.col("n_nationkey").cast("bigint"), F.col("s_suppkey").cast("bigint")))
    return nodes_of(spark, sf_dir).select("tree_id", "node_id", "level", "name").join(keys, ["level", "name"], "left")


#: Bases that are put together at once into a piece of a block.
PIECE = 4096


def placed(parts: DataFrame) -> DataFrame:
    """parts (block_id, p_partkey, base) with pos, their number in the block in order of key; no block is one task."""
    numbers = ranked(parts, ["block_id", "p_partkey"], "__n")
    first = numbers.groupBy("block_id").agg(F.min("__n").alias("__first"))
    return numbers.join(F.broadcast(first), "block_id").select("block_id", "p_partkey", "base", (F.col("__n") - F.col("__first")).cast("int").alias("pos"))  # a row a block


def consensus_of(places: DataFrame) -> DataFrame:
    """block_id and consensus of placed parts, first by pieces and then as a whole, so that a group holds few rows."""
    joined = lambda at, text: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at, text))), lambda x: x[text]), "")
    pieces = places.groupBy("block_id", F.floor(F.col("pos") / PIECE).alias("k")).agg(joined("pos", "base").alias("piece"))
    return pieces.groupBy("block_id").agg(joined("k", "piece").alias("consensus"))


def _tables(spark, sf_dir: str) -> dict[str, DataFrame]:
    nodes = nodes_of(spark, sf_dir)
    keyed = _once(spark, sf_dir, "blocks-keyed", lambda: _keyed(spark, sf_dir))
    part = table(spark, sf_dir, "part")
    n_parts = part.count()
    places = _once(spark, sf_dir, "blocks-places", lambda: placed(part.select(F.expr(_PART).alias("block_id"), "p_partkey", F.expr(_BASE).alias("base"))))
    ids = spark.range(BLOCKS + REPEATS).select(F.col("id").cast("int").alias("block_id"), F.when(F.col("id") < BLOCKS, F.col("id")).otherwise(F.col("id") - REPEAT).cast("int").alias("src"))
    block = ids.join(consensus_of(places).withColumnRenamed("block_id", "src"), "src").select(F.lit(0).alias("tree_id"), "block_id", "consensus")
    gap = block.select("tree_id", "block_id", F.col("block_id").alias("pos"), (F.col("block_id") % 3 + 1).cast("int").alias("len"))
    gap = gap.unionByName(block.select("tree_id", "block_id", F.length("consensus").alias("pos"), F.lit(2).alias("len")))

    spread = keyed.select("*", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS + REPEATS - 1))).alias("b"))
    happens = F.array(*[F.when(F.expr(where), F.struct(F.expr(f"CAST({b} AS INT)").alias("block_id"), F.lit(nth).alias("nth"), F.lit(kind).alias("kind"))) for where, b, nth, kind in _EVENTS])
    events = spread.select("tree_id", "node_id", F.explode(F.filter(happens, lambda e: e.isNotNull())).alias("e"))
    block_mut = events.select("tree_id", "node_id", (F.col("e.nth") * (BLOCKS + REPEATS) + F.col("e.block_id")).alias("ord"), "e.block_id", "e.kind")

    def base(k):
        return F.substring(F.lit("-ACGT"), (k % 5 + 1).cast("int"), F.lit(1))

    own = keyed.select("tree_id", "node_id", "level", "n", "s")
    customer = table(spark, sf_dir, "customer").withColumn("p_partkey", 1 + F.col("c_custkey") % n_parts)
    by_nation = customer.groupBy(F.col("c_nationkey").cast("bigint").alias("n"), "p_partkey").agg(base(F.max("c_custkey")).alias("base")).join(own.where("level = 2"), "n")
    items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p_partkey")).agg(base(F.sum("l_quantity").cast("bigint")).alias("base"))
    main = by_nation.select("tree_id", "node_id", "p_partkey", "base").unionByName(items.join(own.where("level = 3"), "s").select("tree_id", "node_id", "p_partkey", "base"))
    main = main.join(places.drop("base"), "p_partkey").select("tree_id", "node_id", "block_id", "pos", F.lit(-1).alias("gap_pos"), F.when(F.col("base") == "-", "D").otherwise("S").alias("type"), "base")
    at = (F.col("s") % BLOCKS).cast("int")
    side = own.where("level = 3").select("tree_id", "node_id", at.alias("block_id"), at.alias("pos"), F.lit(0).alias("gap_pos"), F.lit("I").alias("type"), F.substring(F.lit("ACGT"), (F.col("s") % 4 + 1).cast("int"), F.lit(1)).alias("base"))
    tail = own.where("level = 2").withColumn("block_id", ((F.col("n") + 1) % BLOCKS).cast("int")).join(block, ["tree_id", "block_id"])
    tail = tail.select("tree_id", "node_id", "block_id", F.length("consensus").alias("pos"), F.lit(1).alias("gap_pos"), F.lit("I").alias("type"), F.lit("G").alias("base"))
    meta = keyed.where("level = 3").select("tree_id", "node_id", *[F.expr(e).cast("boolean" if c == "inverted" else "int").alias(c) for c, e in _META.items()])
    return {
        "node": nodes, "block": block, "gap": gap, "nuc_mut": mutations.pack(main.unionByName(side).unionByName(tail)), "block_mut": block_mut,
        "seq_meta": meta, "complex_mut": spark.createDataFrame([], TABLES["complex_mut"]),
    }


def network_of(spark, sf_dir: str) -> Network:
    parts: dict = {}

    def make(name):
        if not parts:
            parts.update(_tables(spark, sf_dir))
        return parts[name]

    return Network({name: _once(spark, sf_dir, f"blocks-{name}", lambda name=name: make(name)) for name in TABLES})


def first_tip(net: Network) -> str:
    return net["node"].where("is_leaf").agg(F.min("name")).first()[0]


_NET = _fixture()
_REF = "(SELECT min(name) FROM i WHERE level = 3)"
#: Columns of the first tip's blocks in their own order, with running numbers of bases.
_COORDS = f"""ref AS (SELECT wd.b, coalesce(tx.t, repeat('-', w)) AS t FROM wd LEFT JOIN tx ON tx.b = wd.b AND tx.id = (SELECT id FROM i WHERE name = {_REF})),
cc AS (SELECT b, unnest(range(0, length(t))) AS k, unnest(string_split(t, '')) AS base FROM ref),
co AS (SELECT b, k, base, row_number() OVER (ORDER BY b, k) - 1 AS col, sum(CASE WHEN base <> '-' THEN 1 ELSE 0 END) OVER (ORDER BY b, k) AS nb FROM cc)"""


@query(f"{_NET} SELECT name, aligned, seq FROM seqs")
def net_blocks_sequences(spark, sf_dir):
    net = network_of(spark, sf_dir).tables
    return spelling.spelled(net).select("name", "aligned", "seq")


@query(f"{_NET} SELECT i.name, st.b AS block_id, st.forward FROM st JOIN i ON i.id = st.id")
def net_blocks_states(spark, sf_dir):
    net = network_of(spark, sf_dir)
    return named(sequence.block_states(net["node"], net["block_mut"]), net["node"]).select("name", F.col("block_id").cast("bigint").alias("block_id"), "forward")


@query(f"""{_NET}, t AS (SELECT count_if(kind LIKE 'ins%') AS block_insertions, count_if(kind = 'del') AS block_deletions, count_if(kind IN ('inv', 'ins_inv')) AS block_inversions, count_if(kind IN ('inv', 'ins_inv') AND id <> 0) AS inversions FROM ev)
SELECT (SELECT count(*) FROM i) AS nodes, (SELECT count(*) FROM i WHERE level = 3) AS samples, inversions, block_insertions, block_deletions, block_inversions FROM t""")
def net_blocks_summary(spark, sf_dir):
    return network_of(spark, sf_dir).summary().select("nodes", "samples", "inversions", "block_insertions", "block_deletions", "block_inversions")


@query(f"""{_NET}, con AS (SELECT src.b, string_agg(pt.base, '' ORDER BY pt.pos) AS c FROM src JOIN pt ON pt.b = src.src GROUP BY src.b),
fresh AS (SELECT st.id, n.parent, st.b FROM st JOIN n ON n.id = st.id WHERE n.parent IS NOT NULL AND NOT EXISTS (SELECT 1 FROM st o WHERE o.id = n.parent AND o.b = st.b)),
seen AS (SELECT fresh.id, fresh.b, arg_min(st.b IS NOT NULL, q.b) AS dup FROM fresh JOIN con p ON p.b = fresh.b JOIN con q ON q.c = p.c AND q.b <> p.b JOIN st o ON o.id = fresh.parent AND o.b = q.b LEFT JOIN st ON st.id = fresh.id AND st.b = q.b GROUP BY 1, 2)
SELECT count_if(dup) AS duplications, count_if(NOT dup) AS translocations FROM seen""")
def net_blocks_copies(spark, sf_dir):
    return network_of(spark, sf_dir).copies().select("duplications", "translocations")


@query(f"{_NET} SELECT src.b AS block_id, '>' || src.b || chr(10) || string_agg(pt.base, '' ORDER BY pt.pos) AS record FROM src JOIN pt ON pt.b = src.src GROUP BY src.b")
def net_blocks_consensus(spark, sf_dir):
    return network_of(spark, sf_dir).consensus().select(F.col("block_id").cast("bigint").alias("block_id"), "record")


@query(f"{_NET} SELECT name, aligned AS seq FROM seqs WHERE level = 0")
def net_blocks_root(spark, sf_dir):
    return network_of(spark, sf_dir).root().select("name", "seq")


@query(f"""{_NET}, w AS (SELECT i.name, st.b, CASE WHEN forward THEN '+' ELSE '-' END AS sign, lead(st.b) OVER o AS b2, lead(CASE WHEN forward THEN '+' ELSE '-' END) OVER o AS sign2 FROM st JOIN i ON i.id = st.id WHERE level = 3 WINDOW o AS (PARTITION BY st.id ORDER BY st.b))
SELECT 0 AS rank, 'H' || chr(9) || 'VN:Z:1.0' AS line
UNION ALL SELECT 1, 'S' || chr(9) || src.b || chr(9) || string_agg(pt.base, '' ORDER BY pt.pos) FROM src JOIN pt ON pt.b = src.src GROUP BY src.b
UNION ALL SELECT DISTINCT 2, array_to_string(['L', CAST(b AS VARCHAR), sign, CAST(b2 AS VARCHAR), sign2, '0M'], chr(9)) FROM w WHERE b2 IS NOT NULL
UNION ALL SELECT 3, array_to_string(['P', name, string_agg(b || sign, ',' ORDER BY b), '*'], chr(9)) FROM w GROUP BY name""")
def net_blocks_gfa(spark, sf_dir):
    return network_of(spark, sf_dir).gfa(with_bases=False).select("rank", "line")


@query(f"""{_fixture("b BETWEEN 2 AND 8 AND (b > 2 OR pos >= 3) AND (b < 8 OR pos <= 9)", 2)} SELECT name, aligned, seq FROM seqs""")
def net_blocks_segment(spark, sf_dir):
    """Sequences of the network from base 3 of block 2 to base 9 of block 8."""
    net = network_of(spark, sf_dir).segment(2, 3, 8, 9).tables
    return spelling.spelled(net).select("name", "aligned", "seq")


@query(f"{_NET}, {_COORDS} SELECT b AS block_id, k AS at, base, col AS \"column\", CAST(nb AS BIGINT) AS n_bases FROM co")
def net_blocks_coordinates(spark, sf_dir):
    net = network_of(spark, sf_dir)
    each = sequence.coordinates(net.tables, net.node_ids([first_tip(net)]))
    return each.select(*[F.col(c).cast("bigint").alias(c) for c in ("block_id", "at")], "base", F.col("column").cast("bigint").alias("column"), F.col("n_bases").cast("bigint").alias("n_bases"))


@query(f"""{_NET}, {_COORDS}, bounds AS (SELECT min(col) AS lo, max(col) AS hi FROM co WHERE base <> '-' AND nb BETWEEN 5 AND 140)
SELECT name, substr(aligned, CAST(lo + 1 AS BIGINT), CAST(hi - lo + 1 AS BIGINT)) AS seq FROM seqs, bounds WHERE level = 3""")
def net_blocks_range_query(spark, sf_dir):
    net = network_of(spark, sf_dir)
    return net.index(first_tip(net), 5, 140).select("name", "seq")


@query(f"""{_NET}, con AS (SELECT src.b, string_agg(pt.base, '' ORDER BY pt.pos) AS c FROM src JOIN pt ON pt.b = src.src GROUP BY src.b),
grp AS (SELECT b, min(b) OVER (PARTITION BY c) AS g FROM con),
sz AS (SELECT i.name, tx.*, off, length(translate(t, '-', '')) AS size FROM tx JOIN i ON i.id = tx.id JOIN laid ON laid.id = tx.id WHERE i.level = 3),
so AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY id ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, sum(size) OVER (PARTITION BY id) AS total FROM sz),
ln AS (SELECT name, so.b, g, array_to_string(['s', name, CAST(CASE WHEN off = 0 THEN start ELSE ((start - off) % total + total) % total END AS VARCHAR), CAST(size AS VARCHAR), CASE WHEN forward THEN '+' ELSE '-' END, CAST(total AS VARCHAR), t], chr(9)) AS line FROM so JOIN grp ON grp.b = so.b)
SELECT -1 AS "group", '##maf version=1' AS line UNION ALL SELECT g, 'a' || chr(10) || string_agg(line, chr(10) ORDER BY name, b) || chr(10) FROM ln GROUP BY g""")
def net_blocks_maf(spark, sf_dir):
    return network_of(spark, sf_dir).maf().select(F.col("group").cast("bigint").alias("group"), "line")


@query(f"""{_NET}, {_RECORDS.replace("tips AS (SELECT m.id, m.name, string_agg(m.base, '' ORDER BY m.site) AS seq FROM m JOIN cons ON cons.site = m.site GROUP BY m.id, m.name)", "tips AS (SELECT id, name, aligned AS seq FROM seqs WHERE level = 3)")} SELECT * FROM rec""")
def net_blocks_variant_records(spark, sf_dir):
    """Records from root paths where a tip has the reference's blocks, from whole texts elsewhere."""
    net = network_of(spark, sf_dir)
    return variants.tip_records(net.tables, net.node_ids([first_tip(net)])).select("tip", "pos", "ref", "alt")


_CONSENSUS = "con AS (SELECT src.b, string_agg(pt.base, '' ORDER BY pt.pos) AS c FROM src JOIN pt ON pt.b = src.src GROUP BY src.b)"


@query(f"{_NET} SELECT name, aligned, seq FROM seqs WHERE level = 3")
def net_blocks_reroot(spark, sf_dir):
    """Tips after blocks and bases are inferred anew with a root above the first one."""
    net = network_of(spark, sf_dir)
    again = net.reroot(first_tip(net))
    return spelling.spelled(again.tables, again.node_ids(tips=True)).select("name", "aligned", "seq")


@query(f"{_NET} SELECT seqs.name, seqs.seq FROM seqs JOIN i ON i.id = seqs.id WHERE i.level = 3 AND i.s % 3 = 1")
def net_blocks_subnet(spark, sf_dir):
    """Every third tip, with the mutations of merged branches consolidated."""
    wanted = _keyed(spark, sf_dir).where("level = 3 and s % 3 = 1").select("tree_id", "name")
    return network_of(spark, sf_dir).subnet(wanted).sequences().select("name", "seq")


@query(f"{_NET} SELECT seqs.name, CASE WHEN i.r = (SELECT arg_max(r, name) FROM i WHERE level = 1) THEN 7 ELSE 0 END AS tree_id, seqs.seq FROM seqs JOIN i ON i.id = seqs.id WHERE i.level = 3")
def net_blocks_split(spark, sf_dir):
    net = network_of(spark, sf_dir)
    top = net["node"].where("level = 1").agg(F.max("name")).first()[0]
    return net.split(top, 7).sequences().select("name", "tree_id", "seq")


@query(f"""{_NET}, par AS (SELECT n FROM i WHERE level = 3 AND name IN (SELECT min(name) FROM i WHERE level = 3 UNION ALL SELECT max(name) FROM i WHERE level = 3)),
cut AS (SELECT n, name FROM i WHERE level = 2 AND n % 3 <> 0 AND n NOT IN (SELECT n FROM par))
SELECT seqs.name, coalesce(cut.name, 'world') AS top, seqs.seq, (SELECT count(*) FROM cut) AS events FROM seqs JOIN i ON i.id = seqs.id LEFT JOIN cut ON cut.n = i.n WHERE i.level = 3""")
def net_blocks_complex(spark, sf_dir):
    """Two nations in three are recombinants of the first and the last tip; those above one of them do not count."""
    net = network_of(spark, sf_dir)
    ends = net["node"].where("is_leaf").agg(F.min("name").alias("seq1"), F.max("name").alias("seq2"))
    child = _keyed(spark, sf_dir).where("level = 2 and n % 3 <> 0")
    values = {"type": F.lit("R"), "seq3": F.col("name"), **{f"tree{k}": F.lit(0) for k in (1, 2, 3)}, **{c: F.lit(v).cast("bigint") for c, v in (("s1", 0), ("e1", 9), ("s2", 10), ("e2", 20))}}
    events = child.join(ends).withColumns(values).select(net["complex_mut"].columns)
    made = net.create_network(events)
    tops = made["node"].where("parent_id is null").select("tree_id", F.col("name").alias("top"))
    count = made["complex_mut"].agg(F.count("*").alias("events"))
    # one row a tree, and one row: texts stay where they are spelled
    return made.sequences().join(F.broadcast(tops), "tree_id").join(F.broadcast(count)).select("name", "top", "seq", "events")


_ALL = f"""ref AS (SELECT i.id, i.name, i.s, wd.b, coalesce(tx.t, repeat('-', w)) AS t FROM i CROSS JOIN wd LEFT JOIN tx ON tx.b = wd.b AND tx.id = i.id WHERE i.level = 3),
cc AS (SELECT id, name, s, b, unnest(range(0, length(t))) AS k, unnest(string_split(t, '')) AS base FROM ref),
co AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY b, k) - 1 AS col, sum(CASE WHEN base <> '-' THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY b, k) AS nb FROM cc)"""


def _asked(spark, sf_dir: str, number) -> DataFrame:
    """tree_id, node_id, name and a number of the tip that each customer asks, by the rest of its key."""
    customer = table(spark, sf_dir, "customer")
    count = table(spark, sf_dir, "supplier").count()
    tips = _keyed(spark, sf_dir).where("level = 3").select("tree_id", "node_id", "name", "s")
    return customer.select("c_custkey", (F.col("c_custkey") % count).alias("s"), number).join(tips, "s").drop("s")


@query(f"""{_NET}, {_ALL} SELECT c_custkey, co.name, co.b AS block_id, co.k AS at, co.col AS "column" FROM customer JOIN co ON co.s = c_custkey % (SELECT count(*) FROM supplier) AND co.base <> '-' AND co.nb = 1 + c_custkey * 7""")
def net_blocks_base_places(spark, sf_dir):
    """Where base 1 + 7 c of a tip stands, for every customer c; tips with fewer bases give no row."""
    net = network_of(spark, sf_dir)
    found = spelling.base_places(net.tables, _asked(spark, sf_dir, (1 + F.col("c_custkey") * 7).alias("nth")))
    return found.select("c_custkey", "name", *[F.col(c).cast("bigint").alias(c) for c in ("block_id", "at", "column")])


@query(f"""{_NET}, {_ALL} SELECT c_custkey, co.name, co.b AS block_id, co.k AS at, co.base, CAST(co.nb AS BIGINT) AS n_bases FROM customer JOIN co ON co.s = c_custkey % (SELECT count(*) FROM supplier) AND co.b = c_custkey % {BLOCKS} AND co.k = c_custkey % 200""")
def net_blocks_bases_up_to(spark, sf_dir):
    """What stands at a column of a block of a tip, and how many bases up to it, for every customer."""
    net = network_of(spark, sf_dir)
    asked = _asked(spark, sf_dir, (F.col("c_custkey") % 200).alias("at")).withColumn("block_id", (F.col("c_custkey") % BLOCKS).cast("int"))
    found = spelling.bases_up_to(net.tables, asked)
    return found.select("c_custkey", "name", *[F.col(c).cast("bigint").alias(c) for c in ("block_id", "at")], "base", F.col("n_bases").cast("bigint").alias("n_bases"))


@query(f"""{_NET}, {_CONSENSUS} SELECT i.name, string_agg(CASE WHEN forward THEN c ELSE translate(reverse(c), 'ACGT', 'TGCA') END, '' ORDER BY CASE WHEN s % 3 = 0 THEN -st.b ELSE st.b END) AS seq
FROM st JOIN con ON con.b = st.b JOIN i ON i.id = st.id WHERE level = 3 GROUP BY i.name""")
def net_blocks_from_gfa(spark, sf_dir):
    """Tips of a network built from the paths of blocks alone, a third of which run from the last block to the first."""
    net = network_of(spark, sf_dir)
    back = _keyed(spark, sf_dir).where("level = 3 and s % 3 = 0").select(F.col("name").alias("path"), F.lit(-1).alias("way"))
    steps = graph.block_steps(net.tables).join(back, "path", "left").withColumn("step", F.col("step") * F.coalesce("way", F.lit(1)))
    steps = steps.select("path", "step", F.col("segment").cast("string").alias("segment"), "forward")
    segments = net["block"].select(F.col("block_id").cast("string").alias("segment"), F.col("consensus").alias("seq"))
    return Network.from_gfa(net["node"], segments, steps).sequences().select("name", "seq")


def pangraph_of(net: Network) -> dict[str, DataFrame]:
    """The tables of a PanGraph file of the tips: their blocks in order, and what differs from the consensus."""
    tips = net.node_ids(tips=True)
    steps = graph.block_steps(net.tables).select("tree_id", "path", "step", F.col("segment").alias("block_id"), "forward")
    meta = named(net["seq_meta"], net["node"]).select(F.col("name").alias("path"), F.col("circ_offset").alias("offset"))
    last = named(sequence.last_writes(closure(net["node"], start=tips), net["nuc_mut"]), net["node"]).withColumnRenamed("name", "path")
    edits = last.join(steps.select("path", "block_id"), ["path", "block_id"]).select(F.col("block_id").cast("string").alias("block"), "path", F.lit(1).alias("occ"), "pos", "gap_pos", "base")
    key, main, bare = ["block", "path", "occ"], F.col("gap_pos") < 0, F.col("base") == "-"
    block = F.col("block_id").cast("string").alias("block")
    return {
        "path": steps.join(meta, "path").select("path", F.lit(False).alias("circular"), "offset", "step", block, "forward", F.lit(1).alias("occ")),
        "block": net["block"].select(block, F.col("consensus").alias("seq")),
        "gap": net["gap"].select(block, "pos", "len"),
        "sub": edits.where(main & ~bare).select(*key, (F.col("pos") + 1).alias("pos"), "base"),
        "ins": edits.where(~main & ~bare).select(*key, "pos", F.col("gap_pos").alias("gap"), F.col("base").alias("text")),
        "del": edits.where(main & bare).select(*key, (F.col("pos") + 1).alias("pos"), F.lit(1).alias("len")),
    }


@query(f"""{_NET}, p AS (SELECT i.name, i.s % 50 AS off, translate(string_agg(t, '' ORDER BY b), '-', '') AS x FROM tx JOIN i ON i.id = tx.id WHERE level = 3 GROUP BY i.name, i.s)
SELECT name, CASE WHEN x = '' THEN '' ELSE substr(x, CAST(off % length(x) + 1 AS BIGINT)) || substr(x, 1, CAST(off % length(x) AS BIGINT)) END AS seq FROM p""")
def net_blocks_from_pangraph(spark, sf_dir):
    """Tips of a network that is inferred from their blocks, strands, edits and offsets."""
    net = network_of(spark, sf_dir)
    return Network.from_pangraph(net["node"], pangraph_of(net)).sequences().select("name", "seq")
