"""Queries of runs, coordinates, replay, variants and graphs over the driver's tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from cladeframe.functions import codes
from cladeframe.operators import graph, mutations, sequence, variants
from cladeframe.operators.order import ranked
from cladeframe.plans.registry import query, table
from cladeframe.plans.scalars import SEQ, sequences
from cladeframe.scratch import written
from cladeframe.sources.text import occurrence

#: Keys of a group whose pairs are made together.
SLICE = 1024

_STEP = "SELECT user_id, event_id, event_type, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step FROM events"


def steps(spark, sf_dir):
    """Events of a user in order of time: path, step, segment."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events")
    return rows.select("user_id", "event_id", "event_type", "ts", (F.row_number().over(order) - 1).cast("bigint").alias("step"))


@query("""SELECT l_returnflag AS type, count(*) AS n FROM lineitem GROUP BY l_returnflag""")
def parsimony_by_type(spark, sf_dir):
    return mutations.count_by_type(table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("type")))


@query("""SELECT (SELECT count(*) FROM nation) + (SELECT count(*) FROM supplier) AS nodes, (SELECT count(*) FROM supplier) AS samples,
count(*) FILTER (WHERE l_returnflag = 'R') AS subs, count(*) FILTER (WHERE l_returnflag = 'A') AS ins, count(*) FILTER (WHERE l_returnflag = 'N') AS dels,
count(*) FILTER (WHERE l_linestatus = 'F') AS inversions FROM lineitem""")
def summary_totals(spark, sf_dir):
    flag = F.col("l_returnflag")
    items = table(spark, sf_dir, "lineitem").agg(
        F.count_if(flag == "R").alias("subs"), F.count_if(flag == "A").alias("ins"), F.count_if(flag == "N").alias("dels"), F.count_if(F.col("l_linestatus") == "F").alias("inversions")
    )
    n = table(spark, sf_dir, "nation").agg(F.count("*").alias("a"))
    s = table(spark, sf_dir, "supplier").agg(F.count("*").alias("samples"))
    one = items.crossJoin(F.broadcast(n)).crossJoin(F.broadcast(s))  # three single rows
    return one.select((F.col("a") + F.col("samples")).alias("nodes"), "samples", "subs", "ins", "dels", "inversions")


@query(f"""WITH s AS ({_STEP}), e AS (SELECT user_id, event_type, step, step - row_number() OVER (PARTITION BY user_id, event_type ORDER BY step) AS g FROM s),
r AS (SELECT *, (row_number() OVER (PARTITION BY user_id, event_type, g ORDER BY step) - 1) // 6 AS k FROM e)
SELECT user_id, event_type, CAST(min(step) AS BIGINT) AS start, count(*) AS len FROM r GROUP BY user_id, event_type, g, k""")
def run_packing(spark, sf_dir):
    marked = mutations.runs(steps(spark, sf_dir), ["user_id", "event_type"], "step", [], 6)
    return marked.groupBy("user_id", "event_type", "run").agg(F.min("step").alias("start"), F.count("*").alias("len")).drop("run")


@query("""WITH d AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem),
e AS (SELECT *, l_linenumber - row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS g FROM d)
SELECT l_orderkey, min(l_linenumber) AS start, count(*) AS len FROM e GROUP BY l_orderkey, g""")
def run_packing_gap(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    marked = mutations.runs(rows, ["l_orderkey"], "l_linenumber", [])
    return marked.groupBy("l_orderkey", "run").agg(F.min("l_linenumber").alias("start"), F.count("*").alias("len")).drop("run")


@query("""SELECT user_id, CAST(event_id % 7 AS BIGINT) AS site, arg_max(event_type, ts) AS last_type, count(*) AS n FROM events GROUP BY user_id, event_id % 7""")
def consolidate_last(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("site", F.col("event_id") % 7)
    return rows.groupBy("user_id", "site").agg(F.max_by("event_type", "ts").alias("last_type"), F.count("*").alias("n"))


_KIND = "CASE event_type WHEN 'click' THEN 'ins' WHEN 'purchase' THEN 'del' ELSE 'inv' END"


@query(f"""WITH s AS (SELECT user_id, event_id % 3 AS block, ts, event_id, CASE event_id % 5 WHEN 0 THEN 'ins' WHEN 1 THEN 'del' WHEN 2 THEN 'ins_inv' ELSE 'inv' END AS kind FROM events),
l AS (SELECT user_id, block, max(CASE WHEN kind <> 'inv' THEN event_id END) AS at FROM (SELECT * FROM s) GROUP BY user_id, block),
b AS (SELECT s.user_id, s.block, max(CASE WHEN s.event_id = l.at THEN kind END) AS kind, count(*) FILTER (WHERE s.kind = 'inv' AND s.event_id > coalesce(l.at, -1)) AS flips
FROM s JOIN l ON s.user_id = l.user_id AND s.block = l.block GROUP BY s.user_id, s.block)
SELECT user_id, CAST(block AS BIGINT) AS block, coalesce(kind IN ('ins', 'ins_inv'), false) AS block_exists, (coalesce(kind, 'del') = 'ins_inv') = (flips % 2 = 1) AS forward FROM b""")
def strand_parity(spark, sf_dir):
    n = F.col("event_id") % 5
    kind = F.when(n == 0, "ins").when(n == 1, "del").when(n == 2, "ins_inv").otherwise("inv")
    rows = table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 3).alias("block"), "event_id", kind.alias("kind"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "kind"))), lambda x: x["kind"])
    folded = rows.groupBy("user_id", "block").agg(mutations.fold_blocks(ordered).alias("x"))
    return folded.select("user_id", "block", F.col("x.exists").alias("block_exists"), F.col("x.forward").alias("forward"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(sum(CASE WHEN l_returnflag <> 'N' THEN 1 ELSE 0 END) OVER
(PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_shipdate ROWS UNBOUNDED PRECEDING) AS BIGINT) AS n_bases FROM lineitem""")
def prefix_coordinates(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_shipdate"]
    return sequence.prefix_counts(rows, ["l_suppkey"], order, F.col("l_returnflag") != "N").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "n_bases")


@query("""WITH b AS (SELECT p_brand, p_partkey, p_size, sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey) - p_size AS lo FROM part),
q AS (SELECT DISTINCT p_brand, p_size * 20 AS at FROM part)
SELECT q.p_brand, CAST(q.at AS BIGINT) AS at, b.p_partkey AS block_id, CAST(q.at - b.lo AS BIGINT) AS pos FROM q JOIN b ON b.p_brand = q.p_brand AND q.at >= b.lo AND q.at < b.lo + b.p_size""")
def coordinate_inverse(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    lengths = part.select(F.col("p_brand").alias("tree_id"), F.col("p_partkey").alias("block_id"), F.col("p_size").alias("n"))
    points = part.select(F.col("p_brand").alias("tree_id"), (F.col("p_size") * 20).cast("bigint").alias("at")).distinct()
    found = sequence.to_block_coordinate(lengths, points)
    return found.select(F.col("tree_id").alias("p_brand"), "at", "block_id", F.col("pos").cast("bigint").alias("pos"))


@query("""WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS rn, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY (rn - o_custkey % n + n) % n) AS ring FROM r GROUP BY o_custkey""")
def circular_shift(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("x"))
    turned = sequence.rotated(F.col("x"), (F.col("o_custkey") % F.size("x")).cast("int"))
    return rows.select("o_custkey", F.array_join(F.transform(turned, lambda k: k.cast("string")), ",").alias("ring"))


@query(f"""WITH s AS ({_STEP}) SELECT user_id, string_agg(upper(substr(event_type, 1, 1)), '' ORDER BY step) AS seq FROM s GROUP BY user_id""")
def sequence_replay(spark, sf_dir):
    rows = steps(spark, sf_dir).withColumn("c", F.upper(F.substring("event_type", 1, 1)))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("step", "c"))), lambda x: x["c"])
    return rows.groupBy("user_id").agg(F.array_join(ordered, "").alias("seq"))


@query(f"SELECT doc_id, substr(s, 11, 30) AS part FROM (SELECT doc_id, {SEQ} AS s FROM documents) WHERE length(s) >= 11")
def range_slice(spark, sf_dir):
    return sequences(spark, sf_dir).where(F.length("seq") >= 11).select("doc_id", F.substring("seq", 11, 30).alias("part"))


_SITES = f"""s AS (SELECT doc_id, source, unnest(range(0, length(s))) AS i, unnest(string_split(s, '')) AS c FROM (SELECT doc_id, source, {SEQ} AS s FROM documents) WHERE s <> '')"""


def sites(spark, sf_dir):
    """All columns of the documents' sequences, as the alignment of a source."""
    rows = sequences(spark, sf_dir)
    return rows.select("doc_id", "source", F.posexplode(F.split("seq", "")).alias("i", "c")).where("c <> ''").withColumn("i", F.col("i").cast("bigint"))


@query(f"WITH {_SITES} SELECT source, CAST(i AS BIGINT) AS i, arg_min(c, doc_id) FILTER (WHERE c <> '-') AS base FROM s GROUP BY source, i HAVING bool_or(c <> '-')")
def msa_consensus(spark, sf_dir):
    # a base is kept as its number, so that bases are gathered in a hash table where they are read, not sorted
    real = sites(spark, sf_dir).where("c <> '-'").withColumn("c", F.ascii("c"))
    return real.groupBy("source", "i").agg(F.min_by("c", "doc_id").alias("base")).select("source", "i", F.char("base").alias("base"))


@query(f"WITH {_SITES}, g AS (SELECT source, i FROM s GROUP BY source, i HAVING bool_and(c = '-')) SELECT s.doc_id, count(*) AS n FROM s WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.source = s.source AND g.i = s.i) GROUP BY s.doc_id")
def drop_gap_columns(spark, sf_dir):
    # the blank columns of a source go to its documents as one list, so that no base meets them in a join
    blank = sites(spark, sf_dir).groupBy("source", "i").agg(F.bool_and(F.col("c") == "-").alias("all_gap")).where("all_gap")
    lists = blank.groupBy("source").agg(F.collect_list("i").alias("blank"))
    rows = sequences(spark, sf_dir).join(lists, "source", "left").withColumn("len", F.length("seq"))
    lost = F.when(F.col("blank").isNull(), 0).otherwise(F.size(F.filter("blank", lambda i: i < F.col("len"))))
    return rows.select("doc_id", (F.col("len") - lost).cast("bigint").alias("n")).where("n > 0")


_AA = "CASE " + " ".join(
    f"WHEN codon = '{a + b + c}' THEN '{codes.THREE[codes.RESIDUES[16 * i + 4 * j + k]]}'" for i, a in enumerate("TCAG") for j, b in enumerate("TCAG") for k, c in enumerate("TCAG")
) + " END"


@query(f"""WITH s AS (SELECT doc_id, regexp_replace({SEQ}, '[^ACGT]', '', 'g') AS s FROM documents),
c AS (SELECT doc_id, unnest(range(0, length(s) // 3)) AS k, unnest(regexp_extract_all(s, '.{{3}}')) AS codon FROM s)
SELECT doc_id, CAST(k AS BIGINT) AS k, codon, {_AA} AS residue FROM c""")
def codon_translate(spark, sf_dir):
    bare = F.regexp_replace(codes.only_bases(F.col("seq")), "-", "")
    each = sequences(spark, sf_dir).select("doc_id", F.posexplode(F.regexp_extract_all(bare, F.lit(".{3}"), 0)).alias("k", "codon"))
    return each.select("doc_id", F.col("k").cast("bigint").alias("k"), "codon", codes.codon_residue(F.col("codon")).alias("residue"))


@query("""WITH a AS (SELECT DISTINCT user_id, event_id * 3 AS lo, event_id * 3 + 2 AS hi FROM events WHERE event_type = 'click'),
b AS (SELECT DISTINCT user_id, event_id * 3 + 1 AS lo, event_id * 3 + 5 AS hi FROM events WHERE event_type <> 'click')
SELECT a.user_id, a.lo AS a_lo, count(b.lo) AS n_overlap FROM a LEFT JOIN b ON a.user_id = b.user_id AND b.lo <= a.hi AND b.hi >= a.lo GROUP BY a.user_id, a.lo""")
def aa_interval_compare(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    a = e.where("event_type = 'click'").select("user_id", (F.col("event_id") * 3).alias("a_lo"), (F.col("event_id") * 3 + 2).alias("a_hi")).distinct()
    b = e.where("event_type <> 'click'").select(F.col("user_id").alias("u"), (F.col("event_id") * 3 + 1).alias("lo"), (F.col("event_id") * 3 + 5).alias("hi")).distinct()
    meets = (a.user_id == b.u) & (b.lo <= a.a_hi) & (b.hi >= a.a_lo)
    return a.join(b, meets, "left").groupBy("user_id", "a_lo").agg(F.count("lo").alias("n_overlap"))


@query(f"""WITH {_SITES}, r AS (SELECT source, min(doc_id) AS ref FROM documents GROUP BY source),
d AS (SELECT s.doc_id, s.source, s.i, q.c AS old, s.c AS new, s.i - row_number() OVER (PARTITION BY s.doc_id ORDER BY s.i) AS g
FROM s JOIN r ON s.source = r.source JOIN s q ON q.doc_id = r.ref AND q.i = s.i WHERE s.c <> q.c)
SELECT doc_id, CAST(min(i) AS BIGINT) AS start, string_agg(old, '' ORDER BY i) AS old, string_agg(new, '' ORDER BY i) AS new FROM d GROUP BY doc_id, g""")
def variant_diff(spark, sf_dir):
    rows = sequences(spark, sf_dir)
    first = rows.groupBy("source").agg(F.min("doc_id").alias("doc_id"))
    base = rows.join(first, ["source", "doc_id"]).select("source", F.col("seq").alias("old"))
    pairs = rows.join(base, "source").select("doc_id", "seq", "old").where("seq <> old")

    def run(frames):
        for f in frames:
            out = []
            for doc, seq, old in zip(f["doc_id"], f["seq"], f["old"]):
                n = min(len(seq), len(old))
                at = np.flatnonzero(np.frombuffer(seq[:n].encode(), "u1") != np.frombuffer(old[:n].encode(), "u1"))
                for part in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1) if len(at) else []:
                    lo, hi = int(part[0]), int(part[-1]) + 1
                    out.append((doc, lo, old[lo:hi], seq[lo:hi]))
                if len(out) >= 50_000:
                    yield pd.DataFrame(out, columns=["doc_id", "start", "old", "new"])
                    out = []
            if out:
                yield pd.DataFrame(out, columns=["doc_id", "start", "old", "new"])

    return pairs.mapInPandas(run, "doc_id bigint, start bigint, old string, new string")


@query(f"""WITH {_SITES}, g AS (SELECT source, i, c, count(*) AS n_tips FROM s GROUP BY source, i, c)
SELECT source, CAST(i AS BIGINT) AS i, c AS alt, n_tips, CAST(dense_rank() OVER (PARTITION BY source, i ORDER BY c) AS BIGINT) AS genotype FROM g""")
def variant_genotype(spark, sf_dir):
    grouped = sites(spark, sf_dir).groupBy("source", "i", F.col("c").alias("alt")).agg(F.count("*").alias("n_tips"))
    return grouped.withColumn("genotype", F.dense_rank().over(Window.partitionBy("source", "i").orderBy("alt")).cast("bigint"))


@query(f"""WITH s AS ({_STEP}), l AS (SELECT user_id, step, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY step) AS old FROM s)
SELECT user_id, string_agg(upper(substr(old, 1, 1)) || CAST(step + 1 AS VARCHAR) || upper(substr(event_type, 1, 1)), ',' ORDER BY step) AS mutations FROM l WHERE old <> event_type GROUP BY user_id""")
def mutation_list(spark, sf_dir):
    rows = steps(spark, sf_dir).withColumn("old", F.lag("event_type").over(Window.partitionBy("user_id").orderBy("step"))).where("old <> event_type")
    letter = lambda c: F.upper(F.substring(c, 1, 1))
    text = codes.mutation_text(letter("old"), F.col("step") + 1, letter("event_type"), F.lit(False))
    parts = F.array_sort(F.collect_list(F.struct("step", text.alias("t"))))
    return rows.groupBy("user_id").agg(F.array_join(F.transform(parts, lambda x: x["t"]), ",").alias("mutations"))


@query(f"""WITH s AS ({_STEP}), l AS (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY step) AS dst FROM s)
SELECT src, true AS src_forward, dst, true AS dst_forward FROM (SELECT DISTINCT src, dst FROM l WHERE dst IS NOT NULL)""")
def path_edges(spark, sf_dir):
    return graph.path_edges(steps(spark, sf_dir).withColumn("forward", F.lit(True)), "user_id", "step", "event_type")


@query(f"""WITH s AS ({_STEP}), l AS (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY step) AS dst FROM s)
SELECT src, dst, count(*) AS n FROM l WHERE dst IS NOT NULL GROUP BY src, dst""")
def edge_counts(spark, sf_dir):
    order = Window.partitionBy("user_id").orderBy("step")
    pairs = steps(spark, sf_dir).select(F.col("event_type").alias("src"), F.lead("event_type").over(order).alias("dst")).where("dst is not null")
    return pairs.groupBy("src", "dst").agg(F.count("*").alias("n"))


@query(f"""WITH p AS (SELECT doc_id, unnest(range(0, (length(s) + 31) // 32)) AS k, unnest(regexp_extract_all(s, '.{{1,32}}')) AS part FROM (SELECT doc_id, {SEQ} AS s FROM documents)),
c AS (SELECT doc_id, k, translate(part, '-x', '') AS seq FROM p),
u AS (SELECT DISTINCT k, seq FROM c WHERE seq <> '')
SELECT CAST(k AS BIGINT) AS k, seq, CAST(row_number() OVER (PARTITION BY k ORDER BY seq) AS BIGINT) AS segment FROM u""")
def segment_chunks(spark, sf_dir):
    pieces = F.transform(F.regexp_extract_all("seq", F.lit(".{1,32}"), 0), codes.strip_gaps)
    cut = sequences(spark, sf_dir).select(F.posexplode(pieces).alias("k", "seq")).where("seq <> ''").distinct()
    numbered = F.row_number().over(Window.partitionBy("k").orderBy("seq"))
    return cut.select(F.col("k").cast("bigint").alias("k"), "seq", numbered.cast("bigint").alias("segment"))


@query("""WITH w AS (SELECT l_orderkey AS path, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS step
FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem)),
s AS (SELECT path, step, CASE WHEN step % 3 = 1 THEN l_partkey ELSE 1000000000 + path * 100 + step END AS segment FROM w),
n AS (SELECT segment, count(*) AS n FROM s GROUP BY segment), l AS (SELECT segment AS src, lead(segment) OVER (PARTITION BY path ORDER BY step) AS dst FROM s),
e AS (SELECT src, dst, count(*) AS n FROM l WHERE dst IS NOT NULL GROUP BY src, dst)
SELECT e.src, e.dst FROM e JOIN n a ON e.src = a.segment JOIN n b ON e.dst = b.segment WHERE e.n = a.n AND e.n = b.n AND e.src <> e.dst""")
def unitig_candidates(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").distinct()
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    walk = rows.select(F.col("l_orderkey").alias("path"), F.row_number().over(order).alias("step"), "l_partkey")
    own = F.lit(1_000_000_000) + F.col("path") * 100 + F.col("step")
    return graph.unitig_links(walk.select("path", "step", F.when(F.col("step") % 3 == 1, F.col("l_partkey")).otherwise(own).alias("segment")))


@query("""SELECT a.doc_id, count(*) AS n_twins, min(b.doc_id) AS first_twin FROM documents a JOIN documents b ON a.text = b.text AND a.doc_id <> b.doc_id GROUP BY a.doc_id""")
def duplicate_blocks(spark, sf_dir):
    # sizes and two least ids of each group of equal texts give every member its twins without a self-join
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    groups = docs.groupBy("h").agg(F.count("*").alias("n"), F.min("doc_id").alias("lo")).where("n > 1")
    second = docs.join(groups, "h").where("doc_id <> lo").groupBy("h").agg(F.min("doc_id").alias("next"))
    rows = docs.join(groups, "h").join(second, "h")
    return rows.select("doc_id", (F.col("n") - 1).alias("n_twins"), F.when(F.col("doc_id") == F.col("lo"), F.col("next")).otherwise(F.col("lo")).alias("first_twin"))


@query(f"WITH s AS ({_STEP}) SELECT user_id, event_id, event_type, CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY step) AS BIGINT) AS occ FROM s")
def occurrence_number(spark, sf_dir):
    numbered = occurrence(steps(spark, sf_dir), ["user_id", "event_type"], ["step"])
    return numbered.select("user_id", "event_id", "event_type", F.col("occ").cast("bigint").alias("occ"))


@query("""WITH o AS (SELECT DISTINCT event_type FROM events), p AS (SELECT DISTINCT user_id FROM events), f AS (SELECT user_id, event_type, count(*) AS n, min(event_id) % 2 = 0 AS forward FROM events GROUP BY user_id, event_type)
SELECT p.user_id, o.event_type, coalesce(f.n, -1) AS n, f.forward FROM p CROSS JOIN o LEFT JOIN f ON f.user_id = p.user_id AND f.event_type = o.event_type""")
def path_align(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    order = events.select("event_type").distinct()  # the fixed set of event types
    found = events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), (F.min("event_id") % 2 == 0).alias("forward"))
    grid = events.select("user_id").distinct().crossJoin(F.broadcast(order))
    return grid.join(found, ["user_id", "event_type"], "left").select("user_id", "event_type", F.coalesce("n", F.lit(-1)).alias("n"), "forward")


@query("""SELECT a.p_brand, a.p_partkey AS x, b.p_partkey AS y FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey""")
def anchor_pairs(spark, sf_dir):
    # keys of a group in order are cut into slices, and pairs of slices are dealt to tasks, whatever a group's size
    part = table(spark, sf_dir, "part").select("p_brand", "p_size", "p_partkey").dropna()
    cut = ranked(part, ["p_brand", "p_size", "p_partkey"]).withColumn("s", F.floor(F.col("rank") / SLICE))
    slices = written(cut.groupBy("p_brand", "p_size", "s").agg(F.array_sort(F.collect_list("p_partkey")).alias("xs")))
    met = slices.groupBy("p_brand", "p_size").count().agg(F.sum(F.col("count") * (F.col("count") + 1) / 2)).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, int(met) // 64)
    later = slices.select("p_brand", "p_size", F.col("s").alias("t"), F.col("xs").alias("ys"))
    dealt = slices.join(later, ["p_brand", "p_size"]).where("s <= t").repartition(tasks)
    each = dealt.select("p_brand", "s", "t", "ys", F.posexplode("xs").alias("i", "x"))
    behind = F.when(F.col("s") == F.col("t"), F.slice("ys", F.col("i") + 2, F.size("ys"))).otherwise(F.col("ys"))
    return each.select("p_brand", "x", F.explode(behind).alias("y")).where("x < y")


@query("""SELECT a.p_partkey AS x, count(*) AS n_before, max(b.p_partkey) AS latest FROM part a JOIN part b
ON b.p_partkey BETWEEN a.p_partkey - 40 AND a.p_partkey - 1 AND b.p_size BETWEEN a.p_size - 10 AND a.p_size - 1 GROUP BY a.p_partkey""")
def chain_window(spark, sf_dir):
    # a range join by buckets as wide as the reach: each anchor looks into its own and the one before
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("x"), F.col("p_size").alias("y"), F.floor(F.col("p_partkey") / 40).alias("bucket"))
    near = part.withColumn("bucket", F.explode(F.array(F.col("bucket"), F.col("bucket") - 1)))
    prev = part.select(F.col("x").alias("px"), F.col("y").alias("py"), "bucket")
    hit = near.join(prev, "bucket").where(F.col("px").between(F.col("x") - 40, F.col("x") - 1) & F.col("py").between(F.col("y") - 10, F.col("y") - 1))
    return hit.groupBy("x").agg(F.count("*").alias("n_before"), F.max("px").alias("latest"))


@query()
def chain_best(spark, sf_dir):
    """Length of the best chain of each user's events against the user before; tested against brute force."""
    lists = steps(spark, sf_dir).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("step", "event_type"))).alias("x"))
    lists = lists.select("user_id", F.transform("x", lambda e: e["event_type"]).alias("seq"))
    other = lists.select((F.col("user_id") + 1).alias("user_id"), F.col("seq").alias("before"))

    def run(frames):
        for f in frames:
            f["n_anchors"] = [len(graph.chain(list(a), list(b))) for a, b in zip(f["before"], f["seq"])]
            yield f[["user_id", "n_anchors"]]

    return lists.join(other, "user_id").mapInPandas(run, "user_id bigint, n_anchors bigint")


@query()
def rotation_best(spark, sf_dir):
    """Where all events of a user, as a circle, best begin against the user before; tested against brute force."""
    lists = steps(spark, sf_dir).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("step", "event_type"))).alias("x"))
    lists = lists.select("user_id", F.transform("x", lambda e: e["event_type"]).alias("seq"))
    other = lists.select((F.col("user_id") + 1).alias("user_id"), F.col("seq").alias("before"))

    def run(frames):
        for f in frames:
            f["start"] = [graph.rotation_start(list(a), list(b)) for a, b in zip(f["before"], f["seq"])]
            yield f[["user_id", "start"]]

    return lists.join(other, "user_id").mapInPandas(run, "user_id bigint, start bigint")


@query("""WITH t AS (SELECT d.source, d.lang, coalesce(l.toxic, 0) AS a FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
n AS (SELECT sum(a) AS na, sum(1 - a) AS nb FROM t)
SELECT source, round(sum(a) / any_value(na), 9) AS frac_a, round(sum(1 - a) / any_value(nb), 9) AS frac_b, round((sum(a) / any_value(na)) / (sum(1 - a) / any_value(nb) + 0.0001), 6) AS ratio FROM t, n GROUP BY source""")
def ratio_test(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("source", F.coalesce("toxic", F.lit(0)).alias("a"))
    totals = rows.agg(F.sum("a").alias("na"), F.sum(1 - F.col("a")).alias("nb"))
    grouped = rows.groupBy("source").agg(F.sum("a").alias("x"), F.sum(1 - F.col("a")).alias("y")).crossJoin(F.broadcast(totals))  # one row
    a, b = F.col("x") / F.col("na"), F.col("y") / F.col("nb")
    return grouped.select("source", F.round(a, 9).alias("frac_a"), F.round(b, 9).alias("frac_b"), F.round(variants.ratio(a, b), 6).alias("ratio"))


@query("""SELECT d.doc_id, string_agg(v, ';' ORDER BY k) AS annotations FROM documents d JOIN
(SELECT doc_id, 1 AS k, 'quality=' || quality AS v FROM labels UNION ALL SELECT doc_id, 2, 'toxic=' || toxic FROM labels) a ON d.doc_id = a.doc_id GROUP BY d.doc_id""")
def annotate_nodes(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    value = lambda k, c: F.struct(F.lit(k).alias("k"), F.concat(F.lit(f"{c}="), F.col(c).cast("string")).alias("v"))
    rows = labels.select("doc_id", F.explode(F.array(value(1, "quality"), value(2, "toxic"))).alias("x")).where("x.v is not null")
    grouped = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    joined = table(spark, sf_dir, "documents").select("doc_id").join(grouped, "doc_id")
    return joined.select("doc_id", F.array_join(F.transform("x", lambda e: e["v"]), ";").alias("annotations"))


@query(f"""WITH s AS ({_STEP}), l AS (SELECT user_id, step, event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY step) AS old FROM s)
SELECT user_id, CAST(step + 1 AS BIGINT) AS position, CAST(old % 16 AS INTEGER) AS par_nuc, list_filter([0, 1, 2, 3], lambda i: (CAST(event_id % 16 AS INTEGER) >> i) % 2 = 1) AS mut_nuc
FROM l WHERE old IS NOT NULL AND event_id % 16 <> 0 AND old % 16 <> event_id % 16""")
def placement_rows(spark, sf_dir):
    rows = steps(spark, sf_dir).withColumn("old", F.lag("event_id").over(Window.partitionBy("user_id").orderBy("step")))
    rows = rows.where("old is not null and event_id % 16 <> 0 and old % 16 <> event_id % 16")
    return rows.select("user_id", (F.col("step") + 1).alias("position"), (F.col("old") % 16).cast("int").alias("par_nuc"), codes.expanded((F.col("event_id") % 16).cast("int")).alias("mut_nuc"))


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())""")
def grouping_total(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return rows.groupingSets([[rows.l_returnflag, rows.l_linestatus], [rows.l_returnflag], []], rows.l_returnflag, rows.l_linestatus).agg(
        F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty")
    )


@query("""SELECT l_suppkey, l_returnflag AS type, CAST(greatest(l_partkey % 100, 20) AS BIGINT) AS lo, CAST(least(l_partkey % 100 + l_linenumber - 1, 60) AS BIGINT) AS hi, count(*) AS n FROM lineitem
WHERE l_partkey % 100 + l_linenumber - 1 >= 20 AND l_partkey % 100 <= 60 GROUP BY ALL""")
def range_clip(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_returnflag").alias("type"), (F.col("l_partkey") % 100).alias("pos"), F.col("l_linenumber").alias("len"), F.repeat(F.lit("N"), F.col("l_linenumber")).alias("chars"))
    cut = sequence.clip_runs(rows, F.lit(20), F.lit(60))
    lo = (F.col("pos") + 20).cast("bigint")
    return cut.groupBy("l_suppkey", "type", lo.alias("lo"), (lo + F.col("len") - 1).cast("bigint").alias("hi")).agg(F.count("*").alias("n"))
