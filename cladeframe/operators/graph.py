"""Sequence graphs: GFA and MAF exports, unitigs, chaining of block paths, circular rotation."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cladeframe.functions.codes import strip_gaps
from cladeframe.operators import sequence
from cladeframe.scratch import written

#: Columns of a segment in the graph with bases.
CHUNK = 32
# How far an anchor's predecessor may be, what an anchor is worth, and its least score.
REACH, WORTH, FLOOR = 4000, 50, 10
# Scores of a match, a gap and a mismatch in the circular alignment.
MATCH, GAP, MISMATCH = 5, -1, -2


def path_edges(steps: DataFrame, path: str = "path", step: str = "step", segment: str = "segment", within: list[str] | None = None) -> DataFrame:
    """Distinct (*within, src, src_forward, dst, dst_forward) of steps that follow each other on a path of `within`."""
    within = within or []
    order = Window.partitionBy(*within, path).orderBy(step)
    pairs = steps.select(*within, F.col(segment).alias("src"), F.col("forward").alias("src_forward"), F.lead(segment).over(order).alias("dst"), F.lead("forward").over(order).alias("dst_forward"))
    return pairs.where("dst is not null").distinct()


def block_steps(net: dict[str, DataFrame]) -> DataFrame:
    """tree_id, path, step, segment and forward of the present blocks of every tip."""
    tips = net["node"].where("is_leaf").select("tree_id", "node_id", F.col("name").alias("path"))
    states = sequence.block_states(net["node"], net["block_mut"]).join(tips, ["tree_id", "node_id"])
    return states.select("tree_id", "path", F.col("block_id").alias("step"), F.col("block_id").alias("segment"), "forward")


def base_steps(net: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Segments (tree_id, segment, seq) and steps of every tip's text cut into stretches of CHUNK columns a block.

    A segment is a stretch's first column and its text without gaps; equal ones of a tree share a number, made
    of the column and the text's rank in it. Stretches without a base are left out."""
    tips = net["node"].where("is_leaf").select("tree_id", "node_id", F.col("name").alias("path"))
    texts = sequence.block_texts(net, tips).join(tips, ["tree_id", "node_id"])
    order = Window.partitionBy("tree_id").orderBy("block_id").rowsBetween(Window.unboundedPreceding, -1)
    starts = sequence.widths(net).withColumn("lo", F.coalesce(F.sum("width").over(order), F.lit(0)))
    pieces = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{CHUNK}}}"), 0)
    cut = texts.join(starts, ["tree_id", "block_id"]).select("tree_id", "path", "lo", F.posexplode(pieces).alias("k", "piece"))
    cut = cut.select("tree_id", "path", (F.col("lo") + F.col("k") * CHUNK).alias("step"), strip_gaps(F.col("piece")).alias("seq"))
    cut = written(cut.where("seq <> ''"))  # tips are spelled once, and numbers of segments are given to what was written
    ids = cut.select("tree_id", "step", "seq").distinct()
    rank = F.row_number().over(Window.partitionBy("tree_id", "step").orderBy("seq"))
    ids = written(ids.withColumn("segment", F.col("step").cast("bigint") * (1 << 24) + rank))
    steps = cut.join(ids, ["tree_id", "step", "seq"]).select("tree_id", "path", "step", "segment", F.lit(True).alias("forward"))
    return ids.select("tree_id", "segment", "seq"), steps


def unitig_links(steps: DataFrame, within: list[str] | None = None) -> DataFrame:
    """(*within, src, dst) of segments that can be one: on every path that has either, dst follows src."""
    within = within or []
    on = steps.groupBy(*within, "segment").agg(F.count("*").alias("n"))
    order = Window.partitionBy(*within, "path").orderBy("step")
    pairs = steps.select(*within, F.col("segment").alias("src"), F.lead("segment").over(order).alias("dst")).where("dst is not null")
    pairs = pairs.groupBy(*within, "src", "dst").agg(F.count("*").alias("n_both"))
    side = lambda end: on.select(*within, F.col("segment").alias(end), F.col("n").alias(f"n_{end}"))
    joined = pairs.join(side("src"), [*within, "src"]).join(side("dst"), [*within, "dst"])
    return joined.where("n_both = n_src and n_both = n_dst and src <> dst").select(*within, "src", "dst")


def unitigs(segments: DataFrame, steps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Segments (tree_id, segment, seq) and steps with unitigs as one segment, under the number of its first. Chains
    of links shrink by half a round of pointer jumping; a chain of n segments takes log2(n) rounds."""
    own = ["tree_id", "segment"]
    links = unitig_links(steps, ["tree_id"])
    jump = segments.select(own).join(links.select("tree_id", F.col("dst").alias("segment"), F.col("src").alias("head")), own, "left")
    jump = jump.select(*own, F.coalesce("head", "segment").alias("head"), F.col("head").isNotNull().cast("int").alias("nth"))
    open_ = None
    while open_ != 0:
        jump = written(jump)
        further = jump.select("tree_id", F.col("segment").alias("head"), F.col("head").alias("top"), F.col("nth").alias("more"))
        jump = jump.join(further, ["tree_id", "head"]).select(*own, F.col("top").alias("head"), (F.col("nth") + F.col("more")).alias("nth"))
        now = jump.agg(F.sum("nth")).first()[0]
        open_ = 0 if now == open_ else now
    parts = F.array_sort(F.collect_list(F.struct("nth", "seq")))
    jump = written(jump)
    merged = segments.join(jump, own).groupBy("tree_id", F.col("head").alias("unitig")).agg(F.array_join(F.transform(parts, lambda x: x["seq"]), "").alias("seq"))
    kept = steps.join(jump.where("nth = 0").select(own), own, "left_semi")
    return merged.select("tree_id", F.col("unitig").alias("segment"), "seq"), kept.select("tree_id", "path", "step", "segment", "forward")


def gfa_lines(segments: DataFrame, steps: DataFrame) -> DataFrame:
    """rank, key and line of a GFA file: header, segments, links and paths in order. Segments and steps may have
    a tree_id; segments of trees other than 0 have its number before theirs."""
    spark = segments.sparkSession
    within = ["tree_id"] if "tree_id" in steps.columns else []
    sign = lambda c: F.when(c, "+").otherwise("-")

    def name(c: str):
        return F.when(F.col("tree_id") != 0, F.concat_ws(".", F.col("tree_id").cast("string"), F.col(c).cast("string"))).otherwise(F.col(c).cast("string")) if within else F.col(c).cast("string")

    def key(*columns):
        return F.concat(*[F.lpad(F.col(c).cast("string"), 10, "0") for c in within], *columns)

    long = lambda c: F.lpad(F.col(c).cast("string"), 20, "0")
    head = spark.createDataFrame([(0, "", "H\tVN:Z:1.0")], "rank int, key string, line string")
    body = segments.select(F.lit(1).alias("rank"), key(long("segment")).alias("key"), F.concat_ws("\t", F.lit("S"), name("segment"), "seq").alias("line"))
    link = F.concat_ws("\t", F.lit("L"), name("src"), sign(F.col("src_forward")), name("dst"), sign(F.col("dst_forward")), F.lit("0M"))
    links = path_edges(steps, within=within).select(F.lit(2).alias("rank"), key(long("src"), long("dst"), sign(F.col("src_forward")), sign(F.col("dst_forward"))).alias("key"), link.alias("line"))
    parts = F.array_sort(F.collect_list(F.struct("step", F.concat(name("segment"), sign(F.col("forward"))).alias("s"))))
    paths = steps.groupBy(*within, "path").agg(F.array_join(F.transform(parts, lambda x: x["s"]), ",").alias("p"))
    lines = paths.select(F.lit(3).alias("rank"), key(F.col("path")).alias("key"), F.concat_ws("\t", F.lit("P"), "path", "p", F.lit("*")).alias("line"))
    return head.unionByName(body).unionByName(links).unionByName(lines).orderBy("rank", "key")


def gfa(net: dict[str, DataFrame], with_bases: bool = True) -> DataFrame:
    """GFA lines of the tips: blocks as segments, or unitigs of their bases."""
    if with_bases:
        return gfa_lines(*unitigs(*base_steps(net)))
    return gfa_lines(net["block"].select("tree_id", F.col("block_id").alias("segment"), F.col("consensus").alias("seq")), block_steps(net))


def maf(net: dict[str, DataFrame]) -> DataFrame:
    """key and line of a MAF file: a paragraph for each group of blocks of equal consensus, a row for each
    tip that has one: start among the tip's bases, bases, strand, the tip's bases, aligned text."""
    tips = net["node"].where("is_leaf").select("tree_id", "node_id", "name")
    texts = sequence.block_texts(net, tips).join(tips, ["tree_id", "node_id"]).withColumn("size", F.length(strip_gaps(F.col("text"))))
    order = Window.partitionBy("tree_id", "node_id").orderBy("block_id")
    before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("size").over(Window.partitionBy("tree_id", "node_id"))
    meta = net["seq_meta"].select("tree_id", "node_id", "circ_offset")
    rows = texts.withColumn("start", before).withColumn("total", total).join(meta, ["tree_id", "node_id"], "left")
    start = F.when(F.coalesce("circ_offset", F.lit(0)) == 0, F.col("start")).otherwise(F.pmod(F.col("start") - F.col("circ_offset"), F.greatest("total", F.lit(1))))
    group = net["block"].select("tree_id", "block_id", F.min("block_id").over(Window.partitionBy("tree_id", "consensus")).alias("group"))
    line = F.concat_ws("\t", F.lit("s"), "name", start.cast("string"), F.col("size").cast("string"), F.when(F.col("forward"), "+").otherwise("-"), F.col("total").cast("string"), "text")
    listed = rows.join(group, ["tree_id", "block_id"]).groupBy("tree_id", "group").agg(F.array_sort(F.collect_list(F.struct("name", "block_id", line.alias("line")))).alias("x"))
    text = F.concat(F.lit("a\n"), F.array_join(F.transform("x", lambda x: x["line"]), "\n"), F.lit("\n"))
    head = net["block"].sparkSession.createDataFrame([(-1, -1, "##maf version=1")], "tree_id int, group int, line string")
    return head.unionByName(listed.select("tree_id", "group", text.alias("line"))).orderBy("tree_id", "group")


def chain(consensus: list, sample: list) -> list[tuple[int, int]]:
    """Best chain of equal blocks (index in consensus, index in sample), both rising.

    An anchor is worth WORTH less its distance to the one before, which lies at most REACH back in
    both; it starts a chain at FLOOR, the pair (0, 0) at WORTH. Predecessors are taken from the latest
    on; one that comes before another in x, and before any so far in y, is passed over. Of equal
    predecessors the later wins, of equal ends the first.
    """
    places: dict = {}
    for j, block in enumerate(sample):
        places.setdefault(block, []).append(j)
    anchors = np.array([(i, j) for i, block in enumerate(consensus) for j in places.get(block, [])], dtype=np.int64).reshape(-1, 2)
    if not len(anchors):
        return []
    x, y = anchors[:, 0], anchors[:, 1]
    score = np.full(len(anchors), FLOOR, dtype=np.int64)
    back = np.full(len(anchors), -1, dtype=np.int64)
    for k in range(len(anchors)):
        if x[k] == 0 and y[k] == 0:
            score[k] = WORTH
            continue
        lo, hi = bisect_left(x, x[k] - REACH), bisect_left(x, x[k])
        near = np.flatnonzero((y[lo:hi] < y[k]) & (y[lo:hi] >= y[k] - REACH)) + lo
        if len(near):
            near = near[::-1]
            above = np.concatenate([[-1], np.maximum.accumulate(y[near])[:-1]])
            near = near[(x[near] == x[near[0]]) | (y[near] >= above)]
            gain = score[near] + WORTH - (x[k] - x[near]) - (y[k] - y[near])
            best = int(gain.argmax())
            if gain[best] > FLOOR:
                score[k], back[k] = gain[best], near[best]
    out, k = [], int(score.argmax())
    while k >= 0:
        out.append((int(x[k]), int(y[k])))
        k = int(back[k])
    return out[::-1]


def merge_chain(consensus: list, sample: list, anchors: list[tuple[int, int]]) -> list:
    """The consensus with the sample's other blocks put in: before each anchor what stands between it and
    the one before, first the consensus's, then the sample's."""
    out, i, j = [], 0, 0
    for a, b in [*anchors, (len(consensus), len(sample))]:
        out += consensus[i:a] + sample[j:b]
        if a < len(consensus):
            out.append(consensus[a])
        i, j = a + 1, b + 1
    return out


def rotation_start(consensus: list, sample: list) -> int:
    """Where in a circular sample the best local alignment with the consensus starts."""
    n = len(sample)
    if not n or not len(consensus):
        return 0
    last = np.full(n, -1, dtype=np.int64)
    origin, column = np.full(n, -1, dtype=np.int64), np.arange(n)
    best, where = None, -1
    for block in consensus:
        hit = np.array([MATCH if s == block else MISMATCH for s in sample], dtype=np.int64)
        diagonal = np.roll(last, 1) + hit
        source = np.roll(origin, 1)
        left = last + GAP
        row = np.maximum(diagonal, left)
        begins = np.where(diagonal >= left, np.where(source < 0, column, source), origin)
        if row[0] < -1:
            row[0], begins[0] = -1, -1
        for c in range(1, n):
            if row[c - 1] + GAP > row[c]:
                row[c], begins[c] = row[c - 1] + GAP, begins[c - 1]
        last, origin = row, begins
        top = int(row.argmax())
        if best is None or row[top] > best:
            best, where = row[top], int(begins[top])
    return max(where, 0)


def order_blocks(paths: DataFrame, guide: DataFrame | None = None) -> DataFrame:
    """The common order of blocks of paths (tree_id, path, step, block, forward), one chain after another:
    tree_id, path, at (place in the order), block, forward for every step. Paths are taken in order of name, or, with
    guide, the nodes of a tree whose tips they are, in pre-order, so that related paths meet early; paths that are
    no tips come last. A tree's paths depend on each other in that order, so one task takes a tree."""
    if guide is None:
        paths = paths.withColumn("turn", F.lit(0))
    else:
        tips = guide.where("is_leaf").select("tree_id", F.col("name").alias("path"), F.col("pre").alias("turn"))
        paths = paths.join(tips, ["tree_id", "path"], "left").withColumn("turn", F.coalesce("turn", F.lit(2**31 - 1)))

    def run(frame):
        import pandas as pd

        order: list = []
        taken: dict[str, list[int]] = {}
        groups = {name: part.sort_values("step") for (_, name), part in frame.groupby(["turn", "path"], sort=True)}
        for name, part in groups.items():
            sample = part["block"].tolist()
            order_blocks_ = [b for b, _ in order]
            anchors = chain(order_blocks_, sample)
            tagged = [(b, ("new", name, k)) for k, b in enumerate(sample)]
            order = merge_chain(order, tagged, anchors)
            taken[name] = anchors
        place = {tag: i for i, (_, tag) in enumerate(order)}
        # an anchored step stands where the consensus entry of its turn went
        out = []
        history: list = []
        for name, part in groups.items():
            sample = part["block"].tolist()
            hits = {b: a for a, b in taken[name]}
            for k, (block, forward) in enumerate(zip(sample, part["forward"])):
                tag = history[hits[k]][1] if k in hits else ("new", name, k)
                out.append((part["tree_id"].iloc[0], name, place[tag], block, forward))
            tagged = [(b, ("new", name, k)) for k, b in enumerate(sample)]
            history = merge_chain(history, tagged, taken[name])
        return pd.DataFrame(out, columns=["tree_id", "path", "at", "block", "forward"])

    return paths.groupBy("tree_id").applyInPandas(run, "tree_id int, path string, at int, block string, forward boolean")


def rotate_paths(paths: DataFrame) -> DataFrame:
    """Circular paths (tree_id, path, step, block, forward) turned to where they fit the first path by name best.
    Each path meets that first one alone, as a row of blocks."""
    steps = F.array_sort(F.collect_list(F.struct("step", "block", "forward")))
    per = written(paths.groupBy("tree_id", "path").agg(steps.alias("x")))
    first = per.groupBy("tree_id").agg(F.min_by("x", "path").alias("f"))
    blocks = lambda c: F.transform(c, lambda e: e["block"])

    def run(frames):
        for f in frames:
            f["start"] = [rotation_start(list(a), list(b)) for a, b in zip(f["first"], f["own"])]
            yield f[["tree_id", "path", "start"]]

    lists = per.join(first, "tree_id").select("tree_id", "path", blocks("f").alias("first"), blocks("x").alias("own"))
    starts = lists.mapInPandas(run, "tree_id int, path string, start int")
    turned = per.join(starts, ["tree_id", "path"]).select("tree_id", "path", F.posexplode(sequence.rotated(F.col("x"), F.col("start"))).alias("at", "s"))
    return turned.select("tree_id", "path", F.col("at").cast(paths.schema["step"].dataType).alias("step"), "s.block", "s.forward")
