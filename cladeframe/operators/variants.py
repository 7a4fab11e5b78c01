"""Comparison of sequences: variants, mutation lists, group frequencies, amino acids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeframe.functions.codes import RESIDUES, THREE, base_code, complement, expanded, mutation_text, only_bases
from cladeframe.operators import replay, sequence, spelling
from cladeframe.operators.order import running, subtree_sums
from cladeframe.operators.tree import closure, find, path_above
from cladeframe.scratch import written
from cladeframe.sources.sinks import vcf_lines

_CODONS = {a + b + c: THREE[RESIDUES[16 * i + 4 * j + k]] for i, a in enumerate("TCAG") for j, b in enumerate("TCAG") for k, c in enumerate("TCAG")}


def differences(ref: str, alt: str) -> list[tuple[int, str, str]]:
    """Records (position in ref without gaps from 1, ref, alt) of two aligned sequences.

    Columns where both have the same base part the stretches that differ. A stretch that opens with a
    gap on one side takes the equal base before it as its anchor; one without a base in ref and
    without an anchor takes the equal base behind it, which then anchors nothing else.
    """
    return differing(np.frombuffer(ref.encode(), np.uint8), np.frombuffer(alt.encode(), np.uint8))


def differing(a: np.ndarray, b: np.ndarray) -> list[tuple[int, str, str]]:
    """differences() of two texts as bytes."""
    pos, ref, alt = differing_columns(a, b)
    return list(zip(pos.tolist(), ref.to_pylist(), alt.to_pylist()))


def _cut(text: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.StringArray:
    """text[lo:hi] without gaps for every pair of bounds, which rise and do not overlap."""
    sizes = hi - lo
    ends = np.cumsum(sizes)
    codes = text[np.arange(ends[-1]) + np.repeat(lo - (ends - sizes), sizes)]
    kept = codes != ord("-")
    offsets = np.append(0, np.cumsum(kept)[ends - 1]).astype(np.int32)
    return pa.StringArray.from_buffers(len(lo), pa.py_buffer(offsets), pa.py_buffer(codes[kept]))


def differing_columns(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, pa.StringArray, pa.StringArray]:
    """differences() of two texts as bytes, as columns pos, ref and alt. A record's texts are what lies between two bounds,
    which take in the base that anchors it, so that no record is made by itself."""
    if len(a) != len(b):
        raise ValueError("sequences of different lengths")
    gap = ord("-")
    real = (a != gap) | (b != gap)
    a, b = a[real], b[real]
    differs = np.flatnonzero(a != b)
    if not len(differs):
        none = pa.array([], pa.string())
        return np.zeros(0, np.int32), none, none
    apart = np.diff(differs) > 1
    lo, hi = differs[np.append(True, apart)], differs[np.append(apart, True)] + 1
    bare = a[lo] == gap
    before = (bare | (b[lo] == gap)) & (lo > 0)
    behind = np.zeros(len(lo), dtype=bool)
    # an equal base behind anchors only where nothing stands before: in the first stretch, and in those that follow it at once
    for k in range(len(lo)):
        if before[k] and not (k and behind[k - 1] and lo[k] - 1 == hi[k - 1]):
            break
        before[k] = False
        behind[k] = hi[k] < len(a) and not (a[lo[k] : hi[k]] != gap).any()
        if not behind[k]:
            break
    place = np.cumsum(a != gap, dtype=np.int32)
    pos = np.where(before, place[lo - 1], np.where(behind, place[np.minimum(hi, len(a) - 1)], place[lo] + bare)).astype(np.int32)
    lo, hi = lo - before, hi + behind
    return pos, _cut(a, lo, hi), _cut(b, lo, hi)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("tree_id", pa.int32()), ("tip", pa.string()), ("pos", pa.int32()), ("ref", pa.string()), ("alt", pa.string())])
    for batch in batches:
        rows = [
            (tree, tip, *record)
            for tree, tip, ref, alt in zip(*(batch.column(c).to_pylist() for c in ("tree_id", "tip", "ref_seq", "alt_seq")))
            for record in differences(ref, alt)
        ]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def variant_records(aligned: DataFrame, reference: DataFrame) -> DataFrame:
    """tree_id, tip, pos, ref, alt of aligned sequences (tree_id, name, seq) against one a tree (tree_id, seq)."""
    ref = reference.select("tree_id", F.col("seq").alias("ref_seq"))
    rows = aligned.join(ref, "tree_id").select("tree_id", F.col("name").alias("tip"), "ref_seq", F.col("seq").alias("alt_seq"))
    return rows.mapInArrow(_compare, "tree_id int, tip string, pos int, ref string, alt string")


def records_of(rows: list[tuple[int, str, str, str | None, str | None]]) -> list[tuple[int, str, str]]:
    """What differences() gives, from the differing columns alone, in order: the reference's bases up to and with the
    column, its base there, the other's, and the reference's nearest base before and behind."""
    out, spent, k = [], None, 0
    while k < len(rows):
        first = k
        k += 1
        while k < len(rows) and rows[k][0] - (rows[k][1] != "-") == rows[k - 1][0]:
            k += 1
        own = "".join(r[1] for r in rows[first:k] if r[1] != "-")
        other = "".join(r[2] for r in rows[first:k] if r[2] != "-")
        n, ref, alt, before, _ = rows[first]
        at, behind = n - (ref != "-"), rows[k - 1][4]
        if "-" in (ref, alt) and at > 0 and at != spent:
            out.append((at, before + own, before + other))
        elif not own and behind is not None:
            spent = rows[k - 1][0] + 1
            out.append((spent, behind, other + behind))
        else:
            out.append((at + 1, own, other))
    return out


_RECORD = pa.schema([("tree_id", pa.int32()), ("tip", pa.string()), ("pos", pa.int32()), ("ref", pa.string()), ("alt", pa.string())])


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of rows (tree_id, node_id, name, n_bases, ref, alt, before, behind) sorted by node and column."""
    now, held, out = None, [], []

    def settle() -> None:
        if now is not None:
            out.extend((now[0], now[2], *record) for record in records_of(held))
        held.clear()

    def give() -> pa.RecordBatch:
        columns = [pa.array(c, f.type) for c, f in zip(zip(*out), _RECORD)]
        out.clear()
        return pa.RecordBatch.from_arrays(columns, schema=_RECORD)

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if now is None or row[:2] != now[:2]:
                settle()
                now = row[:3]
            held.append(row[3:])
        if out:
            yield give()
    settle()
    if out:
        yield give()


def node_columns(net: dict[str, DataFrame], wanted: DataFrame, path: DataFrame | None = None) -> DataFrame:
    """Every column of wanted nodes (tree_id, node_id), one a tree, in blocks' order: tree_id, block_id, pos, gap_pos,
    start (the consensus there, - in gap columns), forward and there (of the block), base as it is shown, column and
    n_bases (see coordinates())."""
    path = written(path_above(net["node"], wanted)) if path is None else path
    states = sequence.block_states(net["node"], net["block_mut"], path).select("tree_id", "block_id", "forward")
    placed = sequence.coordinates(net, wanted, path).join(states, ["tree_id", "block_id"], "left").join(sequence.widths(net), ["tree_id", "block_id"])
    at = F.when(F.coalesce("forward", F.lit(True)), F.col("at")).otherwise(F.col("width") - 1 - F.col("at"))
    return placed.withColumn("at", at.cast("int")).join(_own_positions(net), ["tree_id", "block_id", "at"]).select(
        "tree_id", "block_id", "pos", "gap_pos", "start", F.coalesce("forward", F.lit(True)).alias("forward"), F.col("forward").isNotNull().alias("there"), "base", "column", "n_bases"
    )


def tip_records(net: dict[str, DataFrame], ref_id: DataFrame) -> DataFrame:
    """tree_id, tip, pos, ref, alt of every tip of the reference's tree (ref_id: tree_id, node_id) against it.

    A record comes from mutations: columns where the tip's path and the reference's differ. Only tips that
    have other blocks than the reference, a block on the other strand, or a turned order of blocks are spelled and compared as texts."""
    tips = net["node"].where("is_leaf").join(ref_id.select("tree_id"), "tree_id", "left_semi").select("tree_id", "node_id")
    path = written(path_above(net["node"], ref_id))
    states = sequence.block_states(net["node"], net["block_mut"], path)
    last = sequence.last_writes(path, net["nuc_mut"])
    # blocks alone tell which tips are spelled; the bases of their paths are not looked at
    of_blocks = written(replay.apart({**net, "nuc_mut": net["nuc_mut"].limit(0)}, tips, states, last.limit(0)))
    turned = net["seq_meta"].where("rot_block <> 0 or inverted").select("tree_id", "node_id")
    whole = tips.join(turned.join(ref_id, ["tree_id", "node_id"]).select("tree_id"), "tree_id", "left_semi")
    spelled = written(of_blocks.where("not plain").select("tree_id", "node_id").unionByName(tips.join(turned, ["tree_id", "node_id"])).unionByName(whole).distinct())
    alike = written(tips.join(spelled, ["tree_id", "node_id"], "left_anti"))
    compared = lambda: spelling.compared(net, spelled, written(sequence.sequences(net, ref_id, aligned=True)), differing_columns, by_column=True)
    if alike.isEmpty():
        return compared()
    found = written(replay.apart({**net, "node": spelling.on_paths(net["node"], alike)}, alike, states, last))

    columns = written(node_columns(net, ref_id, path))
    bases = columns.where("base <> '-'")
    near = lambda name: bases.select("tree_id", F.col("n_bases").alias("k"), F.col("base").alias(name))
    columns = columns.where("there").withColumn("k", F.col("n_bases") - (F.col("base") != "-").cast("int")).join(near("before"), ["tree_id", "k"], "left")
    columns = columns.withColumn("k", F.col("n_bases") + 1).join(near("behind"), ["tree_id", "k"], "left").drop("k")
    own = F.coalesce(F.col("x.base"), F.col("start"))
    shown = F.when(F.col("forward") | (own == "-"), own).otherwise(complement(own))
    place = ["tree_id", "block_id", "pos", "gap_pos"]
    rows = found.where("block_id is not null").select(*place, "node_id", F.struct("base").alias("x")).join(columns, place).withColumn("alt", shown).where(F.col("alt") != F.col("base"))
    rows = rows.join(net["node"].select("tree_id", "node_id", "name"), ["tree_id", "node_id"])
    rows = rows.repartition("tree_id", "node_id").sortWithinPartitions("tree_id", "node_id", "column")
    listed = rows.select("tree_id", "node_id", "name", "n_bases", F.col("base").alias("ref"), "alt", "before", "behind")
    records = listed.mapInArrow(_records, "tree_id int, tip string, pos int, ref string, alt string")
    return records if spelled.isEmpty() else records.unionByName(compared())


def genotypes(records: DataFrame, names: DataFrame) -> DataFrame:
    """pos, ref, alts in order of text, and calls: an array of struct(tip, alt), the number of a tip in names (one row, an
    array) and that of its alt, from 1, in order of tips."""
    numbers = names.select(F.posexplode("names").alias("i", "tip"))
    # merged, because the planner takes records for few and would send them to the driver
    grouped = records.hint("merge").join(numbers, "tip").groupBy("tree_id", "pos", "ref").agg(
        F.array_sort(F.collect_set("alt")).alias("alts"), F.array_sort(F.collect_set(F.struct("i", "alt"))).alias("x")
    )
    calls = F.transform("x", lambda x: F.struct(x["i"].alias("tip"), F.array_position("alts", x["alt"]).alias("alt")))
    return grouped.select("tree_id", "pos", "ref", "alts", calls.alias("calls"))


def vcf(net: dict[str, DataFrame], reference: str) -> DataFrame:
    """at and line of a VCF of every tip of a tree against its node `reference`; ValueError if there is none."""
    ref_id = find(net["node"], reference).select("tree_id", "node_id")
    if ref_id.isEmpty():
        raise ValueError(f"no node {reference!r}")
    names = net["node"].where("is_leaf").join(ref_id.select("tree_id"), "tree_id", "left_semi").agg(F.array_sort(F.collect_list("name")).alias("names"))
    return vcf_lines(genotypes(tip_records(net, ref_id), names), names, reference)


def _own_positions(net: dict[str, DataFrame]) -> DataFrame:
    """For every block, pos and gap_pos of each column in order, and the consensus there: tree_id, block_id, at, pos, gap_pos, start."""
    each = net["block"].select("tree_id", "block_id", F.length("consensus").alias("n"), F.posexplode(F.split(F.concat("consensus", F.lit("-")), "")).alias("pos", "main"))
    full = each.where("main <> ''").join(net["gap"], ["tree_id", "block_id", "pos"], "left").withColumn("len", F.coalesce("len", F.lit(0)))
    inner = F.concat(
        F.when(F.col("len") > 0, F.sequence(F.lit(0), F.col("len") - 1)).otherwise(F.array().cast("array<int>")),
        F.when(F.col("pos") < F.col("n"), F.array(F.lit(-1))).otherwise(F.array().cast("array<int>")),
    )
    width = F.col("len") + (F.col("pos") < F.col("n")).cast("int")
    block = full.withColumn("__block", F.struct("tree_id", "block_id"))
    started = running(block.withColumn("width", width), {"upto": F.col("width").cast("bigint")}, at="pos", key="__block")
    return started.select("tree_id", "block_id", "pos", "main", (F.col("upto") - F.col("width")).alias("before"), F.posexplode(inner).alias("k", "gap_pos")).select(
        "tree_id", "block_id", (F.col("before") + F.col("k")).cast("int").alias("at"), "pos", "gap_pos", F.when(F.col("gap_pos") == -1, F.col("main")).otherwise("-").alias("start")
    )


def branch_changes(net: dict[str, DataFrame]) -> DataFrame:
    """Every base mutation with the parent's base and its place on the root: tree_id, node_id, block_id,
    pos, gap_pos, type, old, new, root_base, column, n_bases. Mutations of blocks that are absent at
    their node are left out. A node has one mutation a place; what stood there is what its nearest ancestor with one wrote."""
    roots = net["node"].where("parent_id is null").select("tree_id", "node_id")
    place = ["tree_id", "block_id", "pos", "gap_pos"]
    columns = node_columns(net, roots).select(*place, "start", F.col("base").alias("root_base"), "column", "n_bases")
    rows = replay.old_bases(net).join(columns, place)
    return rows.select("tree_id", "node_id", "block_id", "pos", "gap_pos", "ord", "type", F.coalesce("old", "start").alias("old"), "new", "root_base", "column", "n_bases")


def mutation_list(net: dict[str, DataFrame]) -> DataFrame:
    """name, type and mutations of every node that has some: old base, position on the root from 1, new
    base, with g in front where the root has a gap; in order of position. Substitutions over gaps are left out."""
    rows = branch_changes(net).where((F.col("type") != "S") | (F.col("old") != "-"))
    rows = rows.join(net["node"].where("parent_id is not null").select("tree_id", "node_id", "name"), ["tree_id", "node_id"])
    text = mutation_text(F.col("old"), F.col("n_bases"), F.col("new"), F.col("root_base") == "-")
    parts = F.array_sort(F.collect_list(F.struct("column", text.alias("t"))))
    return rows.groupBy("tree_id", "node_id", "name", "type").agg(F.array_join(F.transform(parts, lambda x: x["t"]), ",").alias("mutations"))


def mutations_against(net: dict[str, DataFrame], reference: str) -> DataFrame:
    """name and mutations (type, old base, position, new base, each with a comma behind) of every node in
    coordinates of an aligned reference string as wide as the alignment; changes to N are left out."""
    ref = net["node"].sparkSession.range(1).select(F.posexplode(F.split(F.lit(reference), "")).alias("column", "c")).where("c <> ''")
    n = F.sum((F.col("c") != "-").cast("int")).over(Window.orderBy("column"))
    ref = ref.select("column", n.alias("at"))
    rows = branch_changes(net).where("new <> 'N'").join(ref, "column").join(net["node"].select("tree_id", "node_id", "name"), ["tree_id", "node_id"])
    text = F.concat("type", "old", F.col("at").cast("string"), "new", F.lit(","))
    parts = F.array_sort(F.collect_list(F.struct("column", text.alias("t"))))
    return rows.groupBy("tree_id", "name").agg(F.array_join(F.transform(parts, lambda x: x["t"]), "").alias("mutations"))


def path_deletions(net: dict[str, DataFrame], wanted: DataFrame) -> DataFrame:
    """tree_id, node_id, anc_id, dist, pos (on the root, from 1) and len of every run of bases that an ancestor of a
    wanted node (tree_id, node_id), or the node itself, has lost; runs join neighbours of one branch."""
    lost = branch_changes(net).where("type = 'D'")
    order = Window.partitionBy("tree_id", "node_id").orderBy("column")
    fresh = F.coalesce((F.col("column") != F.lag("column").over(order) + 1).cast("int"), F.lit(1))
    numbered = lost.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(order))
    ranges = numbered.groupBy("tree_id", F.col("node_id").alias("anc_id"), "run").agg(F.min("n_bases").alias("pos"), F.count("*").alias("len")).drop("run")
    return closure(net["node"], start=wanted).join(ranges, ["tree_id", "anc_id"]).select("tree_id", "node_id", "anc_id", "dist", "pos", "len")


def mutations_at(net: dict[str, DataFrame], name: str, block_id: int, pos: int) -> DataFrame:
    """Records of the named node's ancestors, and its own, that cover a position, from the root on."""
    path = path_above(net["node"], find(net["node"], name))
    hit = net["nuc_mut"].where((F.col("block_id") == block_id) & F.lit(pos).between(F.col("pos"), F.col("pos") + F.when(F.col("gap_pos") == -1, F.col("len") - 1).otherwise(0)))
    joined = path.select("tree_id", "anc_id", "dist").join(hit.withColumnRenamed("node_id", "anc_id"), ["tree_id", "anc_id"])
    return joined.orderBy(F.desc("dist"), "ord")


def placement_rows(net: dict[str, DataFrame]) -> DataFrame:
    """preorder, position (column from 1), ref_nuc (root), par_nuc and mut_nuc of every base-level
    mutation that leaves a base; mut_nuc lists 0..3 for A, C, G, T."""
    rows = branch_changes(net).join(net["node"].select("tree_id", "node_id", "pre"), ["tree_id", "node_id"]).where("new <> '-'")
    return rows.select(
        "tree_id", F.col("pre").alias("preorder_idx"), (F.col("column") + 1).alias("position"),
        base_code(F.col("root_base")).alias("ref_nuc"), base_code(F.col("old")).alias("par_nuc"), expanded(base_code(F.col("new"))).alias("mut_nuc"),
    )


def group_counts(nodes: DataFrame, first: str, second: str) -> DataFrame:
    """Tips whose first annotation is `first` or `second` at or below every node: tree_id, node_id, a, b."""
    group = F.get("annotations", F.lit(0))
    own = lambda name: F.coalesce((F.col("is_leaf") & (group == name)).cast("bigint"), F.lit(0))
    return subtree_sums(nodes, {"a": own(first), "b": own(second)})


def ratio(part_a: Column, part_b: Column) -> Column:
    return part_a / (part_b + F.lit(1e-4))


def ratio_test(net: dict[str, DataFrame], first: str, second: str) -> DataFrame:
    """pos (on the root), type, len, frac_a, frac_b and ratio of every run of mutations: the shares of both
    groups' tips that stand below it. Runs join neighbours of one node and type; by position."""
    counts = group_counts(net["node"], first, second)
    totals = counts.join(net["node"].where("parent_id is null").select("tree_id", "node_id"), ["tree_id", "node_id"]).select("tree_id", F.col("a").alias("all_a"), F.col("b").alias("all_b"))
    order = Window.partitionBy("tree_id", "node_id", "type").orderBy("column")
    rows = branch_changes(net).withColumn("new_run", F.coalesce((F.col("column") != F.lag("column").over(order) + 1).cast("int"), F.lit(1)))
    rows = rows.withColumn("run", F.sum("new_run").over(order))
    runs = rows.groupBy("tree_id", "node_id", "type", "run").agg(F.min("n_bases").alias("pos"), F.count("*").alias("len"))
    shared = runs.join(counts, ["tree_id", "node_id"]).join(totals, "tree_id")
    share = lambda x, y: F.when(F.col(y) > 0, F.col(x) / F.col(y)).otherwise(F.lit(0.0))
    full = shared.select("tree_id", "node_id", "pos", "type", "len", share("a", "all_a").alias("frac_a"), share("b", "all_b").alias("frac_b"))
    return full.withColumn("ratio", ratio(F.col("frac_a"), F.col("frac_b"))).orderBy("tree_id", "pos", "type", "node_id")


def codons(seq: str) -> list[tuple[int, int, str]]:
    """First and last column and residue of every three bases; a rest of one or two is dropped."""
    at = [i for i, c in enumerate(seq) if c in "ACGT"]
    return [(at[k], at[k + 2], _CODONS["".join(seq[i] for i in at[k : k + 3])]) for k in range(0, len(at) - 2, 3)]


def residue_changes(ref: str, alt: str) -> str:
    """S:i:residue; I:i:residue; D:i; of alt against ref, aligned. A codon of alt belongs to the codon of
    ref in whose columns it starts, the first such one; the others of alt are insertions before the next
    codon of ref, and codons of ref without one are deleted."""
    own, other = codons(ref), codons(alt)
    home = np.searchsorted(np.array([c[1] for c in own], dtype=np.int64), np.array([c[0] for c in other], dtype=np.int64))
    matched: dict[int, str] = {}
    inserted = []
    for (start, _, residue), i in zip(other, home.tolist()):
        if i < len(own) and start >= own[i][0]:
            if i not in matched:
                matched[i] = residue
                continue
            i += 1
        inserted.append((i, residue))
    changed = [f"S:{i}:{r};" for i, r in matched.items() if own[i][2] != r]
    gone = [f"D:{i};" for i in range(len(own)) if i not in matched]
    return "".join([*changed, *(f"I:{i}:{r};" for i, r in inserted), *gone])


def amino_acid_changes(net: dict[str, DataFrame], start: int, end: int) -> DataFrame:
    """name and aa_mutations of every node whose residues in the root's bases [start, end) (from 0) differ."""
    roots = net["node"].where("parent_id is null").select("tree_id", "node_id")
    bounds = sequence.base_bounds(net, roots, start + 1, end)
    cut = only_bases(F.substring("seq", F.col("lo") + 1, F.col("hi") - F.col("lo") + 1))
    everyone = sequence.sequences(net, None, aligned=True).join(bounds, "tree_id").select("tree_id", "node_id", "name", cut.alias("alt"))
    ref = everyone.join(roots, ["tree_id", "node_id"], "left_semi").select("tree_id", F.col("alt").alias("ref"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [residue_changes(r, a) for r, a in zip(batch.column("ref").to_pylist(), batch.column("alt").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("tree_id"), batch.column("name"), pa.array(found, pa.string())], names=["tree_id", "name", "aa_mutations"])

    rows = everyone.join(ref, "tree_id").select("tree_id", "name", "ref", "alt")
    return rows.mapInArrow(run, "tree_id int, name string, aa_mutations string").where("aa_mutations <> ''")
