"""Texts spelled on walks: nothing of a text is shuffled, and trees with cut subtrees keep their paths."""

from cladeframe.operators import sequence, spelling
from cladeframe.plans import blocks
from cladeframe.schemas import TABLES


def small(spark):
    """world (0) over a (1), b (2) and c (3); one block ACGT with a gap column ahead of place 1."""
    rows = [(0, 0, "world", None, 0, 0, 3, 0, 0.0, False, []), (0, 1, "a", 0, 0, 1, 1, 1, 1.0, True, []), (0, 2, "b", 0, 1, 2, 2, 1, 1.0, True, []), (0, 3, "c", 0, 2, 3, 3, 1, 1.0, True, [])]
    made = {
        "node": rows, "block": [(0, 0, "ACGT")], "gap": [(0, 0, 1, 1)], "block_mut": [(0, 0, 0, 0, "ins"), (0, 2, 0, 0, "inv")],
        "nuc_mut": [(0, 0, 0, 0, 3, -1, "S", 1, "A"), (0, 1, 0, 0, 1, 0, "I", 1, "G"), (0, 1, 1, 0, 0, -1, "D", 1, "-")], "seq_meta": [(0, 1, 1, 0, False)], "complex_mut": [],
    }
    return {name: spark.createDataFrame(made[name], ddl) for name, ddl in TABLES.items()}


def test_texts(spark):
    found = {r.name: (r.aligned, r.seq) for r in spelling.spelled(small(spark)).collect()}
    assert found == {"world": ("A-CGA", "ACGA"), "a": ("-GCGA", "CGAG"), "b": ("TCG-T", "TCGT"), "c": ("A-CGA", "ACGA")}


def test_paths_of_a_cut_tree(spark):
    """The root ends at a place that is not there any more."""
    net = small(spark)
    net["node"] = net["node"].where("name <> 'c'")
    assert [r.node_id for r in spelling.on_paths(net["node"], net["node"].where("name = 'a'")).orderBy("node_id").collect()] == [0, 1]


def test_no_text_is_shuffled(spark):
    """The step that spells is the last one: what is above it in the plan neither deals nor sorts texts."""
    net = small(spark)
    plan = sequence.sequences(net)._jdf.queryExecution().sparkPlan().toString()
    above = plan[: plan.index("MapInArrow")]
    assert not any(step in above for step in ("Exchange", "Join", "Aggregate", "Sort"))


def test_points(spark):
    net = small(spark)
    points = spark.createDataFrame([(0, 1, 1), (0, 1, 4), (0, 1, 5), (0, 2, 4)], "tree_id int, node_id int, nth int")
    assert sorted(tuple(r)[1:] for r in spelling.base_places(net, points).collect()) == [(1, 1, 0, 1, 1), (1, 4, 0, 4, 4), (2, 4, 0, 4, 4)]
    points = spark.createDataFrame([(0, 2, 0, 3), (0, 2, 0, 4), (0, 2, 0, 5)], "tree_id int, node_id int, block_id int, at int")
    assert sorted(tuple(r)[3:] for r in spelling.bases_up_to(net, points).collect()) == [(3, "-", 3), (4, "T", 4)]


def test_consensus_by_pieces(spark, monkeypatch):
    monkeypatch.setattr(blocks, "PIECE", 2)
    parts = spark.createDataFrame([(b, k, "ACGT"[(k + b) % 4]) for b in (0, 1) for k in range(5)], "block_id int, p_partkey long, base string")
    found = blocks.consensus_of(blocks.placed(parts))
    assert sorted(tuple(r) for r in found.collect()) == [(0, "ACGTA"), (1, "CGTAC")]


def test_compared_in_the_walk(spark):
    """Tips meet their tree's reference text where they are spelled, not by the tree's number in one task."""
    from cladeframe.operators import variants

    net = small(spark)
    tips = net["node"].where("is_leaf").select("tree_id", "node_id")
    reference = spark.createDataFrame([(0, "A-CGA")], "tree_id int, seq string")
    found = spelling.compared(net, tips, reference, variants.differing)
    aligned = {"a": "-GCGA", "b": "TCG-T", "c": "A-CGA"}
    assert sorted(tuple(r)[1:] for r in found.collect()) == sorted((t, *x) for t, s in aligned.items() for x in variants.differences("A-CGA", s))
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan[: plan.index("MapInArrow")]


def test_pieces_for_inference(spark):
    """Rerooting spells tips where it cuts them: turned blocks come forward, under the new number."""
    net = small(spark)
    wanted = spark.createDataFrame([(0, 1, 7, 0), (0, 2, 8, 1)], "tree_id int, node_id int, to int, part int")
    found = spelling.pieces(net, wanted, 2)
    assert sorted((r.node_id, r.part, r.chunk, bytes(r.piece)) for r in found.collect()) == [
        (7, 0, 0, b"-G"), (7, 0, 1, b"CG"), (7, 0, 2, b"A"), (8, 1, 0, b"A-"), (8, 1, 1, b"CG"), (8, 1, 2, b"A"),
    ]
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan[: plan.index("MapInArrow")]


def test_baseline_spares_the_texts(spark, monkeypatch):
    """Where a baseline is the consensus, no other text is looked at for one."""
    from cladeframe.operators import parsimony

    inner = parsimony._candidates

    def watched(columns):
        run = inner(columns)

        def only_roles(batches):
            for batch in batches:
                assert batch.column("role").null_count == 0
                yield from run(iter([batch]))

        return only_roles

    monkeypatch.setattr(parsimony, "_candidates", watched)
    net = small(spark)
    texts = spark.createDataFrame([(0, n, 0, s) for n, s in (("a", "AC"), ("b", "AC"), ("c", "AT"))], "tree_id int, name string, block_id int, seq string")
    base = spark.createDataFrame([(0, 0, "AG")], "tree_id int, block_id int, seq string")
    assert sorted(tuple(r)[2:] for r in parsimony.infer_by_block(net["node"], texts, base).collect()) == [(0, 1, "S", "C"), (3, 1, "S", "T")]


def test_records_are_made_by_column(spark, monkeypatch):
    """Records of spelled tips go out as arrays, and no base is walked for tips that are spelled."""
    from cladeframe.operators import replay, variants

    monkeypatch.delattr(variants, "_compare")
    net = small(spark)
    net["seq_meta"] = spark.createDataFrame([(0, 1, 0, 0, True)], TABLES["seq_meta"])
    walked = []
    inner = replay.apart

    def watched(net, *rest):
        walked.append(net["nuc_mut"].count())
        return inner(net, *rest)

    monkeypatch.setattr(replay, "apart", watched)
    monkeypatch.delattr(variants, "differing")  # that made a tuple of every record
    found = variants.tip_records(net, net["node"].where("name = 'a'").select("tree_id", "node_id"))
    aligned = {"a": "-GCGA", "b": "TCG-T", "c": "A-CGA"}
    assert sorted(tuple(r)[1:] for r in found.collect()) == sorted((t, *x) for t, s in aligned.items() for x in _plain("-GCGA", s))
    assert walked == [0]


def _plain(ref, alt):
    """variants.differences() stretch by stretch."""
    columns = [(r, a) for r, a in zip(ref, alt) if (r, a) != ("-", "-")]
    out, k, n, spent = [], 0, 0, None
    while k < len(columns):
        if columns[k][0] == columns[k][1]:
            n, k = n + 1, k + 1
            continue
        first = k
        while k < len(columns) and columns[k][0] != columns[k][1]:
            k += 1
        own, other = ("".join(c[i] for c in columns[first:k]).replace("-", "") for i in (0, 1))
        if "-" in columns[first] and first and first - 1 != spent:
            out.append((n, columns[first - 1][0] + own, columns[first - 1][0] + other))
        elif not own and k < len(columns):
            spent = k
            out.append((n + 1, columns[k][0], other + columns[k][0]))
        else:
            out.append((n + 1, own, other))
        n += len(own)
    return out


def test_records_of_any_texts():
    import random

    from cladeframe.operators import variants

    draw = random.Random(3)
    for _ in range(4000):
        letters, n = draw.choice(["-A", "-AC", "-ACG"]), draw.randint(0, 12)
        ref, alt = ("".join(draw.choice(letters) for _ in range(n)) for _ in range(2))
        assert variants.differences(ref, alt) == _plain(ref, alt), (ref, alt)


def test_bases_are_counted_without_texts(spark, monkeypatch):
    """A node with points costs these and its own mutations, not the length of its text."""
    monkeypatch.delattr(spelling.Columns, "in_order")
    net = small(spark)
    points = spark.createDataFrame([(0, n, 0, at) for n in range(4) for at in range(-1, 6)], "tree_id int, node_id int, block_id int, at int")
    shown = {0: "A-CGA", 1: "-GCGA", 2: "TCG-T", 3: "A-CGA"}
    expected = [(n, at, s[at], sum(c != "-" for c in s[: at + 1])) for n, s in shown.items() for at in range(5)]
    assert sorted((r.node_id, r.at, r.base, r.n_bases) for r in spelling.bases_up_to(net, points).collect()) == expected


def test_counts_follow_what_is_written(monkeypatch):
    """Counts of bases stay those of the text when mutations are written, written twice, and taken back."""
    import numpy as np

    monkeypatch.setattr(spelling, "COUNTED", 2)
    draw = np.random.default_rng(5)
    columns = spelling.Columns({0: "ACGTACGTAC", 3: "GGT"}, [(0, 4, 2), (0, 10, 1), (3, 0, 2)])
    for pre, post in [(0, 9), (1, 4), (2, 2), (3, 4), (5, 9), (6, 6), (7, 9), (8, 8), (9, 9)]:
        columns.enter(pre, post)
        n = int(draw.integers(0, 12))
        columns.write(draw.choice([0, 3, 5], n), draw.integers(0, 3, n), np.full(n, -1), draw.choice(np.frombuffer(b"-ACG", np.uint8), n))
        before = columns.bases_before()
        assert [before(c) for c in range(len(columns.text) + 1)] == [int((columns.text[:c] != spelling.GAP).sum()) for c in range(len(columns.text) + 1)]


def test_writers_do_not_hold_a_hundred_texts(spark, tmp_path):
    """In a session that spells, a row group ends by its bytes, also where a hundred rows are more than a task has memory for."""
    import pyarrow.parquet as pq
    from pyspark.sql import functions as F

    keys = [*spelling._WRITER, "parquet.block.size"]
    for key in keys:
        spark.conf.unset(key)
    spelling.spelled(small(spark))
    spark.conf.set("parquet.block.size", str(4 << 20))
    text = F.expr("array_join(transform(sequence(1, 20000), i -> sha2(cast(i * 100 + id as string), 256)), '')")
    spark.range(0, 20, 1, 1).select(text.alias("text")).write.parquet(f"{tmp_path}/out")
    for key in keys:
        spark.conf.unset(key)
    groups = [f.row_group(k).num_rows for p in (tmp_path / "out").glob("*.parquet") for f in [pq.ParquetFile(p).metadata] for k in range(f.num_row_groups)]
    assert sum(groups) == 20 and max(groups) < 5
