"""Plans and results of steps whose memory, traffic or time grew faster than their input."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from cladeframe.functions import codes
from cladeframe.operators import mutations, replay, variants
from cladeframe.plans import registry
from cladeframe.sources import sinks


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def events_of(spark):
    nodes = spark.createDataFrame([(0, 0, "r", None, 0, 2), (0, 1, "a", 0, 1, 2), (0, 2, "b", 1, 2, 2)], "tree_id int, node_id int, name string, parent_id int, pre int, post int")
    bases = spark.createDataFrame([(0, 0, 0, 3, -1, "S", "A"), (0, 1, 0, 3, -1, "S", "C"), (0, 1, 0, 4, -1, "S", "G"), (0, 2, 0, 3, -1, "S", "T"), (0, 2, 1, 0, -1, "S", "T")], "tree_id int, node_id int, block_id int, pos int, gap_pos int, type string, base string")
    block = spark.createDataFrame([(0, 0, 0, 0, "ins")], "tree_id int, node_id int, ord int, block_id int, kind string")
    return {"node": nodes, "nuc_mut": mutations.pack(bases), "block_mut": block}


def test_pack_meets_a_node_once(spark):
    rows = [(0, n, 0, p, -1, "S", "ACGT"[p % 4]) for n in range(3) for p in range(20) if p != 9] + [(0, 0, 0, 5, g, "I", "G") for g in range(8)]
    packed = mutations.pack(spark.createDataFrame(rows, "tree_id int, node_id int, block_id int, pos int, gap_pos int, type string, base string"))
    plan = plan_of(packed)
    assert plan.count("Exchange ") == 1 and plan.count("Sort [") == 2 and "Aggregate" not in plan
    got = [(r.ord, r.pos, r.gap_pos, r.len, r.chars) for r in packed.where("node_id = 0").orderBy("ord").collect()]
    assert got == [(0, 0, -1, 6, "ACGTAC"), (1, 5, 0, 6, "GGGGGG"), (2, 5, 6, 2, "GG"), (3, 6, -1, 3, "GTA"), (4, 10, -1, 6, "GTACGT"), (5, 16, -1, 4, "ACGT")]


def test_mutations_are_not_broadcast(spark):
    plan = plan_of(replay.events(events_of(spark)))
    assert "SortMergeJoin" in plan and not [line for line in plan.splitlines() if "BroadcastHashJoin" in line and "tree_id" in line and "node_id" in line]


def test_old_bases_come_with_nodes_and_not_row_by_row(spark, monkeypatch):
    monkeypatch.delattr(replay, "_rows")  # that made a dict of every base
    found = replay.old_bases(events_of(spark)).collect()
    assert Counter((r.node_id, r.pos, r.new, r.old) for r in found) == Counter([(0, 3, "A", None), (1, 3, "C", "A"), (1, 4, "G", None), (2, 3, "T", "C")])


def test_bases_written_twice_at_a_node():
    walk = replay.Walk()
    walk.enter(0, 1)
    assert walk.written_over([(0, 1, -1), (0, 1, -1)], ["A", "C"]) == [None, "A"]
    walk.enter(1, 1)
    assert walk.written_over([(0, 1, -1)], ["G"]) == ["C"]
    walk.enter(2, 2)
    assert walk.bases == {}


def test_names_of_a_vcf_stay_in_the_cluster(spark):
    names = spark.createDataFrame([(["a", "b", "c"],)], "names array<string>")
    calls = spark.createDataFrame([(5, "A", ["C"], [(1, 1)])], "pos int, ref string, alts array<string>, calls array<struct<tip:int, alt:int>>")
    lines = sinks.vcf_lines(calls, names, "a")
    assert lines.where("at = 5").first().line == ".\t5\t.\tA\tC\t.\t.\t.\t.\t0\t1\t0"
    assert "names" not in [c for line in plan_of(lines).splitlines() if "CartesianProduct" in line or "BroadcastNestedLoopJoin" in line for c in line.split()]
    joined = lines._jdf.queryExecution().optimizedPlan().toString()
    assert "size(names" in joined.split("Join", 1)[1]


def test_msa_consensus_is_hashed(spark):
    plan = plan_of(registry.QUERIES["msa_consensus"](spark, "/root/testdata/sf0.001"))
    assert "SortAggregate" not in plan and "HashAggregate" in plan


def test_consensus_words(spark):
    rows = spark.createDataFrame([(t,) for t in ("", "A", "ACMGRSVTWYHKDBN", "AC\nGx", "é😀C", None)], "s string")
    packed = rows.select("s", codes.pack_consensus(F.col("s")).alias("w"), codes.unpack_consensus(codes.pack_consensus(F.col("s"))).alias("t")).collect()
    assert {r.s: (r.w, r.t) for r in packed} == {
        "": ([], ""), "A": ([0x10000000], "A"), "ACMGRSVTWYHKDBN": ([0x12345678, 0x9ABCDEF0], "ACMGRSVTWYHKDBN"), "AC\nGx": ([0x12040000], "AC"), "é😀C": ([0x00200000], ""), None: (None, None),
    }


def test_records_are_not_broadcast(spark):
    names = spark.createDataFrame([(["a", "b"],)], "names array<string>")
    records = spark.createDataFrame([(0, "b", 5, "A", "C")], "tree_id int, tip string, pos int, ref string, alt string")
    calls = variants.genotypes(records, names)
    assert "BroadcastHashJoin" not in plan_of(calls) and "SortMergeJoin" in plan_of(calls)
    assert [(r.pos, r.alts, [tuple(c) for c in r.calls]) for r in calls.collect()] == [(5, ["C"], [(1, 1)])]


#: Queries that give texts of tips of the network of blocks, and those that give what stands at points of texts.
TEXTS = ["net_blocks_complex", "net_blocks_split", "net_blocks_segment", "net_blocks_range_query", "net_blocks_subnet"]
POINTS = ["net_blocks_base_places", "net_blocks_bases_up_to"]


@pytest.mark.parametrize("name", TEXTS + POINTS)
def test_nothing_of_a_text_is_shuffled_or_sorted(spark, name):
    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    above, _, walk = plan.partition("MapInArrow")
    assert walk and not any(step in above for step in ("Exchange", "Aggregate", "Sort [", "Window"))
    assert not any(text in above for text in ("aligned#", "seq#", " text#")) if name in POINTS else "SortMergeJoin" not in above


def test_tips_are_spelled_once_for_a_graph(spark, monkeypatch):
    """Segments and steps are read from what was written, and not spelled again for each of their readers."""
    from cladeframe.operators import graph
    from tests.test_spelling import small

    segments, steps = graph.base_steps(small(spark))
    assert all("MapInArrow" not in plan_of(df) for df in (segments, steps))
    assert sorted((r.path, r.step, r.seq) for r in steps.join(segments, ["tree_id", "segment"]).collect()) == [("a", 0, "GCGA"), ("b", 0, "TCGT"), ("c", 0, "ACGA")]


def test_changes_of_a_part_go_out_in_slices(monkeypatch):
    """What a kernel holds of its changes does not grow with the part."""
    import numpy as np

    from cladeframe.operators import parsimony

    monkeypatch.setattr(parsimony, "OUT_CELLS", 8)
    code, above = np.array([[1, 2, 0, 3]] * 5, dtype=np.int8), np.array([[1, 0, 2, 4]] * 5, dtype=np.int8)
    batches = list(parsimony._changes(0, 0, np.arange(10, 15), code, above, 100))
    assert [b.num_rows for b in batches] == [6, 6, 3]
    rows = [tuple(r.values())[2:] for b in batches for r in b.to_pylist()]
    assert rows == [(n, 100 + k, kind, base) for n in range(10, 15) for k, kind, base in ((1, "I", parsimony.BASES[2]), (2, "D", parsimony.BASES[0]), (3, "S", parsimony.BASES[3]))]


def test_pairs_of_a_group_are_dealt_in_slices(spark, monkeypatch, tmp_path):
    """Neither a small file nor a large group makes all pairs one task; repeated and missing keys are as in SQL."""
    from cladeframe.plans import columns

    monkeypatch.setattr(columns, "SLICE", 4)
    rows = [("a", 1, k) for k in range(30)] + [("a", 1, 7), ("a", 1, 7), ("b", 1, 3), ("b", 2, 4), ("b", 2, 9), (None, 1, 1), (None, 1, 2), ("a", None, 1), ("a", None, 2), ("a", 1, None)]
    spark.createDataFrame(rows, "p_brand string, p_size int, p_partkey long").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    found = columns.anchor_pairs(spark, str(tmp_path))
    want = [(a[0], a[2], b[2]) for a in rows for b in rows if None not in a + b and a[:2] == b[:2] and a[2] < b[2]]
    assert Counter(tuple(r) for r in found.collect()) == Counter(want)
    assert found.rdd.getNumPartitions() >= 8
