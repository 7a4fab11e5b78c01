"""Readers, writers and column functions that few commands use."""

import datetime

from pyspark.sql import functions as F

from cladeframe.functions import codes
from cladeframe.operators import tree
from cladeframe.sources import newick, sinks, text


def nodes_of(spark, newick_text):
    return newick.read_newick(spark.createDataFrame([(0, newick_text)], "tree_id int, newick string"))


def test_column_window(spark):
    msa = spark.createDataFrame([("A", "ACGT-A"), ("B", "TTTTTT")], "name string, seq string")
    assert {r.name: r.seq for r in text.column_window(msa, 2, 3).collect()} == {"A": "GT-", "B": "TTT"}


def test_breakpoints(spark, tmp_path):
    rows = [("A", "B", "C", 1, 2, 3, 4), ("C", "D", "E", 5, 6, 7, 8), ("F", "G", "H", 9, 10, 11, 12)]
    (tmp_path / "b.tsv").write_text("P_ACCNUM\tQ\tC\n" + "".join("\t".join(map(str, r)) + "\n" for r in rows))
    got = sorted(tuple(r) for r in text.read_breakpoints(spark, str(tmp_path / "b.tsv"), 4).collect())
    assert got == [("R", 4, "A", 4, "B", 1, 2, 3, 4, 4, "C"), ("R", 4, "F", 4, "G", 9, 10, 11, 12, 4, "H")]


def test_rename_leaves(spark):
    nodes = nodes_of(spark, "((A,B),C);")
    names = spark.createDataFrame([("A", "x"), ("node_2", "never"), ("Q", "q")], "old string, new string")
    assert sorted(r.name for r in newick.rename_leaves(nodes, names).collect()) == ["B", "C", "node_1", "node_2", "x"]


def test_level_order(spark):
    assert [r.name for r in tree.level_order(nodes_of(spark, "((A,B),C);")).collect()] == ["node_1", "node_2", "C", "A", "B"]


def test_write_by_name(spark, tmp_path):
    rows = spark.createDataFrame([("A", "ACGT" * 20), ("B", "T")], "name string, seq string")
    sinks.write_by_name(rows, str(tmp_path / "out"))
    got = {p.parent.name: p.read_text() for p in (tmp_path / "out").glob("*/part-*")}
    assert got == {"name=A": ">A\n" + ("ACGT" * 20)[:70] + "\n" + ("ACGT" * 20)[70:] + "\n", "name=B": ">B\nT\n"}


def test_scalars(spark):
    row = spark.range(1).select(
        codes.file_date(F.lit(datetime.date(2024, 3, 5))).alias("day"),
        codes.state_of(F.lit(3)).alias("state"),
        codes.state_code(F.lit(8)).alias("code"),
        codes.state_code(F.lit(0)).alias("none"),
        *[c.alias(f"b{i}") for i, c in enumerate(codes.unpack_block_id(codes.pack_block_id(F.lit(7), F.lit(9))))],
    )
    assert tuple(row.first()) == ("202435", 8, 3, None, 7, 9)


def test_complex_mutations_file(spark, tmp_path):
    (tmp_path / "e.tsv").write_text("R\t0\tA\t1\tB\t1\t2\t3\t4\t0\tC\tignored\n\n")
    got = [tuple(r) for r in text.read_events(spark, str(tmp_path / "e.tsv")).collect()]
    assert got == [("R", 0, "A", 1, "B", 1, 2, 3, 4, 0, "C")]


def test_reference_file(spark, tmp_path):
    (tmp_path / "r.txt").write_text(" AC-GT \nsecond\n")
    assert text.read_reference(spark, str(tmp_path / "r.txt")) == "AC-GT"
