"""More of the network's methods, and the command line."""

import pytest
from pyspark.sql import functions as F

from cladeframe import __main__ as cli
from cladeframe.network import Network
from cladeframe.operators import mutations, sequence
from cladeframe.sources import text

MSA = {"A": "ACGT-A", "B": "ACGTTA", "C": "ATGT-A", "D": "ATG-NA"}


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    place = tmp_path_factory.mktemp("net")
    (place / "t.nwk").write_text("((A:1,B:1):1,(C:1,D:1):1);")
    (place / "m.fa").write_text("".join(f">{k}\n{v}\n" for k, v in MSA.items()))
    cli.main(["build", str(place / "net"), "--newick", str(place / "t.nwk"), "--msa", str(place / "m.fa")])
    return place


def read(spark, stored):
    return Network.read(spark, str(stored / "net"))


def test_cli(spark, stored, capsys):
    cli.main(["newick", str(stored / "net")])
    assert "node_2:1.000000" in capsys.readouterr().out
    cli.main(["msa", str(stored / "net"), "-o", str(stored / "msa")])
    assert sorted(r.value for r in spark.read.text(str(stored / "msa")).collect() if not r.value.startswith(">")) == sorted(MSA.values())
    with pytest.raises(SystemExit):
        cli.main(["build", "x", "--newick", str(stored / "t.nwk")])
    with pytest.raises(SystemExit):
        cli.main(["reroot", str(stored / "net"), "--tip", "C", "-o", f"{stored / 'net'}/"])
    (stored / "notes.tsv").write_text("A\tgood\n")
    cli.main(["annotate", str(stored / "net"), "--file", str(stored / "notes.tsv"), "-o", str(stored / "noted")])
    assert [r.name for r in Network.read(spark, str(stored / "noted")).search("good").collect()] == ["A"]


def test_index_and_segment(spark, stored):
    net = read(spark, stored)
    assert {r.name: r.seq for r in net.index("A", 2, 4).collect()} == {"A": "CGT", "B": "CGT", "C": "TGT", "D": "TG-"}
    cut = net.segment(0, 1, 0, 4)
    assert {r.name: r.seq for r in cut.sequences(aligned=True).collect()} == {k: v[1:5] for k, v in MSA.items()}


def test_mutations_against_and_at(spark, stored):
    net = read(spark, stored)
    got = {r.name: r.mutations for r in net.mutations_against("ACGT-A").collect()}
    assert got["node_3"] == "SC2T," and got["B"] == "I-4T,"
    assert [(r.anc_id, r.type) for r in net.mutations_at("D", 0, 4).collect()] == [(0, "D"), (6, "I")]


def test_events(spark, stored):
    net = read(spark, stored)
    events = spark.createDataFrame([("R", 0, "A", 0, "B", 0, 2, 1, 5, 0, "D")], net["complex_mut"].schema)
    made = net.create_network(events)
    row = made.extended_newick()[1].first()
    assert (row.s1.at, row.e1.at, row.s2.at, row.e2.at) == (0, 2, 1, 5)


def test_circle(spark, stored):
    net = read(spark, stored)
    meta = spark.createDataFrame([(0, 2, 2, 0, False)], net["seq_meta"].schema)
    turned = Network({**net.tables, "seq_meta": meta})
    assert {r.name: r.seq for r in turned.sequences(["A"]).collect()} == {"A": "GTAAC"}


def test_copies(spark):
    nodes = spark.createDataFrame([(0, 0, None), (0, 1, 0)], "tree_id int, node_id int, parent_id int")
    blocks = spark.createDataFrame([(0, 0, "AC"), (0, 1, "AC"), (0, 2, "GT"), (0, 3, "GT")], "tree_id int, block_id int, consensus string")
    states = spark.createDataFrame([(0, 0, 0), (0, 1, 0), (0, 1, 1), (0, 0, 2), (0, 1, 3)], "tree_id int, node_id int, block_id int")
    got = mutations.copies(states, blocks, nodes).first()
    assert (got.duplications, got.translocations) == (1, 1)


def test_places(spark):
    place = lambda b, p, g: F.struct(F.lit(b).alias("block"), F.lit(p).alias("pos"), F.lit(g).alias("gap"))
    cases = [((0, 5, -1), (0, 5, 2), True, True), ((0, 5, 1), (0, 5, -1), True, False), ((1, 0, 0), (0, 9, -1), True, True), ((0, 5, 1), (0, 5, -1), False, True)]
    for a, b, forward, want in cases:
        assert spark.range(1).select(sequence.at_or_after(place(*a), place(*b), F.lit(forward)).alias("x")).first().x is want
    points = spark.createDataFrame([("A", 5), ("A", 2)], "name string, column int")
    msa = spark.createDataFrame(list(MSA.items()), "name string, seq string")
    assert {r.column: r["at"] for r in sequence.ungapped(points, msa).collect()} == {5: 4, 2: 2}


def test_maf_round_trip(spark, stored, tmp_path):
    net = read(spark, stored)
    lines = [r.line for r in net.maf().collect()]
    spark.createDataFrame([("\n".join(lines),)], "v string").coalesce(1).write.text(str(tmp_path / "m"))
    back = text.maf_sequences(text.read_maf(spark, str(tmp_path / "m")))
    assert {r.name: r.seq for r in back.collect()} == {k: v.replace("-", "") for k, v in MSA.items()}


def test_polytomy_takes_sankoff(spark):
    from cladeframe.operators import build, tree
    from cladeframe.sources import newick

    nodes = newick.read_newick(spark.createDataFrame([(0, "(A,B,C);")], "tree_id int, newick string"))
    assert tree.polytomies(nodes).count() == 1
    states = spark.createDataFrame([(0, "A", 0, True), (0, "B", 0, True)], "tree_id int, name string, block_id int, forward boolean")
    got = sorted((r.node_id, r.kind) for r in build.block_mutations(nodes, states, method="sankoff").collect())
    assert got == [(0, "ins"), (3, "del")]


def lines_of(path):
    return path.read_text().splitlines()


def test_exports_are_files(spark, stored):
    """Exports of the command line are byte for byte what the formats ask for, in parts and in one file, and read back."""
    net = str(stored / "net")
    cli.main(["vcf", net, "--reference", "A", "-o", str(stored / "a.vcf"), "--one-file"])
    got = lines_of(stored / "a.vcf")
    assert got[0] == "##fileformat=VCFv4.2" and got[1].startswith("##fileDate=") and got[2] == "##reference=A"
    assert got[3:] == [
        "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tA\tB\tC\tD",
        ".\t2\t.\tC\tT\t.\t.\t.\t.\t0\t0\t1\t1", ".\t3\t.\tGT\tGN\t.\t.\t.\t.\t0\t0\t0\t1", ".\t4\t.\tT\tTT\t.\t.\t.\t.\t0\t1\t0\t0",
    ]
    cli.main(["vcf", net, "--reference", "A", "-o", str(stored / "calls")])
    parts = sorted((stored / "calls").glob("part-*"))
    assert [x for p in parts for x in lines_of(p)] == got
    tips = spark.createDataFrame([(k,) for k in MSA], "name string")
    back = text.apply_vcf(text.read_vcf(spark, str(stored / "a.vcf")), "ACGTA", tips)
    assert {r.name: r.seq for r in back.collect()} == {k: v.replace("-", "") for k, v in MSA.items()}
    cli.main(["gfa", net, "-o", str(stored / "g.gfa"), "--one-file"])
    got = lines_of(stored / "g.gfa")
    assert got[0] == "H\tVN:Z:1.0" and [x[0] for x in got] == sorted([x[0] for x in got], key="HSLP".index)
    segments, steps = text.read_gfa(spark, str(stored / "g.gfa"))
    seqs = {r.segment: r.seq for r in segments.collect()}
    walks = {}
    for r in sorted(steps.collect(), key=lambda r: (r.path, r.step)):
        walks[r.path] = walks.get(r.path, "") + seqs[r.segment]
    assert walks == {k: v.replace("-", "") for k, v in MSA.items()}
    cli.main(["maf", net, "-o", str(stored / "m.maf"), "--one-file"])
    assert lines_of(stored / "m.maf") == ["##maf version=1", "a", *(f"s\t{k}\t0\t{len(v.replace('-', ''))}\t+\t{len(v.replace('-', ''))}\t{v}" for k, v in MSA.items()), ""]
    back = text.maf_sequences(text.read_maf(spark, str(stored / "m.maf")))
    assert {r.name: r.seq for r in back.collect()} == {k: v.replace("-", "") for k, v in MSA.items()}
    cli.main(["consensus", net, "-o", str(stored / "c.fa"), "--one-file"])
    assert lines_of(stored / "c.fa") == [">0", "ACGTTA"]
    cli.main(["fasta", net, "--nodes", "D", "B", "-o", str(stored / "f.fa"), "--one-file"])
    assert sorted(lines_of(stored / "f.fa")) == sorted([">B", "ACGTTA", ">D", "ATGNA"])


def test_one_output_a_tree(spark, stored, tmp_path):
    split = tmp_path / "two"
    cli.main(["split", str(stored / "net"), "--node", "node_3", "--tree", "5", "-o", str(split)])
    cli.main(["newick", str(split), "-o", str(tmp_path / "t"), "--one-file"])
    assert sorted(p.name for p in (tmp_path / "t").iterdir() if not p.name.startswith(".")) == ["tree_0", "tree_5"]
    assert lines_of(tmp_path / "t" / "tree_5") == ["(C:1.000000,D:1.000000)node_3:0.000000;"]
    cli.main(["vcf", str(split), "--reference", "C", "-o", str(tmp_path / "c.vcf"), "--one-file"])
    assert lines_of(tmp_path / "c.vcf")[3].split("\t")[9:] == ["C", "D"]
    cli.main(["extended-newick", str(split), "-o", str(tmp_path / "x"), "--one-file"])
    assert len(lines_of(tmp_path / "x")) == 2
    with pytest.raises(SystemExit):
        cli.main(["vcf", str(split), "--reference", "nobody", "-o", str(tmp_path / "none")])


def test_binary_placement(spark, stored):
    """Records and files, plain and gzip, give the placement rows again; their bytes are those of the wire format."""
    from cladeframe.sources import placement

    net = read(spark, stored)
    want = sorted(tuple(r) for r in net.placement().select("tree_id", "preorder_idx", "position", "ref_nuc", "par_nuc", "mut_nuc").collect())
    kept = net.placement_records()
    assert want and kept.count() == net["node"].count()
    kept.repartition(3).write.parquet(str(stored / "records"))
    assert sorted(map(tuple, placement.rows_of(spark.read.parquet(str(stored / "records"))).collect())) == want
    for name in ("p.pb", "p.pb.gz"):
        cli.main(["placement", str(stored / "net"), "--binary", "-o", str(stored / name)])
        assert sorted(map(tuple, placement.read_file(spark, str(stored / name)).collect())) == want
    data = (stored / "p.pb").read_bytes()
    assert next(placement.fields(data)) == (placement.NEWICK, net.newick().first().newick.encode())
    assert placement.field(placement.LIST, placement.mutation(300, 0, 2, [1, 200])) == bytes.fromhex("120c" "0a0a" "08ac02" "1802" "2203" "01c801")
    assert list(placement.mutations_in(placement.mutation(300, 0, 2, [1, 200]) + placement.mutation(1, 4, 8, []))) == [(300, 0, 2, [1, 200]), (1, 4, 8, [])]
    for wrong in (b"\x12\x05\x0a", b"\x0d\x00\x00\x00\x00", b"\x80"):
        with pytest.raises(ValueError):
            list(placement.fields(wrong))
    with pytest.raises(SystemExit):
        cli.main(["placement", str(stored / "net"), "--binary"])


def test_coordinate_index_over_stretches(spark, monkeypatch):
    """Bases of two blocks, one of them turned and one longer than a stretch, whatever the points' columns are called."""
    from cladeframe import schemas
    from cladeframe.operators import sequence

    monkeypatch.setattr(sequence, "STRETCH", 5)
    rows = {
        "node": [(0, 0, "r", None, 0, 0, 0, 0, 0.0, True, [])],
        "block": [(0, 0, "ACGTACGTACGTA"), (0, 1, "GGCA"), (0, 2, "TTTT")],
        "gap": [(0, 0, 4, 7)],
        "nuc_mut": [(0, 0, 0, 0, 4, 6, "I", 1, "C"), (0, 0, 1, 0, 0, -1, "D", 2, "--")],
        "block_mut": [(0, 0, 0, 0, "ins"), (0, 0, 2, 2, "ins_inv")],
    }
    net = {k: spark.createDataFrame(rows.get(k, []), ddl) for k, ddl in schemas.TABLES.items()}
    text = "--GT------CACGTACGTA" + "----" + "AAAA"
    index = sequence.coordinate_index(net, net["node"]).cache()
    assert "".join(r.text for r in index.orderBy("column").collect()) == text
    held = [i for i, c in enumerate(text) if c != "-"]
    block = lambda i: (0, i) if i < 20 else (1, i - 20) if i < 24 else (2, i - 24)
    points = spark.createDataFrame([(0, 0, n, "x", "y") for n in range(-1, 40)], "tree_id int, node_id int, nth long, n string, text string")
    got = sorted((r.nth, r.block_id, r.at, r.column) for r in sequence.base_places(index, points).collect())
    assert got == [(n + 1, *block(i), i) for n, i in enumerate(held)]
    points = spark.createDataFrame([(0, 0, *block(i)) for i in range(len(text))] + [(0, 0, 1, 4), (0, 0, 0, -1)], "tree_id int, node_id int, block_id int, at int")
    got = sorted((r.block_id, r.at, r.base, r.n_bases) for r in sequence.bases_up_to(index, points).collect())
    assert got == [(*block(i), c, len(text[: i + 1].replace("-", ""))) for i, c in enumerate(text)]
    whole = {r.column: (r.base, r.n_bases) for r in sequence.coordinates(net, net["node"]).collect()}
    assert whole == {i: (c, len(text[: i + 1].replace("-", ""))) for i, c in enumerate(text)}
    bounds = lambda a, b: [(r.lo, r.hi) for r in sequence.base_bounds(net, net["node"], a, b).collect()]
    assert bounds(2, 3) == [(held[1], held[2])] and bounds(-4, 99) == [(held[0], held[-1])] and bounds(99, 120) == [] and bounds(3, 2) == []
