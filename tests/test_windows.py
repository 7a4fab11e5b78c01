"""Alignments read by windows of columns."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from cladeframe.network import Network
from cladeframe.sources import newick, text, windows

NAMES = [f"t{k}" for k in range(9)]


def spelled(rng, width=57):
    """Sequences, and a file of them with lines of any length, blank lines, both line ends, > in headers and a name twice."""
    seqs = {n: "".join(rng.choice("ACGT-") for _ in range(width)) for n in NAMES}
    out = [">t3 an older one\n" + "A" * width + "\n"]
    for n, s in seqs.items():
        end = rng.choice(["\n", "\r\n"])
        out.append(f">{n} left>right note{end}")
        while s:
            k = rng.randint(1, 30)
            out.append(s[:k] + end * rng.randint(1, 2))
            s = s[k:]
    return seqs, "".join(out).rstrip("\n")


@pytest.mark.parametrize("width,size,chunk", [(20, 64, 16), (57, 7, 5), (8, 10_000, 1 << 20), (1, 33, 3), (100, 50, 64)])
def test_index_and_reader(spark, tmp_path, monkeypatch, width, size, chunk):
    seqs, body = spelled(random.Random(width))
    (tmp_path / "a.fa").write_text(body, newline="")
    monkeypatch.setattr(windows, "CHUNK", chunk)  # of ranges scanned here; workers take the whole
    index = windows.index_fasta(spark, f"{tmp_path}/a.fa", width, size)
    want = sorted((n, k // width, s[k : k + width]) for n, s in seqs.items() for k in range(0, len(s), width))
    assert sorted(tuple(r) for r in windows.read_index(index).collect()) == want
    assert sorted(tuple(r) for r in windows.read_index(index, [0]).collect()) == [w for w in want if w[1] == 0]
    whole = text.read_fasta(spark, f"{tmp_path}/a.fa")
    assert sorted(tuple(r) for r in windows.cut(whole, width).collect()) == want
    # the scan itself, in this process, with chunks that end anywhere
    file, n = f"file:{tmp_path}/a.fa", len(body.encode())
    found = [r for lo in range(0, n, size) for r in windows._records(file, lo, lo + size, width)]
    last = {r[2]: r[1] for r in found}
    got = [(r[2], r[4], body.encode()[r[5] : r[6]].translate(None, windows._BLANKS).decode()) for r in found if r[1] == last[r[2]]]
    assert sorted(got) == want


def test_odd_files(spark, tmp_path):
    (tmp_path / "empty.fa").write_text("")
    assert windows.index_fasta(spark, f"{tmp_path}/empty.fa").count() == 0
    assert windows.read_windows(spark, f"{tmp_path}/empty.fa").count() == 0
    (tmp_path / "bare.fa").write_text("\n\n>a\n>b\n\n>c")
    assert sorted(tuple(r) for r in windows.read_windows(spark, f"{tmp_path}/bare.fa").collect()) == [("a", 0, ""), ("b", 0, ""), ("c", 0, "")]
    (tmp_path / "uneven.fa").write_text(">a\nACGT\n>b\nAC\n")
    with pytest.raises(ValueError):
        windows.read_windows(spark, f"{tmp_path}/uneven.fa")
    with gzip.open(tmp_path / "p.fa.gz", "wt") as f:
        f.write(">a\nACG\nT\n>b\nGGGG\n")
    assert sorted(tuple(r) for r in windows.read_windows(spark, f"{tmp_path}/p.fa.gz", 3).collect()) == [("a", 0, "ACG"), ("a", 1, "T"), ("b", 0, "GGG"), ("b", 1, "G")]


@pytest.mark.parametrize("method,reference", [("fitch", None), ("sankoff", "t4")])
def test_network_of_windows(spark, tmp_path, method, reference):
    """The same network as from whole sequences; gaps of the reference take the first base of their column."""
    seqs, body = spelled(random.Random(5))
    (tmp_path / "a.fa").write_text(body, newline="")
    tree = spark.createDataFrame([(0, "(((t0:1,t1:1)x:1,t2:1)y:1,((t3:1,t4:1)z:1,(t5:1,t6:1,t7:1)u:1)v:1,t8:1)r;")], "tree_id int, newick string")
    nodes = newick.read_newick(tree).cache()
    rows = windows.read_windows(spark, f"{tmp_path}/a.fa", 10).withColumn("tree_id", F.lit(0))
    split = Network.from_windows(nodes, rows, 10, method, reference)
    whole = Network.from_msa(nodes, text.read_fasta(spark, f"{tmp_path}/a.fa").withColumn("tree_id", F.lit(0)), method, reference)
    for name in ("block", "nuc_mut", "block_mut"):
        assert sorted(map(str, split[name].collect())) == sorted(map(str, whole[name].collect()))
    assert {r.name: r.seq for r in split.sequences().collect()} == {n: s.replace("-", "") for n, s in seqs.items()}
    if reference:
        lead = "".join(seqs["t4"][k] if seqs["t4"][k] != "-" else next((seqs[n][k] for n in NAMES if seqs[n][k] != "-"), "") for k in range(57))
        assert split["block"].first()["consensus"] == lead
