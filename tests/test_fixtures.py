"""Small trees with worked-out results."""

import pytest
from pyspark.sql import functions as F

from cladeframe.functions import codes
from cladeframe.network import Network
from cladeframe.operators import graph, mutations, parsimony, sequence, tree, variants
from cladeframe.sources import newick, sinks, text

TREE = "((A:1,B:1):1,(C:1,D:1):1);"
MSA = {"A": "ACGT-A", "B": "ACGTTA", "C": "ATGT-A", "D": "ATG-NA"}


@pytest.fixture(scope="module")
def nodes(spark):
    return newick.read_newick(spark.createDataFrame([(0, TREE)], "tree_id int, newick string")).cache()


def msa(spark, rows):
    return spark.createDataFrame([(0, k, v) for k, v in rows.items()], "tree_id int, name string, seq string")


@pytest.fixture(scope="module")
def net(spark, nodes):
    made = Network.from_msa(nodes, msa(spark, MSA))
    return Network({k: v.cache() for k, v in made.tables.items()})


def named(net, rows):
    names = {r.node_id: r.name for r in net["node"].collect()}
    return sorted((names[r.node_id], r.pos, r.type, r.chars) for r in rows.collect())


def test_newick_round_trip(nodes):
    want = "((A:1.000000,B:1.000000)node_2:1.000000,(C:1.000000,D:1.000000)node_3:1.000000)node_1:0.000000;"
    assert newick.write_newick(nodes).first().newick == want


@pytest.mark.parametrize("bad", ["((A,B);", "A,B;", "(A))(;", ""])
def test_newick_errors(bad):
    with pytest.raises(ValueError):
        newick.parse(bad)


def test_newick_lengths():
    rows = {r["name"]: r["branch_len"] for r in newick.parse("(A:0,B,'x,y':2.5e-1):3;")}
    assert rows == {"node_1": 0.0, "A": 1.0, "B": 1.0, "'x,y'": 0.25}


@pytest.mark.parametrize("method", ["fitch", "sankoff"])
def test_mutations(spark, nodes, method):
    net = Network.from_msa(nodes, msa(spark, MSA), method)
    assert net["block"].first().consensus == "ACGTTA"
    want = [("B", 4, "I", "T"), ("D", 3, "D", "-"), ("D", 4, "I", "N"), ("node_1", 4, "D", "-"), ("node_3", 1, "S", "T")]
    assert named(net, net["nuc_mut"]) == want


def test_missing_tip(spark, nodes):
    net = Network.from_msa(nodes, msa(spark, {k: v for k, v in MSA.items() if k != "D"}))
    assert not [m for m in named(net, net["nuc_mut"]) if m[0] == "D"]


def test_all_gap_columns_are_dropped(spark, nodes):
    net = Network.from_msa(nodes, msa(spark, {"A": "A-C", "B": "A-C", "C": "A-G", "D": "--G"}))
    assert net["block"].first().consensus == "AC"


def test_reference_fixes_the_root(spark, nodes):
    net = Network.from_msa(nodes, msa(spark, MSA), reference="C")
    assert ("node_2", 1, "S", "C") in named(net, net["nuc_mut"])


def test_summary(net):
    r = net.summary().first()
    assert (r.nodes, r.samples, r.substitutions, r.insertions, r.deletions, r.inversions) == (7, 4, 1, 2, 1, 0)
    assert (r.max_depth, r.mean_depth, r.block_insertions) == (2, 2.0, 1)


def test_replay_gives_the_input_back(net):
    assert {r.name: r.seq for r in net.sequences(aligned=True).collect()} == MSA
    assert {r.name: r.seq for r in net.sequences().collect()} == {k: v.replace("-", "") for k, v in MSA.items()}


def test_vcf_and_back(spark, net, tmp_path):
    lines = [r.line for r in net.vcf("A").orderBy("at").collect()]
    body = [x.split("\t")[1:5] + x.split("\t")[9:] for x in lines if not x.startswith("#")]
    assert body == [
        ["2", ".", "C", "T", "0", "0", "1", "1"], ["3", ".", "GT", "GN", "0", "0", "0", "1"], ["4", ".", "T", "TT", "0", "1", "0", "0"]
    ]
    path = str(tmp_path / "x.vcf")
    spark.createDataFrame([("\n".join(lines),)], "v string").coalesce(1).write.text(path)
    tips = spark.createDataFrame([(n,) for n in MSA], "name string")
    back = text.apply_vcf(text.read_vcf(spark, path), "ACGTA", tips)
    assert {r.name: r.seq for r in back.collect()} == {k: v.replace("-", "") for k, v in MSA.items()}


def test_mutation_list_and_placement(net):
    assert sorted((r.name, r.type, r.mutations) for r in net.mutations().collect()) == [
        ("B", "I", "g-4T"), ("D", "D", "T4-"), ("D", "I", "g-4N"), ("node_3", "S", "C2T")
    ]
    assert sorted((r.preorder_idx, r.position, r.par_nuc, tuple(r.mut_nuc)) for r in net.placement().collect()) == [
        (3, 5, 0, (3,)), (4, 2, 2, (3,)), (6, 5, 0, (0, 1, 2, 3))
    ]


def test_subnet_and_reroot_keep_sequences(spark, net):
    part = net.subnet(spark.createDataFrame([(0, "B"), (0, "D")], "tree_id int, name string"))
    assert {r.name: r.seq for r in part.sequences(aligned=True).collect()} == {"B": MSA["B"], "D": MSA["D"]}
    assert {r.name: r.branch_len for r in part["node"].collect()} == {"node_1": 0.0, "B": 2.0, "D": 2.0}
    turned = net.reroot("C")
    assert {r.name: r.seq for r in turned.sequences(aligned=True).collect()} == MSA
    with pytest.raises(ValueError):
        net.subnet(spark.createDataFrame([(0, "nobody")], "tree_id int, name string"))


def test_split_and_network(spark, net):
    events = spark.createDataFrame(
        [("R", 0, "A", 0, "B", 0, 1, 2, 3, 0, "node_3"), ("R", 0, "A", 0, "nobody", 0, 1, 2, 3, 0, "D"), ("H", 0, "C", 0, "A", 0, 1, 2, 3, 0, "node_3")], net["complex_mut"].schema
    )
    made = net.create_network(events)
    assert {r.name: r.seq for r in made.sequences(aligned=True).collect()} == MSA
    assert [(r.seq3, r.tree3) for r in made["complex_mut"].collect()] == [("node_3", 1)]


def test_ratio(spark, net):
    notes = spark.createDataFrame([("C", 0, "African"), ("D", 0, "African"), ("A", 0, "Non-African"), ("B", 0, "Non-African")], "name string, ord int, value string")
    rows = net.annotate(notes).ratio_test().collect()
    hit = [r for r in rows if r.pos == 2][0]
    assert (hit.frac_a, hit.frac_b) == (1.0, 0.0) and abs(hit.ratio - 10000) < 1e-6


def test_store_and_read(spark, net, tmp_path):
    net.write(str(tmp_path / "net"))
    back = Network.read(spark, str(tmp_path / "net"))
    assert {r.name: r.seq for r in back.sequences(aligned=True).collect()} == MSA


def test_gap_columns_and_strand(spark, nodes):
    block = spark.createDataFrame([(0, 0, "ACG")], "tree_id int, block_id int, consensus string")
    gap = spark.createDataFrame([(0, 0, 1, 2)], "tree_id int, block_id int, pos int, len int")
    nuc = spark.createDataFrame([(0, 0, 0, 0, 1, 0, "I", 2, "TT")], "tree_id int, node_id int, ord int, block_id int, pos int, gap_pos int, type string, len int, chars string")
    flip = spark.createDataFrame([(0, 0, 0, 0, "ins"), (0, 1, 0, 0, "inv")], "tree_id int, node_id int, ord int, block_id int, kind string")
    meta = spark.createDataFrame([], "tree_id int, node_id int, circ_offset int, rot_block int, inverted boolean")
    made = {"node": nodes, "block": block, "gap": gap, "nuc_mut": nuc, "block_mut": flip, "seq_meta": meta}
    texts = {r.node_id: r.text for r in sequence.block_texts(made).collect()}
    assert (texts[0], texts[2]) == ("ATTCG", "CGAAT")


def test_run_packing(spark):
    def packed(types):
        rows = spark.createDataFrame([(0, 0, 0, 10 + i, -1, t, "A") for i, t in enumerate(types)], "tree_id int, node_id int, block_id int, pos int, gap_pos int, type string, base string")
        return sorted((r.pos, r.len) for r in mutations.pack(rows).collect())

    assert packed("S" * 8) == [(10, 6), (16, 2)]
    assert packed("SSSDDDDD") == [(10, 3), (13, 5)]


def test_folds(spark):
    row = spark.range(1)
    kinds = lambda *k: F.array(*[F.lit(x) for x in k])
    state = row.select(mutations.fold_blocks(kinds("ins", "inv", "inv", "del", "ins_inv")).alias("x")).first().x
    assert (state.exists, state.forward) == (True, False)
    merged = {("S", "D"): "D", ("I", "S"): "I", ("I", "D"): None, ("D", "I"): "S", ("D", "S"): "S", ("S", "I"): "S"}
    for (a, b), want in merged.items():
        assert row.select(codes.merged_type(F.lit(a), F.lit(b)).alias("x")).first().x == want
    blocks = {("ins", "inv"): "ins_inv", ("ins", "del"): None, ("inv", "del"): "del", ("inv", "inv"): None, ("ins_inv", "inv"): "ins"}
    for (a, b), want in blocks.items():
        assert row.select(mutations.merge_blocks(kinds(a, b)).alias("x")).first().x == want


def test_codes(spark):
    letters = "ACGTRYSWKMBDHVN-x"
    rows = spark.createDataFrame([(c,) for c in letters], "c string").select(codes.base_code(F.col("c")).alias("k"), codes.code_base(codes.base_code(F.col("c"))).alias("b"))
    assert [r.k for r in rows.collect()] == [1, 2, 4, 8, 5, 10, 6, 9, 12, 3, 14, 13, 11, 7, 15, 0, 0]
    one = spark.range(1).select(codes.complement(F.lit("ACGTRYSWKMBDHVN")).alias("c"), codes.unpack_consensus(codes.pack_consensus(F.lit("ACGTNACGTA"))).alias("p")).first()
    assert (one.c, one.p) == ("TGCAYRSWMKVHDBN", "ACGTNACGTA")


def test_codons():
    assert [c[2] for c in variants.codons("ATG-GCCTAAC")] == ["Met", "Ala", "*"]
    assert variants.residue_changes("ATGGCC", "ATGGGC") == "S:1:Gly;"
    assert variants.residue_changes("ATGGCC", "ATG---") == "D:1;"
    assert variants.residue_changes("ATG---GCC", "ATGAAAGCC") == "I:1:Lys;"


def test_chain_and_rotation():
    assert graph.chain(list("abcde"), list("abxde")) == [(0, 0), (1, 1), (3, 3), (4, 4)]
    assert graph.merge_chain(list("abc"), list("axc"), [(0, 0), (2, 2)]) == list("abxc")
    assert graph.chain(list("ab"), list("xy")) == []
    for k in range(6):
        ring = list("abcdef")
        sample = ring[k:] + ring[:k]
        assert sample[graph.rotation_start(ring, sample) :][0] == "a"


def test_gfa_build(spark, nodes):
    segments = spark.createDataFrame([("1", "ACG"), ("2", "TT"), ("3", "GA")], "segment string, seq string")
    paths = {"A": "1+,2+,3+", "B": "1+,3+", "C": "1+,2-,3+", "D": "2+,3+"}
    steps = [(p, i, x[:-1], x[-1] == "+") for p, walk in paths.items() for i, x in enumerate(walk.split(","))]
    from cladeframe.operators import build

    net = Network(build.from_gfa(nodes, segments, spark.createDataFrame(steps, "path string, step int, segment string, forward boolean")))
    assert {r.name: r.seq for r in net.sequences().collect()} == {"A": "ACGTTGA", "B": "ACGGA", "C": "ACGAAGA", "D": "TTGA"}
    lines = [r.line for r in net.gfa(with_bases=False).collect()]
    assert "P\tC\t0+,1-,2+\t*" in lines


def test_pangraph_build(spark, nodes, tmp_path):
    import json

    block = lambda i, seq, gaps, mutate, insert, delete: {"id": i, "sequence": seq, "gaps": gaps, "mutate": mutate, "insert": insert, "delete": delete}
    who = lambda n: {"name": n, "number": 1}
    doc = {
        "paths": [{"name": n, "circular": False, "offset": 0, "blocks": [{"id": "x", "strand": True}, {"id": "y", "strand": n != "C"}]} for n in "ABCD"],
        "blocks": [
            block("x", "acgta", {"2": 2}, [[who("B"), [[2, "T"]]]], [[who("C"), [[[2, 0], "GG"]]]], [[who("D"), [[4, 2]]]]),
            block("y", "TTG", {}, [], [], []),
        ],
    }
    (tmp_path / "p.json").write_text(json.dumps(doc))
    from cladeframe.operators import build

    net = Network(build.from_pangraph(nodes, text.read_pangraph(spark, str(tmp_path / "p.json"))))
    got = {r.name: r.seq for r in net.sequences().collect()}
    assert got == {"A": "ACGTATTG", "B": "ATGTATTG", "C": "ACGGGTACAA", "D": "ACGTTG"}


def test_readers(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one first\nAC\nGT\r\n>two\nAAAA\n>one\nCCCC\n")
    assert {r.name: r.seq for r in text.read_fasta(spark, str(tmp_path / "a.fa"), check_width=True).collect()} == {"one": "CCCC", "two": "AAAA"}
    (tmp_path / "b.fa").write_text(">one\nAC\n>two\nAAAA\n")
    with pytest.raises(Exception, match="different lengths"):
        text.read_fasta(spark, str(tmp_path / "b.fa"), check_width=True).collect()
    (tmp_path / "c.gfa").write_text("H\tVN:Z:1.0\nS\t1\tACG\nS\t2\tTT\nP\tp\t1+,2-\t*\n")
    assert text.gfa_sequences(*text.read_gfa(spark, str(tmp_path / "c.gfa"))).first().seq == "ACGAA"
    (tmp_path / "d.tsv").write_text("A\tx\t\ty \nB\n")
    assert [(r.name, r.value) for r in text.read_annotations(spark, str(tmp_path / "d.tsv")).collect()] == [("A", "x"), ("A", "y")]
    (tmp_path / "e.txt").write_text("0 A B\n1 C\n")
    assert [(r.tree_id, r.name) for r in text.read_node_lists(spark, str(tmp_path / "e.txt")).collect()] == [(0, "A"), (0, "B"), (1, "C")]


def test_closure_and_counts(nodes):
    up = {(r.node_id, r.anc_id): r.dist for r in tree.closure(nodes).collect()}
    assert up[(3, 0)] == 2 and len(up) == 7 + 6 + 4
    counts = {r.node_id: r.n_leaves for r in tree.subtree_leaf_counts(nodes).collect()}
    assert counts == {0: 4, 1: 2, 2: 1, 3: 1, 4: 2, 5: 1, 6: 1}
    assert sorted(r.name for r in tree.tips_under(nodes, "node_3").collect()) == ["C", "D"]


def test_deep_chain_closure(spark):
    text_ = "A"
    for i in range(40):
        text_ = f"({text_},t{i})"
    deep = newick.read_newick(spark.createDataFrame([(0, text_ + ";")], "tree_id int, newick string"))
    longest = tree.closure(deep).agg(F.max("dist"), F.count("*"), F.countDistinct("node_id", "anc_id")).first()
    assert longest[0] == 40 and longest[1] == longest[2]


def test_levels_agree_with_kernel(spark, nodes):
    import numpy as np

    rng = np.random.default_rng(1)
    parent = np.array([0, 0, 1, 1, 0, 4, 4])
    sets = np.zeros((7, 50), dtype=np.uint16)
    leaves = [2, 3, 5, 6]
    sets[leaves] = 1 << rng.integers(0, 5, (4, 50))
    rows = [(int(n), int(s), int(sets[n, s])) for n in leaves for s in range(50)]
    up = parsimony.fitch_up(parent, sets.copy())
    got = parsimony.fitch_levels(nodes, spark.createDataFrame(rows, "node_id int, site int, state int"), ["site"])
    assert all(up[r.node_id, r.site] == r.sets for r in got.collect())


def test_chain_against_a_plain_scan():
    import random

    r = random.Random(4)
    for _ in range(200):
        a, b = ([r.choice("abcd") for _ in range(r.randint(0, 9))] for _ in range(2))
        points = [(i, j) for i, p in enumerate(a) for j, q in enumerate(b) if p == q]
        score, back = {}, {}
        for x, y in points:
            if (x, y) == (0, 0):
                score[x, y], back[x, y] = graph.WORTH, None
                continue
            score[x, y], back[x, y] = graph.FLOOR, None
            wall_x = wall_y = -1
            for p, q in sorted([s for s in points if s[0] < x and s[1] < y], reverse=True):
                if p <= wall_x and q <= wall_y:
                    continue
                gain = score[p, q] + graph.WORTH - (x - p) - (y - q)
                if gain > score[x, y]:
                    score[x, y], back[x, y] = gain, (p, q)
                wall_x, wall_y = max(wall_x, p - 1), max(wall_y, q - 1)
        want, at = [], max(points, key=lambda s: score[s], default=None)
        while at is not None:
            want.append(at)
            at = back[at]
        assert graph.chain(a, b) == want[::-1]


def plain_states(parent, leaf, method, root):
    """One column's state of every node in pre-order, straight from the definitions; leaf has codes by node."""
    n = len(parent)
    below = [[j for j in range(1, n) if parent[j] == i] for i in range(n)]
    if method == "fitch":
        sets = [set() for _ in range(n)]
        for i in reversed(range(n)):
            if below[i]:
                shared = set.intersection(*[sets[j] for j in below[i]])
                sets[i] = shared or set.union(*[sets[j] for j in below[i]])
            elif i in leaf:
                sets[i] = {leaf[i]}
        state = [None] * n
        for i in range(n):
            low = min(sets[i], default=-1)
            state[i] = (low if root is None else root) if i == 0 else state[parent[i]] if state[parent[i]] in sets[i] else low
        return state
    never = 10**9
    cost = [[0] * 16 for _ in range(n)]
    for i in reversed(range(n)):
        known = [min(cost[j]) < never for j in below[i]]
        for s in range(16):
            if below[i]:
                cost[i][s] = sum(min(cost[j][s], min(cost[j]) + 1) for j, k in zip(below[i], known) if k) if any(known) else never
            else:
                cost[i][s] = 0 if leaf.get(i) == s else never
    state = [None] * n
    for i in range(n):
        up = None if i == 0 else state[parent[i]]
        total = [c + (up is not None and s != up) for s, c in enumerate(cost[i])]
        state[i] = -1 if min(cost[i]) >= never or up == -1 else total.index(min(total))
        if i == 0 and root is not None:
            state[i] = root
    return state


def grown(r, n, kind):
    """Parents in pre-order of a random tree, a ladder, or one node with many children."""
    below = {0: []}
    for i in range(1, n):
        below.setdefault({"random": r.randrange(i), "ladder": max(0, 2 * ((i - 1) // 2)), "star": 0 if r.random() < 0.7 else r.randrange(i)}[kind], []).append(i)
    order, stack = [], [(0, None)]
    while stack:
        i, up = stack.pop()
        order.append(up)
        at = len(order) - 1
        stack += [(j, at) for j in reversed(below.get(i, []))]
    return order


@pytest.mark.parametrize("method", ["fitch", "sankoff"])
@pytest.mark.parametrize("kind", ["random", "ladder", "star"])
def test_parts_and_crown(spark, monkeypatch, method, kind):
    """Mutations of parted trees, whole trees and the definitions are the same: unknown tips, a reference, two trees of different size, several stretches."""
    import random

    from cladeframe.functions.codes import BASES
    from cladeframe.schemas import NODE

    r = random.Random(len(kind))
    width, trees, rows, nodes = 21, {}, [], []
    for t, n in ((0, 60), (1, 9)):
        parent = trees[t] = grown(r, n, kind)
        last, level = list(range(n)), [0] * n
        for i in reversed(range(1, n)):
            last[parent[i]] = max(last[parent[i]], last[i])
        for i in range(1, n):
            level[i] = level[parent[i]] + 1
        for i, p in enumerate(parent):
            leaf = i not in parent
            nodes.append((t, i, f"t{t}n{i}", p, 0, i, last[i], level[i], 1.0, leaf, []))
            if leaf and r.random() < 0.85:
                rows.append((t, f"t{t}n{i}", "".join(r.choice("ACGT-N") for _ in range(width))))
        rows.append((t, "a stranger", "ACG" * 7))
    frame, msa = spark.createDataFrame(nodes, NODE), spark.createDataFrame(rows, "tree_id int, name string, seq string")
    monkeypatch.setattr(parsimony, "COLUMNS", 8)
    for reference in (None, rows[0][1]):
        want, texts = set(), {}
        for t, parent in trees.items():
            own = sorted((n, s) for u, n, s in rows if u == t)
            fixed = next((s for n, s in own if reference and reference in n), None)
            for site in range(width):
                base = next((s[site] for _, s in own if s[site] != "-"), "-")
                base = fixed[site] if fixed and fixed[site] != "-" else base
                texts[t] = texts.get(t, "") + base
                leaf = {int(n.split("n")[1]): BASES.index(s[site]) for n, s in own if n != "a stranger"}
                state = plain_states(parent, leaf, method, BASES.index(fixed[site]) if fixed else None)
                for i, s in enumerate(state):
                    old = BASES.index(base) if i == 0 else state[parent[i]]
                    if s != old and s >= 0 and old >= 0:
                        want.add((t, i, site, "I" if old == 0 else "D" if s == 0 else "S", BASES[s]))
        for part, memory in ((1 << 14, 256 << 20), (5, 256 << 20), (5, 512 * 100)):
            monkeypatch.setattr(parsimony, "PART", part)
            monkeypatch.setattr(parsimony, "WORK_BYTES", memory)
            muts, chunks = parsimony.infer(frame, msa, method, reference)
            got = [tuple(x) for x in muts.select("tree_id", "node_id", "site", "type", "base").collect()]
            assert len(got) == len(set(got)) and set(got) == want
            shown = {}
            for c in sorted(chunks.collect(), key=lambda c: c.site):
                shown[c.tree_id] = shown.get(c.tree_id, "") + c.base
            assert shown == texts


def test_sequences_of_different_lengths(spark, nodes):
    msa = spark.createDataFrame([(0, "A", "ACGT"), (0, "B", "ACG")], "tree_id int, name string, seq string")
    with pytest.raises(Exception, match="different lengths"):
        parsimony.infer(nodes, msa)[0].collect()


def test_headers_and_two_trees(spark, tmp_path):
    """A header may hold >; segments of two trees have nothing in common."""
    (tmp_path / "a.fa").write_text(">s1 left>right note\r\nAC>GT\r\nAC\n>s2\n>s3 x\nTT\n\n")
    assert {r.name: r.seq for r in text.read_fasta(spark, str(tmp_path / "a.fa")).collect()} == {"s1": "AC>GTAC", "s2": "", "s3": "TT"}
    nodes = newick.read_newick(spark.createDataFrame([(0, "(A,B);"), (1, "(C,D);")], "tree_id int, newick string"))
    rows = {"A": "ACGT" * 16, "B": "ACGA" * 16, "C": "TTTT" * 16, "D": "ACGT" * 16}
    msa = spark.createDataFrame([(int(n in "CD"), n, s) for n, s in rows.items()], "tree_id int, name string, seq string")
    net = Network.from_msa(nodes, msa)
    for with_bases in (True, False):
        place = str(tmp_path / f"g{with_bases}")
        sinks.write_lines(net.gfa(with_bases).select("rank", "key", "line"), place, ["rank", "key"])
        segments, steps = text.read_gfa(spark, place)
        names = [r.segment for r in segments.collect()]
        assert len(names) == len(set(names))
        if with_bases:
            assert {r.name: r.seq for r in text.gfa_sequences(segments, steps).collect()} == rows


def walked(parent, child_ord, ids):
    """pre, post, level and parent's pre of every node, by a walk with a stack."""
    below = {}
    for i in sorted(ids, key=lambda i: (child_ord[i], i)):
        below.setdefault(parent[i], []).append(i)
    out, stack = {}, [(i, None, 0) for i in reversed(below[None])]
    while stack:
        i, up, level = stack.pop()
        out[i] = [len(out), len(out), level, up]
        stack += [(j, out[i][0], level + 1) for j in reversed(below.get(i, []))]
    at = {v[0]: v for v in out.values()}
    for pre in sorted(at, reverse=True):
        if at[pre][3] is not None:
            at[at[pre][3]][1] = max(at[at[pre][3]][1], at[pre][1])
    return out


@pytest.mark.parametrize("kind", ["random", "ladder", "star"])
def test_numbering_by_doubling(spark, kind):
    """Trees of any shape, a forest, ids in no order and ties of child_ord."""
    import random

    from cladeframe.schemas import NODE

    r = random.Random(len(kind))
    rows, want = [], set()
    for t, n, roots in ((0, 90, 1), (3, 1, 1), (7, 25, 4)):
        shape = grown(r, n, kind)
        ids = r.sample(range(-5, 500), n)
        parent = {ids[i]: None if i < roots else ids[shape[i]] for i in range(n)}
        child_ord = {i: r.randrange(4) for i in ids}
        rows += [(t, i, f"n{i}", parent[i], child_ord[i], 9, 9, 9, 2.0, None, ["note"]) for i in ids]
        for i, (pre, post, level, up) in walked(parent, child_ord, ids).items():
            want.add((t, f"n{i}", pre, pre, post, level, up, i not in parent.values()))
    got = tree.numbered(spark.createDataFrame(rows, NODE))
    assert {(x.tree_id, x.name, x.node_id, x.pre, x.post, x.level, x.parent_id, x.is_leaf) for x in got.collect()} == want
    order = {}
    for x in got.collect():
        order.setdefault((x.tree_id, x.parent_id), []).append((x.pre, x.child_ord))
    assert all([o for _, o in sorted(v)] == list(range(len(v))) for v in order.values())
    assert tree.numbered(got.limit(0)).collect() == []


def test_running_sums(spark, monkeypatch):
    import random

    from cladeframe.operators import order

    r = random.Random(2)
    monkeypatch.setattr(order, "BUCKET", 7)
    rows = [(t, i, r.randrange(5)) for t in (0, 1) for i in range(40)]
    got = order.running(spark.createDataFrame(rows, "tree_id int, pre int, x bigint"), {"upto": F.col("x")})
    assert {(g.tree_id, g.pre, g.upto) for g in got.collect()} == {(t, i, sum(x for u, j, x in rows if u == t and j <= i)) for t, i, _ in rows}


def random_network(spark, r, kind, n=40, trees=(0, 2)):
    """Blocks that come, go and turn, gap columns, one mutation a place and node, some turned orders."""
    from cladeframe import schemas

    tables = {name: [] for name in schemas.TABLES}
    for t in trees:
        parent = grown(r, n, kind)
        last, level = list(range(n)), [0] * n
        for i in reversed(range(1, n)):
            last[parent[i]] = max(last[parent[i]], last[i])
        for i in range(1, n):
            level[i] = level[parent[i]] + 1
        for i, p in enumerate(parent):
            tables["node"].append((t, i, f"t{t}n{i}", p, 0, i, last[i], level[i], 1.0, i not in parent, []))
        gaps = {b: {pos: r.randint(1, 3) for pos in r.sample(range(13), 3)} for b in range(3)}
        for b in range(3):
            tables["block"].append((t, b, "".join(r.choice("ACGT") for _ in range(12))))
            tables["gap"] += [(t, b, pos, k) for pos, k in gaps[b].items()]
            tables["block_mut"].append((t, 0, b, b, r.choice(["ins", "ins_inv"])))
        for i in range(1, n):
            if r.random() < 0.2:
                tables["block_mut"].append((t, i, 0, r.randrange(3), r.choice(["ins", "ins_inv", "del", "inv"])))
        start = {(b, pos, -1): c for u, b, text_ in tables["block"] if u == t for pos, c in enumerate(text_)}
        stands: list[dict] = []
        for i in range(n):
            stands.append(dict(start if i == 0 else stands[parent[i]]))
            places = [(b, pos, -1) for b in range(3) for pos in range(12)] + [(b, pos, k) for b in range(3) for pos, m in gaps[b].items() for k in range(m)]
            for k, (b, pos, gap_pos) in enumerate(r.sample(places, r.randint(0, 9))):
                old = stands[i].get((b, pos, gap_pos), "-")
                new = stands[i][b, pos, gap_pos] = r.choice("ACGT-N".replace(old, ""))
                tables["nuc_mut"].append((t, i, k, b, pos, gap_pos, "I" if old == "-" else "D" if new == "-" else "S", 1, new))
        tables["seq_meta"] += [(t, i, r.randint(0, 3), r.randint(0, 1), r.random() < 0.5) for i in r.sample(range(n), 4)]
    return Network({name: spark.createDataFrame(rows, schemas.TABLES[name]).cache() for name, rows in tables.items()}), tables


@pytest.mark.parametrize("kind", ["random", "ladder"])
def test_old_bases_and_records_from_paths(spark, monkeypatch, kind):
    """Over stretches of any size the nearest ancestor's base, and the records that whole texts give."""
    import random

    from cladeframe.operators import replay

    r = random.Random(len(kind))
    net, tables = random_network(spark, r, kind)
    parent = {(x[0], x[1]): x[3] for x in tables["node"]}
    wrote = {(x[0], x[1], *x[3:6]): x[8] for x in tables["nuc_mut"]}
    turns = {}
    for t, i, k, b, what in tables["block_mut"]:
        turns.setdefault((t, i), []).append((k, b, what))

    def there(t, i):
        blocks = set() if parent[t, i] is None else there(t, parent[t, i])
        for _, b, what in sorted(turns.get((t, i), [])):
            blocks = blocks - {b} if what == "del" else blocks if what == "inv" else blocks | {b}
        return blocks

    want = set()
    for (t, i, *place), new in wrote.items():
        up = parent[t, i]
        while up is not None and (t, up, *place) not in wrote:
            up = parent[t, up]
        if place[0] in there(t, i):
            want.add((t, i, *place, new, None if up is None else wrote[t, up, *place]))
    tips = net.node_ids(tips=True)
    texts = sequence.sequences(net.tables, tips, aligned=True).cache()
    for stretch in (7, 4096):
        monkeypatch.setattr(replay, "STRETCH", stretch)
        got = replay.old_bases(net.tables).select("tree_id", "node_id", "block_id", "pos", "gap_pos", "new", "old").collect()
        assert len(got) == len(want) and {tuple(x) for x in got} == want
        for ref in ("t0n5",) if stretch == 7 else ("t2n39",):
            ref_id = net["node"].where(F.col("name") == ref).select("tree_id", "node_id")
            own = sequence.sequences(net.tables, ref_id, aligned=True)
            told = variants.variant_records(texts.join(own.select("tree_id"), "tree_id"), own)
            assert sorted(map(tuple, variants.tip_records(net.tables, ref_id).collect())) == sorted(map(tuple, told.collect()))


def test_records_of_columns():
    """Differing columns alone give what whole texts give."""
    import random

    r = random.Random(9)
    for _ in range(3000):
        a, b = ("".join(r.choice("AC--") for _ in range(r.randint(1, 12))) for _ in range(2))
        n = min(len(a), len(b))
        a, b = a[:n], b[:n]
        bases = a.replace("-", "")
        rows = []
        for i in range(n):
            if a[i] != b[i]:
                upto = n - i and len(a[: i + 1].replace("-", ""))
                before = upto - (a[i] != "-")
                rows.append((upto, a[i], b[i], bases[before - 1] if before else None, bases[upto] if upto < len(bases) else None))
        assert variants.records_of(rows) == variants.differences(a, b)


def test_guided_order(spark):
    """Paths are chained in the tree's order where it guides them, else by name, as a fold over them in that order."""
    import random

    r = random.Random(5)
    nodes = newick.read_newick(spark.createDataFrame([(0, "((D,A),(C,B));")], "tree_id int, newick string"))
    walks = {p: [r.choice("uvwxyz") for _ in range(9)] for p in "ABCDZ"}
    steps = [(0, p, i, b, True) for p, w in walks.items() for i, b in enumerate(w)]
    paths = spark.createDataFrame(steps, "tree_id int, path string, step int, block string, forward boolean")
    for guide, order in ((None, "ABCDZ"), (nodes, "DACBZ")):
        common: list = []
        for p in order:
            common = graph.merge_chain(common, [(b, p, i) for i, b in enumerate(walks[p])], graph.chain([c[0] for c in common], walks[p]))
        got = graph.order_blocks(paths, guide).collect()
        assert {x.at: x.block for x in got} == {i: c[0] for i, c in enumerate(common)}
        assert {(x.path, x.at) for x in got if (x.block, x.path) in {c[:2] for c in common}} >= {(p, i) for i, (_, p, _) in enumerate(common)}


@pytest.mark.parametrize("kind", ["random", "ladder"])
def test_events_in_rounds(spark, kind):
    """All events at once come to what one after another gives: which count, trees at their time, cuts, sequences."""
    import random

    r = random.Random(len(kind))
    net, tables = random_network(spark, r, kind, n=30)
    names = {x[2]: (x[0], x[1]) for x in tables["node"]}
    parent = {(x[0], x[1]): None if x[3] is None else (x[0], x[3]) for x in tables["node"]}
    pick = lambda: r.choice([*names, "nobody"] if r.random() < 0.3 else list(names))
    rows = [(r.choice("RH"), 9, pick(), 9, pick(), k, k, k, k, 9, pick()) for k in range(45)]
    events = spark.createDataFrame(rows, net["complex_mut"].schema).coalesce(1)

    root_of = {k: k[0] for k in parent if parent[k] is None}

    def where(k):
        while k not in root_of:
            k = parent[k]
        return root_of[k], k

    def above(a, b):
        while b != a and b not in root_of:
            b = parent[b]
        return a == b

    want, after = [], 3
    for e in rows:
        if not all(e[k] in names for k in (2, 4, 10)):
            continue
        p1, p2, c = (names[e[k]] for k in (2, 4, 10))
        if any(where(p)[0] == where(c)[0] and above(c, p) for p in (p1, p2)):
            continue
        t1, t2 = where(p1)[0], where(p2)[0]
        if c not in root_of:
            root_of[c] = after
            after += 1
        want.append((e[0], t1, e[2], t2, e[4], *e[5:9], root_of[c], e[10]))
    assert after > 6 and len(want) < len(rows)
    made = net.create_network(events)
    assert sorted(map(tuple, made["complex_mut"].collect())) == sorted(want)
    placed = {x.name: (x.tree_id, x.node_id, x.parent_id) for x in made["node"].collect()}
    assert placed == {n: (where(k)[0], k[1], None if k in root_of else parent[k][1]) for n, k in names.items()}
    own = {x.name: x.seq for x in net.sequences(aligned=True).collect()}
    assert {x.name: x.seq for x in made.sequences(aligned=True).collect()} == own
