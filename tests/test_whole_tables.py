"""Queries that once read a part of their tables, over whole ones."""

import random
import re
from collections import Counter, defaultdict

import pytest

from cladeframe.functions import codes
from cladeframe.operators import graph
from cladeframe.plans import registry

SF = "/root/testdata/sf0.001"


def rows_of(spark, name, sf=SF):
    return [tuple(r) for r in registry.QUERIES[name](spark, sf).collect()]


def test_gfa_lines(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet").collect()
    walks = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/lineitem.parquet").collect():
        walks[r.l_orderkey].append((r.l_linenumber, r.l_partkey, r.l_suppkey))
    want = [("S", str(r.o_orderkey), f"S\t{r.o_orderkey}\t{r.o_orderpriority}") for r in orders]
    want += [("P", str(k), f"P\t{k}\t{','.join(f'{x[1]}+' for x in sorted(w))}\t*") for k, w in walks.items()]
    assert sorted(rows_of(spark, "gfa_lines")) == sorted(want)


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    """Folder of documents of up to 300 bases in three sources, with gap columns beyond 60, and their sequences."""
    r = random.Random(5)
    rows = []
    for i in range(30):
        n = r.choice([0, 1, 2, 31, 32, 33, 61, 129, 250, 300])
        chars = [r.choice("ACGTacgtN.") for _ in range(n)]
        if i % 3 == 1:
            for k in (5, 70, 71, 200):
                chars[k : k + 1] = "." * len(chars[k : k + 1])
        rows.append((i, "".join(chars) + " xyz", f"s{i % 3}"))
    rows += [(30, None, "s0"), (31, "", "s1"), (32, "A" * 300, "s2"), (33, "C" * 10, None)]
    folder = str(tmp_path_factory.mktemp("texts"))
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{folder}/documents.parquet")
    seqs = {i: (s, re.sub("[^ACGTN.]", "", t.upper()).replace(".", "-")) for i, t, s in rows if t is not None}
    return folder, seqs


def test_alignment_columns(spark, texts):
    folder, seqs = texts
    column = defaultdict(dict)
    for i, (source, s) in seqs.items():
        for k, c in enumerate(s):
            column[source, k][i] = c
    real = {k: {i: c for i, c in x.items() if c != "-"} for k, x in column.items()}
    want = {(*k, x[min(x)]) for k, x in real.items() if x}
    assert Counter(rows_of(spark, "msa_consensus", folder)) == Counter(want)
    kept = Counter(i for k, x in column.items() if real[k] or k[0] is None for i in x)
    assert dict(rows_of(spark, "drop_gap_columns", folder)) == kept
    genotypes = {(*k, c, list(x.values()).count(c), g + 1) for k, x in column.items() for g, c in enumerate(sorted(set(x.values())))}
    assert Counter(rows_of(spark, "variant_genotype", folder)) == Counter(genotypes)


def test_variant_diff(spark, texts):
    folder, seqs = texts
    want = []
    for i, (source, s) in seqs.items():
        if source is not None:
            old = seqs[min(j for j, x in seqs.items() if x[0] == source)][1]
            marks = "".join("x" if a != b else "." for a, b in zip(s, old))
            want += [(i, m.start(), old[m.start() : m.end()], s[m.start() : m.end()]) for m in re.finditer("x+", marks)]
    assert any(r[1] > 60 for r in want)
    assert Counter(rows_of(spark, "variant_diff", folder)) == Counter(want)


def test_whole_sequences(spark, texts):
    folder, seqs = texts
    code = {c: k for k, c in enumerate("-ACMGRSVTWYHKDBN")}
    got = Counter((r[0], r[1], r[2], r[3] or 0) for r in rows_of(spark, "code_encode", folder))
    assert got == Counter((i, k, c, code[c]) for i, (_, s) in seqs.items() for k, c in enumerate(s))
    bare = {i: s.replace("-", "") for i, (_, s) in seqs.items()}
    words = [(i, k // 8, sum(code[c] << 4 * (7 - j) for j, c in enumerate(s[k : k + 8]))) for i, s in bare.items() for k in range(0, len(s), 8)]
    assert Counter(rows_of(spark, "pack_consensus", folder)) == Counter(words)
    assert {k: v for k, v in rows_of(spark, "unpack_consensus", folder) if k in bare} == bare


def test_codons_and_chunks(spark, texts):
    folder, seqs = texts
    only = {i: re.sub("[^ACGT]", "", s) for i, (_, s) in seqs.items()}
    residue = lambda c: codes.THREE[codes.RESIDUES["TCAG".index(c[0]) * 16 + "TCAG".index(c[1]) * 4 + "TCAG".index(c[2])]]
    want = [(i, k // 3, s[k : k + 3], residue(s[k : k + 3])) for i, s in only.items() for k in range(0, len(s) - 2, 3)]
    assert any(r[1] >= 20 for r in want)
    assert Counter(rows_of(spark, "codon_translate", folder)) == Counter(want)
    chunks = {(k // 32, s[k : k + 32].replace("-", "")) for _, s in seqs.values() for k in range(0, len(s), 32)}
    chunks = sorted(x for x in chunks if x[1])
    numbered = [(k, s, 1 + [x for x in chunks if x[0] == k].index((k, s))) for k, s in chunks]
    assert max(chunks)[0] > 3
    assert Counter(rows_of(spark, "segment_chunks", folder)) == Counter(numbered)


@pytest.fixture(scope="module")
def users(spark, tmp_path_factory):
    """Folder of events of users of up to 230 events, and each user's event types in order of time."""
    r = random.Random(6)
    lists = {u: [r.choice("abcdefgh") for _ in range(n)] for u, n in enumerate([60, 75, 40, 215, 230, 1])}
    lists[1] = lists[0][30:] + lists[0][:30]  # the circle begins beyond the 30th event
    lists[4] = lists[3][140:] + lists[3][:140]
    rows = [(u, 1000 * u + k, c, k) for u, x in lists.items() for k, c in enumerate(x)]
    r.shuffle(rows)
    folder = str(tmp_path_factory.mktemp("users"))
    frame = spark.createDataFrame(rows, "user_id long, event_id long, event_type string, ts long")
    frame.selectExpr("user_id", "event_id", "event_type", "timestamp_seconds(ts) AS ts").write.parquet(f"{folder}/events.parquet")
    return folder, lists


def plain_chain(a, b):
    points = [(i, j) for i, p in enumerate(a) for j, q in enumerate(b) if p == q]
    score, size = {}, {}
    for x, y in points:
        score[x, y], size[x, y] = (graph.WORTH if (x, y) == (0, 0) else graph.FLOOR), 1
        if (x, y) == (0, 0):
            continue
        wall_x = wall_y = -1
        for p in range(x - 1, -1, -1):
            for q in range(y - 1, -1, -1):
                if (p, q) in score and not (p <= wall_x and q <= wall_y):
                    gain = score[p, q] + graph.WORTH - (x - p) - (y - q)
                    if gain > score[x, y]:
                        score[x, y], size[x, y] = gain, size[p, q] + 1
                    wall_x, wall_y = max(wall_x, p - 1), max(wall_y, q - 1)
            if wall_x >= p - 1 and wall_y >= y - 2:
                break  # all that is left lies behind the wall
    return size[max(points, key=lambda s: score[s])] if points else 0


def plain_rotation(a, b):
    """Cells of a local alignment against a circle, one at a time."""
    n = len(b)
    last, origin, best, where = [-1] * n, [-1] * n, None, -1
    for block in a:
        row, begins = [], []
        for c in range(n):
            diagonal, left = last[c - 1] + (graph.MATCH if b[c] == block else graph.MISMATCH), last[c] + graph.GAP
            if diagonal >= left:
                row.append(diagonal)
                begins.append(origin[c - 1] if origin[c - 1] >= 0 else c)
            else:
                row.append(left)
                begins.append(origin[c])
        if row[0] < -1:
            row[0], begins[0] = -1, -1
        for c in range(1, n):
            if row[c - 1] + graph.GAP > row[c]:
                row[c], begins[c] = row[c - 1] + graph.GAP, begins[c - 1]
        last, origin = row, begins
        if best is None or max(row) > best:
            best, where = max(row), begins[row.index(max(row))]
    return max(where, 0)


def test_chains_and_circles(spark, users):
    folder, lists = users
    pairs = [(u, lists[u - 1], x) for u, x in lists.items() if u - 1 in lists]
    assert sorted(rows_of(spark, "chain_best", folder)) == [(u, plain_chain(a, b)) for u, a, b in pairs]
    got = rows_of(spark, "rotation_best", folder)
    assert sorted(got) == [(u, plain_rotation(a, b)) for u, a, b in pairs]
    assert dict(got)[1] == 30


def test_pack_records(spark):
    want = Counter()
    for r in spark.read.parquet(f"{SF}/lineitem.parquet").collect():
        a, b = r.l_partkey % 16, r.l_suppkey % 16
        want[r.l_orderkey, r.l_linenumber, a, b, a << 20 | b << 16, b, 50, (r.l_partkey << 32) + r.l_suppkey] += 1
    assert len({k[1] for k in want}) > 1
    assert Counter(rows_of(spark, "pack_records")) == want
