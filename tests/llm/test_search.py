"""SimHash components, importance resampling and ranked search against plain Python."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cladeframe.llm import lexical, resample, simhash
from cladeframe.llm.queries import QUERIES

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(prints, distance=2):
    top = {p: p for p in prints}

    def find(x):
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for a, b in itertools.combinations(sorted(top), 2):
        if (a ^ b).bit_count() <= distance:
            top[find(a)] = find(b)
    return {p: find(p) for p in top}


def similar(rows):
    prints = [fingerprint(t) for _, t in rows]
    root = components(prints)
    least, size = {}, Counter()
    for (i, _), p in zip(rows, prints):
        if i is not None:
            least[root[p]] = min(i, least.get(root[p], i))
        size[root[p]] += 1
    return Counter((i, f"{p:016x}", least.get(root[p]), size[root[p]]) for (i, _), p in zip(rows, prints))


def test_simhash(spark, edge, rng):
    rows = [(r.doc_id, r.text) for r in edge.collect()]
    base = [f"w{rng.randrange(900)}" for _ in range(400)]
    for k in range(150):
        w = list(base)
        for _ in range(k % 3):
            w[rng.randrange(400)] = f"w{rng.randrange(900)}"
        rows.append((10_000 + k, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit(1)).withColumn("lo", F.lit(2))
    shown = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    got = simhash.similar_documents(docs).select("doc_id", shown, "component_id", "component_size")
    assert Counter(tuple(r) for r in got.collect()) == similar(rows)
    assert simhash.similar_documents(docs.limit(0)).collect() == []
    only = spark.createDataFrame([(None, "a b c d"), (None, "a b c d")], "doc_id long, text string")
    assert [(r.component_id, r.component_size) for r in simhash.similar_documents(only).collect()] == [(None, 2)] * 2


def test_simhash_query(spark, sf, documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    want = Counter((i, p, c) for (i, p, c, _), n in similar(rows).items() for _ in range(n))
    assert Counter(tuple(r) for r in QUERIES["op11_simhash"](spark, sf).select("doc_id", "fingerprint", "component_id").collect()) == want


@pytest.mark.parametrize("distance, node", [(2, simhash.NODE), (2, 25), (1, 40)])
def test_links_of_parted_nodes(spark, rng, distance, node):
    """However nodes are parted by masks, links connect what plain pairs connect."""
    codes = {rng.getrandbits(64) for _ in range(150)}
    for _ in range(3):  # crowds that share most of their bits
        code = rng.getrandbits(64)
        for _ in range(60):
            codes.add(code ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))))
    frame = spark.createDataFrame([(simhash._signed(c),) for c in codes], "fp long")
    top = {c: c for c in codes}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for r in simhash.links(frame, distance, node).collect():
        a, b = r.a & (1 << 64) - 1, r.b & (1 << 64) - 1
        top[max(find(a), find(b))] = min(find(a), find(b))
    want = components(codes, distance)
    for a, b in itertools.combinations(sorted(codes), 2):
        assert (find(a) == find(b)) == (want[a] == want[b])


def test_hierarchy_prunes(rng, monkeypatch):
    codes = np.array(sorted(rng.getrandbits(64) for _ in range(700)), dtype=np.uint64)
    group = np.repeat([0, 1, 2], [1, 640, 59])
    for every, same, first in simhash.hierarchy(group, codes):
        assert first[-1] >= 1 and len(every) == len(same) == len(first) - 1
    monkeypatch.setattr(simhash, "PAIRS", 64)
    assert len(set(simhash.linked(group, codes, 2).tolist())) == 700


def features(text, longest):
    w = WORD.findall(lower(text))
    return len(w), [" ".join(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)]


def ranked(rows, target, buckets=10_000, longest=1, least=20, percent=10, seed=2024):
    def bucket(f):
        return zlib.crc32(f.encode()) % buckets

    source, wanted = Counter(), Counter()
    for _, t in rows:
        source.update(map(bucket, features(t, longest)[1]))
    for t in target:
        wanted.update(map(bucket, features(t, longest)[1]))
    s, t = sum(source.values()), sum(wanted.values())
    out = []
    for i, text in rows:
        n, found = features(text, longest)
        weight = sum(math.floor(1000 * math.log((wanted[b] + 1) * (t and s + buckets or s + buckets) / ((source[b] + 1) * (t + buckets)))) for b in map(bucket, found))
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n >= least])
    able = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return Counter(tuple(r[:5]) for r in out)


@pytest.mark.parametrize("options", [{}, {"longest": 2, "buckets": 97, "least": 1, "percent": 50, "seed": 5}, {"least": 0, "percent": 100}])
def test_resampling(spark, edge, rng, options):
    rows = [(r.doc_id, r.text) for r in edge.collect()]
    rows += [(100 + k, " ".join(f"w{min(rng.randrange(60), rng.randrange(60))}" for _ in range(rng.randint(1, 60)))) for k in range(300)]
    rows += [(100, "w1 w2 " * 15)] * 3  # repeated rows tie with each other
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("weight", F.lit(1)).withColumn("bucket", F.lit("x"))
    target = spark.createDataFrame([(f"w{k} w{k + 1}",) for k in range(20)] + [(None,)], "text string")
    got = resample.rank_documents(docs, target, **options)
    assert Counter(tuple(r) for r in got.collect()) == ranked(rows, [r.text for r in target.collect()], **options)
    drawn = resample.draw_documents(docs, target, **options)
    assert drawn.columns == docs.columns
    assert Counter(r.doc_id for r in drawn.collect()) == Counter(r.doc_id for r in got.where("rank IS NOT NULL").collect())


def test_resampling_empty(spark, edge):
    docs = edge.select("doc_id", "text")
    assert resample.rank_documents(docs.limit(0), docs).collect() == []
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert Counter(tuple(r) for r in resample.rank_documents(docs, docs.limit(0)).collect()) == ranked(rows, [])


def test_ranks_above(spark, rng):
    scores = Counter(rng.choice([rng.randint(-40, 40), rng.randint(-(10**6), 10**6), rng.randint(-(2**60), 2**60)]) for _ in range(400))
    frame = spark.createDataFrame(list(scores.items()), "score long, n long")
    got = {r.score: r.above for r in resample.ranks_above(frame).collect()}
    assert got == {s: sum(n for o, n in scores.items() if o > s) for s in scores}


def best(rows, items, top):
    split = [(i, Counter(WORD.findall(lower(t)))) for i, t in rows]
    split = [(i, c) for i, c in split if c]
    n_docs, length = len(split), sum(sum(c.values()) for _, c in split)
    df = Counter(t for _, c in split for t in c)
    out = []
    for item, text in set(items):
        asked = Counter(WORD.findall(lower(text)))
        found = []
        for i, c in split:
            m = 75 + 25 * sum(c.values()) * n_docs // length
            score = sum(k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, k in asked.items() if t in c)
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, k + 1, f[3], -f[0]) for k, f in enumerate(sorted(found, key=lambda f: f[:3])[:top])]
    return Counter(out)


@pytest.mark.parametrize("block, sums, top", [(lexical.BLOCK_TERMS, lexical.SUMS, 20), (40, 30, 3)])
def test_ranked_search(spark, edge, rng, monkeypatch, block, sums, top):
    """Also with several blocks of items and sums in many pieces; ties, null and repeated ids."""
    monkeypatch.setattr(lexical, "BLOCK_TERMS", block)
    monkeypatch.setattr(lexical, "SUMS", sums)
    rows = [(r.doc_id, r.text) for r in edge.collect()]
    rows += [(100 + k, " ".join(f"w{min(rng.randrange(90), rng.randrange(90))}" for _ in range(rng.randint(1, 40)))) for k in range(300)]
    rows += [(i, "W1 w2 tied") for i in (7000, 7001, 7002, 7001)]
    items = [(k, " ".join(f"w{rng.randrange(95)}" for _ in range(12))) for k in range(15)]
    items += [(50, None), (51, ""), (52, "absent"), (53, "w1 w1 TIED"), (53, "w1 w1 TIED"), (None, "w3 x"), (54, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit(1)).withColumn("id", F.lit(2))
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("item", F.lit(0))
    got = lexical.search(docs, asked, top=top)
    assert Counter(tuple(r) for r in got.collect()) == best(rows, items, top)


def test_ranked_search_empty(spark, edge):
    items = spark.createDataFrame([(1, "one")], "item_id long, text string")
    assert lexical.search(edge.limit(0), items).collect() == []
    none = lexical.search(edge, items.limit(0))
    assert none.collect() == [] and none.columns == ["item_id", "rank", "doc_id", "score"]
