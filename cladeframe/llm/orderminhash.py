"""Near-duplicates by order MinHash.

Each sketch of a document takes the three smallest of its occurrence-labelled five-word shingles
under one hash function and keeps them in text order, so that two documents share a sketch with odds
that fall as shingles differ or change places. Documents that share a sketch are candidates; a banded
alignment of their labelled shingles decides, so that texts whose parts have changed places are no
near-duplicates unless what stands in order is enough.

Work is on distinct texts: copies only join them again at the end. Inside a bucket of one sketch no
pairs are spelled out: every text is aligned with one leader first, connected texts collapse into a
component, and only texts of a bucket that are still in different components are compared, in blocks.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, let_go, slices, stash, tidy, unstash
from .decontam import normal_words

#: Words in a shingle, shingles in a sketch, sketches of a document. At a similarity of 0.8 each sketch
#: is shared with odds of about one half, and none of 24 with odds below 10^-6.
SHINGLE, DRAWN, SKETCHES = 5, 3, 24
#: Text that is sketched at once, in bytes.
SLICE = 4 << 20
#: Texts of a bucket that are compared side by side, and slots that their shingles are counted in first.
BLOCK_TEXTS, SLOTS = 256, 1 << 12

_POWER = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(SHINGLE)], dtype=np.uint64)
_ODD = np.random.default_rng(20240229).integers(1 << 62, 1 << 63, SKETCHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def shingles(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of hashed words, and each text's first one. A text of fewer words is one shingle."""
    n = np.diff(first)
    count = np.where(n > 0, np.maximum(n - SHINGLE + 1, 1), 0)
    ends = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(ends[-1]) + np.repeat(first[:-1] - ends[:-1], count)
    stop = np.repeat(first[1:], count)
    out = np.zeros(len(at), dtype=np.uint64)
    for k in range(SHINGLE):
        inside = at + k < stop
        out[inside] += words[at[inside] + k] * _POWER[k]
    return _mix(out), ends


def labelled(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """values made distinct within each text: the second, third ... occurrence gets another hash."""
    owner = np.repeat(np.arange(len(first) - 1, dtype=np.uint64), np.diff(first))
    both = values ^ _mix(owner + np.uint64(1))
    order = np.argsort(both, kind="stable")
    ordered = both[order]
    fresh = np.ones(len(ordered), dtype=bool)
    fresh[1:] = ordered[1:] != ordered[:-1]
    run = np.flatnonzero(fresh)
    nth = np.arange(len(ordered)) - np.repeat(run, np.diff(np.append(run, len(ordered))))
    out = values.copy()
    again = nth > 0
    out[order[again]] = _mix(values[order[again]] + nth[again].astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    return out


def sketches(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each text, one key a sketch; all texts have a shingle."""
    starts, sizes = first[:-1], np.diff(first)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    keys = np.empty((len(sizes), SKETCHES), dtype=np.uint64)
    top = np.uint64((1 << 64) - 1)
    for t in range(SKETCHES):
        h = values * _ODD[t]
        places = np.empty((len(sizes), DRAWN), dtype=np.int64)
        for k in range(DRAWN):
            least = np.minimum.reduceat(h, starts)
            found = np.flatnonzero(h == least[owner])
            of = owner[found]
            head = np.ones(len(of), dtype=bool)
            head[1:] = of[1:] != of[:-1]
            places[:, k] = found[head]
            h[places[:, k]] = top
        places.sort(axis=1)
        key = np.full(len(sizes), t + 1, dtype=np.uint64)
        for k in range(DRAWN):
            key = _mix(key * np.uint64(0x9FB21C651E98DF25) + values[places[:, k]])
        keys[:, t] = key
    return keys


@tidy
def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    let_go()
    for batch in batches:
        for part in slices(batch, "text", SLICE):
            words, first, _, _ = normal_words(part.column("text"))
            coded = pc.dictionary_encode(words)
            hashed = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()], dtype=np.uint64)
            flat = hashed[coded.indices.to_numpy()] if len(words) else np.zeros(0, np.uint64)
            short = (flat >> np.uint64(32)).astype("<u4")
            grams, at = shingles(short.astype(np.uint64), first)
            full = np.flatnonzero(np.diff(at))
            keys: list[list[int] | None] = [None] * part.num_rows
            if len(full):
                bounds = np.append(at[full], at[-1])
                found = sketches(labelled(grams, bounds), bounds).view(np.int64)
                for i, row in zip(full.tolist(), found.tolist()):
                    keys[i] = row
            seq = pa.LargeBinaryArray.from_buffers(
                pa.large_binary(), part.num_rows, [None, pa.py_buffer(first.astype(np.int64) * 4), pa.py_buffer(short)]
            )
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("node"), pa.array(keys, pa.list_(pa.int64())), seq.cast(pa.binary())],
                names=["doc_id", "node", "keys", "seq"],
            )


class Shingled:
    """One text's shingles, made from its hashed words and told apart by occurrence, in rising order, with places."""

    def __init__(self, seq: bytes):
        words = np.frombuffer(seq, dtype="<u4").astype(np.uint64)
        grams, at = shingles(words, np.array([0, len(words)]))
        own = labelled(grams, at)
        self.place = np.argsort(own, kind="stable")
        self.own = own[self.place]


def _common(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where two sorted arrays of distinct values have the same."""
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    hit = np.flatnonzero(b[at] == a) if len(b) else np.zeros(0, dtype=np.int64)
    return hit, at[hit]


def alignment(a: Shingled, b: Shingled, least: float) -> float:
    """Similarity of two texts: labelled shingles matched in order, as a share of all, by an alignment within
    a band that holds every pair as similar as `least`. 0 where the shingles in common are too few for that."""
    n, m = len(a.own), len(b.own)
    if not n or not m or min(n, m) < max(n, m) * least - 1e-6:
        return 0.0
    i, j = _common(a.own, b.own)
    if len(i) / (n + m - len(i)) < least:  # no alignment matches more
        return 0.0
    i, j = a.place[i], b.place[j]
    near = np.abs(i - j) <= max(n, m) * (1 - least) + 1
    steps = j[near][np.argsort(i[near], kind="stable")]
    if np.all(steps[1:] > steps[:-1]):
        matched = len(steps)
    else:
        tails: list[int] = []
        for x in steps.tolist():
            k = bisect_left(tails, x)
            if k == len(tails):
                tails.append(x)
            else:
                tails[k] = x
        matched = len(tails)
    return matched / (n + m - matched)


def _verify(least: float):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [
                alignment(Shingled(x.as_buffer()), Shingled(y.as_buffer()), least) >= least
                for x, y in zip(batch.column("seq_a"), batch.column("seq_b"))
            ]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _links(pairs: DataFrame, texts: DataFrame, least: float, name: str) -> DataFrame:
    """Those pairs (a, b) of texts that are similar."""
    first = texts.select(F.col("node").alias("a"), F.col("seq").alias("seq_a"))
    second = texts.select(F.col("node").alias("b"), F.col("seq").alias("seq_b"))
    return stash(pairs.join(first, "a").join(second, "b").mapInArrow(_verify(least), "a binary, b binary"), name)


def components(links: DataFrame) -> DataFrame:
    """node and root, the least node of its component, for every linked node that is no root; links may
    repeat or lead from a node to itself, and without links there are no rows.

    Alternates large and small stars: each node's larger neighbours, then its smaller ones, are
    linked with its least neighbour, until nothing changes. Every round is written, so that none
    depends on the executors of the one before.
    """
    edges, last = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a")
        new = small.select("a", F.col("m").alias("b")).unionByName(
            small.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        )
        before, edges = edges, stash(new.where("a <> b").distinct(), "components")
        if last is not None:
            unstash(before)
        seen = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if tuple(seen) == last:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        last = tuple(seen)


def _slots(texts: list[bytes]) -> np.ndarray:
    """How many shingles of each text fall into each slot."""
    out = np.zeros((len(texts), SLOTS), dtype=np.float32)
    for row, text in zip(out, texts):
        row += np.bincount((Shingled(text).own >> np.uint64(20)).astype(np.int64) & (SLOTS - 1), minlength=SLOTS)
    return out


def _hopeful(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Pairs of texts that may be similar, from their slots: two texts have at most the sum over slots of the
    product of their counts in common, so that no pair of similarity `least` is left out."""
    n, m = a.sum(axis=1)[:, None], b.sum(axis=1)[None, :]
    return (a @ b.T) * (1 + least) >= least * (n + m) - 1e-3


def _compare(least: float):
    """Two blocks of one bucket: links between texts of different components.

    A pair is looked at in the first sketch that it shares, and only if counts of their shingles in slots allow
    the similarity. What a link has joined is not looked at again, so that at most one link a text leaves here, however
    large the bucket is.
    """

    def run(keys: tuple, left: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(left)
        turn, i, j = keys[0].as_py(), keys[2].as_py(), keys[3].as_py()
        node, root = table.column("node").to_pylist(), table.column("root").to_pylist()
        number = {r: k for k, r in enumerate(dict.fromkeys(root))}
        group = np.array([number[r] for r in root])
        sketch = np.array(table.column("keys").to_pylist(), dtype=np.int64)
        seq = table.column("seq").to_pylist()
        side = table.column("blk").to_numpy()
        a, b = np.flatnonzero(side == i), np.flatnonzero(side == j)
        shared = np.zeros((len(a), len(b)), dtype=np.int8)
        earlier = np.zeros((len(a), len(b)), dtype=bool)
        for t in range(sketch.shape[1]):
            same = sketch[a, t][:, None] == sketch[b, t][None, :]
            shared += same
            if t < turn:
                earlier |= same
        wanted = ~earlier & (group[a][:, None] != group[b][None, :])
        if i == j:
            wanted &= a[:, None] < b[None, :]
        if wanted.any():
            own = _slots([seq[k] for k in a.tolist()])
            wanted &= _hopeful(own, own if i == j else _slots([seq[k] for k in b.tolist()]), least)
        x, y = np.nonzero(wanted)
        order = np.argsort(-shared[x, y], kind="stable")
        joined = list(range(len(number)))

        def top(k: int) -> int:
            while joined[k] != k:
                joined[k] = joined[joined[k]]
                k = joined[k]
            return k

        made: dict[int, Shingled] = {}
        found = []
        for p, q in zip(a[x[order]].tolist(), b[y[order]].tolist()):
            r, s = top(group[p]), top(group[q])
            if r != s:
                for k in (p, q):
                    if k not in made:
                        made[k] = Shingled(seq[k])
                if alignment(made[p], made[q], least) >= least:
                    joined[max(r, s)] = min(r, s)
                    found.append((node[p], node[q]))
        yield pa.RecordBatch.from_arrays(
            [pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.binary())], names=["a", "b"]
        )

    return run


def _classes(docs: DataFrame, id_col: str, text_col: str, least: float) -> tuple[DataFrame, DataFrame]:
    """doc_id and node (MD5 of the text) of every row, and node and root of every node that is linked to a lesser one."""
    spark = lean(docs.sparkSession, SLICE)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text.alias("text"), F.unhex(F.md5(text)).alias("node"))
    drawn = stash(rows.mapInArrow(_sketch, "doc_id bigint, node binary, keys array<bigint>, seq binary"), "sketches")

    nodes = drawn.where(F.col("keys").isNotNull()).groupBy("node").agg(F.first("keys").alias("keys"))
    entries = nodes.select("node", F.posexplode("keys").alias("turn", "key"))
    # a frequent sketch is counted before it moves, and its entries are not dealt by key but met by the join
    buckets = entries.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("leader")).where("n > 1")
    shared = stash(entries.join(buckets, "key"), "shared-sketches")

    wanted = shared.select("node").distinct()
    texts = drawn.where(F.col("keys").isNotNull()).join(wanted, "node", "left_semi")
    texts = stash(texts.groupBy("node").agg(F.first("keys").alias("keys"), F.first("seq").alias("seq")), "candidate-texts")

    often = shared.where("node <> leader").groupBy("node", "leader").agg(F.count("*").alias("n"))
    best = often.groupBy("node").agg(F.max(F.struct("n", "leader")).alias("x"))
    stars = best.select(F.col("node").alias("a"), F.col("x.leader").alias("b"))
    links = _links(stars, texts, least, "star-links")
    found = components(links)

    placed = shared.join(found, "node", "left").select("turn", "key", "node", "n", F.coalesce("root", "node").alias("root"))
    mixed = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    members = placed.join(mixed, "key", "left_semi")
    members = members.withColumn("g", F.ceil(F.col("n") / BLOCK_TEXTS).cast("int"))
    members = members.withColumn("blk", F.pmod(F.xxhash64("node"), F.col("g")).cast("int"))
    members = members.join(texts, "node")
    dealt = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    dealt = dealt.withColumn("i", F.least("blk", "other")).withColumn("j", F.greatest("blk", "other"))
    dealt = dealt.select("turn", "key", "i", "j", "node", "root", "keys", "seq", "blk")
    more = stash(dealt.groupBy("turn", "key", "i", "j").applyInArrow(_compare(least), "a binary, b binary"), "cross-links")
    joined = found.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)
    classes = components(joined)
    for spent in (shared, texts):
        unstash(spent)
    return drawn.select("doc_id", "node"), classes


def _by_node(rows: DataFrame, classes: DataFrame, *measures) -> DataFrame:
    """measures of rows for each node, with its root; copies of a text are one row before anything moves by class."""
    return rows.groupBy("node").agg(*measures).join(classes, "node", "left").withColumn("root", F.coalesce("root", "node"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8) -> DataFrame:
    """doc_id, class_id (the least doc_id of the class) and class_size of every row.

    Texts are linked when an alignment of their five-word shingles (lower-cased words of ASCII
    letters, digits and characters above U+007F, the k-th occurrence of a shingle with the k-th) matches
    a share of `least` or more; classes are the connected components of the links. Equal texts are always of one
    class; a null text counts as empty, and texts without words are linked with their copies only.
    Null ids pass through and name no class, unless there is no other; other columns are not read; an
    empty table gives an empty result.
    """
    rows, classes = _classes(docs, id_col, text_col, least)
    nodes = _by_node(rows, classes, F.min("doc_id").alias("lo"), F.count("*").alias("n"))
    totals = nodes.groupBy("root").agg(F.min("lo").alias("class_id"), F.sum("n").alias("class_size"))
    named = nodes.select("node", "root").join(totals, "root").drop("root")
    return rows.join(named, "node").select("doc_id", "class_id", "class_size")


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8) -> DataFrame:
    """docs with one row of each class of near-duplicates: that of the least id (null last), then of the
    least MD5 of its text; of rows equal in both any one. All columns stay."""
    rows, classes = _classes(docs, id_col, text_col, least)
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("node").alias("md5"))
    kept = _by_node(rows, classes, F.min(order).alias("x")).groupBy("root").agg(F.min("x").alias("x")).select("x.*")
    own = F.col(id_col).cast("bigint")
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"),
        own.isNull().alias("none"),
        F.coalesce(own, F.lit(0)).alias("id"),
        F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")))).alias("md5"),
    )
    key = ["md5", "id", "none"]
    found = keyed.join(kept, key, "left_semi").groupBy(key).agg(F.first("__row").alias("__row"))
    return found.select(*[F.col("__row")[c].alias(c) for c in docs.columns])
