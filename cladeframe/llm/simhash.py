"""Near-duplicates by SimHash with a Gray-order hierarchical index.

Fingerprints that differ in few bits agree wholly under one of a few masks, so the uppermost nodes of
the index are pairs of a mask and the bits that its members share under it: one row for each mask and
fingerprint, dealt by node. A node that holds too many is parted by further masks of its free bits, until
its free bits alone bound it, so that every group fits a task and no link is lost. Below such a node Spark
sorts fingerprints by their Gray rank; runs of neighbours form nodes that keep the bits on which all
members agree, runs of nodes form the next level, and a pair of nodes whose shared bits already differ
too often is pruned with all pairs below it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_words, flat_bytes, lean, let_go, slices, stash, tidy, unstash
from .orderminhash import components

#: Bits of a fingerprint, words of a shingle, seed of XXH64.
BITS, SHINGLE, SEED = 64, 3, 42
#: Fingerprints that one node of a mask may hold before it is parted by further masks.
NODE = 1 << 14
#: Children of a node below the masks, and pairs of children that are compared at once.
FAN, PAIRS = 8, 1 << 20
#: Text that is hashed at once, in bytes, and shingles whose bits are counted at once.
SLICE, COUNTED = 4 << 20, 1 << 17

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_INSIDE = np.ones(256, dtype=bool)
_INSIDE[[32, 9, 10, 11, 12, 13]] = False


def shingle_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every shingle of the texts, and each text's first one (one more at the end). A text of
    fewer words is one shingle, a text without words has none."""
    data, offsets = flat_bytes(texts)
    words, first, start, end = byte_words(_LOWER[data], offsets, _INSIDE)
    size = end - start
    spaced = np.full(int(size.sum()) + len(size), 32, dtype=np.uint8)
    spaced[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = np.frombuffer(words.buffers()[2], np.uint8)[: int(size.sum())]
    at = np.cumsum(size + 1) - (size + 1)
    n = np.diff(first)
    count = np.where(n > 0, np.maximum(n - SHINGLE + 1, 1), 0)
    bounds = np.concatenate([[0], np.cumsum(count)])
    head = np.arange(bounds[-1]) + np.repeat(first[:-1] - bounds[:-1], count)
    last = np.minimum(head + SHINGLE - 1, np.repeat(first[1:], count) - 1)
    raw, digest = spaced.tobytes(), xxhash.xxh64_intdigest
    spans = zip(at[head].tolist(), (at[last] + size[last]).tolist())
    return np.fromiter((digest(raw[a:b], SEED) for a, b in spans), dtype=np.uint64, count=len(head)), bounds


def fingerprints(texts: pa.Array) -> np.ndarray:
    """One unsigned 64-bit fingerprint a text: a bit is 1 if it is set in over half of the shingles' hashes."""
    hashes, bounds = shingle_hashes(texts)
    n = np.diff(bounds)
    owner = np.repeat(np.arange(len(n)), n)
    ones = np.zeros((len(n), BITS), dtype=np.int64)
    for lo in range(0, len(hashes), COUNTED):
        part, own = hashes[lo : lo + COUNTED], owner[lo : lo + COUNTED]
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        head = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        ones[own[head]] += np.add.reduceat(bits, head, axis=0, dtype=np.int32)
    return np.packbits(2 * ones > n[:, None], axis=1, bitorder="little").view("<u8").ravel()


@tidy
def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    let_go()
    for batch in batches:
        for part in slices(batch, "text", SLICE):
            print64 = pa.array(fingerprints(part.column("text")).view(np.int64))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), print64], names=["doc_id", "fp"])


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def masks_below(mask: int, distance: int) -> list[int]:
    """Masks that add to mask one of distance + 1 even parts of its free bits: of two fingerprints that agree
    under mask and differ in at most distance bits, one of these masks hides every difference."""
    free = [b for b in range(BITS - 1, -1, -1) if not mask >> b & 1]
    parts = np.array_split(np.array(free, dtype=object), distance + 1)
    return [mask | sum(1 << int(b) for b in part) for part in parts]


def gray_rank(code):
    """A column that rises with the place of code in the Gray sequence, as a signed number."""
    for step in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, step))
    return code.bitwiseXOR(F.lit(-(1 << (BITS - 1))))


def hierarchy(group: np.ndarray, codes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Levels over sorted codes from the bottom up, none across two groups and one node a group at the top:
    for each node the pattern, the mask of the bits on which all below it agree, and its first child (one more at the end)."""
    change = np.concatenate([[True], group[1:] != group[:-1]])
    groups = int(change.sum())
    owner = np.cumsum(change) - 1
    place = np.arange(len(codes)) - np.flatnonzero(change)[owner]
    some = every = codes
    levels = []
    while not levels or len(owner) > groups:
        place = place // FAN
        head = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (place[1:] != place[:-1])]))
        first = np.append(head, len(owner))
        some, every = np.bitwise_or.reduceat(some, head), np.bitwise_and.reduceat(every, head)
        owner, place = owner[head], place[head]
        levels.append((every, ~(some ^ every), first))
    return levels


def _join(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Give the members of linked components one label, the least."""
    while True:
        while np.any((up := label[label]) != label):
            label[:] = up
        r, s = label[i], label[j]
        apart = r != s
        if not apart.any():
            return
        i, j, r, s = i[apart], j[apart], r[apart], s[apart]
        np.minimum.at(label, np.maximum(r, s), np.minimum(r, s))


def linked(group: np.ndarray, codes: np.ndarray, distance: int) -> np.ndarray:
    """For each code, the least position in its component, where codes of one group that differ in at most
    distance bits are linked. Codes stand by group; their order inside a group decides the work only."""
    label = np.arange(len(codes))
    if not len(codes):
        return label
    levels = hierarchy(group, codes)
    below = [(codes, np.full(len(codes), ~np.uint64(0)))] + [(bits, same) for bits, same, _ in levels]
    top = np.arange(len(levels[-1][0]))
    stack = [(len(levels) - 1, top, top)]
    while stack:
        depth, a, b = stack.pop()
        first = levels[depth][2]
        wide = first[b + 1] - first[b]
        n = (first[a + 1] - first[a]) * wide
        if n.sum() > PAIRS and len(a) > 1:
            half = len(a) // 2
            stack += [(depth, a[:half], b[:half]), (depth, a[half:], b[half:])]
            continue
        pair = np.repeat(np.arange(len(a)), n)
        at = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
        x, y = first[a[pair]] + at // wide[pair], first[b[pair]] + at % wide[pair]
        keep = x <= y if depth else x < y
        x, y = x[keep], y[keep]
        bits, same = below[depth]
        near = np.bitwise_count((bits[x] ^ bits[y]) & same[x] & same[y]) <= distance
        x, y = x[near], y[near]
        if not len(x):
            continue
        if depth:
            stack.append((depth - 1, x, y))
        else:
            _join(label, x, y)
    return label


def _search(distance: int):
    """Links that join the components of each group; rows come sorted by group, and a group that goes on is held back."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        held = np.zeros((3, 0), dtype=np.int64)
        for batch in chain(batches, [None]):
            if batch is not None:
                held = np.concatenate([held, [batch.column(c).to_numpy() for c in ("mask", "key", "fp")]], axis=1)
            fresh = np.flatnonzero(np.any(held[:2, 1:] != held[:2, :-1], axis=0)) + 1
            stop = held.shape[1] if batch is None else int(fresh[-1]) if len(fresh) else 0
            if not stop:
                continue
            group = np.zeros(stop, dtype=np.int64)
            group[fresh[fresh < stop]] = 1
            codes = held[2, :stop]
            label = linked(np.cumsum(group), codes.view(np.uint64), distance)
            moved = np.flatnonzero(label != np.arange(stop))
            held = np.ascontiguousarray(held[:, stop:])
            yield pa.RecordBatch.from_arrays([pa.array(codes[moved]), pa.array(codes[label[moved]])], names=["a", "b"])

    return run


def links(prints: DataFrame, distance: int = 2, node: int = NODE) -> DataFrame:
    """Written links (a, b) that connect exactly those of the distinct fingerprints fp whose chains differ in at
    most distance bits a step. Nodes of more than `node` fingerprints are parted by further masks, at most as often
    as it takes until their free bits allow no more; a node of NODE comes to 81 masks for two bits."""
    level = {0: masks_below(0, distance)}
    rows = prints.select("fp", F.explode(F.array(*[F.lit(_signed(m)) for m in level[0]])).alias("mask"))
    found = []
    while True:
        rows = rows.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        # nodes are counted before anything moves, and members of a large one are met by the join
        sizes = rows.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1")
        held = stash(rows.join(sizes, ["mask", "key"]), "mask-nodes")
        small = held.where(F.col("n") <= node).select("mask", "key", "fp", gray_rank(F.col("fp")).alias("gray"))
        dealt = small.repartition("mask", "key").sortWithinPartitions("mask", "key", "gray")
        found.append(stash(dealt.select("mask", "key", "fp").mapInArrow(_search(distance), "a bigint, b bigint"), "links"))
        large = held.where(F.col("n") > node)
        if large.isEmpty():
            unstash(held)
            break
        level = {m: masks_below(m, distance) for below in level.values() for m in below}
        choice = F.create_map(*[x for m, b in level.items() for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(c)) for c in b]))])
        before, rows = held, stash(large.select("fp", F.explode(choice[F.col("mask")]).alias("mask")), "mask-parts")
        unstash(before)
    if len(found) == 1:
        return found[0]
    both = found[0]
    for more in found[1:]:
        both = both.unionByName(more)
    out = stash(both, "links")
    for part in found:
        unstash(part)
    return out


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 2) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed number), component_id (the least doc_id of the component) and
    component_size of every row.

    Texts are lower-cased in A-Z and split at blanks, tabs and line ends; every run of three words, repeats
    included, votes with its XXH64. Fingerprints that differ in at most `distance` bits are linked, and components
    are all that links connect. A text of one or two words has one vote; null texts and texts without words have
    the fingerprint 0 and are linked like any other. Null ids pass through and name no component, unless
    there is no other; repeated rows each come back; other columns are not read; no rows give none.
    """
    spark = lean(docs.sparkSession, SLICE)
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = stash(texts.mapInArrow(_fingerprint, "doc_id bigint, fp bigint"), "fingerprints")
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("lo"), F.count("*").alias("n"))
    pairs = links(nodes, distance)
    roots = components(pairs).select(F.col("node").alias("fp"), "root")
    placed = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    totals = placed.groupBy("root").agg(F.min("lo").alias("component_id"), F.sum("n").alias("component_size"))
    named = stash(placed.join(totals, "root").drop("root", "lo"), "components-named")
    unstash(pairs)
    # fingerprints of over a thousandth of all rows, less than a thousand in number, are joined where their rows are
    total = rows.count()
    often = F.broadcast(named.where(F.col("n") * 1000 > total).withColumn("often", F.lit(True)).drop("n"))
    met = rows.join(often, "fp", "left")
    columns = ["doc_id", "fp", "component_id", "component_size"]
    rest = met.where("often IS NULL").select("doc_id", "fp").join(named, "fp").select(columns)
    return met.where("often").select(columns).unionByName(rest)
