"""Ranked lexical search by a threshold-seeded join.

For every query term the documents' impacts are counted by value, which gives its document frequency, its
greatest and its kth impact. The kth impact of one term alone is a lower bound of an item's kth score, so
the greatest of them seeds the item's threshold. An item's terms are ordered by what they can add at most;
the tail of them whose bounds sum to less than the threshold cannot bring a document into the result by
itself, so only the other terms generate candidates. A candidate whose score so far and the tail's bound
fall short is dropped, all others are scored exactly. Items go in blocks of a bounded size against all rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, let_go, ragged, slices, stash, tidy, unstash
from .decontam import normal_words

#: Documents returned for an item.
TOP = 20
#: Terms of items that are searched at once, about 20 MB in a worker.
BLOCK_TERMS = 200_000
#: Slots of the filter that keeps words of documents which no item asks for from being written; a power of two.
SLOTS = 1 << 20
#: Text that is split at once, in bytes, and sums that are built at once.
SLICE, SUMS = 4 << 20, 1 << 21

_HITS = "array<struct<term: string, tf: bigint>>"


def _split(wanted: np.ndarray | None):
    """number of words and distinct terms with their occurrences of every text; terms whose slot is not wanted are left out."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                words, first, _, _ = normal_words(part.column("text"))
                coded = pc.dictionary_encode(words)
                size = max(len(coded.dictionary), 1)
                codes, owner = coded.indices.to_numpy().astype(np.int64), np.repeat(np.arange(part.num_rows), np.diff(first))
                if wanted is not None and len(codes):
                    slot = [zlib.crc32(w.as_buffer()) & (SLOTS - 1) for w in coded.dictionary]
                    kept = wanted[slot][codes]
                    codes, owner = codes[kept], owner[kept]
                key, tf = np.unique(owner * size + codes, return_counts=True)
                bounds = np.searchsorted(key, np.arange(part.num_rows + 1) * size).astype(np.int32)
                terms = coded.dictionary.take(pa.array(key % size)).cast(pa.string())
                hits = pa.StructArray.from_arrays([terms, pa.array(tf.astype(np.int64))], names=["term", "tf"])
                columns = [pa.array(np.diff(first)), pa.ListArray.from_arrays(pa.array(bounds), hits)]
                yield pa.RecordBatch.from_arrays([part.column("id"), *columns], names=["id", "n", "hits"])

    return run


def _weighted(terms: DataFrame, posts: DataFrame, n_docs: int, top: int) -> DataFrame:
    """item, term, gain (the term's weight times its repeats), essential and floor (the threshold that the item
    starts from) of every term of an item that a document holds, and bound, the most that it can add."""
    impact = F.expr("(1000000000L * tf) div (1000L * tf + 12L * m)").alias("impact")
    counts = posts.select("m", F.inline("hits")).select("term", impact).groupBy("term", "impact").agg(F.count("*").alias("n"))
    down = Window.partitionBy("term").orderBy(F.col("impact").desc()).rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn("reached", F.sum("n").over(down))
    kth = F.max(F.when(F.col("reached") >= top, F.col("impact")))
    stats = counts.groupBy("term").agg(F.sum("n").alias("df"), F.max("impact").alias("best"), F.coalesce(kth, F.lit(0)).alias("kth"))
    gain = F.col("times") * F.floor(1000 * F.log((2.0 * n_docs + 2.0) / (2.0 * F.col("df") + 1.0)))
    rows = terms.join(stats, "term").withColumn("gain", gain).where("gain > 0")
    rows = rows.withColumn("bound", F.col("gain") * F.col("best"))
    whole = Window.partitionBy("item")
    up = whole.orderBy("bound", "term").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("floor", F.greatest(F.lit(1).cast("bigint"), F.max(F.col("gain") * F.col("kth")).over(whole)))
    return rows.select("item", "term", "gain", "bound", "floor", (F.sum("bound").over(up) >= F.col("floor")).alias("essential"))


class Items:
    """Terms of a block of items: by term those that generate candidates, by item those that only add to a score."""

    def __init__(self, rows: pa.Table):
        self.items, item = np.unique(rows.column("item").to_numpy(), return_inverse=True)
        coded = pc.dictionary_encode(rows.column("term").combine_chunks())
        self.terms, term = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        gain, bound = rows.column("gain").to_numpy(), rows.column("bound").to_numpy()
        lead = rows.column("essential").to_numpy(zero_copy_only=False).astype(bool)
        self.floor = np.zeros(len(self.items), dtype=np.int64)
        self.floor[item] = rows.column("floor").to_numpy()
        self.tail = np.zeros(len(self.items), dtype=np.int64)
        np.add.at(self.tail, item[~lead], bound[~lead])
        self.lead = self._by(term, item, gain, lead, len(self.terms))
        self.rest = self._by(item, term, gain, ~lead, len(self.items))

    @staticmethod
    def _by(key, value, gain, chosen, n):
        """Starts and lengths of every key's rows, and their values and gains."""
        at = np.flatnonzero(chosen)
        at = at[np.argsort(key[at], kind="stable")]
        size = np.bincount(key[at], minlength=n)
        return np.cumsum(size) - size, size, value[at], gain[at]


def _sums(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key, kind="stable")
    key, value = key[order], value[order]
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[head], np.add.reduceat(value, head) if len(key) else value


def _candidates(block: Items, floor: np.ndarray, owner, code, impact) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """item, row and exact score of all pairs that reach the item's floor; hits are sorted by row and term."""
    n = len(block.items)
    start, size, item, gain = block.lead
    at, times = ragged(code, start, size)
    key, score = _sums(np.repeat(owner, times) * n + item[at], gain[at] * np.repeat(impact, times))
    row, who = key // n, key % n
    near = score + block.tail[who] >= floor[who]
    row, who, score = row[near], who[near], score[near]
    start, size, term, gain = block.rest
    at, times = ragged(who, start, size)
    width = len(block.terms)
    known = owner * width + code
    asked = np.repeat(row, times) * width + term[at]
    place = np.minimum(np.searchsorted(known, asked), len(known) - 1) if len(known) else np.zeros(0, np.int64)
    more = np.where(known[place] == asked, gain[at] * impact[place], 0) if len(known) else np.zeros(0, np.int64)
    total = np.concatenate([[0], np.cumsum(more)])
    ends = np.cumsum(times)
    score = score + total[ends] - total[ends - times]
    good = score >= floor[who]
    return who[good], row[good], score[good]


def _search(block: Items, top: int):
    """The best documents of every item in a task; an item's floor rises with what the task has found."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        floor = block.floor.copy()
        best = tuple(np.zeros(0, dtype=np.int64) for _ in range(4))  # item, score, null, id
        for batch in batches:
            hits = batch.column("hits")
            flat = hits.flatten()
            code = pc.fill_null(pc.index_in(flat.field("term"), value_set=block.terms), -1).to_numpy().astype(np.int64)
            owner = np.repeat(np.arange(batch.num_rows), np.asarray(pc.list_value_length(hits)))
            m, tf = np.asarray(batch.column("m"))[owner], np.asarray(flat.field("tf"))
            asked = np.flatnonzero(code >= 0)
            asked = asked[np.lexsort((code[asked], owner[asked]))]
            owner, code = owner[asked], code[asked]
            impact = 1_000_000_000 * tf[asked] // (1000 * tf[asked] + 12 * m[asked])
            ids = batch.column("doc_id")
            none, ids = np.asarray(ids.is_null()).astype(np.int64), np.asarray(pc.fill_null(ids, 0))
            load = np.concatenate([[0], np.cumsum(block.lead[1][code])])
            by_row = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            lo = 0
            while lo < batch.num_rows:  # whole rows, so many that their sums fit
                hi = max(lo + 1, int(np.searchsorted(load[by_row], load[by_row[lo]] + SUMS, side="right")) - 1)
                part = slice(by_row[lo], by_row[hi])
                who, row, score = _candidates(block, floor, owner[part], code[part], impact[part])
                best = tuple(np.concatenate(x) for x in zip(best, (who, score, none[row], ids[row])))
                order = np.lexsort((best[3], best[2], -best[1], best[0]))
                best = tuple(x[order] for x in best)
                first = np.searchsorted(best[0], np.arange(len(block.items) + 1))
                nth = np.arange(len(best[0])) - first[best[0]]
                full = np.flatnonzero(nth == top - 1)
                floor[best[0][full]] = np.maximum(floor[best[0][full]], best[1][full])
                best = tuple(x[nth < top] for x in best)
                lo = hi
        who, score, none, ids = best
        columns = [pa.array(block.items[who]), pa.array(ids, mask=none.astype(bool)), pa.array(score)]
        yield pa.RecordBatch.from_arrays(columns, names=["item", "doc_id", "score"])

    return run


def search(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", top: int = TOP
) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of the `top` best documents of every item, all if fewer score above 0.

    Terms are runs of ASCII letters, digits and characters above U+007F with A-Z lower-cased. A term weighs
    w = floor(1000 ln((2N + 2) / (2 df + 1))) in a corpus of N documents with a term, df of them with this one; a document of n
    terms with repeats, of L in all, has m = 75 + (25 n N) div L, and scores w ((10^9 tf) div (1000 tf + 12 m)) for every term
    of the item, repeats included. Equal scores go by the smaller id, null last. Null texts have no terms; null
    and repeated ids of documents rank row by row; repeated rows of items are one item, an item of null id is
    one like others, and two texts under one item id are two items, each ranked from 1; items without hits
    give no row; other columns are not read; an empty table on either side gives none.
    """
    spark = lean(docs.sparkSession, SLICE)
    known = stash(
        items.select(F.col(item_col).alias("item_id"), F.col(item_text).cast("string").alias("text")).distinct().withColumn("id", F.monotonically_increasing_id()),
        "items",
    )
    asked = known.select("id", "text").mapInArrow(_split(None), f"id bigint, n bigint, hits {_HITS}")
    terms = stash(asked.select(F.col("id").alias("item"), F.inline("hits")).withColumnRenamed("tf", "times"), "item-terms")
    slots = np.zeros(SLOTS, dtype=bool)
    for r in terms.select((F.crc32(F.col("term").cast("binary")) % SLOTS).alias("slot")).distinct().collect():  # SLOTS rows at most
        slots[r.slot] = True

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    raw = rows.mapInArrow(_split(slots), f"id bigint, n bigint, hits {_HITS}").where("n > 0")
    split = stash(raw.withColumnRenamed("id", "doc_id"), "postings")
    n_docs, length = split.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(1))).first()
    posts = split.withColumn("m", F.expr(f"75L + (25L * n * {n_docs}L) div {length}L")).drop("n")

    weighted = stash(_weighted(terms, posts, n_docs, top), "weighted-terms")
    blocks = -(-weighted.count() // BLOCK_TERMS)
    parts = []
    for b in range(blocks):  # an item is never parted
        own = weighted.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).toArrow()
        if own.num_rows:
            parts.append(stash(posts.mapInArrow(_search(Items(own), top), "item bigint, doc_id bigint, score bigint"), "best"))
    for spent in (weighted, terms, split):
        unstash(spent)
    if not parts:
        return known.limit(0).select("item_id", F.lit(1).alias("rank"), F.col("id").alias("doc_id"), F.col("id").alias("score"))
    best = parts[0]
    for part in parts[1:]:
        best = best.unionByName(part)
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(known.select(F.col("id").alias("item"), "item_id"), "item").select("item_id", "rank", "doc_id", "score")
