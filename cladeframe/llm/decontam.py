"""Benchmark decontamination with a generalised suffix automaton of the normalised test items."""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_words, flat_bytes, held, lean, slices, stash, tidy

#: Words of test items in one automaton, about 150 MB in a worker; more items take more passes over the texts.
BLOCK_WORDS = 600_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_INSIDE = np.zeros(256, dtype=bool)
_INSIDE[48:58] = _INSIDE[97:123] = _INSIDE[128:] = True


def normal_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """byte_words() of the texts with A-Z lower-cased; a word holds 0-9, a-z and characters above U+007F."""
    data, offsets = flat_bytes(texts)
    return byte_words(_LOWER[data], offsets, _INSIDE)


class ItemAutomaton:
    """Suffix automaton of many word sequences. A state stands for the word strings that end at the
    same places of the items; link leads to the state of the longest shorter ones. Most states have one
    word behind them, which stands in two arrays; the others of a state are in a table of its own."""

    def __init__(self, items: list[tuple[str | None, str]], window: int):
        self.window = window
        self.word, self.target = array("q", [-1]), array("q", [0])
        self.more: dict[int, dict[int, int]] = {}
        self.link = array("q", [-1])
        self.length = array("q", [0])
        self.vocabulary: dict[str, int] = {}
        words, first, _, _ = normal_words(pa.array([t for _, t in items], pa.string()))
        words = words.to_pylist()
        tokens = [
            [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words[a:b]] for a, b in zip(first[:-1], first[1:])
        ]
        for sequence in tokens:
            last = 0
            for word in sequence:
                last = self._extend(last, word)
        self.shortest = min([min(len(t), window) for t in tokens if t], default=0)
        self._mark([name for name, _ in items], tokens)

    def _state(self, length: int, link: int, like: int | None = None) -> int:
        """A new state, with the words behind the state `like`."""
        new = len(self.length)
        self.length.append(length)
        self.link.append(link)
        self.word.append(-1 if like is None else self.word[like])
        self.target.append(0 if like is None else self.target[like])
        if like in self.more:
            self.more[new] = dict(self.more[like])
        return new

    def to(self, state: int, word: int) -> int:
        """The state behind a word, or -1."""
        if self.word[state] == word:
            return self.target[state]
        others = self.more.get(state)
        return -1 if others is None else others.get(word, -1)

    def _lead(self, state: int, word: int, target: int) -> None:
        if self.word[state] in (-1, word):
            self.word[state], self.target[state] = word, target
        else:
            self.more.setdefault(state, {})[word] = target

    def _split(self, state: int, word: int, target: int) -> int:
        """The state for the longest string of `state` with word behind it; target's shorter strings part from it if need be."""
        if self.length[target] == self.length[state] + 1:
            return target
        copy = self._state(self.length[state] + 1, self.link[target], target)
        self.link[target] = copy
        while state >= 0 and self.to(state, word) == target:
            self._lead(state, word, copy)
            state = self.link[state]
        return copy

    def _extend(self, last: int, word: int) -> int:
        known = self.to(last, word)
        if known >= 0:
            return self._split(last, word, known)
        new = self._state(self.length[last] + 1, 0)
        while last >= 0 and self.to(last, word) < 0:
            self._lead(last, word, new)
            last = self.link[last]
        if last >= 0:
            self.link[new] = self._split(last, word, self.to(last, word))
        return new

    def _mark(self, names: list[str | None], tokens: list[list[int]]) -> None:
        """Note which items own a window, and for each state the state of its window and the short items that end there."""
        window, length, link = self.window, self.length, self.link
        self.owners: dict[int, frozenset[str]] = {}
        short: dict[int, dict[int, frozenset[str]]] = {}
        for name, sequence in zip(names, tokens):
            own = frozenset() if name is None else frozenset([name])
            state = 0
            for i, word in enumerate(sequence):
                state = self.to(state, word)
                while length[link[state]] >= window:
                    state = link[state]
                if i + 1 >= window:
                    before = self.owners.setdefault(state, own)
                    if not own <= before:
                        self.owners[state] = before | own
            if 0 < len(sequence) < window:
                at = short.setdefault(state, {})
                at[len(sequence)] = at.get(len(sequence), frozenset()) | own
        order = sorted(range(1, len(length)), key=length.__getitem__)
        self.at_window = array("q", [0] * len(length))
        self.shorts: list[tuple[tuple[int, frozenset[str]], ...]] = [()] * len(length)
        for state in order:
            up = link[state]
            if length[state] >= window:
                self.at_window[state] = self.at_window[up] or state
            own = short.get(state)
            self.shorts[state] = self.shorts[up] if own is None else (*self.shorts[up], *own.items())

    def hits(self, words: list[int]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans of words (first, end) covered by windows, and the items whose windows occur."""
        first, target, more, link, length = self.word, self.target, self.more, self.link, self.length
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        state = matched = 0
        for i, word in enumerate(words):
            while True:
                if first[state] == word:
                    to = target[state]
                else:
                    to = more[state].get(word, -1) if state in more else -1
                if to >= 0 or not state:
                    break
                state = link[state]
                matched = length[state]
            if to < 0:
                continue
            state, matched = to, matched + 1
            if matched >= self.window:
                spans.append((i + 1 - self.window, i + 1))
                items |= self.owners[self.at_window[state]]
            for n, own in self.shorts[state]:
                if n <= matched:
                    spans.append((i + 1 - n, i + 1))
                    items |= own
        return spans, items


def _hits(automaton: ItemAutomaton, texts: pa.Array) -> tuple[np.ndarray, dict[int, tuple[list[int], list[str]]]]:
    """Words of each text, and of those with hits the bounds of the spans, in order and joined, and the items."""
    words, first, _, _ = normal_words(texts)
    coded = pc.dictionary_encode(words)
    known = np.array([automaton.vocabulary.get(w, -1) for w in coded.dictionary.to_pylist()], dtype=np.int64)
    ids = known[coded.indices.to_numpy()] if len(words) else np.zeros(0, np.int64)
    inside = np.zeros(len(ids) + 2, dtype=np.int8)
    inside[1:-1] = ids >= 0
    edge = np.diff(inside)
    opened, closed = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    found: dict[int, tuple[list[tuple[int, int]], set[str]]] = {}
    if automaton.shortest:
        long = closed - opened >= automaton.shortest
        for a, b in zip(opened[long].tolist(), closed[long].tolist()):
            doc = int(np.searchsorted(first, a, side="right")) - 1
            while a < b:
                end = min(b, int(first[doc + 1]))
                spans, names = automaton.hits(ids[a:end].tolist())
                if spans:
                    shift = a - int(first[doc])
                    kept = found.setdefault(doc, ([], set()))
                    kept[0].extend((x + shift, y + shift) for x, y in spans)
                    kept[1].update(names)
                a, doc = end, doc + 1
    return np.diff(first), {doc: (_joined(spans), sorted(names)) for doc, (spans, names) in found.items()}


def _joined(spans: list[tuple[int, int]]) -> list[int]:
    """Bounds of spans, in order, those that meet as one."""
    out: list[int] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]:
            out[-1] = max(b, out[-1])
        else:
            out += [a, b]
    return out


_BOUNDS, _NAMES = pa.list_(pa.int32()), pa.list_(pa.string())


def _scan(items, key: int, window: int, text_col: str):
    """Rows (__row) with __words, __hit (bounds of spans) and __items."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = held(("items", key, window), lambda: ItemAutomaton(items.value, window))
        for batch in batches:
            for part in slices(batch, "__row", field=text_col):
                n, found = _hits(automaton, pc.struct_field(part.column("__row"), text_col))
                rows = [found.get(i, ([], [])) for i in range(len(n))]
                yield pa.RecordBatch.from_arrays(
                    [part.column("__row"), pa.array(n), pa.array([h for h, _ in rows], _BOUNDS), pa.array([x for _, x in rows], _NAMES)],
                    names=["__row", "__words", "__hit", "__items"],
                )

    return run


def _find(items, key: int, window: int):
    """Of rows of key and text those with hits: key, hit (bounds of spans) and items."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = held(("items", key, window), lambda: ItemAutomaton(items.value, window))
        for batch in batches:
            for part in slices(batch, "text"):
                _, found = _hits(automaton, part.column("text"))
                at = sorted(found)
                yield pa.RecordBatch.from_arrays(
                    [part.column("key").take(pa.array(at, pa.int64())), pa.array([found[i][0] for i in at], _BOUNDS), pa.array([found[i][1] for i in at], _NAMES)],
                    names=["key", "hit", "items"],
                )

    return run


def _settle(text_col: str):
    """Rows of __row, hits and names (lists from several passes, or null) to those of _scan()."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__row", field=text_col):
                _, first, _, _ = normal_words(pc.struct_field(part.column("__row"), text_col))
                hits = [_joined([s for x in h or [] for s in zip(x[::2], x[1::2])]) for h in part.column("hits").to_pylist()]
                names = [sorted({i for x in n or [] for i in x}) for n in part.column("names").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("__row"), pa.array(np.diff(first)), pa.array(hits, _BOUNDS), pa.array(names, _NAMES)],
                    names=["__row", "__words", "__hit", "__items"],
                )

    return run


def _item_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_words: int) -> Iterator[list[tuple[str | None, str]]]:
    block, n = [], 0
    for r in benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).toLocalIterator():
        size = len((r.t or "").encode()) // 4 + 1
        if block and n + size > block_words:
            yield block
            block, n = [], 0
        block.append((r.i, r.t))
        n += size
    yield block


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 13,
    max_percent: int = 5,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """One row per document: __row (the document), __words, __hit (first and end word of each
    covered span, in a row), __items (ids of the items whose windows occur, sorted as strings), n_hit
    and contaminated (at least max_percent of the words are covered, and one at all).

    Items of fewer than window words are one window; items without words match nothing. Items are
    taken in blocks of about block_words words; each block's automaton streams over all documents. Of
    several blocks each writes its hits alone, under the MD5 of their texts, which then meet the
    documents in one join; the texts themselves are not written.
    Null texts have no words; an item without id marks words but adds no name; repeated items and
    documents count as they stand; without items nothing is covered.
    """
    sc = lean(docs.sparkSession).sparkContext
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    schema = rows.select(
        "__row", F.lit(0).cast("bigint").alias("__words"), F.array().cast("array<int>").alias("__hit"), F.array().cast("array<string>").alias("__items")
    ).schema
    blocks = _item_blocks(benchmark, item_col, item_text_col, block_words)
    block, further = next(blocks), next(blocks, None)
    if further is None:
        items = sc.broadcast(block)
        rows = rows.mapInArrow(_scan(items, items._jbroadcast.id(), window, text_col), schema)
    else:
        own = F.unhex(F.md5(F.col("text")))
        texts = docs.select(F.col(text_col).alias("text")).where("text is not null").select(own.alias("key"), "text")
        found = None
        for each in chain([block, further], blocks):
            items = sc.broadcast(each)
            hits = stash(texts.mapInArrow(_find(items, items._jbroadcast.id(), window), "key binary, hit array<int>, items array<string>"), "decontam")
            found = hits if found is None else found.unionByName(hits)
        merged = found.distinct().groupBy("key").agg(F.collect_list("hit").alias("hits"), F.collect_list("items").alias("names"))
        met = rows.withColumn("key", F.unhex(F.md5(F.col("__row")[text_col]))).join(merged, "key", "left")
        rows = met.select("__row", "hits", "names").mapInArrow(_settle(text_col), schema)
    bounds = F.transform("__hit", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x).cast("bigint"))
    n_hit = F.aggregate(bounds, F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    return rows.withColumn("n_hit", n_hit).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 100 >= F.col("__words") * max_percent)
    )


def contamination_digest(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of contamination(), which says what
    becomes of nulls, repeated rows and empty tables."""
    return contamination(docs, benchmark, **options).select(
        F.col("__row")[id_col].alias("doc_id"),
        F.col("__words").alias("n_words"),
        "n_hit",
        F.size("__items").cast("long").alias("n_items"),
        F.sha2(F.array_join("__items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def _cut(text_col: str):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.struct_field(batch.column("__row"), text_col).to_pylist()
            for i, hit in enumerate(batch.column("__hit").to_pylist()):
                if hit:
                    raw = texts[i].encode()
                    _, _, start, end = normal_words(pa.array([texts[i]]))
                    kept, at = [], 0
                    for a, b in zip(hit[::2], hit[1::2]):
                        kept.append(raw[at : start[a]])
                        at = end[b - 1]
                    texts[i] = b"".join([*kept, raw[at:]]).decode()
            yield pa.RecordBatch.from_arrays([batch.column("__row"), pa.array(texts, pa.string())], names=["__row", "__text"])

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """docs without the contaminated rows; from the other rows the covered spans are cut. All columns stay,
    whatever their names; a null text stays null, repeated rows are treated alike, and an empty table of
    documents or of items gives docs as they are."""
    clean = contamination(docs, benchmark, text_col=text_col, **options).where(~F.col("contaminated")).select("__row", "__hit")
    cut = clean.mapInArrow(_cut(text_col), clean.select("__row", F.col("__row")[text_col].alias("__text")).schema)
    return cut.select(*[(F.col("__text") if c == text_col else F.col("__row")[c]).alias(c) for c in docs.columns])
