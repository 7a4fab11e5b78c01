"""Language identification by unigram pieces, summed over every segmentation of a word.

A word's probability in a language is the sum, over all ways to cut it into pieces of a fixed public
vocabulary, of the product of the pieces' probabilities; a forward pass finds it, whatever the word's
length. The probabilities are learned from expected counts over all segmentations (forward and
backward passes), beginning with equal ones. A text's score is the mean of its words' log
probabilities.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_words, flat_bytes, held, lean, slices, stash, tidy, unstash

#: Letters of a word up to which plain probabilities cannot underflow; longer words sum logarithms instead.
PLAIN_LETTERS = 30
#: Probability of a letter that no piece covers.
UNKNOWN = 1e-8
#: Text that is scored at once, in bytes.
SLICE = 4 << 20
#: Words that go through a pass together.
GROUP = 20_000
#: Words that one worker keeps scored; beyond it the table starts anew.
CACHE_WORDS = 300_000
#: Rounds of expected counts.
ROUNDS = 3

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_INSIDE = np.zeros(256, dtype=bool)
_INSIDE[97:123] = _INSIDE[128:] = True
_ASCII_LETTER = np.zeros(256, dtype=bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True
_NO_LETTER = re.compile(r"[\W\d_]+")


def held_out(doc_id: Column) -> Column:
    """True for the documents that are never learned from; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _letters(word: str) -> list[str]:
    """The runs of letters of a word whose ASCII letters are lower-cased already."""
    if word.isascii():
        return [word]
    return [p for p in _NO_LETTER.sub(" ", word.lower()).split(" ") if p]


def _words(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
    """Codes of all words in a row, the distinct words, each text's first word, and which texts have an ASCII letter."""
    data, offsets = flat_bytes(texts)
    words, first, _, _ = byte_words(_LOWER[data], offsets, _INSIDE)
    coded = pc.dictionary_encode(words)
    seen = np.concatenate([[0], np.cumsum(_ASCII_LETTER[data])])
    return coded.indices.to_numpy(), coded.dictionary.to_pylist(), first, seen[offsets[1:]] > seen[offsets[:-1]]


class Pieces:
    """The vocabulary as a trie: sorted keys of (state, letter) and the states that they lead to."""

    def __init__(self, pieces: list[str]):
        states: dict[str, int] = {"": 0}
        keys: list[int] = []
        for piece in pieces:
            for k in range(len(piece)):
                if piece[: k + 1] not in states:
                    keys.append(states[piece[:k]] << 21 | ord(piece[k]))
                    states[piece[: k + 1]] = len(states)
        order = np.argsort(np.array(keys, dtype=np.int64), kind="stable")
        self.keys = np.array(keys, dtype=np.int64)[order]
        self.child = (order + 1).astype(np.int64)
        self.piece = np.full(len(states), -1, dtype=np.int64)
        for i, piece in enumerate(pieces):
            if piece:
                self.piece[states[piece]] = i
        self.unknown = len(pieces)

    def arcs(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Every place where a piece stands in a run of letters behind the sign of a word's start, or a single
        letter that is none: its first node, its letters and its piece, by first letter, then letters; and each
        run's first node. A run of n letters has n + 2 nodes, one before each letter, the sign's included."""
        sizes = np.array([len(r) + 1 for r in runs], dtype=np.int64)
        text = np.frombuffer(("".join("▁" + r + "\0" for r in runs)).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        start = np.concatenate([[0], np.cumsum(sizes + 1)])
        inside = np.ones(len(text), dtype=bool)
        inside[start[1:] - 1] = False
        at = np.flatnonzero(inside)
        state = np.zeros(len(at), dtype=np.int64)
        found = []
        length = 0
        while len(at) and len(self.keys):
            wanted = state << 21 | text[at + length]
            place = np.searchsorted(self.keys, wanted)
            place[place == len(self.keys)] = 0
            hit = self.keys[place] == wanted
            at, state = at[hit], self.child[place[hit]]
            length += 1
            whole = self.piece[state]
            here = whole >= 0
            found.append((at[here], np.full(int(here.sum()), length), whole[here]))
            if length == 1:
                single = np.zeros(len(text), dtype=bool)
                single[at[here]] = True
                alone = np.flatnonzero(inside & ~single)
                found.append((alone, np.ones(len(alone), dtype=np.int64), np.full(len(alone), self.unknown)))
        if not found:
            alone = np.flatnonzero(inside)
            found = [(alone, np.ones(len(alone), dtype=np.int64), np.full(len(alone), self.unknown))]
        node, size, piece = (np.concatenate(x) for x in zip(*found))
        nth = node - np.repeat(start[:-1], sizes + 1)[node]
        order = np.lexsort((size, nth))
        return node[order], size[order], piece[order], start


def _steps(node: np.ndarray, size: np.ndarray, start: np.ndarray) -> list[slice]:
    """Stretches of arcs of one first letter and one length: no two of them lead from or to one node."""
    nth = node - start[np.searchsorted(start, node, side="right") - 1]
    cuts = np.flatnonzero((np.diff(nth) != 0) | (np.diff(size) != 0)) + 1
    return [slice(a, b) for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(node)])] if len(node) else []


def _log_sum(values: np.ndarray) -> np.ndarray:
    top = values.max(axis=0)
    return top + np.log(np.exp(values - top).sum(axis=0))


def _log_forward(node: np.ndarray, size: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Logarithms of the sums over all ways from node 0 to each of n nodes, by arcs with logarithms `value`."""
    end = node + size
    order = np.argsort(end, kind="stable")
    cuts = np.searchsorted(end[order], np.arange(1, n + 1))
    out = np.zeros((n, value.shape[1]))
    for b in range(1, n):
        own = order[cuts[b - 1] : cuts[b]]
        out[b] = _log_sum(out[node[own]] + value[own])
    return out


def _log_backward(node: np.ndarray, size: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """The same over all ways from each node to the last."""
    return _log_forward(n - 1 - node - size, size, value, n)[::-1]


def log_probabilities(trie: Pieces, table: np.ndarray, runs: list[str]) -> np.ndarray:
    """For each run of letters, the log of the sum over all its segmentations, in every language. The last
    row of table is the probability of a letter that no piece covers."""
    out = np.empty((len(runs), table.shape[1]))
    long = [k for k, r in enumerate(runs) if len(r) > PLAIN_LETTERS]
    short = sorted((k for k, r in enumerate(runs) if len(r) <= PLAIN_LETTERS), key=lambda k: len(runs[k]))
    for i in range(0, len(short), GROUP):
        part = short[i : i + GROUP]
        node, size, piece, start = trie.arcs([runs[k] for k in part])
        alpha = np.zeros((start[-1], table.shape[1]))
        alpha[start[:-1]] = 1
        for step in _steps(node, size, start):
            alpha[node[step] + size[step]] += alpha[node[step]] * table[piece[step]]
        out[part] = np.log(alpha[start[1:] - 1])
    for k in long:
        node, size, piece, start = trie.arcs([runs[k]])
        out[k] = _log_forward(node, size, np.log(table)[piece], start[1])[-1]
    return out


def expected_counts(trie: Pieces, table: np.ndarray, runs: list[str], times: np.ndarray) -> np.ndarray:
    """Expected number of each piece over all segmentations of runs that occur so many times, by the one column of table."""
    total = np.zeros(trie.unknown + 1)
    long = [k for k, r in enumerate(runs) if len(r) > PLAIN_LETTERS]
    short = sorted((k for k, r in enumerate(runs) if len(r) <= PLAIN_LETTERS), key=lambda k: len(runs[k]))
    for i in range(0, len(short), GROUP):
        part = short[i : i + GROUP]
        node, size, piece, start = trie.arcs([runs[k] for k in part])
        p, steps = table[piece], _steps(node, size, start)
        alpha, beta = np.zeros(start[-1]), np.zeros(start[-1])
        alpha[start[:-1]] = 1
        beta[start[1:] - 1] = 1
        for step in steps:
            alpha[node[step] + size[step]] += alpha[node[step]] * p[step]
        for step in reversed(steps):
            beta[node[step]] += p[step] * beta[node[step] + size[step]]
        weight = times[part] / alpha[start[1:] - 1]
        of = np.searchsorted(start, node, side="right") - 1
        total += np.bincount(piece, alpha[node] * p * beta[node + size] * weight[of], minlength=len(total))
    for k in long:
        node, size, piece, start = trie.arcs([runs[k]])
        value = np.log(table)[piece][:, None]
        alpha, beta = _log_forward(node, size, value, start[1]), _log_backward(node, size, value, start[1])
        share = np.exp(alpha[node] + value + beta[node + size] - alpha[-1])[:, 0]
        total += np.bincount(piece, share * times[k], minlength=len(total))
    return total


@tidy
def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of lang and text to the number of each run of letters in each language."""
    for batch in batches:
        for part in slices(batch, "text", SLICE):
            codes, words, first, _ = _words(part.column("text"))
            lang = pc.dictionary_encode(part.column("lang"))
            lang_of = np.repeat(lang.indices.to_numpy(), np.diff(first))
            runs = [_letters(w) for w in words]
            for k, name in enumerate(lang.dictionary.to_pylist()):
                n = np.bincount(codes[lang_of == k], minlength=len(words))
                rows = [(r, int(n[w])) for w in np.flatnonzero(n) for r in runs[w]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(rows), pa.string()), pa.array([r for r, _ in rows], pa.string()), pa.array([c for _, c in rows], pa.int64())],
                    names=["lang", "word", "n"],
                )


def _expect(model, path: str, languages: list[str]):
    """Rows of lang, word and n to expected counts of pieces in each language."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, table = model.value
        trie = held(("pieces", path), lambda: Pieces(pieces))
        total = np.zeros((len(languages), len(pieces) + 1))
        for batch in batches:
            lang = np.array(batch.column("lang").to_pylist(), dtype=object)
            words, times = np.array(batch.column("word").to_pylist(), dtype=object), batch.column("n").to_numpy()
            for k, name in enumerate(languages):
                own = lang == name
                if own.any():
                    total[k] += expected_counts(trie, np.append(table[:, k], UNKNOWN), words[own].tolist(), times[own])
        for k, name in enumerate(languages):
            used = np.flatnonzero(total[k, :-1])
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(used), pa.string()), pa.array(used, pa.int32()), pa.array(total[k, used])], names=["lang", "piece", "n"]
            )

    return run


def learn(
    docs: DataFrame,
    model: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    docs_a_language: int = 10_000,
    smoothing: float = 0.05,
    rounds: int = ROUNDS,
) -> tuple[list[str], list[str], np.ndarray]:
    """Languages, pieces, and the probability of each piece (row) in each language (column).

    Learns from a bounded sample: of each language about docs_a_language documents that are not held
    out, have text and have a language, chosen by a hash of the id. Each round counts the pieces of the
    sample's words over all segmentations, weighed by the probabilities of the round before; the first
    takes equal ones. The driver receives the sizes of the languages and one count for each piece and
    language. Rows with a null id, text or language teach nothing, repeated rows teach as often as they
    stand; without any row there is no language.
    """
    import sentencepiece

    spark = lean(docs.sparkSession, SLICE)
    open_ = docs.where(~held_out(F.col(id_col)) & F.col(id_col).isNotNull() & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    sizes = {r[0]: r[1] for r in open_.groupBy(lang_col).count().collect()}
    languages = sorted(sizes)
    tokenizer = sentencepiece.SentencePieceProcessor(model_file=model)
    pieces = [tokenizer.id_to_piece(i) for i in range(tokenizer.vocab_size())]
    table = np.full((len(pieces), len(languages)), 1 / len(pieces))
    if not languages:
        return languages, pieces, table
    share = F.lit(0.0)
    for name, n in sizes.items():
        share = F.when(F.col(lang_col) == name, F.lit(min(1.0, docs_a_language / n))).otherwise(share)
    drawn = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1 << 30)) < share * (1 << 30)
    sample = open_.where(drawn).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    words = sample.mapInArrow(_count_words, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = stash(words, "language-words")
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((pieces, table))
        found = words.mapInArrow(_expect(shared, model, languages), "lang string, piece int, n double")
        counts = np.full(table.shape, smoothing)
        for r in found.groupBy("lang", "piece").agg(F.sum("n").alias("n")).collect():
            counts[r.piece, languages.index(r.lang)] += r.n
        table = counts / counts.sum(axis=0)
        shared.destroy()
    unstash(words)
    return languages, pieces, table


class WordScorer:
    """Log probabilities of words in every language."""

    def __init__(self, pieces: list[str], table: np.ndarray):
        self.table = np.vstack([table, np.full((1, table.shape[1]), UNKNOWN)])
        self.trie = Pieces(pieces)
        self.index: dict[str, int] = {}
        self.rows = np.zeros((CACHE_WORDS, table.shape[1]))

    def forward(self, runs: list[str]) -> np.ndarray:
        """For each run of letters, the log of the sum over all its segmentations, in every language."""
        return log_probabilities(self.trie, self.table, runs)

    def scores(self, words: list[str]) -> np.ndarray:
        at = np.array([self.index.get(w, -1) for w in words], dtype=np.int64)
        missing = np.flatnonzero(at < 0)
        if len(self.index) + len(missing) > len(self.rows):
            self.index.clear()
            missing = np.arange(len(words))
            self.rows = np.zeros((max(CACHE_WORDS, len(words)), self.rows.shape[1]))
        for i in range(0, len(missing), GROUP):
            part = missing[i : i + GROUP]
            runs = [_letters(words[k]) for k in part]
            logs = self.forward([r for rs in runs for r in rs])
            sums = np.zeros((len(part), logs.shape[1]))
            np.add.at(sums, np.repeat(np.arange(len(part)), [len(rs) for rs in runs]), logs)
            n = len(self.index)
            self.rows[n : n + len(part)] = sums
            for j, k in enumerate(part):
                self.index[words[k]] = at[k] = n + j
        return self.rows[at]


def _predict(model, key: int, languages: list[str], text_col: str):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = held(("words", key), lambda: WordScorer(*model.value))
        for batch in batches:
            for part in slices(batch, "__row", SLICE, text_col):
                texts = pc.struct_field(part.column("__row"), text_col)
                codes, words, first, lettered = _words(texts)
                for i in np.flatnonzero(~lettered):
                    lettered[i] = any(c.isalpha() for c in texts[int(i)].as_py() or "")
                logs = np.zeros((len(lettered), len(languages)))
                if len(codes) and languages:
                    full = np.flatnonzero(np.diff(first))
                    logs[full] = np.add.reduceat(scorer.scores(words)[codes], first[full], axis=0)
                mean = logs / np.maximum(np.diff(first), 1)[:, None]
                if languages:
                    odds = np.exp(mean - mean.max(axis=1, keepdims=True))
                    odds /= odds.sum(axis=1, keepdims=True)
                    best = odds.argmax(axis=1)
                    name = [languages[b] if ok else "und" for b, ok in zip(best, lettered)]
                    score = np.where(lettered, np.round(odds.max(axis=1), 6), 0.0)
                else:
                    name, score = ["und"] * len(lettered), np.zeros(len(lettered))
                yield pa.RecordBatch.from_arrays(
                    [part.column("__row"), pa.array(name, pa.string()), pa.array(score)], names=["__row", "lang_pred", "score"]
                )

    return run


def identify(
    docs: DataFrame,
    model: str,
    learned: tuple[list[str], list[str], np.ndarray] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    **options,
) -> DataFrame:
    """One row per document: __row (the document), lang_pred and score.

    score is the share of the best language when the languages' mean word probabilities are weighed
    against each other. Texts that are null or have no letter get 'und' and 0, as do all where there
    is nothing to learn from; ties go to the language that sorts first. Only the text takes part in a
    prediction. Repeated rows are judged alike; an empty table gives an empty result.
    """
    languages, pieces, table = learned or learn(docs, model, id_col, text_col, lang_col, **options)
    shared = lean(docs.sparkSession, SLICE).sparkContext.broadcast((pieces, table))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    schema = rows.select("__row", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    return rows.mapInArrow(_predict(shared, shared._jbroadcast.id(), languages, text_col), schema)


def language_digest(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row, as identify() gives them; a null id is not held out.
    Columns besides the id, the text and, for learning, the language are not read."""
    learned = learn(docs, model, id_col=id_col, text_col=text_col, **options)
    found = identify(docs.select(id_col, text_col), model, learned, id_col, text_col)
    doc_id = F.col("__row")[id_col]
    return found.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, model: str, min_score: float = 0.3, **options) -> DataFrame:
    """docs without the rows whose language is 'und' or whose score is under min_score; columns unchanged.
    Rows of null or empty text or without a letter go, repeated rows stay or go together, ties of languages
    do not matter; other columns pass through whatever their names; an empty table gives an empty one."""
    found = identify(docs, model, **options).where((F.col("lang_pred") != "und") & (F.col("score") >= min_score))
    return found.select(*[F.col("__row")[c].alias(c) for c in docs.columns])
