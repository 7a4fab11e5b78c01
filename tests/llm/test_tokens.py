"""BPE, token files and edit-aware counts against the tokenizers library."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from cladeframe.llm import bpe, editcount, huffman

PATH = public_tokenizers.path("byte_bpe_50k.json")
BITS = ["a", "B", "  ", " ", "\n", "\t", "é", " ", "\u00a0", "\u3000", "1", "²", "'s", "<|endoftext|>", "<|end", "oftext|>", "漢", "🙂", "!", "don't", "\x1c", "\x85", "\x00", "foo", "x."]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_units_are_independent(tokenizer, rng):
    texts = ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 30))) for _ in range(2000)] + ["", " ", None]
    ids, first = bpe.encode_texts(pa.array(texts), bpe.UnitEncoder.of(PATH))
    for i, t in enumerate(texts):
        assert ids[first[i] : first[i + 1]].tolist() == ids_of(tokenizer, t), repr(t)


@pytest.mark.parametrize("which", ["edge", "documents"])
def test_encode_decode(which, request, tokenizer):
    docs = request.getfixturevalue(which)
    got = Counter((r.doc_id, r.n_tokens, bytes(r.ids), r.decoded) for r in bpe.decode_ids(bpe.encode_docs(docs, PATH, buckets=5), PATH).collect())
    want = Counter()
    for r in docs.collect():
        ids = ids_of(tokenizer, r.text)
        want[(r.doc_id, len(ids), np.array(ids, "<u4").tobytes(), tokenizer.decode(ids, skip_special_tokens=False))] += 1
    assert got == want
    assert bpe.decode_ids(bpe.encode_docs(docs.limit(0), PATH), PATH).collect() == []


def test_decode_of_any_ids(spark, tokenizer, rng):
    rows = [(i, bytes(np.array([rng.randrange(50257) for _ in range(rng.randint(0, 9))], "<u4").tobytes())) for i in range(200)]
    df = spark.createDataFrame([*rows, (999, None)], "doc_id long, ids binary")
    for r in bpe.decode_ids(df, PATH).collect():
        ids = [] if r.ids is None else np.frombuffer(r.ids, "<u4").tolist()
        assert r.decoded == tokenizer.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("n,vocabulary", [(0, 1), (1, 5), (9, 3), (20_000, 300), (50_000, 50_000)])
def test_shards(n, vocabulary):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n), vocabulary - 1).astype(np.uint32)
    lengths = huffman.code_lengths(np.bincount(ids, minlength=vocabulary), 18)
    used = lengths[lengths > 0].astype(float)
    assert lengths.max(initial=0) <= 18 and (2.0**-used).sum() <= 1 + 1e-9
    sizes = np.array([n // 3, 0, n - n // 3])
    back, docs = huffman.read_shard(huffman.write_shard(ids, sizes, lengths, every=64))
    assert (back == ids).all() and (docs == sizes).all()


def test_code_lengths_are_optimal():
    import heapq

    counts = np.random.default_rng(3).integers(1, 1000, 60)
    heap, total = [int(c) for c in counts], 0
    heapq.heapify(heap)
    while len(heap) > 1:
        merged = heapq.heappop(heap) + heapq.heappop(heap)
        total += merged
        heapq.heappush(heap, merged)
    assert (huffman.code_lengths(counts, 20) * counts).sum() == total
    assert huffman.code_lengths(counts, 6).max() == 6


@pytest.mark.parametrize("which", ["edge", "documents"])
def test_token_files(which, request, tokenizer):
    docs = request.getfixturevalue(which)
    rows = sorted(huffman.read_tokens(huffman.write_tokens(docs, PATH, shard_ids=3000)).collect(), key=lambda r: r.start)
    want = Counter((r.doc_id, zlib.crc32(np.array([*ids_of(tokenizer, r.text), 0], "<u4").tobytes())) for r in docs.collect())
    assert Counter((r.doc_id, zlib.crc32(r.ids)) for r in rows) == want
    assert [r.doc_id for r in rows] == sorted((r.doc_id for r in rows), key=lambda x: -1 if x is None else x)
    at = 0
    for r in rows:
        assert r.start == at and r.n_tokens == len(r.ids) // 4
        at += r.n_tokens
    assert huffman.read_tokens(huffman.write_tokens(docs.limit(0), PATH)).collect() == []


def test_edits(tokenizer, rng, monkeypatch):
    monkeypatch.setattr(editcount, "LEAF_CHARS", 8)
    monkeypatch.setattr(editcount, "MOST_CHARS", 64)
    encoder = bpe.UnitEncoder.of(PATH)
    for _ in range(300):
        text = "".join(rng.choice(BITS) for _ in range(rng.randint(0, 60)))
        tree = next(editcount._trees(pa.array([text]), encoder))
        for _ in range(rng.randint(1, 6)):
            a = rng.randint(-2, len(text) + 3)
            b = a + rng.randint(-1, 12)
            new = "".join(rng.choice(BITS) for _ in range(rng.choice([0, 3, 12, 60])))
            tree.edit(a, b, new)
            lo = min(max(a, 0), len(text))
            text = text[:lo] + new + text[min(max(b, lo), len(text)) :]
            assert tree.text() == text and tree.total == len(ids_of(tokenizer, text))
            if rng.random() < 0.3:  # kept and read again
                tree = editcount.CountTree.of(*tree.parts(), encoder.encode)


def test_edits_of_many_texts_together(tokenizer, rng):
    """Edits of many texts take one call of the encoder, and every text comes out as if it were alone."""
    encoder = bpe.UnitEncoder.of(PATH)
    texts = ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 60))) for _ in range(200)]
    edits = [(rng.randint(0, 20), rng.randint(0, 40), "".join(rng.choice(BITS) for _ in range(rng.randint(0, 5)))) for _ in texts]
    alone, together = ([next(editcount._trees(pa.array([t]), encoder)) for t in texts] for _ in range(2))
    for tree, edit in zip(alone, edits):
        tree.edit(*edit)
    calls = []
    editcount.edit_together([(tree, *edit) for tree, edit in zip(together, edits)], lambda units: calls.append(1) or encoder.encode(units))
    assert len(calls) == 1
    assert [(*t.parts(), t.total, t.reencoded) for t in together] == [(*t.parts(), t.total, t.reencoded) for t in alone]
    assert all(t.total == len(ids_of(tokenizer, t.text())) for t in together)


def test_edit_table(spark, edge, tokenizer):
    steps = spark.createDataFrame([(5, 2, 0, 5, "x y"), (5, 1, 3, None, None), (99, 1, 0, 0, "q"), (0, 1, 0, 0, "new")], "doc_id long, seq int, start int, stop int, text string")
    got = {r.doc_id: r for r in editcount.count_tokens(editcount.attach_edits(edge, steps), PATH, edits=editcount.F.col("edits")).where("doc_id <> 3").collect()}
    assert got[5].n_tokens_edited == len(ids_of(tokenizer, "x y CASE words, with. punctuation!")) and got[5].n_edits == 2
    assert got[0].n_tokens == 0 and got[0].n_tokens_edited == len(ids_of(tokenizer, "new"))
    assert editcount.count_tokens(edge.limit(0), PATH).collect() == []


def test_digest_of_query(spark, sf, tokenizer):
    from cladeframe.llm.queries import QUERIES

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in QUERIES["op6_bpe"](spark, sf).collect():
        ids = ids_of(tokenizer, texts[r.doc_id])
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_edits_beside_a_long_unit(tokenizer):
    """Only what stands around an edit is encoded again, however long the units next to it are."""
    text = "word, " * 20_000 + "x" * 5_000 + " and more" * 20_000
    encoder = bpe.UnitEncoder.of(PATH)
    tree = next(editcount._trees(pa.array([text]), encoder))
    seen = []
    tree.encode = lambda units: seen.append(sum(map(len, units))) or encoder.encode(units)
    for k in range(5):
        tree.edit(120_000 + k, 120_000 + k, "y")
    assert max(seen) < 6_000 and tree.reencoded < 400
    assert tree.total == len(ids_of(tokenizer, tree.text()))
    tree.edit(300, 300, "new words " * 3_000)
    tree.edit(600, 610, "z")
    assert seen[-1] < 6_000 and tree.total == len(ids_of(tokenizer, tree.text()))


def test_kept_trees(spark, edge, tokenizer, tmp_path):
    """Trees are written, read, edited, written and edited again; counts are the library's throughout."""
    editcount.grow_trees(edge, PATH).write.parquet(str(tmp_path / "one"))
    first = spark.read.parquet(str(tmp_path / "one")).withColumn("edits", editcount.sample_edits(editcount.F.col("text")))
    editcount.edit_trees(first, PATH).write.parquet(str(tmp_path / "two"))
    second = spark.read.parquet(str(tmp_path / "two"))
    for r in second.collect():
        assert r.n_tokens_edited == len(ids_of(tokenizer, r.text)) == sum(r.leaf_tokens) and sum(r.leaf_chars) == len(r.text)
    again = editcount.edit_trees(second.withColumn("edits", editcount.sample_edits(editcount.F.col("text"))), PATH).collect()
    assert all(r.n_tokens_edited == len(ids_of(tokenizer, r.text)) and r.n_edits == 3 for r in again) and len(again) == edge.count()


def test_query_of_edits(spark, sf, tokenizer):
    """Every row of op4 against the library, with the three edits made in Python."""
    from cladeframe.llm.queries import QUERIES

    want = Counter()
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        t = r.text or ""
        third = len(t) // 3
        new = "Note: " + t
        new = new[:third] + " changed by hand, " + new[third + 20 :]
        new = new[: 2 * third] + new[2 * third + 15 :]
        want[(r.doc_id, len(ids_of(tokenizer, r.text)), len(ids_of(tokenizer, new)), 3)] += 1
    assert Counter(tuple(r)[:4] for r in QUERIES["op4_token_counts"](spark, sf).collect()) == want
