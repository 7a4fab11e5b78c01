"""Importance resampling towards the word distribution of a target.

Words, or runs of words, fall into hashed buckets; a bucket's gain is the log ratio of its share in the
target and in the documents, and a document's weight is the sum of gains over an array. Gumbel noise
from the id turns the highest scores into a draw without replacement. The cut is exact without a global
sort: scores are counted, counts are summed from the highest down in digits of the score, so that no task
sees more than a digit's values, and only documents at or above the score where the draw ends are
numbered, inside their score.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, let_go, slices, stash, tidy, unstash
from .decontam import normal_words

#: Buckets of features, longest run of words, least words of a document that may be drawn, percent drawn, seed.
BUCKETS, LONGEST, LEAST, PERCENT, SEED = 10_000, 1, 20, 10, 2024
#: Text that is handled at once, in bytes.
SLICE = 4 << 20
#: Bits of a score that one step of the suffix sums resolves.
DIGIT = 14


def features(texts: pa.Array, buckets: int, longest: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For each length of runs, the bucket of every run and each text's first one (one more at the end); and the words of each text."""
    words, first, _, _ = normal_words(texts)
    out = []
    for size in range(1, longest + 1):
        count = np.maximum(np.diff(first) - size + 1, 0)
        bounds = np.concatenate([[0], np.cumsum(count)])
        at = np.arange(bounds[-1]) + np.repeat(first[:-1] - bounds[:-1], count)
        runs = words if size == 1 else pc.binary_join_element_wise(*[words.take(pa.array(at + k)) for k in range(size)], pa.scalar(" ", words.type))
        coded = pc.dictionary_encode(runs)
        bucket = np.array([zlib.crc32(w.as_buffer()) % buckets for w in coded.dictionary], dtype=np.int64)
        out.append((bucket[coded.indices.to_numpy()] if len(runs) else np.zeros(0, np.int64), bounds))
    return out, np.diff(first)


def _count(buckets: int, longest: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        seen = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                for found, _ in features(part.column("text"), buckets, longest)[0]:
                    seen += np.bincount(found, minlength=buckets)
        kept = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(kept), pa.array(seen[kept])], names=["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, text_col: str, buckets: int, longest: int) -> list[int]:
    """How many features of all texts fall into each bucket; at most `buckets` rows come to the driver."""
    rows = texts.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_count(buckets, longest), "bucket bigint, n bigint")
    out = [0] * buckets
    for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: list[int], target: list[int]) -> list[int]:
    """floor(1000 ln(target share / source share)) of every bucket, each count raised by one."""
    n = len(source)
    s_all, t_all = float(sum(source) + n), float(sum(target) + n)
    return [math.floor(1000 * math.log((t + 1) * s_all / ((s + 1) * t_all))) for s, t in zip(source, target)]


def _weigh(gain: np.ndarray, longest: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                runs, n_words = features(part.column("text"), len(gain), longest)
                weight, n = np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows, np.int64)
                for found, first in runs:
                    total = np.concatenate([[0], np.cumsum(gain[found])])
                    weight += total[first[1:]] - total[first[:-1]]
                    n += np.diff(first)
                columns = [pa.array(n_words), pa.array(n), pa.array(weight)]
                others = [c for c in part.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in others] + columns, names=[*others, "n_words", "n_features", "weight"])

    return run


def ranks_above(counts: DataFrame) -> DataFrame:
    """score and above, the sum of n over all greater scores, of distinct scores with their counts n. Sums run
    inside digits of the score, so that a task holds 2^DIGIT distinct values at most, however they crowd."""
    above = None
    for shift in range(DIGIT * 3, -1, -DIGIT):
        own, parent = F.shiftright("score", shift), F.shiftright("score", min(shift + DIGIT, 63))
        rows = counts.groupBy(own.alias("digit"), parent.alias("parent")).agg(F.sum("n").alias("n"))
        if above is None:  # what is left of 64 bits above the third digit is one group
            rows = rows.withColumn("parent", F.lit(0).cast("bigint"))
        order = Window.partitionBy("parent").orderBy(F.col("digit").desc()).rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("within", F.coalesce(F.sum("n").over(order), F.lit(0)))
        if above is not None:
            rows = rows.join(above.select(F.col("digit").alias("parent"), F.col("above").alias("base")), "parent")
            rows = rows.withColumn("within", F.col("within") + F.col("base"))
        above = rows.select("digit", F.col("within").alias("above"), "n")
    return above.select(F.col("digit").alias("score"), "above", "n")


def _noise(id_col: str, seed: int):
    """floor(-1000 ln(-ln u)), u from the first 32 bits of SHA-256 of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    uniform = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(uniform)))


def rank_documents(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", *,
    buckets: int = BUCKETS, longest: int = LONGEST, least: int = LEAST, percent: int = PERCENT, seed: int = SEED, keys: tuple = (),
) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of docs, and columns `keys` made from its rows.

    Features are runs of 1 to `longest` words (lower-cased ASCII letters, digits, characters above U+007F),
    repeats counted. Of the N documents of `least` words or more, floor(percent * N / 100) of the highest
    scores are drawn, ties to the smaller id (null last; of rows equal in both any); rank is their order from 1, null for all others. Null
    texts have no words and weight 0; a null id is hashed as an empty one; repeated rows are ranked one by
    one; other columns are not read; an empty target leaves every bucket its smoothing count; no rows give none.
    """
    spark = lean(docs.sparkSession, SLICE)
    gain = np.array(gains(bucket_counts(docs, text_col, buckets, longest), bucket_counts(target, target_text, buckets, longest)), dtype=np.int64)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), *keys, F.col(text_col).cast("string").alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("text").schema)
    weighed = rows.mapInArrow(_weigh(gain, longest), f"{schema}, n_words bigint, n_features bigint, weight bigint")
    scored = stash(weighed.withColumn("score", F.col("weight") + _noise("doc_id", seed)), "scores")

    able = F.col("n_words") >= least
    counts = stash(scored.where(able).groupBy("score").agg(F.count("*").alias("n")), "score-counts")
    drawn = percent * (counts.agg(F.sum("n")).first()[0] or 0) // 100
    above = stash(ranks_above(counts), "score-ranks")
    cut = above.where(F.col("above") < drawn).agg(F.min("score")).first()[0]
    unstash(counts)
    names = [c for c in scored.columns if c != "n_words"]
    if cut is None:
        return scored.select(*names, F.lit(None).cast("bigint").alias("rank"))
    high = able & (F.col("score") >= cut)
    order = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last())
    best = scored.where(high).join(above.where(F.col("score") >= cut).drop("n"), "score")
    place = F.col("above") + F.row_number().over(order)
    best = best.withColumn("rank", place).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return best.select(*names, "rank").unionByName(scored.where(~high).select(*names, F.lit(None).cast("bigint").alias("rank")))


def draw_documents(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Those rows of docs that rank_documents() draws, with all their columns; of rows equal in id and text as
    many as are drawn."""
    digest = F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    ranked = rank_documents(docs, target, id_col, text_col, keys=(digest.alias("md5"),), **options).where("rank IS NOT NULL")
    some = F.coalesce(F.col("doc_id"), F.lit(0)), F.col("doc_id").isNull()
    wanted = ranked.groupBy(some[0].alias("id"), some[1].alias("none"), "md5").agg(F.count("*").alias("wanted"))
    own = F.col(id_col).cast("bigint")
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.coalesce(own, F.lit(0)).alias("id"), own.isNull().alias("none"), digest.alias("md5")
    )
    met = keyed.join(wanted, ["id", "none", "md5"]).withColumn("k", F.row_number().over(Window.partitionBy("id", "none", "md5").orderBy("id")))
    return met.where("k <= wanted").select(*[F.col("__row")[c].alias(c) for c in docs.columns])
