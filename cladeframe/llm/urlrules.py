"""URL filtering: fixed host and path rules, and association rules mined from labelled URLs."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash, unstash

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Places over which the verdict of one set of tokens is spread.
SALTS = 32
#: Rows of one set of tokens that one task makes.
PART = 10_000


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return F.when(F.instr(url, "://") > 0, host).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host up to ?, # or the end; empty without ://."""
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def fixed_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Rule string and action of the longest (action, host, path) rule that fits; null where none does."""
    name, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verb, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        action = F.when(fits, F.lit(verb)).otherwise(action)
    return name, action


def url_tokens(url: Column) -> Column:
    """Sorted distinct tokens: the host, its labels and their words, words of the path, the file's
    ending, the keys of the query and the scheme. Numbers are left out."""
    host, path = host_of(url), path_of(url)
    query = F.regexp_extract(url, r"\?([^#]*)", 1)

    def tagged(tag: str, words: Column) -> Column:
        return F.transform(F.filter(words, lambda w: (w != "") & ~w.rlike("^[0-9]+$")), lambda w: F.concat(F.lit(tag), w))

    parts = [
        F.filter(F.array(F.concat(F.lit("host:"), host)), lambda h: h != "host:"),
        tagged("label:", F.split(host, r"\.")),
        tagged("word:", F.split(host, r"[.-]")),
        tagged("path:", F.split(F.lower(path), r"[^a-zA-Z0-9]+")),
        tagged("key:", F.transform(F.split(query, "&"), lambda p: F.regexp_extract(p, "^([^=]*)", 1))),
        tagged("scheme:", F.array(F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)))),
    ]
    return F.when(url.isNull(), F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(F.concat(*parts))))


def alike(labelled: DataFrame, tokens_col: str = "tokens") -> DataFrame:
    """token and same, the least of the tokens that stand in the same rows of labelled, for every token that some
    row lacks. Rows are compared by their number and two 64-bit sums over them; rows without tokens or with
    null ones give nothing, repeated rows count as they stand. labelled is read more than once and is to stand in
    files, so that its rows have the same numbers each time."""
    rows = labelled.select(F.monotonically_increasing_id().alias("id"), F.col(tokens_col).alias("tokens"))
    total = rows.count()
    each = rows.select("id", F.explode(F.array_distinct("tokens")).alias("token")).where("token is not null")
    prints = each.groupBy("token").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"), F.sum(F.crc32(F.col("id").cast("string"))).alias("y"))
    prints = prints.where(F.col("n") < total)
    least = prints.groupBy("n", "x", "y").agg(F.min("token").alias("same"))
    return prints.join(least, ["n", "x", "y"]).select("token", "same")


def replaced(rows: DataFrame, same: DataFrame, tokens_col: str = "tokens") -> DataFrame:
    """Distinct tokens of rows, and what they come to where each is replaced by what alike() says; others are left out."""
    sets = rows.select(F.col(tokens_col).alias("tokens")).distinct()
    each = sets.select("tokens", F.explode("tokens").alias("token")).join(same, "token")
    return each.groupBy("tokens").agg(F.array_sort(F.collect_set("same")).alias("items"))


def _held(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows of sets (items) with a column rule for each of rules (rule) that they hold.

    The inverted index has each rule once, under its rarest token in sets; a set looks up its own
    tokens there and then checks the rules found.
    """
    entries = sets.withColumn("token", F.explode("items"))
    parts = rules.select("rule", F.explode("rule").alias("token"))
    often = entries.join(parts.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    index = parts.join(often, "token", "left").groupBy("rule").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("token").alias("t")))["t"].alias("token"))
    return entries.join(index, "token").where(F.size(F.array_except("rule", "items")) == 0).drop("token")


def mine_rules(
    labelled: DataFrame,
    tokens_col: str,
    bad_col: str,
    min_support: float = 0.002,
    min_rows: int = 20,
    min_confidence: float = 0.8,
    max_tokens: int | None = None,
    same: DataFrame | None = None,
) -> DataFrame:
    """Rules (tokens, confidence, support) whose tokens foretell a bad URL, mined by Spark's FP-growth.

    FP-growth goes through the bad rows; how many rows hold a found set is then counted over all by an
    inverted index. A token that stands in every labelled row adds nothing to a rule, and of tokens that
    stand in the same rows the least stands for all (see alike()), so that sets do not multiply by
    tokens that say the same. Only rules that no rule with fewer of their tokens matches in confidence
    stay, whatever their length, unless max_tokens sets a bound. Each rule holds in min_support of the
    labelled rows at least, and in min_rows of them, bad ones, so that the number of rules depends on
    the thresholds and not on the number of rows. Rows without a label are left out; without bad rows
    there is no rule. same is what alike() gives for the labelled rows, where that is known.
    """
    rows = stash(labelled.where(F.col(bad_col).isNotNull()).select(F.array_distinct(tokens_col).alias("tokens"), F.col(bad_col).alias("bad")), "url-labelled")
    total = rows.count()
    least = max(min_rows, math.ceil(min_support * total))
    given = same is not None
    same = same if given else stash(alike(rows), "url-alike")
    sets = rows.groupBy("tokens").agg(F.count("*").alias("n"), F.count_if("bad").alias("n_bad"))
    sets = stash(sets.join(replaced(rows, same), "tokens").groupBy("items").agg(F.sum("n").alias("n"), F.sum("n_bad").alias("n_bad")), "url-sets")
    often = sets.where("n_bad > 0").select(F.explode("items").alias("token"), "n_bad").groupBy("token").agg(F.sum("n_bad").alias("n")).where(F.col("n") >= least)
    kept = F.array_sort(F.collect_set("token"))
    known = sets.where("n_bad > 0").select("items", "n_bad", F.explode("items").alias("token")).join(often.select("token"), "token", "left_semi")
    known = known.groupBy("items", "n_bad").agg(kept.alias("kept"))
    # one row for each bad URL, as FP-growth counts them; those of one set are made in parts, side by side
    parts = known.select(F.col("kept").alias("items"), "n_bad", F.explode(F.sequence(F.lit(0), F.floor((F.col("n_bad") - 1) / PART))).alias("part"))
    parts = parts.repartition("items", "part").withColumn("m", F.least(F.lit(PART), F.col("n_bad") - F.col("part") * PART))
    items = stash(parts.select("items", F.explode(F.sequence(F.lit(1), F.col("m"))).alias("nth")).select("items"), "url-items")
    n_bad = items.count()
    schema = "rule array<string>, freq bigint"
    if n_bad < least:
        found = rows.sparkSession.createDataFrame([], schema)
    else:
        model = FPGrowth(itemsCol="items", minSupport=least / n_bad * (1 - 1e-9)).fit(items)
        found = model.freqItemsets.select(F.array_sort("items").alias("rule"), "freq")
        found = found if max_tokens is None else found.where(F.size("rule") <= max_tokens)
    found = stash(found, "url-frequent")
    counted = _held(sets, found).groupBy("rule").agg(F.sum("n").alias("n")).join(found, "rule")
    good = counted.select("rule", (F.col("freq") / F.col("n")).alias("confidence"), (F.col("freq") / F.lit(max(1, total))).alias("support"))
    good = stash(good.where(F.col("confidence") >= min_confidence), "url-rules")
    narrow = good.select("rule", F.col("confidence").alias("own"))
    within = _held(good.select(F.col("rule").alias("items"), "confidence"), good.select("rule")).join(narrow, "rule")
    lost = within.where((F.size("rule") < F.size("items")) & (F.col("own") >= F.col("confidence"))).select(F.col("items").alias("rule")).distinct()
    kept = stash(good.join(lost, "rule", "left_anti").select(F.col("rule").alias("tokens"), "confidence", "support"), "url-mined")
    for spent in (rows, sets, items, found, good, *(() if given else (same,))):
        unstash(spent)
    return kept


def match_rules(sets: DataFrame, rules: DataFrame, tokens_col: str = "tokens", same: DataFrame | None = None) -> DataFrame:
    """For each distinct set of tokens that holds all tokens of a rule, the best confidence. With same, what
    alike() gave for the rules' labelled rows, a token counts for those that stood in the same rows."""
    sets = sets.select(F.col(tokens_col).alias("tokens")).distinct().withColumn("items", F.col("tokens"))
    if same is not None:
        sets = sets.select("tokens").join(replaced(sets, same), "tokens")
    hits = _held(sets, rules.select(F.col("tokens").alias("rule"))).join(rules.select(F.col("tokens").alias("rule"), "confidence"), "rule")
    return hits.groupBy("tokens").agg(F.max("confidence").alias("confidence"))


def filter_urls(
    pages: DataFrame,
    labels: DataFrame,
    rules: Sequence[tuple[str, str, str]],
    id_col: str = "page_id",
    url_col: str = "url",
    label_id_col: str = "doc_id",
    bad: Column | None = None,
    **mining,
) -> DataFrame:
    """page_id, host, path, rule, verdict and confidence of every row.

    The longest fixed rule decides; where none fits, a URL whose tokens hold a mined rule's is
    blocked and the others are allowed. confidence is that of the best mined rule, null without one.
    A label makes a URL bad when it is toxic or of quality 0, or as the condition `bad` on labels says;
    rows of labels with one id count once, bad if any is, and null labels are none. A null URL or one
    without :// has an empty host and path and is allowed unless a rule says otherwise; repeated rows
    are judged alike; empty tables mine no rule and give an empty result; other columns are not read.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    if bad is None:
        labels = labels.where(F.col("toxic").isNotNull() | F.col("quality").isNotNull())
        bad = (F.coalesce(F.col("toxic"), F.lit(0)) == 1) | (F.coalesce(F.col("quality"), F.lit(1)) == 0)
    known = labels.select(F.col(label_id_col).alias("page_id"), bad.alias("bad")).where("bad is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    rows = rows.withColumn("tokens", url_tokens(F.col("url")))
    labelled = stash(rows.join(known, "page_id").select("tokens", "bad"), "url-known")
    same = stash(alike(labelled), "url-same")
    mined = mine_rules(labelled, "tokens", "bad", same=same, **mining)
    unstash(labelled)
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    name, action = fixed_rule(host, path, rules)
    # many URLs may have one set of tokens: its verdict stands in SALTS places, and each row looks in one
    matched = match_rules(rows, mined, same=same).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(matched, ["tokens", "salt"], "left")
    verdict = F.coalesce(action, F.when(F.col("confidence").isNotNull(), "block").otherwise("allow"))
    return rows.select("page_id", host.alias("host"), path.alias("path"), name.alias("rule"), verdict.alias("verdict"), "confidence")
