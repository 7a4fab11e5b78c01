"""Line-first quality rules, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"

# The patterns of the line rules.
NAVIGATION = r"([|»›•·][^|»›•·]*){3}"
BOILERPLATE = (
    r"(?i)(all rights reserved|terms of (use|service)|privacy policy|cookie policy|uses cookies|enable javascript"
    r"|subscribe to our|sign up for our|click here|read more|share this|lorem ipsum"
    r"|alle rechte vorbehalten|nutzungsbedingungen|datenschutzerkl|verwendet cookies|newsletter abonnieren|hier klicken|mehr lesen|weiterlesen"
    r"|tous droits r.serv.s|conditions d.utilisation|politique de confidentialit|utilise des cookies|abonnez-vous|cliquez ici|lire la suite"
    r"|todos los derechos reservados|condiciones de uso|pol.tica de privacidad|utiliza cookies|suscr.bete a|haz clic aqu|leer m.s)"
)
NOISE = r"[#*$%&|<>{}^~=]+"
SHOUT = r"([!?]{2})"
TERMINAL = r"[.!?…。！？:;)\"'”’»][\x20\x09-\x0D]*\z"
PUNCTUATION = r"[.,;:!?…。，、！？]"


def bound(value: Column, body) -> Column:
    """body(value) with value worked out once, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """Words inside three-word windows that occur at least twice. Windows are compared by a 64-bit
    hash: within one text of a million words two different ones meet with odds of 1 in 10^7."""
    n = F.size(words)
    windows = F.when(
        n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    )

    def covered(found: Column) -> Column:
        ordered = F.array_sort(F.transform(found, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        twice = bound(
            ordered,
            lambda s: F.filter(s, lambda e, j: (F.get(s, j - 1)["x"] == e["x"]) | (F.get(s, j + 1)["x"] == e["x"])),
        )
        at = F.flatten(F.transform(twice, lambda e: F.array(e["i"], e["i"] + 1, e["i"] + 2)))
        return F.size(F.array_distinct(at))

    return F.coalesce(
        bound(windows, lambda g: F.when(F.size(F.array_distinct(g)) < F.size(g), covered(g)).otherwise(0)), F.lit(0)
    ).cast("long")


def bad_line(line: Column, n: Column, min_words: int, bare_words: int, max_noise_percent: int, max_shout_percent: int) -> Column:
    """True for a line of n words, one at least, that fails a rule."""
    size = F.length(line)
    noise = size - F.length(F.regexp_replace(line, NOISE, ""))
    shouts = F.size(F.regexp_extract_all(line, F.lit(SHOUT), 1))
    return (
        ((n < min_words) & ~line.rlike(TERMINAL))
        | ((n >= bare_words) & ~line.rlike(PUNCTUATION))
        | (noise * 100 > size * max_noise_percent)
        | (shouts * 100 > n * max_shout_percent)
        | line.rlike(NAVIGATION)
        | line.rlike(BOILERPLATE)
    )


def line_quality(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_words: int = 50,
    max_repeat_percent: int = 50,
    max_lost_percent: int = 50,
    line_min_words: int = 4,
    line_bare_words: int = 30,
    line_noise_percent: int = 10,
    line_shout_percent: int = 30,
) -> DataFrame:
    """Evaluate the rules line by line, remove failing lines, then judge the document by what is left.

    A line fails when it holds three or more menu separators, a boilerplate phrase, too many
    symbols, too many doubled ! or ?, when it is short and ends without punctuation, or when it has
    line_bare_words words or more and no punctuation at all. Each line is split and judged once. A document
    goes when it fails a base rule (under min_words words, or over max_repeat_percent of its words
    in repeated three-word windows) or when the removed lines hold over max_lost_percent of its words.

    Returns one row per input row: the id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, n_lines, n_bad_lines, lost_words and cleaned (the text without
    failing lines). Null text counts as empty, fails the base rules and has a null cleaned text.
    Null ids pass through; repeated rows are judged alike; other columns of docs are not read, so
    their names can't clash. An empty table gives an empty result.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("raw"))
    text = F.coalesce("raw", F.lit(""))
    # no word crosses a line, so that the text's words are those of its lines
    split = base.select("doc_id", "raw", F.transform(F.split(text, "\n"), lambda l: F.struct(l.alias("line"), words_of(l).alias("words"))).alias("all"))

    def judged(e: Column) -> Column:
        n = F.size(e["words"])
        bad = (n > 0) & bad_line(e["line"], n, line_min_words, line_bare_words, line_noise_percent, line_shout_percent)
        return F.struct(e["line"].alias("line"), n.alias("n"), bad.alias("bad"))

    lines = split.select(
        "doc_id", "raw", F.transform("all", judged).alias("all"), F.flatten(F.transform("all", lambda e: e["words"])).alias("words")
    )
    counted = lines.select(
        "doc_id",
        "raw",
        "all",
        F.size("words").cast("long").alias("n_words"),
        F.aggregate("words", F.lit(0).cast("long"), lambda acc, w: acc + F.length(w)).alias("word_chars"),
        (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        F.transform(F.filter("all", lambda e: e["n"] > 0), lambda e: e["line"]).alias("lines"),
        F.filter("all", lambda e: e["bad"]).alias("bad"),
    )
    base_failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_percent)
    judged_docs = counted.select(
        "*", base_failed.alias("base_failed"), F.aggregate("bad", F.lit(0).cast("long"), lambda acc, e: acc + e["n"]).alias("lost_words")
    )
    kept = ~F.col("base_failed") & (F.col("lost_words") * 100 <= F.col("n_words") * max_lost_percent)
    good = F.array_join(F.transform(F.filter("all", lambda e: ~e["bad"]), lambda e: e["line"]), "\n")
    return judged_docs.select(
        "doc_id", "n_words", "word_chars", "n_symbols", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words", "base_failed", kept.alias("kept"), F.size("lines").cast("long").alias("n_lines"), F.size("bad").cast("long").alias("n_bad_lines"),
        "lost_words", F.when(F.size("bad") == 0, F.col("raw")).otherwise(good).alias("cleaned"),
    )
