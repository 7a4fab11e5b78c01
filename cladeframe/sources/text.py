"""Readers of FASTA, GFA, PanGraph JSON, tables of names, VCF and MAF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cladeframe.functions.codes import reverse_complement


def read_fasta(spark: SparkSession, path: str, check_width: bool = False) -> DataFrame:
    """name and seq of every record, plain or gzip; the name ends at the first blank, a name that comes
    again replaces the one before. A record begins with > at the start of a line; headers may hold others.
    With check_width, sequences of different lengths raise an error."""
    raw = spark.read.option("lineSep", "\n>").text(path).withColumn("at", F.monotonically_increasing_id())
    raw = raw.withColumn("value", F.regexp_replace("value", "^>", ""))  # of a file's first record
    head = F.regexp_extract("value", r"^([^\r\n]*)", 1)
    body = F.regexp_replace(F.regexp_replace("value", r"^[^\r\n]*", ""), r"\s", "")
    rows = raw.where("trim(value) <> ''").select(F.regexp_extract(head, r"^(\S*)", 1).alias("name"), body.alias("seq"), "at")
    rows = rows.groupBy("name").agg(F.max_by("seq", "at").alias("seq"))
    return same_width(rows) if check_width else rows


def same_width(rows: DataFrame) -> DataFrame:
    """rows as they are; an error when their sequences differ in length."""
    lengths = rows.agg(F.min(F.length("seq")).alias("lo"), F.max(F.length("seq")).alias("hi"))
    ok = F.coalesce(F.col("lo") == F.col("hi"), F.lit(True))
    return rows.crossJoin(F.broadcast(lengths)).where(F.when(ok, F.lit(True)).otherwise(F.raise_error("sequences of different lengths").cast("boolean"))).select("name", "seq")


def column_window(msa: DataFrame, start: int, width: int = 20_000) -> DataFrame:
    """The same stretch of columns of every sequence."""
    return msa.withColumn("seq", F.substring("seq", start + 1, width))


def read_gfa(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Segments (segment, seq) and path steps (path, step, segment, forward); other records are ignored."""
    lines = spark.read.text(path).select(F.split("value", "\t").alias("f"))
    segments = lines.where(F.col("f")[0] == "S").select(F.col("f")[1].alias("segment"), F.col("f")[2].alias("seq"))
    steps = lines.where(F.col("f")[0] == "P").select(F.col("f")[1].alias("path"), F.posexplode(F.split(F.col("f")[2], ",")).alias("step", "s"))
    forward = F.right("s", F.lit(1)) == "+"
    return segments, steps.select("path", "step", F.expr("substring(s, 1, length(s) - 1)").alias("segment"), forward.alias("forward"))


def gfa_sequences(segments: DataFrame, steps: DataFrame) -> DataFrame:
    """name and seq of every path."""
    text = F.when(F.col("forward"), F.col("seq")).otherwise(reverse_complement(F.col("seq")))
    parts = F.array_sort(F.collect_list(F.struct("step", text.alias("t"))))
    return steps.join(segments, "segment").groupBy(F.col("path").alias("name")).agg(F.array_join(F.transform(parts, lambda x: x["t"]), "").alias("seq"))


PANGRAPH = (
    "paths array<struct<name:string,circular:boolean,offset:int,blocks:array<struct<id:string,strand:boolean>>>>,"
    "blocks array<struct<id:string,sequence:string,gaps:map<string,int>,mutate:array<array<string>>,insert:array<array<string>>,delete:array<array<string>>>>"
)


def read_pangraph(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables path, block, gap, sub, ins and del of a PanGraph file; offsets are negated, sequences in
    upper case, occ is the nth time that a path takes a block, positions of sub and del count from 1."""
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", PANGRAPH, {"mode": "FAILFAST"}).alias("d"))
    paths = doc.select(F.inline("d.paths")).select("name", "circular", (-F.col("offset")).alias("offset"), F.posexplode("blocks").alias("step", "b"))
    steps = paths.select(F.col("name").alias("path"), "circular", "offset", "step", F.col("b.id").alias("block"), F.col("b.strand").alias("forward"))
    occ = F.row_number().over(Window.partitionBy("path", "block").orderBy("step"))
    blocks = doc.select(F.inline("d.blocks"))

    def edits(column: str, shape: str) -> DataFrame:
        entry = blocks.select(F.col("id").alias("block"), F.explode(column).alias("e"))
        who = F.from_json(F.col("e")[0], "name string, number int")
        each = entry.select("block", who.alias("w"), F.explode(F.from_json(F.col("e")[1], f"array<{shape}>")).alias("x"))
        return each.select("block", F.col("w.name").alias("path"), F.col("w.number").alias("occ"), "x")

    x = F.col("x")
    key = ["block", "path", "occ"]
    at = F.from_json(x[0], "array<int>")
    return {
        "path": steps.withColumn("occ", occ),
        "block": blocks.select(F.col("id").alias("block"), F.upper("sequence").alias("seq")),
        "gap": blocks.select(F.col("id").alias("block"), F.explode("gaps").alias("p", "len")).select("block", F.col("p").cast("int").alias("pos"), "len"),
        "sub": edits("mutate", "array<string>").select(*key, x[0].cast("int").alias("pos"), x[1].alias("base")),
        "ins": edits("insert", "array<string>").select(*key, at[0].alias("pos"), at[1].alias("gap"), x[1].alias("text")),
        "del": edits("delete", "array<string>").select(*key, x[0].cast("int").alias("pos"), x[1].cast("int").alias("len")),
    }


def occurrence(rows: DataFrame, partition: list[str], order: list[str], name: str = "occ") -> DataFrame:
    """rows numbered from 1 within each partition."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*partition).orderBy(*order)))


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """name, ord and value of a table of a node and its annotations a line; empty fields are skipped."""
    lines = spark.read.text(path).select(F.transform(F.split("value", "\t"), lambda x: F.trim(x)).alias("f"))
    each = lines.where(F.size("f") > 1).select(F.col("f")[0].alias("name"), F.posexplode(F.slice("f", 2, 1 << 20)).alias("ord", "value"))
    return each.where("value <> ''")


def read_events(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """Complex mutations, one a line; fields beyond the eleventh are ignored."""
    from cladeframe.schemas import COMPLEX_MUT

    f = F.split("value", sep)
    fields = [c.strip().rsplit(" ", 1) for c in COMPLEX_MUT.split(",")]
    return spark.read.text(path).where("value <> ''").select(*[f[i].cast(kind).alias(name) for i, (name, kind) in enumerate(fields)])


def read_node_lists(spark: SparkSession, path: str) -> DataFrame:
    """tree_id and name from lines of a tree's number and names of nodes."""
    words = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).where("trim(value) <> ''").select(words.alias("w"))
    return lines.select(F.col("w")[0].cast("int").alias("tree_id"), F.explode(F.slice("w", 2, 1 << 30)).alias("name"))


def read_reference(spark: SparkSession, path: str) -> str:
    """The first line of a file."""
    row = spark.read.text(path).first()
    return row[0].strip() if row else ""


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """pos, ref, alt and tip of every genotype that is not the reference's. '.' is read as empty."""
    lines = spark.read.text(path)
    names = lines.where(F.col("value").startswith("#CHROM")).select(F.slice(F.split("value", "\t"), 10, 1 << 30).alias("names"))
    rows = lines.where(~F.col("value").startswith("#")).select(F.split("value", "\t").alias("f")).crossJoin(F.broadcast(names))
    calls = rows.select(F.col("f")[1].cast("int").alias("pos"), F.col("f")[3].alias("ref"), F.split(F.col("f")[4], ",").alias("alts"), F.posexplode(F.slice("f", 10, 1 << 30)).alias("i", "gt"), "names")
    hit = calls.where(F.col("gt").cast("int") > 0)
    plain = lambda c: F.when(c == ".", "").otherwise(c)
    return hit.select("pos", plain(F.col("ref")).alias("ref"), plain(F.col("alts")[F.col("gt").cast("int") - 1]).alias("alt"), F.col("names")[F.col("i")].alias("tip"))


def apply_vcf(calls: DataFrame, reference: Column | str, tips: DataFrame) -> DataFrame:
    """name and seq (without gaps) of every tip (name): the reference with the tip's records put in from the last to the first."""
    ref = F.lit(reference) if isinstance(reference, str) else reference
    own = calls.groupBy(F.col("tip").alias("name")).agg(F.sort_array(F.collect_list(F.struct("pos", "ref", "alt")), asc=False).alias("c"))

    def put(acc: Column, x: Column) -> Column:
        return F.concat(F.substring(acc, F.lit(1), x["pos"] - 1), x["alt"], F.substring(acc, x["pos"] + F.length(x["ref"]), F.length(acc)))

    empty = F.array().cast("array<struct<pos:int,ref:string,alt:string>>")
    return tips.select("name").join(own, "name", "left").select("name", F.aggregate(F.coalesce("c", empty), ref, put).alias("seq"))


def read_maf(spark: SparkSession, path: str) -> DataFrame:
    """name, start, size, strand, src_size and text of every s line."""
    f = F.split("value", r"\s+")
    return spark.read.text(path).where(F.col("value").rlike(r"^s\s")).select(
        f[1].alias("name"), f[2].cast("int").alias("start"), f[3].cast("int").alias("size"), f[4].alias("strand"), f[5].cast("int").alias("src_size"), f[6].alias("text")
    )


def maf_sequences(rows: DataFrame) -> DataFrame:
    """name and seq without gaps: the texts of a name in order of start."""
    text = F.translate("text", "-", "")
    own = F.when(F.col("strand") == "-", reverse_complement(text)).otherwise(text)
    parts = F.array_sort(F.collect_list(F.struct("start", own.alias("t"))))
    return rows.where("size > 0").groupBy("name").agg(F.array_join(F.transform(parts, lambda x: x["t"]), "").alias("seq"))


def read_breakpoints(spark: SparkSession, path: str, tree_id: int = 0) -> DataFrame:
    """Recombination triplets (two parents, a child, bounds in columns of the alignment) as complex
    mutations; a row that takes a sequence of an earlier accepted row is left out, which is decided
    row by row in one task, for there are few."""
    from cladeframe.schemas import COMPLEX_MUT

    lines = spark.read.text(path).withColumn("at", F.monotonically_increasing_id())
    f = F.split("value", "\t")
    rows = lines.where(~F.col("value").startswith("P_ACCNUM")).select(
        F.lit(tree_id).alias("tree"), "at", f[0].alias("p"), f[1].alias("q"), f[2].alias("c"), *[f[i].cast("bigint").alias(f"x{i}") for i in range(3, 7)]
    )

    def pick(frame):
        import pandas as pd

        used, out = set(), []
        for r in frame.sort_values("at").itertuples():
            if not used & {r.p, r.q, r.c}:
                used |= {r.p, r.q, r.c}
                out.append(("R", tree_id, r.p, tree_id, r.q, r.x3, r.x4, r.x5, r.x6, tree_id, r.c))
        return pd.DataFrame(out, columns=[c.strip().split(" ")[0] for c in COMPLEX_MUT.split(",")])

    return rows.groupBy("tree").applyInPandas(pick, COMPLEX_MUT)
