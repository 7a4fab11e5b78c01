"""Text forms of results: FASTA, VCF, GFA, MAF and plain lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe.functions.codes import wrap


def fasta_records(rows: DataFrame, width: int = 70) -> DataFrame:
    """record: a header line and wrapped lines for each (name, seq)."""
    return rows.select(F.concat(F.lit(">"), "name", F.lit("\n"), wrap(F.col("seq"), width)).alias("record"))


def write_lines(rows: DataFrame, path: str, order: list[str] | None = None) -> None:
    """The one string column of rows as text files; in order of `order` (columns of rows) across files."""
    ordered = rows.orderBy(*order).drop(*order) if order else rows
    ordered.write.mode("overwrite").text(path)


def write_file(rows: DataFrame, path: str, order: list[str] | None = None) -> None:
    """write_lines() as one file: executors write the parts, and the driver passes their bytes on in order."""
    spark = rows.sparkSession
    parts = f"{path.rstrip('/')}.parts"
    write_lines(rows, parts, order)
    _join(spark, parts, path)


def _join(spark: SparkSession, parts: str, path: str) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    folder, target = jvm.org.apache.hadoop.fs.Path(parts), jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(conf)
    files = sorted((s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-")), key=lambda f: f.getName())
    out = fs.create(target, True)
    for f in files:
        source = fs.open(f)
        jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, conf, False)
        source.close()
    out.close()
    fs.delete(folder, True)


def write_by_name(rows: DataFrame, path: str) -> None:
    """One folder of records for each name."""
    named = rows.select("name", F.concat(F.lit(">"), "name", F.lit("\n"), wrap(F.col("seq"))).alias("record"))
    named.write.mode("overwrite").partitionBy("name").text(path)


def vcf_lines(genotypes: DataFrame, tips: DataFrame, reference: str) -> DataFrame:
    """at and line of a VCF file: header, then a line for each (pos, ref, alts, calls: an array of
    struct(tip, alt) in order of tips), in order of at. tips has one row with the array names, which stays in the
    cluster. A line is made of its calls alone: what stands between two of them is a run of zeros."""
    date = F.concat(F.lit("##fileDate="), F.date_format(F.current_date(), "yyyyMd"))
    columns = F.concat(F.lit("#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT"), F.array_join(F.transform("names", lambda t: F.concat(F.lit("\t"), t)), ""))
    head = F.array(F.lit("##fileformat=VCFv4.2"), date, F.lit(f"##reference={reference}"), columns)
    header = tips.select(F.posexplode(head).alias("i", "line")).select((F.col("i") - 4).cast("long").alias("at"), "line")
    shown = lambda c: F.when(c == "", ".").otherwise(c)
    before = lambda k: F.when(k > 0, F.get("calls", k - 1)["tip"]).otherwise(-1)
    part = F.transform("calls", lambda c, k: F.concat(F.repeat(F.lit("0\t"), c["tip"] - before(k) - 1), c["alt"].cast("string")))
    rest = F.repeat(F.lit("\t0"), F.col("n_names") - 1 - F.element_at("calls", -1)["tip"])
    calls = F.concat(F.array_join(part, "\t"), rest)
    line = F.concat_ws("\t", F.lit("."), F.col("pos").cast("string"), F.lit("."), shown(F.col("ref")), F.array_join(F.transform("alts", shown), ","), F.lit("."), F.lit("."), F.lit("."), F.lit("."), calls)
    rows = genotypes.crossJoin(F.broadcast(tips.select(F.size("names").alias("n_names"))))  # one number
    return header.unionByName(rows.select(F.col("pos").cast("long").alias("at"), line.alias("line")))
