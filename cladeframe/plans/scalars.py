"""Queries of scalar functions, filters and text forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe.functions import codes
from cladeframe.plans.registry import query, table
from cladeframe.sources import sinks

#: Bases that stand for a text: its characters A, C, G, T and - in upper case, whatever else is dropped.
SEQ = "translate(regexp_replace(upper(text), '[^ACGTN.]', '', 'g'), '.', '-')"


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = F.translate(F.regexp_replace(F.upper("text"), "[^ACGTN.]", ""), ".", "-")
    return table(spark, sf_dir, "documents").select("doc_id", "source", seq.alias("seq"))


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_shipdate <= TIMESTAMP '1996-01-01' AND l_returnflag = 'R'")
def scan_project_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return rows.where((F.col("l_shipdate") <= F.expr("TIMESTAMP_NTZ '1996-01-01'")) & (F.col("l_returnflag") == "R")).select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_name = (SELECT min(c_name) FROM customer)")
def node_lookup(spark, sf_dir):
    rows = table(spark, sf_dir, "customer")
    first = rows.agg(F.min("c_name").alias("c_name"))
    return rows.join(F.broadcast(first), "c_name").select("c_custkey", "c_nationkey")


@query("""SELECT doc_id FROM (SELECT doc_id, list_distinct([CASE WHEN quality = 1 THEN 'good' ELSE 'poor' END, CASE WHEN toxic = 1 THEN 'toxic' ELSE 'safe' END]) AS a FROM labels)
WHERE list_contains(a, 'toxic')""")
def annotation_search(spark, sf_dir):
    values = F.array(F.when(F.col("quality") == 1, "good").otherwise("poor"), F.when(F.col("toxic") == 1, "toxic").otherwise("safe"))
    return table(spark, sf_dir, "labels").select("doc_id", values.alias("annotations")).where(F.array_contains("annotations", "toxic")).select("doc_id")


@query("SELECT n_nationkey FROM nation WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 5000)")
def leaf_antijoin(spark, sf_dir):
    rich = table(spark, sf_dir, "supplier").where("s_acctbal > 5000")
    nation = table(spark, sf_dir, "nation")
    return nation.join(rich, nation.n_nationkey == rich.s_nationkey, "left_anti").select("n_nationkey")


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 UNION SELECT doc_id FROM labels WHERE toxic = 1)")
def subset_semijoin(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    wanted = labels.where("quality = 1").select("doc_id").union(labels.where("toxic = 1").select("doc_id")).distinct()
    return table(spark, sf_dir, "documents").join(wanted, "doc_id", "left_semi").select("doc_id", "lang")


@query(f"""SELECT doc_id, CAST(i AS BIGINT) AS i, c AS base, CASE c WHEN 'A' THEN 1 WHEN 'C' THEN 2 WHEN 'G' THEN 4 WHEN 'T' THEN 8 WHEN 'N' THEN 15 ELSE 0 END AS code
FROM (SELECT doc_id, unnest(range(0, length(s))) AS i, unnest(string_split(s, '')) AS c FROM (SELECT doc_id, {SEQ} AS s FROM documents) WHERE s <> '')""")
def code_encode(spark, sf_dir):
    each = sequences(spark, sf_dir).select("doc_id", F.posexplode(F.split("seq", "")).alias("i", "base")).where("base <> ''")
    return each.select("doc_id", F.col("i").cast("bigint").alias("i"), "base", codes.base_code(F.col("base")).alias("code"))


@query("SELECT l_linenumber, CAST(k AS INTEGER) AS code, substr('-ACMGRSVTWYHKDBN', CAST(k AS INTEGER) + 1, 1) AS base, count(*) AS n FROM (SELECT l_linenumber, l_partkey % 16 AS k FROM lineitem) GROUP BY l_linenumber, k")
def code_decode(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_linenumber", (F.col("l_partkey") % 16).cast("int").alias("code"))
    return rows.groupBy("l_linenumber", "code").agg(F.count("*").alias("n")).withColumn("base", codes.code_base(F.col("code")))


@query(f"SELECT doc_id, reverse(translate(regexp_replace(s, '[^ACGT]', 'N', 'g'), 'ACGT', 'TGCA')) AS rc FROM (SELECT doc_id, {SEQ} AS s FROM documents)")
def reverse_complement(spark, sf_dir):
    return sequences(spark, sf_dir).select("doc_id", codes.reverse_complement(F.col("seq")).alias("rc"))


@query(f"SELECT doc_id, translate(s, '-x', '') AS bare, CAST(length(s) - length(translate(s, '-x', '')) AS BIGINT) AS n_gaps FROM (SELECT doc_id, {SEQ} AS s FROM documents)")
def strip_gaps(spark, sf_dir):
    bare = codes.strip_gaps(F.col("seq"))
    return sequences(spark, sf_dir).select("doc_id", bare.alias("bare"), (F.length("seq") - F.length(bare)).cast("bigint").alias("n_gaps"))


@query("SELECT page_id, trim(x) AS part FROM (SELECT page_id, unnest(string_split(regexp_replace(url, '[/?&]+', ',', 'g'), ',')) AS x FROM pages)")
def quote_split(spark, sf_dir):
    listed = F.regexp_replace("url", "[/?&]+", ",")
    return table(spark, sf_dir, "pages").select("page_id", F.explode(codes.quoted_split(listed)).alias("part"))


@query(f"SELECT '>' || doc_id || chr(10) || rtrim(regexp_replace(s, '(.{{70}})', '\\1' || chr(10), 'g'), chr(10)) AS record FROM (SELECT doc_id, {SEQ} AS s FROM documents)")
def fasta_wrap(spark, sf_dir):
    return sinks.fasta_records(sequences(spark, sf_dir).select(F.col("doc_id").cast("string").alias("name"), "seq"))


@query(f"""WITH s AS (SELECT doc_id, regexp_replace({SEQ}, '[-]', '', 'g') AS s FROM documents),
p AS (SELECT doc_id, unnest(range(0, (length(s) + 7) // 8)) AS k, unnest(regexp_extract_all(s, '.{{1,8}}')) AS part FROM s),
w AS (SELECT doc_id, k, rpad(part, 8, '-') AS w FROM p)
SELECT doc_id, CAST(k AS BIGINT) AS k, CAST(sum((instr('ACMGRSVTWYHKDBN', substr(w, j + 1, 1))) * CAST(pow(16, 7 - j) AS BIGINT)) AS BIGINT) AS word
FROM w, range(0, 8) q(j) GROUP BY doc_id, k""")
def pack_consensus(spark, sf_dir):
    rows = sequences(spark, sf_dir).where("seq is not null").select("doc_id", codes.strip_gaps(F.col("seq")).alias("s"))
    return rows.select("doc_id", F.posexplode(codes.pack_consensus(F.col("s"))).alias("k", "word")).select("doc_id", F.col("k").cast("bigint").alias("k"), "word")


@query(f"SELECT doc_id, regexp_replace({SEQ}, '[-]', '', 'g') AS s FROM documents")
def unpack_consensus(spark, sf_dir):
    packed = sequences(spark, sf_dir).select("doc_id", codes.pack_consensus(codes.strip_gaps(F.col("seq"))).alias("w"))
    return packed.select("doc_id", codes.unpack_consensus(F.col("w")).alias("s"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey % 16 AS a, l_suppkey % 16 AS b, CAST((l_partkey % 16) * 1048576 + (l_suppkey % 16) * 65536 AS BIGINT) AS packed,
CAST(l_suppkey % 16 AS BIGINT) AS second, CAST(3 * 16 + 2 AS INTEGER) AS info, CAST(l_partkey * 4294967296 + l_suppkey AS BIGINT) AS block_id FROM lineitem""")
def pack_records(spark, sf_dir):
    a, b = F.col("l_partkey") % 16, F.col("l_suppkey") % 16
    packed = codes.pack_run(F.array(a.cast("int"), b.cast("int")))
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(
        "l_orderkey", "l_linenumber", a.alias("a"), b.alias("b"), packed.cast("bigint").alias("packed"), codes.run_code(packed, 1).cast("bigint").alias("second"),
        codes.mutation_info(F.lit(2), F.lit(3)).alias("info"), codes.pack_block_id(F.col("l_partkey"), F.col("l_suppkey")).alias("block_id"),
    )


@query("SELECT event_id, CAST(regexp_extract(props, '\"k\": ?([0-9]+)', 1) AS BIGINT) AS k FROM events")
def json_path_extract(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("SELECT page_id, tag, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<([a-z0-9]+)', 1)) AS tag FROM pages) GROUP BY page_id, tag")
def html_text_split(spark, sf_dir):
    tags = F.regexp_extract_all("html", F.lit("<([a-z0-9]+)"), 1)
    return table(spark, sf_dir, "pages").select("page_id", F.explode(tags).alias("tag")).groupBy("page_id", "tag").agg(F.count("*").alias("n"))


@query("SELECT user_id, event_id, list_filter([0, 1, 2, 3], lambda i: (CAST(event_id % 16 AS INTEGER) >> i) % 2 = 1) AS nucs, CAST(event_id % 16 AS INTEGER) & -CAST(event_id % 16 AS INTEGER) AS low FROM events")
def ambiguity_expand(spark, sf_dir):
    code = (F.col("event_id") % 16).cast("int")
    return table(spark, sf_dir, "events").select("user_id", "event_id", codes.expanded(code).alias("nucs"), codes.lowest_bit(code).alias("low"))


@query("""SELECT 'S' AS rec, CAST(o_orderkey AS VARCHAR) AS id, 'S' || chr(9) || o_orderkey || chr(9) || o_orderpriority AS line FROM orders
UNION ALL SELECT 'P', CAST(l_orderkey AS VARCHAR), 'P' || chr(9) || l_orderkey || chr(9) || string_agg(l_partkey || '+', ',' ORDER BY l_linenumber, l_partkey, l_suppkey) || chr(9) || '*'
FROM lineitem GROUP BY l_orderkey""")
def gfa_lines(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    items = table(spark, sf_dir, "lineitem")
    seg = orders.select(F.lit("S").alias("rec"), F.col("o_orderkey").cast("string").alias("id"), F.concat_ws("\t", F.lit("S"), F.col("o_orderkey").cast("string"), "o_orderpriority").alias("line"))
    parts = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey")))
    walk = F.array_join(F.transform(parts, lambda x: F.concat(x["l_partkey"].cast("string"), F.lit("+"))), ",")
    path = items.groupBy("l_orderkey").agg(walk.alias("p"))
    line = F.concat_ws("\t", F.lit("P"), F.col("l_orderkey").cast("string"), "p", F.lit("*"))
    return seg.unionByName(path.select(F.lit("P").alias("rec"), F.col("l_orderkey").cast("string").alias("id"), line.alias("line")))


@query("""SELECT n_regionkey, 'a' || chr(10) || string_agg('s' || chr(9) || n_name || chr(9) || n_nationkey || chr(9) || length(n_name) || chr(9) || '+', chr(10) ORDER BY n_name) AS par
FROM nation GROUP BY n_regionkey""")
def maf_lines(spark, sf_dir):
    row = F.concat_ws("\t", F.lit("s"), "n_name", F.col("n_nationkey").cast("string"), F.length("n_name").cast("string"), F.lit("+"))
    rows = F.array_sort(F.collect_list(F.struct("n_name", row.alias("line"))))
    text = F.concat(F.lit("a\n"), F.array_join(F.transform(rows, lambda x: x["line"]), "\n"))
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(text.alias("par"))


@query("SELECT l_linenumber, l_shipdate, l_orderkey, l_partkey, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_shipdate LIMIT 25")
def topk_sites(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_linenumber", "l_shipdate", "l_orderkey", "l_partkey", "l_extendedprice")
    return rows.orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey", "l_shipdate").limit(25)
