"""Newick text to node rows and back."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeframe.schemas import NODE

_TOKEN = re.compile(r"'(?:[^']|'')*'|[(),;:]|[^(),;:']+")


def parse(text: str) -> list[dict]:
    """Nodes of one tree in pre-order. Inner nodes are named node_1, node_2 ... in that order; a length
    that is missing or 0 counts as 1, the root's is 0. A mismatched bracket raises ValueError."""
    nodes: list[dict] = []
    open_: list[int] = []
    current, inner, wants_length = -1, 0, False

    def add(name: str | None) -> int:
        nonlocal inner
        parent = open_[-1] if open_ else None
        if name is None:
            inner += 1
        if parent is None and nodes:
            raise ValueError("more than one root")
        child = nodes[parent]["children"] if parent is not None else []
        nodes.append({"name": name or f"node_{inner}", "parent": parent, "ord": len(child), "children": [], "length": 0.0, "leaf": name is not None})
        child.append(len(nodes) - 1)
        return len(nodes) - 1

    for token in _TOKEN.findall(text.replace(" ", "").replace("\n", "").replace("\r", "")):
        if token == "(":
            open_.append(add(None))
            current, wants_length = -1, False
        elif token == ")":
            if not open_:
                raise ValueError("unbalanced brackets")
            current, wants_length = open_.pop(), False
        elif token == ",":
            if not open_:
                raise ValueError("a comma outside brackets")
            current, wants_length = -1, False
        elif token == ":":
            wants_length = True
        elif token == ";":
            break
        elif wants_length:
            nodes[current]["length"] = float(token)
            wants_length = False
        elif current < 0:
            current = add(token)
        # a name behind a bracket is that of an inner node, which gets its own
    if open_ or not nodes:
        raise ValueError("unbalanced brackets")
    last = list(range(len(nodes)))
    for i in range(len(nodes) - 1, 0, -1):
        parent = nodes[i]["parent"]
        last[parent] = max(last[parent], last[i])
    rows: list[dict] = []
    for i, n in enumerate(nodes):
        rows.append(
            {
                "node_id": i, "name": n["name"], "parent_id": n["parent"], "child_ord": n["ord"], "pre": i, "post": last[i],
                "level": 0 if n["parent"] is None else rows[n["parent"]]["level"] + 1,
                "branch_len": 0.0 if i == 0 else n["length"] or 1.0, "is_leaf": n["leaf"], "annotations": [],
            }
        )
    return rows


def read_newick(trees: DataFrame) -> DataFrame:
    """Node rows of a table (tree_id int, newick string); a tree is one string and is parsed by one task."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(NODE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tree, text in zip(batch.column("tree_id").to_pylist(), batch.column("newick").to_pylist()):
                yield pa.RecordBatch.from_pylist([{"tree_id": tree, **row} for row in parse(text)], schema=schema)

    return trees.select(F.col("tree_id").cast("int"), "newick").mapInArrow(run, NODE)


def write_newick(nodes: DataFrame) -> DataFrame:
    """tree_id and newick of every tree, with the names of inner nodes and six digits of length.

    Each node's opening and closing text is known from its row, and nested brackets are the rows in
    order of pre with the closings of post behind, so that one ordered aggregation writes a tree.
    """
    label = F.concat(F.col("name"), F.lit(":"), F.format_string("%.6f", F.col("branch_len").cast("double")))
    comma = F.when((F.col("child_ord") > 0) & F.col("parent_id").isNotNull(), ",").otherwise("")
    opens = nodes.select(
        "tree_id", F.col("pre").alias("at"), F.lit(0).alias("side"), F.lit(0).alias("up"),
        F.concat(comma, F.when(F.col("is_leaf"), label).otherwise(F.lit("("))).alias("text"),
    )
    closes = nodes.where(~F.col("is_leaf")).select(
        "tree_id", F.col("post").alias("at"), F.lit(1).alias("side"), (-F.col("level")).alias("up"), F.concat(F.lit(")"), label).alias("text")
    )
    alone = F.max(F.when(F.col("side") == 1, 1).otherwise(0)) == 0
    ordered = F.array_sort(F.collect_list(F.struct("at", "side", "up", "text")))
    joined = F.concat(F.array_join(F.transform(ordered, lambda x: x["text"]), ""), F.lit(";"))
    single = F.concat(F.lit("("), F.regexp_replace(joined, ":[0-9.]+;$", ""), F.lit(");"))
    return opens.unionByName(closes).groupBy("tree_id").agg(F.when(alone, single).otherwise(joined).alias("newick"))


def rename_leaves(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """nodes with the leaves' names replaced by those of a table (old, new)."""
    joined = nodes.join(names, (F.col("name") == F.col("old")) & F.col("is_leaf"), "left")
    return joined.withColumn("name", F.coalesce("new", "name")).select(nodes.columns)
