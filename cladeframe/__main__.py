"""Command line: python -m cladeframe COMMAND NETWORK [options]; each command is a method of Network."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe.network import Network
from cladeframe.sources import newick, placement, sinks, text, windows


#: Commands that write lines: the columns that put them in order, and whether each tree has lines of its own.
LINES = {
    "vcf": (["at"], True), "gfa": (["rank", "key"], True), "maf": (["tree_id", "group"], True), "consensus": (["tree_id", "block_id"], True),
    "fasta": ([], True), "msa": ([], True), "index": ([], True), "newick": (["tree_id"], True), "extended-newick": (["rank", "at"], False),
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="cladeframe", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, **options) -> None:
        p = commands.add_parser(name)
        p.add_argument("network")
        p.add_argument("-o", "--output", help="folder for the result; printed without it")
        p.add_argument("--one-file", action="store_true", help="lines go into one file at the output's path, not into a folder of parts")
        for key, settings in options.items():
            p.add_argument(f"--{key.replace('_', '-')}", **settings)

    whole, number = {"required": True}, {"required": True, "type": int}
    command("build", newick=whole, msa={}, window={"type": int, "help": "read the alignment in windows of so many columns"}, gfa={}, pangraph={}, reference={}, method={"choices": ["fitch", "sankoff"], "default": "fitch"})
    for name in ("summary", "newick", "gfa", "maf", "consensus", "ratio-test", "extended-newick", "root", "copies"):
        command(name)
    for name in ("fasta", "msa"):
        command(name, nodes={"nargs": "+", "help": "names of nodes; all tips without it"})
    command("placement", binary={"action": "store_true", "help": "the binary message of each tree, at the output"})
    command("mutations", reference_file={})
    command("mutations-at", node=whole, block=number, position=number)
    command("vcf", reference=whole)
    command("tips", node=whole)
    command("index", reference=whole, start=number, end=number)
    command("amino-acids", start=number, end=number)
    command("annotate", file=whole)
    command("search", annotation=whole)
    command("subnet", file=whole)
    command("reroot", tip=whole)
    command("split", node=whole, tree=number)
    command("segment", first_block=number, start=number, last_block=number, end=number)
    command("create-network", events=whole)
    return top


def build(spark: SparkSession, a: argparse.Namespace) -> Network:
    lines = spark.read.text(a.newick, wholetext=True)
    nodes = newick.read_newick(lines.select(F.lit(0).alias("tree_id"), F.trim("value").alias("newick"))).cache()
    if a.msa and a.window:
        rows = windows.read_windows(spark, a.msa, a.window).withColumn("tree_id", F.lit(0))
        return Network.from_windows(nodes, rows, a.window, a.method, a.reference)
    if a.msa:
        rows = text.read_fasta(spark, a.msa, check_width=True).select(F.lit(0).alias("tree_id"), "name", "seq")
        return Network.from_msa(nodes, rows, a.method, a.reference)
    if a.gfa:
        return Network.from_gfa(nodes, *text.read_gfa(spark, a.gfa))
    if a.pangraph:
        return Network.from_pangraph(nodes, text.read_pangraph(spark, a.pangraph), a.reference)
    raise SystemExit("build needs --msa, --gfa or --pangraph")


def run(spark: SparkSession, a: argparse.Namespace, net: Network | None = None) -> DataFrame | Network:
    """The table or network that a command gives."""
    if a.command == "build":
        return build(spark, a)
    net = net or Network.read(spark, a.network)
    table = {
        "summary": net.summary, "newick": net.newick, "gfa": net.gfa, "maf": net.maf, "consensus": net.consensus, "placement": net.placement,
        "ratio-test": net.ratio_test, "fasta": lambda: net.fasta(a.nodes), "msa": lambda: net.fasta(a.nodes, aligned=True), "root": net.root, "copies": net.copies,
        "extended-newick": net.extended_newick_lines,
        "mutations": lambda: net.mutations_against(text.read_reference(spark, a.reference_file)) if a.reference_file else net.mutations(),
        "mutations-at": lambda: net.mutations_at(a.node, a.block, a.position), "vcf": lambda: net.vcf(a.reference),
        "tips": lambda: net.tips(a.node), "index": lambda: sinks.fasta_records(net.index(a.reference, a.start, a.end)),
        "amino-acids": lambda: net.amino_acids(a.start, a.end), "annotate": lambda: net.annotate(text.read_annotations(spark, a.file)),
        "search": lambda: net.search(a.annotation), "subnet": lambda: net.subnet(text.read_node_lists(spark, a.file)),
        "reroot": lambda: net.reroot(a.tip), "split": lambda: net.split(a.node, a.tree),
        "segment": lambda: net.segment(a.first_block, a.start, a.last_block, a.end),
        "create-network": lambda: net.create_network(text.read_events(spark, a.events)),
    }
    return table[a.command]()


def _trees(net: Network, a: argparse.Namespace) -> list[int]:
    """The trees that a command has lines of; a reference or named nodes stand in some only."""
    names = [a.reference] if a.command in ("vcf", "index") else getattr(a, "nodes", None)
    if names is None:
        return net.tree_ids()
    return [r.tree_id for r in net["node"].where(F.col("name").isin(names)).select("tree_id").distinct().orderBy("tree_id").collect()]


def write_out(spark: SparkSession, a: argparse.Namespace) -> None:
    """The lines of a command at its output; where several trees have some, a part tree_N of it for each."""
    order, by_tree = LINES[a.command]
    write = sinks.write_file if a.one_file else sinks.write_lines
    net = Network.read(spark, a.network)
    trees = _trees(net, a) if by_tree else [None]
    if not trees:
        raise SystemExit("no tree has what is asked for")
    for t in trees:
        made = run(spark, a, net if len(trees) == 1 and t == trees[0] and len(net.tree_ids()) == 1 or t is None else net.only(t))
        line = [c for c in ("line", "record", "newick") if c in made.columns][0]
        write(made.select(*order, line), a.output if len(trees) == 1 else f"{a.output.rstrip('/')}/tree_{t}", order)


def write_messages(spark: SparkSession, a: argparse.Namespace) -> None:
    """Binary placement records of every tree at the output, or in a file tree_N of it for each of several."""
    net = Network.read(spark, a.network)
    trees = net.tree_ids()
    for t in trees:
        one = net.only(t)
        placement.write_file(one.newick().first().newick, one.placement_records(), a.output if len(trees) == 1 else f"{a.output.rstrip('/')}/tree_{t}")


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    if a.output and a.command != "build" and a.output.rstrip("/") == a.network.rstrip("/"):
        raise SystemExit("a network cannot be written over itself while it is read")
    spark = SparkSession.builder.appName("cladeframe").getOrCreate()
    if a.output and a.command in LINES:
        return write_out(spark, a)
    if a.command == "placement" and a.binary:
        if not a.output:
            raise SystemExit("--binary needs an output")
        return write_messages(spark, a)
    made = run(spark, a)
    if isinstance(made, Network):
        made.write(a.output or a.network) if a.command == "build" or a.output else made["node"].show(50, truncate=False)
    elif a.output:
        made.write.mode("overwrite").option("sep", "\t").option("header", "true").csv(a.output)
    else:
        made.show(50, truncate=False)


if __name__ == "__main__":
    main()
