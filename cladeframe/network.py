"""A network of trees as tables, with one method for each command."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cladeframe import schemas
from cladeframe.operators import mutations, parsimony, sequence, tree
from cladeframe.sources import newick, sinks


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], schemas.TABLES[name])


def columns_of(chunks: DataFrame) -> DataFrame:
    """Columns that hold a base: tree_id, site, pos (their number among these) and base, from consensus chunks."""
    order = Window.partitionBy("tree_id").orderBy("site").rowsBetween(Window.unboundedPreceding, -1)
    bases = F.translate("base", "-", "")
    started = chunks.withColumn("before", F.coalesce(F.sum(F.length(bases)).over(order), F.lit(0)))
    kept = F.filter(F.transform(F.split("base", ""), lambda c, i: F.struct(i.alias("i"), c.alias("c"))), lambda x: (x["c"] != "-") & (x["c"] != ""))
    each = started.select("tree_id", "site", "before", F.posexplode(kept).alias("k", "x"))
    return each.select("tree_id", (F.col("site") + F.col("x.i")).alias("site"), (F.col("before") + F.col("k")).cast("int").alias("pos"), F.col("x.c").alias("base"))


@dataclass
class Network:
    """Tables of schemas.TABLES by name; methods give new tables or networks and change nothing."""

    tables: dict[str, DataFrame] = field(default_factory=dict)

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Network:
        return cls({name: spark.read.schema(ddl).parquet(f"{path}/{name}") for name, ddl in schemas.TABLES.items()})

    def write(self, path: str) -> None:
        """Parquet, each table partitioned by tree where it has trees."""
        for name, ddl in schemas.TABLES.items():
            df = self.tables.get(name)
            df = empty(self["node"].sparkSession, name) if df is None else df
            writer = df.write.mode("overwrite").option("compression", "zstd")
            (writer.partitionBy("tree_id") if "tree_id" in df.columns else writer).parquet(f"{path}/{name}")

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    @classmethod
    def from_msa(cls, nodes: DataFrame, msa: DataFrame, method: str = "fitch", reference: str | None = None) -> Network:
        """Infer the mutations of an alignment on given trees: one block, inserted at the root, whose
        consensus leaves out columns without a base."""
        return cls._of_inferred(nodes, *parsimony.infer(nodes, msa, method, reference))

    @classmethod
    def from_windows(cls, nodes: DataFrame, windows: DataFrame, width: int, method: str = "sankoff", reference: str | None = None) -> Network:
        """from_msa() of an alignment in windows of `width` columns (tree_id, name, window, seq)."""
        return cls._of_inferred(nodes, *parsimony.infer_windows(nodes, windows, width, method, reference))

    @classmethod
    def _of_inferred(cls, nodes: DataFrame, muts: DataFrame, chunks: DataFrame) -> Network:
        spark = nodes.sparkSession
        columns = columns_of(chunks)
        placed = muts.join(columns.select("tree_id", "site", "pos"), ["tree_id", "site"])
        bases = placed.select("tree_id", "node_id", F.lit(0).alias("block_id"), "pos", F.lit(-1).alias("gap_pos"), "type", "base")
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("site", "base"))), lambda x: F.translate(x["base"], "-", "")), "")
        block = chunks.groupBy("tree_id").agg(text.alias("consensus")).select("tree_id", F.lit(0).alias("block_id"), "consensus")
        roots = nodes.where("parent_id is null").select("tree_id", "node_id")
        ins = roots.select("tree_id", "node_id", F.lit(0).alias("ord"), F.lit(0).alias("block_id"), F.lit("ins").alias("kind"))
        return cls(
            {
                "node": nodes, "block": block, "gap": empty(spark, "gap"), "nuc_mut": mutations.pack(bases), "block_mut": ins,
                "seq_meta": empty(spark, "seq_meta"), "complex_mut": empty(spark, "complex_mut"),
            }
        )

    @classmethod
    def from_gfa(cls, nodes: DataFrame, segments: DataFrame, steps: DataFrame, guided: bool = False) -> Network:
        from cladeframe.operators import build

        return cls(build.from_gfa(nodes, segments, steps, guided))

    @classmethod
    def from_pangraph(cls, nodes: DataFrame, tables: dict[str, DataFrame], reference: str | None = None, guided: bool = False) -> Network:
        from cladeframe.operators import build

        return cls(build.from_pangraph(nodes, tables, reference, guided))

    def root(self) -> DataFrame:
        """The root's aligned text in every tree."""
        return sequence.sequences(self.tables, self["node"].where("parent_id is null"), aligned=True)

    def extended_newick(self) -> tuple[DataFrame, DataFrame]:
        """Newick of every tree, and the complex mutations between trees with their places in blocks."""
        from cladeframe.operators import edits

        return self.newick(), edits.event_coordinates(self.tables)

    def extended_newick_lines(self) -> DataFrame:
        """rank, at and line of a file: the trees' newicks in order, then the complex mutations, tabs between their fields."""
        trees, events = self.extended_newick()
        place = lambda c: F.concat_ws(":", F.col(f"{c}.block_id").cast("string"), F.col(f"{c}.at").cast("string"))
        fields = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("type", "tree1", "seq1", "tree2", "seq2")]
        fields += [place(c) for c in ("s1", "e1", "s2", "e2")] + [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("tree3", "seq3")]
        line = F.concat_ws("\t", *fields)
        lines = trees.select(F.lit(0).alias("rank"), F.lpad(F.col("tree_id").cast("string"), 10, "0").alias("at"), F.col("newick").alias("line"))
        return lines.unionByName(events.select(F.lit(1).alias("rank"), line.alias("at"), line.alias("line")))

    def mutations_against(self, reference: str) -> DataFrame:
        from cladeframe.operators import variants

        return variants.mutations_against(self.tables, reference)

    def mutations_at(self, name: str, block_id: int, pos: int) -> DataFrame:
        from cladeframe.operators import variants

        return variants.mutations_at(self.tables, name, block_id, pos)

    def copies(self) -> DataFrame:
        """Duplications and translocations of blocks in every tree."""
        states = sequence.block_states(self["node"], self["block_mut"])
        return mutations.copies(states, self["block"], self["node"])

    def node_ids(self, names: list[str] | None = None, tips: bool = False) -> DataFrame:
        rows = self["node"].where("is_leaf") if tips else self["node"]
        return (rows if names is None else rows.where(F.col("name").isin(names))).select("tree_id", "node_id")

    def summary(self) -> DataFrame:
        return mutations.summary(self["node"], self["nuc_mut"], self["block_mut"])

    def branch_counts(self) -> DataFrame:
        """Changed bases of every branch by type."""
        return mutations.branch_counts(self["node"], self["nuc_mut"])

    def newick(self) -> DataFrame:
        return newick.write_newick(self["node"])

    def fasta(self, names: list[str] | None = None, aligned: bool = False) -> DataFrame:
        return sinks.fasta_records(sequence.sequences(self.tables, self.node_ids(names, tips=names is None), aligned))

    def sequences(self, names: list[str] | None = None, aligned: bool = False) -> DataFrame:
        return sequence.sequences(self.tables, self.node_ids(names, tips=names is None), aligned)

    def consensus(self) -> DataFrame:
        """tree_id, block_id and record, a FASTA record of each block's consensus."""
        record = F.concat(F.lit(">"), F.col("block_id").cast("string"), F.lit("\n"), F.col("consensus"))
        return self["block"].select("tree_id", "block_id", record.alias("record"))

    def tree_ids(self) -> list[int]:
        return [r.tree_id for r in self["node"].select("tree_id").distinct().orderBy("tree_id").collect()]

    def only(self, tree_id: int) -> Network:
        """The network of one tree, without its complex mutations."""
        kept = {k: v.where(F.col("tree_id") == tree_id) for k, v in self.tables.items() if k != "complex_mut"}
        return Network({**kept, "complex_mut": self["complex_mut"].limit(0)})

    def tips(self, name: str) -> DataFrame:
        return tree.tips_under(self["node"], name)

    def annotate(self, annotations: DataFrame) -> Network:
        return Network({**self.tables, "node": tree.annotate(self["node"], annotations)})

    def search(self, annotation: str) -> DataFrame:
        return tree.with_annotation(self["node"], annotation)

    def index(self, reference: str, start: int, end: int) -> DataFrame:
        return sequence.slice_columns(self.tables, self.node_ids([reference]), start, end)[1]

    def segment(self, first_block: int, start: int, last_block: int, end: int) -> Network:
        return Network(sequence.segment(self.tables, first_block, start, last_block, end))

    def vcf(self, reference: str) -> DataFrame:
        from cladeframe.operators import variants

        return variants.vcf(self.tables, reference)

    def mutations(self) -> DataFrame:
        from cladeframe.operators import variants

        return variants.mutation_list(self.tables)

    def placement(self) -> DataFrame:
        from cladeframe.operators import variants

        return variants.placement_rows(self.tables)

    def placement_records(self) -> DataFrame:
        """The binary list of mutations of every node."""
        from cladeframe.sources import placement

        return placement.records(self["node"], self.placement())

    def ratio_test(self, first: str = "African", second: str = "Non-African") -> DataFrame:
        from cladeframe.operators import variants

        return variants.ratio_test(self.tables, first, second)

    def amino_acids(self, start: int, end: int) -> DataFrame:
        from cladeframe.operators import variants

        return variants.amino_acid_changes(self.tables, start, end)

    def gfa(self, with_bases: bool = True) -> DataFrame:
        from cladeframe.operators import graph

        return graph.gfa(self.tables, with_bases)

    def maf(self) -> DataFrame:
        from cladeframe.operators import graph

        return graph.maf(self.tables)

    def subnet(self, requested: DataFrame, protected: DataFrame | None = None) -> Network:
        from cladeframe.operators import edits

        return Network(edits.subnet(self.tables, requested, protected))

    def reroot(self, tip: str) -> Network:
        from cladeframe.operators import edits

        return edits.reroot(self, tip)

    def split(self, name: str, new_tree: int) -> Network:
        from cladeframe.operators import edits

        return Network(edits.split(self.tables, name, new_tree))

    def create_network(self, events: DataFrame) -> Network:
        from cladeframe.operators import edits

        return Network(edits.create_network(self.tables, events))
