"""Lines that a source repeats in many of its records, and records without them.

Within a source, wordings are the nodes of a graph whose edges join wordings that stand on
consecutive worded lines of a record; both are weighted by the number of records they stand
in. Nodes with enough support are boilerplate; those joined by edges with enough support
form one block (connected components). Every occurrence of a boilerplate wording is deleted.

Lines have the same wording if their letters a-z agree, ignoring case and taking everything
between them as one space. Lines without such letters are never boilerplate.

Texts are cut into lines once, without a shuffle of texts: a line is kept as its record, number,
128 bits of its wording and those of the worded line before. Counting runs on these rows by
partial aggregation on (source, wording), so a source that holds a third of the records is
spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wrackline.llm.components import components
from wrackline.llm.copies import SENT
from wrackline.session import cut

NODE = ("source", "h", "g")


def wording(line: str | Column) -> Column:
    return F.trim(F.lower(F.regexp_replace(line, "[^A-Za-z]+", " ")))


def _meeting(rows: DataFrame, nodes: DataFrame, prefix: str = "") -> DataFrame:
    """Rows joined to their nodes (`source, h, g` and more), the wording being in `<prefix>h, <prefix>g`."""
    other = _small(nodes.withColumnsRenamed({"source": "_source", "h": "_h", "g": "_g"}))
    return rows.join(other, F.col("source").eqNullSafe(F.col("_source")) & (F.col(prefix + "h") == F.col("_h")) & (F.col(prefix + "g") == F.col("_g"))).drop("_source", "_h", "_g")


def _small(df: DataFrame) -> DataFrame:
    """df marked for broadcast if its rows, counted here, are at most SENT."""
    return F.broadcast(df) if df.limit(SENT + 1).count() <= SENT else df


def deliveries(df: DataFrame, key: str, source: str, text: str, at: str | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows `id, source, text, x, y`, `id, source, x, y` of the delivery of each key that holds, and those of the keys with different ones.

    The latest by `at` holds (then any fixed one); x and y are 128 bits of source and text, so that texts needn't move.
    """
    both = F.struct(F.col(source).alias("s"), F.col(text).alias("t"))
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(source).alias("source"), F.col(text).alias("text"), F.xxhash64(both).alias("x"), F.xxhash64(F.lit("b"), both).alias("y"), (F.col(at) if at else F.lit(0)).alias("_at"))
    last = F.max_by(F.struct("source", "x", "y"), F.struct(F.col("_at").isNotNull(), "_at", "x", "y"))
    held = rows.groupBy("id").agg(last.alias("l"), (F.min(F.struct("x", "y")) != F.max(F.struct("x", "y"))).alias("several")).select("id", "l.*", "several")
    held = cut(held)
    return rows.drop("_at"), held.drop("several"), held.where("several").select("id", "x", "y")


def holding(rows: DataFrame, several: DataFrame) -> DataFrame:
    """The rows (`id, x, y` and more) of the delivery that holds."""
    other = _small(several.toDF("_id", "_x", "_y"))
    joined = rows.join(other, F.col("id") == F.col("_id"), "left")
    return joined.where("_id is null or (x = _x and y = _y)").drop("_id", "_x", "_y")


def lines(rows: DataFrame) -> DataFrame:
    """`id, source, x, y, line_no, h, g, bh, bg`: worded lines (numbered from 1, empty lines counted) by the hash of their wording, and that of the worded line before."""
    cut_up = F.transform(F.split("text", "\n", -1), lambda line, i: F.struct((i + 1).alias("line_no"), wording(line).alias("w")))
    worded = F.transform(F.filter(cut_up, lambda p: p["w"] != ""), lambda p: F.struct(p["line_no"].alias("line_no"), F.xxhash64(p["w"]).alias("h"), F.xxhash64(F.lit("b"), p["w"]).alias("g")))
    pair = lambda w: F.zip_with(w, F.concat(F.array(F.lit(None)), w), lambda one, before: F.struct(one.alias("one"), before.alias("before")))
    pairs = F.get(F.transform(F.array(worded), pair), 0)
    each = rows.select("id", "source", "x", "y", F.explode(pairs).alias("p")).select("id", "source", "x", "y", F.col("p.one").alias("one"), F.col("p.before").alias("before"))
    return each.where("one is not null").select("id", "source", "x", "y", "one.*", F.col("before.h").alias("bh"), F.col("before.g").alias("bg"))


class Graph:
    """Lines, supported nodes and the blocks of a collection.

    A key counts once (its latest delivery by `at`); rows with a null key are left out. Null and
    blank texts count as records of their source but have no case. A null source is a source of
    its own. Ties don't arise: the result depends on counts only.
    """

    def __init__(self, df: DataFrame, key: str, source: str, text: str, at: str | None = None, least: int = 3, percent: float = 2.0):
        self.rows, held, self.several = deliveries(df, key, source, text, at)
        self.least, self.percent = least, percent
        self.lines = cut(holding(lines(self.rows), self.several).drop("x", "y"))
        of = held.groupBy("source").agg(F.count(F.lit(1)).alias("of"))
        # a record counts once for a wording
        counts = self.lines.groupBy(*NODE, "id").agg(F.lit(1).alias("_")).groupBy(*NODE).agg(F.count(F.lit(1)).alias("records")).where(F.col("records") >= least)
        self.of = of
        self.nodes = cut(self._enough(counts, "records"))

    def _enough(self, counts: DataFrame, n: str) -> DataFrame:
        joined = counts.join(self.of.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
        return joined.where((F.col(n) >= self.least) & (F.col(n) * 100.0 >= F.col("of") * self.percent))

    def blocks(self) -> DataFrame:
        """`source, h, g, records, of, block`: supported nodes, each in the block of those that supported edges join it to (alone: in its own)."""
        nodes = self.nodes.withColumn("node", F.xxhash64(*NODE))
        ends = nodes.select(*NODE, "node")
        pairs = _meeting(_meeting(self.lines.where("bh is not null"), ends.withColumnRenamed("node", "b")), ends.withColumnRenamed("node", "a"), "b")
        weights = pairs.groupBy("source", "a", "b", "id").agg(F.lit(1).alias("_")).groupBy("source", "a", "b").agg(F.count(F.lit(1)).alias("weight")).where(F.col("weight") >= self.least)
        strong = self._enough(weights, "weight").select("a", "b")
        named = components(strong).toDF("node", "block")
        return nodes.join(named, "node", "left").select(*NODE, "records", "of", F.coalesce("block", "node").alias("block"))

    def hits(self) -> DataFrame:
        """`id, source, line_no, block, records, of`: every occurrence of a wording of the graph's blocks; their counts are the exact check."""
        kept = cut(self.blocks().where((F.col("records") >= self.least) & (F.col("records") * 100.0 >= F.col("of") * self.percent)))
        found = _meeting(self.lines, kept).select("id", "source", "line_no", "block", "records", "of")
        # a delivery repeated as it is gives its lines again
        return found.groupBy("id", "line_no").agg(*[F.first(c).alias(c) for c in ("source", "block", "records", "of")])


def repeated_lines(df: DataFrame, key: str, source: str, text: str, at: str | None = None, least: int = 3, percent: float = 2.0) -> DataFrame:
    """`id, source, line_no, block, records, of`: every occurrence of a repeated line, with the block of the graph that it belongs to."""
    return Graph(df, key, source, text, at, least, percent).hits().select("id", "source", "line_no", "block", "records", "of")


def blocks(df: DataFrame, key: str, source: str, text: str, at: str | None = None, least: int = 3, percent: float = 2.0) -> DataFrame:
    """`source, wording, records, of, block`: boilerplate wordings and the block each belongs to."""
    graph = Graph(df, key, source, text, at, least, percent)
    kept = cut(graph.blocks())
    # the wordings themselves, from one occurrence each
    one = graph.lines.join(_small(kept.select(*NODE)), list(NODE[1:]), "left_semi").groupBy(*NODE).agg(F.min(F.struct("id", "line_no")).alias("at")).select("at.*", *NODE)
    texts = holding(graph.rows, graph.several).join(_small(one.select("id").distinct()), "id", "left_semi").dropDuplicates(["id"]).select("id", "text")
    named = one.join(texts, "id").select(*NODE, wording(F.get(F.split("text", "\n", -1), F.col("line_no") - 1)).alias("wording"))
    return _meeting(kept, named).select("source", "wording", "records", "of", "block")


def without_lines(df: DataFrame, key: str, source: str, text: str, at: str | None = None, least: int = 3, percent: float = 2.0) -> DataFrame:
    """`id, source, text, removed`: each record once, its text without the repeated lines.

    Null texts stay null. The line breaks around a deleted line close up to one.
    """
    graph = Graph(df, key, source, text, at, least, percent)
    hits = graph.hits().groupBy("id").agg(F.collect_set("line_no").alias("gone"))
    records = holding(graph.rows, graph.several).dropDuplicates(["id"]).select("id", "source", "text")
    rows = records.join(hits, "id", "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<int>")))
    # a removed line leaves no mark in its place: the others are taken by number
    kept = F.filter(F.split("text", "\n", -1), lambda line, i: ~F.array_contains("gone", (i + 1).cast("int")))
    tidy = F.when(F.size("gone") == 0, F.col("text")).otherwise(F.regexp_replace(F.regexp_replace(F.array_join(kept, "\n"), "\n{3,}", "\n\n"), "^\n+|\n+$", ""))
    return rows.select("id", "source", tidy.alias("text"), F.size("gone").alias("removed"))
