"""Exact and near duplicates with a fixed order of preference."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wrackline.functions.text import canonical, simhash
from wrackline.session import cut


def longest_of_copies(records: DataFrame) -> DataFrame:
    """Of records (`source, ordinal, content`) that agree but for case and white space, the longest; ties: the first.

    Copies are reduced by partial aggregation, so a text that fills a third of the table is no
    hot group. Null contents are copies of each other.
    """
    rank = F.struct((-F.length("content")).alias("l"), "source", "ordinal", "content")
    best = records.groupBy(F.sha2(canonical(F.col("content")), 256).alias("_key")).agg(F.min(rank).alias("best"))
    return best.select("best.source", "best.ordinal", "best.content")


def first_of_digest(records: DataFrame, digest: str, *order: str) -> DataFrame:
    """The first record of each digest in the given order."""
    rest = [c for c in records.columns if c not in (digest, *order)]
    best = records.groupBy(digest).agg(F.min(F.struct(*order, *rest)).alias("best"))
    return best.select(digest, "best.*").select(*records.columns)


def near_pairs(hashed: DataFrame, distance: int = 3) -> DataFrame:
    """`a, b`: ids of `id, hash` (64 bits) that differ in at most `distance` bits, with a < b.

    The bits stand in distance + 3 parts, of which at least three agree in such a pair, so rows
    meet under each choice of three parts: at distance 3 these are 20 keys of some 32 bits, and
    what a key holds by chance grows with records / 2**32, not / 2**16 as with four bands. A pair
    within 3 bits shares one of four 16-bit bands, too, so that rule is met as well.
    """
    parts = distance + 3
    edges = [64 * i // parts for i in range(parts + 1)]

    def mask(choice: tuple[int, ...]) -> int:
        """The bits of the parts, as a signed number."""
        bits = sum((1 << edges[i + 1]) - (1 << edges[i]) for i in choice)
        return bits - (1 << 64) if bits >> 63 else bits

    keys = F.array(*[F.struct(F.lit(n).alias("choice"), F.col("hash").bitwiseAND(F.lit(mask(c)).cast("bigint")).alias("value")) for n, c in enumerate(combinations(range(parts), 3))])
    rows = hashed.where("hash is not null").select("id", "hash", F.explode(keys).alias("k")).select("id", "hash", "k.choice", "k.value")
    left, right = rows.toDF("a", "ha", "choice", "value"), rows.toDF("b", "hb", "choice", "value")
    near = left.join(right, ["choice", "value"]).where((F.col("a") < F.col("b")) & (F.bit_count(F.col("ha").bitwiseXOR(F.col("hb"))) <= distance))
    return near.select("a", "b").distinct()


def first_of_near(ranked: DataFrame, pairs: DataFrame) -> DataFrame:
    """`id` of the records kept: in rank order, each that no kept record is near to.

    ranked: `id, rank` (any sortable value, unique). A record is kept once all nearer to the
    front are dropped, dropped once one of them is kept; what was dropped drops nothing.
    """
    r = ranked.select("id", "rank")
    edges = pairs.join(r.toDF("a", "ra"), "a").join(r.toDF("b", "rb"), "b")
    forward = F.col("ra") < F.col("rb")
    edges = cut(edges.select(F.when(forward, F.col("a")).otherwise(F.col("b")).alias("first"), F.when(forward, F.col("b")).otherwise(F.col("a")).alias("then")))
    open_, kept, dropped = edges, None, None
    while not open_.isEmpty():
        later = open_.select(F.col("then").alias("first")).distinct()
        free = open_.select("first").distinct().join(later, "first", "left_anti")
        gone = cut(open_.join(free, "first", "left_semi").select(F.col("then").alias("id")).distinct())
        dropped = gone if dropped is None else cut(dropped.union(gone))
        out = gone.toDF("first")
        open_ = cut(open_.join(free, "first", "left_anti").join(out, "first", "left_anti").join(out.toDF("then"), "then", "left_anti").select("first", "then"))
    return r.select("id") if dropped is None else r.select("id").join(dropped, "id", "left_anti")


def deduplicated(records: DataFrame, distance: int = 3, hashing=simhash) -> DataFrame:
    """Records (`source, ordinal, content`) without exact copies and near copies, longest first; see `in_order`."""
    exact = cut(longest_of_copies(records).withColumn("id", F.struct("source", "ordinal")).withColumn("hash", hashing(F.col("content"))))
    rank = F.struct((-F.length("content")).alias("l"), "source", "ordinal")
    kept = first_of_near(exact.select("id", rank.alias("rank")), near_pairs(exact.select("id", "hash"), distance))
    return exact.join(kept, "id", "left_semi").select("source", "ordinal", "content")


def in_order(records: DataFrame) -> DataFrame:
    """The final order: by source and ordinal."""
    return records.orderBy("source", "ordinal")
