"""Records combined into sequences of a fixed length: best fit under conflicts.

Bins stand in order of the room left. An item goes to the tightest bin that can take it: the
search begins at the least room that is enough and goes on to the next larger as long as the
bin at hand already holds the item's duplicate cluster (or, if asked for, its source); bins
carry both as bitmaps. If none is left, a bin is opened. Items come in falling size, so small
ones fill the gaps.

The search is sequential, so items are first dealt by a hash into groups of bounded size, one
task each; groups of tens of thousands of items leave as little room as one of all items.
Items of different splits never share a sequence. An item beyond the length is cut into whole
sequences and a rest, and only the rest is packed with others.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wrackline.llm.copies import newest

SCHEMA = "split string, rec_id bigint, piece int, start int, tokens int, bin int, place int"


def best_fit(sizes: list[int], clusters: list[int], sources: list[int], length: int, one_source: bool = False) -> list[int]:
    """The bin of each item. clusters and sources: bitmaps of the items (0: no conflict).

    Items of one size and cluster follow each other, and each begins its search where the one
    before it found its bin: all tighter ones hold the cluster, so copies cost no more than others.
    """
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], clusters[i], sources[i], i))
    last: tuple[int, int, int] | None = None
    where = (0, -1)
    room: list[tuple[int, int]] = []
    held: list[int] = []
    origin: list[int] = []
    out = [0] * len(sizes)
    for i in order:
        size, mine, source = sizes[i], clusters[i], sources[i] if one_source else 0
        same = (size, mine, source)
        at = bisect_left(room, where if mine and same == last else (size, -1))
        while at < len(room) and (held[room[at][1]] & mine or origin[room[at][1]] & source):
            at += 1
        if at < len(room):
            left, b = where = room.pop(at)
        else:
            left, b = length, len(held)
            where = (length + 1, b)  # none of those at hand can take another of this kind
            held.append(0)
            origin.append(0)
        held[b] |= mine
        origin[b] |= source
        out[i], last = b, same
        if left > size:
            insort(room, (left - size, b))
    return out


def _bits(values: pd.Series, only_repeated: bool) -> list[int]:
    counts = values.value_counts()
    if only_repeated:
        counts = counts[counts > 1]
    bit = {v: 1 << n for n, v in enumerate(sorted(counts.index))}
    return [bit.get(v, 0) for v in values]


def sequences(df: DataFrame, length: int, key: str = "rec_id", tokens: str = "tokens", split: str = "split", source: str = "source", text: str = "content", digest: str = "digest", at: str | None = "packed_at", one_source: bool = False, group: int = 40_000) -> DataFrame:
    """`rec_id, split, source, piece, start, tokens, sequence, place, status` for every record.

    A key counts once (its latest delivery by `at`); rows with a null key are left out. status
    is `packed`, or `empty` (no tokens) or `unknown` (tokens null or negative): those records
    take no room, have no sequence and come out once. A record without a split is packed among
    its like. The duplicate cluster is the digest in lower case, or the SHA-256 of the trimmed
    text where it is null. The result doesn't depend on the order of rows.
    """
    if length < 1:
        raise ValueError("length must be positive")
    cluster = F.coalesce(F.lower(digest), F.sha2(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), 256))
    rows = df.withColumn("_cluster", F.xxhash64(cluster))
    rows = newest(rows, key, text, at, (tokens, split, source, "_cluster")).select("id", F.col(tokens).cast("int").alias("tokens"), F.col(split).alias("split"), F.col(source).alias("source"), "_cluster")
    known = rows.where("tokens > 0")
    whole = F.floor((F.col("tokens") - 1) / length).cast("int")
    cut = known.select("*", F.explode(F.sequence(F.lit(0), whole)).alias("piece"))
    cut = cut.withColumn("start", F.col("piece") * length).withColumn("size", F.least(F.lit(length), F.col("tokens") - F.col("start")).cast("int"))
    groups = max(1, -(-known.count() // group))
    cut = cut.withColumn("group", F.pmod(F.xxhash64("id", F.lit("packing")), F.lit(groups)).cast("int"))

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["id", "piece"], kind="stable").reset_index(drop=True)
        # a record's own pieces don't conflict: only its last can share a bin
        clusters = _bits(part["_cluster"], True)
        sources = _bits(part["source"].fillna(""), False)
        part["bin"] = best_fit(part["size"].tolist(), clusters, sources, length, one_source)
        part["place"] = part.groupby("bin").cumcount().astype("int32")
        return part[["id", "group", "piece", "start", "size", "bin", "place"]]

    packed = cut.select("id", "group", "_cluster", F.coalesce("split", F.lit("")).alias("part"), "source", "piece", "start", "size").groupBy("part", "group").applyInPandas(pack, "id bigint, group int, piece int, start int, size int, bin int, place int")
    joined = rows.join(packed, "id", "left")
    name = F.when(F.col("bin").isNotNull(), F.concat_ws("-", F.coalesce("split", F.lit("none")), F.col("group"), F.col("bin")))
    status = F.when(F.col("bin").isNotNull(), "packed").when(F.col("tokens") == 0, "empty").otherwise("unknown")
    return joined.select(F.col("id").alias(key), "split", "source", F.coalesce("piece", F.lit(0)).alias("piece"), F.coalesce("start", F.lit(0)).alias("start"), F.coalesce("size", "tokens").alias("tokens"), name.alias("sequence"), "place", status.alias("status"))


def filled(packed: DataFrame, length: int) -> DataFrame:
    """`split, sequences, tokens, unused, least_possible`: how full the sequences of each split are."""
    rows = packed.where("status = 'packed'").groupBy("split").agg(F.count_distinct("sequence").alias("sequences"), F.sum("tokens").alias("tokens"))
    return rows.select("split", "sequences", "tokens", (F.col("sequences") * length - F.col("tokens")).alias("unused"), F.ceil(F.col("tokens") / length).alias("least_possible"))
