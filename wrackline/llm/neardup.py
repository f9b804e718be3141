"""Near-duplicate records by signature trees.

A record is the set of its distinct word n-grams. Records meet in cells, keyed by
bands of minimum hashes; within a cell they stand in a signature tree: a leaf holds
a record's token bitmap and size, an inner node the OR of its children's bitmaps and
their range of sizes. Two nodes can only hold a pair of the wanted likeness if

    bits(a AND b) + min(collisions a, collisions b) >= t / (1 + t) * (size a + size b)

(the left side is the most n-grams that they can share), so the tree is traversed
against itself and node pairs that can't reach it are cut off with all below them.
Surviving record pairs are measured exactly on their n-grams.

Cells are needed because one tree over the whole collection would prune nothing near
its root. A pair of likeness t shares none of the cells with the probability
(1 - t**rows)**bands: 2e-5 at t = 0.5 with the default 2 rows and 38 bands, 5e-9 at 0.6.
Where no pair may be missed, `exact=True` takes the cells from the rarest n-grams instead
(`rare_cells`): records of the likeness always share one, and the trees stand in these cells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wrackline.llm.arrow import blobs, lists, signed
from wrackline.llm.components import components
from wrackline.llm.copies import classes, newest, texts_of
from wrackline.llm.words import WordHashes, distinct, grams, hashed
from wrackline.session import cut

FANOUT = 8
#: Bits of the wider bitmap that candidates must pass before their n-grams are fetched.
WIDE = 2048


def _seeds(n: int) -> np.ndarray:
    return np.random.default_rng(20_011).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(texts: DataFrame, words: int = 3, bits: int = 512, rows: int = 2, bands: int = 38) -> DataFrame:
    """`id, n, bits, cells, wide, more` of texts (`id, text`) with at least one n-gram; wide is a bitmap of WIDE bits, more the n-grams that share a bit in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, factors = WordHashes(), _seeds(rows * bands)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                flat, lengths = hashed(part.column("text").to_pylist(), cache)
                value, text, _ = grams(flat, lengths, words)
                value, text = distinct(value, text)
                if not len(value):
                    continue
                starts = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1])))
                own = text[starts]
                n = np.diff(np.append(starts, len(text)))
                maps = np.zeros((len(own), bits), np.bool_)
                maps[np.repeat(np.arange(len(own)), n), ((value >> np.uint64(17)) % np.uint64(bits)).astype(np.int64)] = True
                wide = np.zeros((len(own), WIDE), np.bool_)
                wide[np.repeat(np.arange(len(own)), n), ((value >> np.uint64(29)) % np.uint64(WIDE)).astype(np.int64)] = True
                more = n - wide.sum(axis=1)
                wide = np.packbits(wide, axis=1).view(np.int64)
                cells = np.empty((len(own), bands), np.uint64)
                for b in range(bands):
                    key = np.full(len(own), b + 1, np.uint64)
                    for f in factors[b * rows : (b + 1) * rows]:
                        least = np.minimum.reduceat((value ^ (value >> np.uint64(23))) * f, starts)
                        key = (key ^ least) * np.uint64(0xD6E8FEB86659FD93)
                        key ^= key >> np.uint64(32)
                    cells[:, b] = key
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(pa.array(own)), pa.array(n.astype(np.int32)), blobs(np.packbits(maps, axis=1)), lists(signed(cells.ravel()), np.full(len(own), bands), pa.int64()), lists(wide.ravel(), np.full(len(own), WIDE // 64), pa.int64()), pa.array(more.astype(np.int32))],
                    names=["id", "n", "bits", "cells", "wide", "more"],
                )

    return texts.select("id", "text").mapInArrow(run, "id bigint, n int, bits binary, cells array<bigint>, wide array<bigint>, more int")


def _count(words: np.ndarray) -> np.ndarray:
    return np.bitwise_count(words).sum(axis=1, dtype=np.int64)


class Tree:
    """A signature tree over records, built bottom up over records in order of size."""

    def __init__(self, bitmap: np.ndarray, n: np.ndarray):
        """bitmap: uint64 words, a row per record; n: sizes, ascending."""
        extra = n - _count(bitmap)
        self.levels = [(bitmap, n, n, extra)]
        while len(self.levels[-1][0]) > FANOUT:
            below, low, high, more = self.levels[-1]
            cut_at = np.arange(0, len(below), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(below, cut_at), np.minimum.reduceat(low, cut_at), np.maximum.reduceat(high, cut_at), np.maximum.reduceat(more, cut_at)))

    def possible(self, level: int, a: np.ndarray, b: np.ndarray, t: float) -> np.ndarray:
        """Whether the nodes a and b of a level can hold a pair of the likeness t."""
        bitmap, low, high, extra = self.levels[level]
        fits = (high[a] >= t * low[b]) & (high[b] >= t * low[a])
        a, b = a[fits], b[fits]
        shared = _count(bitmap[a] & bitmap[b]) + np.minimum(extra[a], extra[b])
        fits[fits] = shared * (1 + t) >= t * (low[a] + low[b]) - 1e-9
        return fits

    def pairs(self, t: float, at_once: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs a < b of records that the bound can't rule out, by a dual traversal from the top."""
        top = len(self.levels) - 1
        a, b = np.triu_indices(len(self.levels[top][0]), 1 if top == 0 else 0)
        stack = [(top, a, b)]
        while stack:
            level, a, b = stack.pop()
            if len(a) > at_once:
                half = len(a) // 2
                stack += [(level, a[half:], b[half:]), (level, a[:half], b[:half])]
                continue
            fits = self.possible(level, a, b, t)
            a, b = a[fits], b[fits]
            if not len(a):
                continue
            if level == 0:
                yield a, b
                continue
            size = len(self.levels[level - 1][0])
            steps = np.arange(FANOUT)
            x = np.repeat(a * FANOUT, FANOUT * FANOUT) + np.tile(np.repeat(steps, FANOUT), len(a))
            y = np.repeat(b * FANOUT, FANOUT * FANOUT) + np.tile(np.tile(steps, FANOUT), len(a))
            good = (x < size) & (y < size) & ((x < y) if level == 1 else (x <= y))
            stack.append((level - 1, x[good], y[good]))


def cell_pairs(cells: DataFrame, records: DataFrame, t: float, block: int = 4096) -> DataFrame:
    """`a, b`: pairs of ids that share a cell and pass the bound. cells: `cell, id`; records: `id, n, bits`, each id once.

    Cells are shuffled without the records first: most hold one record, and only those with more
    are given sizes and bitmaps. A cell with more than `block` records is cut into blocks, and
    each pair of its blocks is a group of its own: no group holds more than two blocks (about),
    and no pair is lost.
    """
    met = cells.select("cell", "id").repartition("cell")
    sizes = met.groupBy("cell").agg(F.count(F.lit(1)).alias("count")).where("count > 1")
    kept = met.join(sizes, "cell").withColumn("blocks", F.ceil(F.col("count") / block).cast("int"))
    own = F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).otherwise(0)
    kept = kept.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # a cell key of two cells that clash only adds pairs that the bound drops
    key = F.when(F.col("blocks") == 1, F.col("cell")).otherwise(F.xxhash64("cell", F.least("own", "other"), F.greatest("own", "other")))
    return _paired(kept.select(key.alias("cell"), "id").join(records.select("id", "n", "bits"), "id"), t)


def _paired(postings: DataFrame, t: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def groups(cell, ids, n, bitmap):
            ends = np.flatnonzero(np.concatenate((cell[1:] != cell[:-1], [True]))) + 1
            starts = np.concatenate(([0], ends[:-1]))
            sizes = ends - starts
            out = []
            for m in np.unique(sizes):
                if m < 2:
                    continue
                at = starts[sizes == m]
                if m <= FANOUT * 4:
                    i, j = np.triu_indices(int(m), 1)
                    for part in np.array_split(at, max(1, len(at) * len(i) // 200_000)):
                        a = (part[:, None] + i).ravel()
                        b = (part[:, None] + j).ravel()
                        fits = (n[a] >= t * n[b]) & (n[b] >= t * n[a])
                        a, b = a[fits], b[fits]
                        extra = np.minimum(n[a] - _count(bitmap[a]), n[b] - _count(bitmap[b]))
                        fits = (_count(bitmap[a] & bitmap[b]) + extra) * (1 + t) >= t * (n[a] + n[b]) - 1e-9
                        out.append((a[fits], b[fits]))
                else:
                    for s in at:
                        order = np.lexsort((bitmap[s : s + m, 0], n[s : s + m])) + s
                        for a, b in Tree(bitmap[order], n[order]).pairs(t):
                            out.append((order[a], order[b]))
            if not out:
                return None
            a = ids[np.concatenate([x for x, _ in out])]
            b = ids[np.concatenate([y for _, y in out])]
            pairs = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), 1)[a != b], axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        def arrays(batch: pa.RecordBatch):
            column = batch.column("bits")
            width = len(column[0].as_py())
            offset = int(np.frombuffer(column.buffers()[1], np.int32)[column.offset])
            raw = np.frombuffer(column.buffers()[2], np.uint8, batch.num_rows * width, offset)
            return batch.column("cell").to_numpy(), batch.column("id").to_numpy(), batch.column("n").to_numpy().astype(np.int64), raw.reshape(-1, width).view(np.uint64)

        for batch in batches:
            if not batch.num_rows:
                continue
            now = arrays(batch)
            if held:
                now = tuple(np.concatenate((h, x)) for h, x in zip(held, now))
            last = int(np.searchsorted(now[0], now[0][-1]))  # the last cell may go on in the next batch
            if last and (done := groups(*(x[:last] for x in now))) is not None:
                yield done
            held = [np.array(x[last:]) for x in now]
        if held and (done := groups(*held)) is not None:
            yield done

    spread = postings.select("cell", "id", "n", "bits").repartition("cell").sortWithinPartitions("cell")
    return spread.mapInArrow(run, "a bigint, b bigint").groupBy("a", "b").agg(F.lit(1).alias("_")).select("a", "b")


def rare_cells(sets: DataFrame, likeness: float) -> DataFrame:
    """`cell, id`: each text's rarest n-grams, enough of them that two texts of the likeness share one.

    sets: `id, grams`. N-grams are ordered by their number of texts, then by value; of n, the first
    n - ceil(likeness * n) + 1 are taken. Those of one text only lead nowhere and are left out.
    """
    rows = sets.select("id", F.size("grams").alias("n"), F.explode("grams").alias("cell"))
    counts = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("texts"))
    # an n-gram of one text is among the first by any means, so only the others need their counts
    shared = rows.join(counts.where("texts > 1"), "cell").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("texts", "cell"))).alias("shared"))
    reach = F.col("n") - F.ceil(F.col("n") * likeness - 1e-9) + 1 - (F.col("n") - F.size("shared"))
    return shared.where(reach > 0).select("id", F.explode(F.slice("shared", F.lit(1), reach.cast("int"))).alias("c")).select("c.cell", "id")


def possible(pairs: DataFrame, records: DataFrame, t: float) -> DataFrame:
    """The pairs (`a, b`) that the bound on the wide bitmaps of their records (`id, n, wide, more`) can't rule out: long texts fill the narrow ones."""
    one, two = (records.select("id", "n", "wide", "more").toDF(c, "n" + c, "w" + c, "m" + c) for c in "ab")
    joined = pairs.join(one, "a").join(two, "b")
    shared = F.aggregate(F.zip_with("wa", "wb", lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda s, n: s + n) + F.least("ma", "mb")
    return joined.where(shared * (1 + t) >= t * (F.col("na") + F.col("nb")) - 1e-9).select("a", "b")


def gram_sets(texts: DataFrame, words: int) -> DataFrame:
    """`id, grams`: the distinct n-grams of each text (`id, text`)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                flat, lengths = hashed(part.column("text").to_pylist(), cache)
                value, text, _ = grams(flat, lengths, words)
                value, text = distinct(value, text)
                yield pa.RecordBatch.from_arrays([part.column("id"), lists(signed(value), np.bincount(text, minlength=part.num_rows), pa.int64())], names=["id", "grams"])

    return texts.select("id", "text").mapInArrow(run, "id bigint, grams array<bigint>")


def near_links(df: DataFrame, key: str, text: str, at: str | None = None, words: int = 5, likeness: float = 0.8, bits: int = 512, rows: int = 2, bands: int = 38, exact: bool = False):
    """Links between different texts of the likeness or more.

    Returns `(members, links)`: members has `id, rep, has_grams` for every key (a key counts once,
    its latest delivery by `at` holds; `rep` is the least key with the very same text, has_grams
    whether the text has an n-gram at all), links has `a, b, likeness` with a < b, both
    representatives. Null, empty and very short texts (less than `words` words) have no n-grams
    and so no links; they are members of their own class. With `exact`, no pair is missed.
    """
    members = classes(newest(df, key, text, at)).select("id", "rep", "text_id")
    reps = cut(members.where(F.col("id") == F.col("rep")))
    texts = texts_of(df, key, text, reps)
    signed_rows = cut(signatures(texts, words, bits, rows, bands))
    members = cut(members.join(signed_rows.select(F.col("id").alias("rep"), F.lit(True).alias("has_grams")), "rep", "left").select("id", "rep", F.coalesce("has_grams", F.lit(False)).alias("has_grams")))
    if exact:
        cells = rare_cells(cut(gram_sets(texts, words)), likeness)
    else:
        cells = signed_rows.select(F.explode("cells").alias("cell"), "id")
    pairs = cut(possible(cell_pairs(cells, signed_rows, likeness), signed_rows, likeness))
    asked = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = cut(gram_sets(texts_of(df, key, text, reps.join(asked, "id", "left_semi")), words))
    one, two = sets.toDF("a", "ga"), sets.toDF("b", "gb")
    shared = F.size(F.array_intersect("ga", "gb"))
    links = pairs.join(one, "a").join(two, "b").withColumn("shared", shared).withColumn("either", F.size("ga") + F.size("gb") - F.col("shared"))
    links = links.where(F.col("shared") >= likeness * F.col("either") - 1e-9).select("a", "b", (F.col("shared") / F.col("either")).alias("likeness"))
    return members, links


def expanded(members: DataFrame, links: DataFrame) -> DataFrame:
    """`a, b`: all pairs of different ids behind the links and within classes of the same text.

    Only for results that are defined as pairs of records. Copies of a text without an n-gram
    make no pair: they have no likeness.
    """
    m = members.select("id", "rep")
    across = links.join(m.toDF("x", "a"), "a").join(m.toDF("y", "b"), "b").select("x", "y")
    some = members.where("has_grams").select("id", "rep")
    copies = some.where(F.col("id") != F.col("rep"))
    within = copies.toDF("x", "rep").join(some.toDF("y", "rep"), "rep").where("x <> y").select("x", "y")
    both = across.unionByName(within).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return both.groupBy("a", "b").agg(F.lit(1).alias("_")).select("a", "b")


def counted(groups: DataFrame) -> DataFrame:
    """One row `records, exact_duplicates, near_duplicates, remaining` of `near_groups`: what a build that keeps one record a group drops.

    Records without an n-gram are counted as records and remain.
    """
    of = groups.where("has_grams").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("id") == F.col("rep")).alias("texts"), F.count_if(F.col("id") == F.col("class_id")).alias("kept"))
    every = groups.agg(F.count(F.lit(1)).alias("records"))
    one = every.crossJoin(F.broadcast(of))  # one row each
    return one.select("records", (F.col("n") - F.col("texts")).alias("exact_duplicates"), (F.col("texts") - F.col("kept")).alias("near_duplicates"), (F.col("records") - F.col("n") + F.col("kept")).alias("remaining"))


def near_groups(df: DataFrame, key: str, text: str, at: str | None = None, **how) -> DataFrame:
    """`id, rep, has_grams, class_id, links, copies`: one row per key.

    class_id is the least key of the group that links and copies join together, links the
    number of different texts linked to this one's text, copies the number of other keys with
    the same text.
    """
    members, links = near_links(df, key, text, at, **how)
    links = cut(links)
    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
    group = components(links.select("a", "b")).toDF("rep", "class_id")
    size = members.groupBy("rep").agg((F.count(F.lit(1)) - 1).alias("copies"))
    about = size.join(degree, "rep", "left").join(group, "rep", "left")
    rows = members.join(about, "rep")
    return rows.select("id", "rep", "has_grams", F.coalesce("class_id", "rep").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"), "copies")
