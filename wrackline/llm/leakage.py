"""Evaluation texts inside training texts, by spaced seeds.

A seed hashes the words at the fixed places of a mask within a window of `run` words and
ignores the others, so a window still hits if words at ignored places were changed. Hits
between the items' seeds and the training texts' are verified around the hit: the windows are
aligned word by word, extended to both sides while at most one word in `run` differs, and the
longest run of equal words and the extent are measured.

Seeds of the items are few against the corpus. Up to `most` of them (counted first) they go to
every task as one sorted array; beyond that, training windows are joined with them by shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wrackline.llm.words import WordHashes, grams, hashed

MASKS = ((0, 1, 2, 4, 6, 7), (0, 2, 3, 4, 5, 7), (0, 1, 3, 5, 6, 7))


def item_words(items: DataFrame, key: str, text: str) -> DataFrame:
    """`item, words`: word hashes of each item, once per distinct (key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            flat, lengths = hashed(batch.column("text").to_pylist(), cache)
            ends = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("item"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))], names=["item", "words"])

    rows = items.select(F.col(key).cast("string").alias("item"), F.col(text).alias("text")).where("item is not null and text is not null").distinct()
    return rows.mapInArrow(run, "item string, words array<bigint>")


def _aligned(x: np.ndarray, y: np.ndarray, i: int, j: int, run: int) -> tuple[int, int, int]:
    """Around position i of x and j of y: longest run of equal words, words and differing words of the extension."""
    back, ahead = min(i, j), min(len(x) - i, len(y) - j)
    same = x[i - back : i + ahead] == y[j - back : j + ahead]
    lo, hi = back, min(back + run, len(same))
    while lo > 0 and (~same[lo - 1 : lo - 1 + run]).sum() <= 1:
        lo -= 1
    while hi < len(same) and (~same[max(0, hi - run + 1) : hi + 1]).sum() <= 1:
        hi += 1
    inside = same[lo:hi]
    breaks = np.flatnonzero(~np.concatenate(([False], inside, [False])))
    return int(np.diff(breaks).max() - 1) if len(breaks) > 1 else 0, hi - lo, int((~inside).sum())


def leaks(texts: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, run: int = 8, masks=MASKS, most: int = 2_000_000) -> DataFrame:
    """`id, item, words, longest, differing`: an item's passage in a text, at its best alignment.

    `longest` is the longest run of equal consecutive words, `words` the length of the aligned
    passage and `differing` the number of its words that differ. Hits with at most one word in
    `run` differing are kept; items shorter than `run` words can't leak. Rows with a null key,
    null and empty texts have no case. The same (id, text) twice counts once.
    """
    wanted = item_words(items, item_key, item_text).where(F.size("words") >= run)
    windows = wanted.agg(F.coalesce(F.sum(F.size("words") - (run - 1)), F.lit(0)).alias("n")).first()["n"]
    rows = texts.select(F.col(key).alias("id"), F.col(text).alias("text")).where("id is not null and text is not null")
    if windows * len(masks) > most:
        return _by_shuffle(rows, wanted, run, masks)
    found = wanted.select("item", "words").toPandas()  # at most `most` windows, as counted
    names = found["item"].tolist()
    lists = [np.asarray(w, np.int64).view(np.uint64) for w in found["words"]]
    flat = np.concatenate(lists) if lists else np.empty(0, np.uint64)
    lengths = np.array([len(w) for w in lists], np.int64)
    index = []
    for m in masks:
        value, item, at = grams(flat, lengths, run, m)
        order = np.argsort(value, kind="stable")
        index.append((value[order], item[order].astype(np.int32), at[order].astype(np.int32)))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        # 2**22 bits let most windows go by without a search
        bit = np.zeros(1 << 22, np.bool_)
        for value, _, _ in index:
            bit[(value >> np.uint64(40)) & np.uint64((1 << 22) - 1)] = True
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                words_, sizes = hashed(part.column("text").to_pylist(), cache)
                firsts = np.concatenate(([0], np.cumsum(sizes)))
                best: dict[tuple[int, int], tuple[int, int, int]] = {}
                for m, (keys, item, at) in zip(masks, index):
                    value, text, place = grams(words_, sizes, run, m)
                    near = np.flatnonzero(bit[(value >> np.uint64(40)) & np.uint64((1 << 22) - 1)])
                    left, right = np.searchsorted(keys, value[near], "left"), np.searchsorted(keys, value[near], "right")
                    for k, lo, hi in zip(near[right > left], left[right > left], right[right > left]):
                        d = int(text[k])
                        y = words_[firsts[d] : firsts[d + 1]]
                        for q in range(lo, hi):
                            got = _aligned(lists[item[q]], y, int(at[q]), int(place[k]), run)
                            if got > best.get((d, int(item[q])), (-1, 0, 0)):
                                best[d, int(item[q])] = got
                if best:
                    docs, which = np.array(list(best)).T
                    yield pa.RecordBatch.from_arrays(
                        [part.column("id").take(pa.array(docs)), pa.array([names[i] for i in which]), *(pa.array([v[c] for v in best.values()], pa.int32()) for c in (1, 0, 2))],
                        names=["id", "item", "words", "longest", "differing"],
                    )

    kind = rows.schema["id"].dataType.simpleString()
    hits = rows.mapInArrow(match, f"id {kind}, item string, words int, longest int, differing int")
    return _best(hits)


def _best(hits: DataFrame) -> DataFrame:
    top = F.max(F.struct("longest", "words", (-F.col("differing")).alias("less"))).alias("top")
    return hits.groupBy("id", "item").agg(top).select("id", "item", "top.words", "top.longest", (-F.col("top.less")).alias("differing"))


def _by_shuffle(rows: DataFrame, wanted: DataFrame, run: int, masks) -> DataFrame:
    """The same for items beyond any bound: seeds of both sides meet in a join, texts are joined to their hits."""
    kind = rows.schema["id"].dataType.simpleString()

    def seeds(of: str):
        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                column = batch.column("words")
                sizes = np.diff(column.offsets.to_numpy()).astype(np.int64)
                flat = column.flatten().to_numpy().view(np.uint64)
                for n, m in enumerate(masks):
                    value, text, at = grams(flat, sizes, run, m)
                    yield pa.RecordBatch.from_arrays([batch.column(of).take(pa.array(text)), pa.array((value ^ np.uint64(n)).view(np.int64)), pa.array(at.astype(np.int32))], names=[of, "seed", "at"])

        return emit

    def hash_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            flat, lengths = hashed(batch.column("text").to_pylist(), cache)
            ends = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))], names=["id", "words"])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_aligned(np.asarray(x), np.asarray(y), i, j, run) for x, y, i, j in zip(*(batch.column(c).to_pylist() for c in ("item_words", "words", "i", "j")))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("item"), *(pa.array([v[c] for v in out], pa.int32()) for c in (1, 0, 2))], names=["id", "item", "words", "longest", "differing"])

    texts = rows.distinct().mapInArrow(hash_words, f"id {kind}, words array<bigint>")
    ours = texts.mapInArrow(seeds("id"), f"id {kind}, seed bigint, at int").withColumnRenamed("at", "j")
    theirs = wanted.mapInArrow(seeds("item"), "item string, seed bigint, at int").withColumnRenamed("at", "i")
    hits = ours.join(theirs, "seed").groupBy("id", "item", "i", "j").agg(F.lit(1).alias("_"))
    both = hits.join(texts, "id").join(wanted.withColumnRenamed("words", "item_words"), "item")
    return _best(both.select("id", "item", "item_words", "words", "i", "j").mapInArrow(measure, f"id {kind}, item string, words int, longest int, differing int"))
