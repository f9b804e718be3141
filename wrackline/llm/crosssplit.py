"""Records of one split that also stand, exactly or almost, in another, by winnowing.

From every window of `window` consecutive k-grams of words the one with the least hash is
kept, so texts that share any run of k + window - 1 words (8 by default) keep a common
fingerprint. Wordings that are common among the evaluation records are put last in the order of
hashes, and a text that has enough others isn't joined on them: so the guarantee holds for runs
of words that aren't common. Fingerprints are joined across the splits; pairs with enough of them
are aligned: shared k-grams are seeds, collinear seeds are chained, chains are extended word
by word, and the covered share of either text and its likeness are measured on whole texts.

Where no pair may be missed, `exact=True` joins on the rarest word n-grams of each text instead,
of which two texts of the likeness always share one; the rest is the same.

Copies are collapsed first, within their split; only fingerprints that the evaluation side
holds (a bitset of bounded size) leave the training side's tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wrackline.llm.arrow import signed
from wrackline.llm.copies import classes, newest, only, texts_of
from wrackline.llm.neardup import gram_sets, rare_cells
from wrackline.llm.words import WordHashes, distinct, grams, hashed
from wrackline.session import cut

#: Texts of fewer words also give their 3-grams: they may have no window of 8 words in common.
SHORT = 32
#: A text whose fingerprints are common ones by more than this share is joined on these, too.
COMMON_SHARE = 0.2


def winnow(value: np.ndarray, text: np.ndarray, rank: np.ndarray, window: int) -> np.ndarray:
    """Marks the k-grams kept: in each window within a text the least by `rank` (a text shorter than a window is one)."""
    kept = np.zeros(len(value), np.bool_)
    if not len(value):
        return kept
    starts = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1])))
    sizes = np.diff(np.append(starts, len(text)))
    n = len(value) - window + 1
    if n > 0:
        least = rank[:n].copy()
        for s in range(1, window):
            np.minimum(least, rank[s : s + n], out=least)
        whole = text[:n] == text[window - 1 :]
        for s in range(window):
            kept[s : s + n] |= whole & (rank[s : s + n] == least)
    small = sizes < window
    if small.any():
        least = np.minimum.reduceat(rank, starts)
        kept |= np.repeat(small, sizes) & (rank == np.repeat(least, sizes))
    return kept


def _member(value: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(value), np.bool_)
    at = np.minimum(np.searchsorted(ordered, value), len(ordered) - 1)
    return ordered[at] == value


def fingerprints(texts: DataFrame, common: np.ndarray, k: int, window: int, share: float, words: int, wanted: np.ndarray | None = None) -> DataFrame:
    """`seed, id, sizes` of texts (`id, text`); sizes: the number of the text's fingerprints and, times 2**32, of its distinct word n-grams.

    common: sorted k-grams that come last; wanted: a bitset (bytes) that a seed has to be in.
    """
    bits = None if wanted is None else len(wanted) * 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                flat, lengths = hashed(part.column("text").to_pylist(), cache)
                value, text, _ = grams(flat, lengths, k)
                last = _member(value, common)
                kept = winnow(value, text, (value >> np.uint64(1)) | (last.astype(np.uint64) << np.uint64(63)), window)
                value, text, last = value[kept], text[kept], last[kept]
                total = np.bincount(text, minlength=part.num_rows)
                held = np.bincount(text[last], minlength=part.num_rows) > share * total
                use = ~last | held[text]
                value, text = value[use], text[use]
                short = lengths < SHORT
                three, own, _ = grams(flat, lengths, 3)
                held_grams = distinct(*((three, own) if words == 3 else grams(flat, lengths, words)[:2]))[1]
                sizes = np.bincount(held_grams, minlength=part.num_rows).astype(np.int64) << 32
                three, own = three[short[own]] ^ np.uint64(3), own[short[own]]
                value, text = distinct(np.concatenate((value, three)), np.concatenate((text, own)))
                sizes += np.bincount(text, minlength=part.num_rows)
                if wanted is not None:
                    place = (value >> np.uint64(11)) % np.uint64(bits)
                    hit = (wanted[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0
                    value, text = value[hit], text[hit]
                yield pa.RecordBatch.from_arrays([pa.array(signed(value)), part.column("id").take(pa.array(text)), pa.array(sizes[text])], names=["seed", "id", "sizes"])

    return texts.select("id", "text").mapInArrow(run, "seed bigint, id bigint, sizes bigint")


def common_grams(texts: DataFrame, k: int, records: int, part: float, most: int = 1_000_000) -> np.ndarray:
    """Sorted k-grams in at least a part of `records` texts. There are at most (k-grams of a text) / part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                flat, lengths = hashed(batch.slice(start, 1000).column("text").to_pylist(), cache)
                value, text, _ = grams(flat, lengths, k)
                value, count = np.unique(distinct(value, text)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(signed(value)), pa.array(count)], names=["seed", "n"])

    counts = texts.select("text").mapInArrow(run, "seed bigint, n bigint").groupBy("seed").agg(F.sum("n").alias("n"))
    counts = cut(counts.where(F.col("n") >= max(8, part * records)))
    least = max(8, part * records)
    while counts.where(F.col("n") >= least).count() > most:  # an order with fewer common k-grams serves as well
        least *= 2
    found = counts.where(F.col("n") >= least).select("seed").toArrow().column("seed").to_numpy()
    return np.sort(found.view(np.uint64))


#: Words of 32 bits in a block of a bitset: a row of 32 KB.
BLOCK = 1 << 13


def bitset(seeds: DataFrame, n: int, most_bits: int = 1 << 28) -> np.ndarray:
    """Bytes of a bitset of the seeds, 16 bits for each of n but never more than `most_bits`.

    Made by OR in the cluster, in blocks; the driver gets the bytes of the set (32 MB at most)
    in a row a block, whatever the number of seeds.
    """
    bits = min(most_bits, 1 << max(16, int(16 * n - 1).bit_length()))
    place = F.pmod(F.shiftrightunsigned("seed", 11), F.lit(bits))
    words = seeds.select(F.shiftright(place, 5).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(32)).cast("int")).alias("bit"))
    words = words.groupBy("word").agg(F.bit_or("bit").alias("bit")).withColumn("block", F.floor(F.col("word") / BLOCK).cast("int"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a block's words are all in one task, each once
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            word, bit, block = (batch.column(c).to_numpy() for c in range(3))
            order = np.argsort(block, kind="stable")
            word, bit, block = word[order] % BLOCK, bit[order].astype(np.uint32), block[order]
            ends = np.flatnonzero(np.diff(block, append=-1)) + 1
            for lo, hi in zip(np.concatenate(([0], ends[:-1])), ends):
                held.setdefault(int(block[lo]), np.zeros(BLOCK, np.uint32))[word[lo:hi]] = bit[lo:hi]
        for block, values in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([values.tobytes()], pa.binary())], names=["block", "bytes"])

    out = np.zeros(max(bits // 32, BLOCK), np.uint32)
    for row in words.repartition("block").mapInArrow(pack, "block int, bytes binary").collect():
        out[row.block * BLOCK : (row.block + 1) * BLOCK] = np.frombuffer(row.bytes, np.uint32)
    return out[: bits // 32].view(np.uint8)


def align(x: np.ndarray, y: np.ndarray, k: int, slack: int) -> tuple[int, int, int, int]:
    """Words of x and of y covered by aligned passages, number of passages, longest passage.

    Shared k-grams are seeds on diagonals; consecutive seeds of a diagonal, and of a near one
    (`slack` words inserted or left out), are chained; each chained seed is extended over equal
    words to both sides.
    """
    one = np.array([len(x)]), np.array([len(y)])
    gx, _, px = grams(x, one[0], k)
    gy, _, py = grams(y, one[1], k)
    order = np.argsort(gy, kind="stable")
    sy, qy = gy[order], py[order]
    lo, hi = np.searchsorted(sy, gx, "left"), np.searchsorted(sy, gx, "right")
    i = np.repeat(px, hi - lo)
    j = qy[np.repeat(lo, hi - lo) + np.arange(len(i)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)] if len(i) else i
    in_x, in_y = np.zeros(len(x), np.bool_), np.zeros(len(y), np.bool_)
    passages = longest = 0
    order = np.lexsort((i, j - i))
    i, j = i[order], j[order]
    runs = np.flatnonzero(np.concatenate(([True], (np.diff(j - i) != 0) | (np.diff(i) > 1)))) if len(i) else np.zeros(0, np.int64)
    segments = [(int(i[a]), int(j[a]), int(i[b] - i[a]) + k) for a, b in zip(runs, np.append(runs[1:], len(i)) - 1)]
    segments.sort()
    at_x = at_y = 0
    begun = None
    for a, b, size in segments:
        in_x[a : a + size] = True
        in_y[b : b + size] = True
        if begun is None or a - at_x > slack or not 0 <= b - at_y <= slack:
            passages += 1
            begun = a
        at_x, at_y = a + size, b + size
        longest = max(longest, at_x - begun)
    return int(in_x.sum()), int(in_y.sum()), passages, longest


def overlaps(df: DataFrame, key: str, text: str, split: str, at: str | None = None, sides: tuple[str, str] = ("eval", "train"), keep: tuple[str, ...] = (), words: int = 5, likeness: float = 0.8, k: int = 5, window: int = 4, part: float = 0.002, shared: float = 0.1, slack: int = 12, exact: bool = False):
    """Links between a text of the first split and one of the second.

    Returns `(members, links)`. members: `id, rep, split, <keep>` of both splits (a key counts
    once, its latest delivery by `at` holds), rep the least key of the same text and split.
    links: `a, b, likeness, coverage_a, coverage_b, passages, longest` between representatives,
    a of sides[0] and b of sides[1], whose word n-grams (`words`) have the likeness or more.
    A pair is aligned if it shares at least `shared` of the fingerprints of the text that has
    fewer, at least one: a pair of likeness 0.5 whose equal runs all have just 8 words shares
    a quarter. Rows of other or no splits, null and empty texts and texts of less than `words`
    words have no links.
    """
    rows = newest(df, key, text, at, (split, *keep)).withColumnRenamed(split, "split").where(F.col("split").isin(*sides))
    members = cut(classes(rows, "split").select("id", "rep", "split", "text_id", *keep))
    reps, others = members.where("id = rep"), members.where("id <> rep")
    # a delivery that no longer holds may add a candidate; texts that hold are measured below
    few, many = (only(df.where(F.col(split) == side).select(F.col(key).alias("id"), F.col(text).alias("text")), others, "left_anti") for side in sides)
    if exact:
        sets = cut(gram_sets(few.unionByName(many), words))
        cells = cut(rare_cells(sets.where(F.size("grams") > 0), likeness).join(sets.select("id", F.size("grams").alias("n")), "id"))
        side = lambda s, c: cells.join(reps.where(F.col("split") == s).select("id"), "id", "left_semi").toDF(c, "cell", "n" + c)
        met = side(sides[0], "a").join(side(sides[1], "b"), "cell").where(F.least("na", "nb") >= likeness * F.greatest("na", "nb") - 1e-9)
        pairs = met.groupBy("a", "b").agg(F.lit(1).alias("_"))
    else:
        common = common_grams(few, k, reps.where(F.col("split") == sides[0]).count(), part)
        probing = cut(fingerprints(few, common, k, window, COMMON_SHARE, words))
        wanted = bitset(probing, probing.count())
        found = fingerprints(many, common, k, window, COMMON_SHARE / 2, words, wanted)
        met = probing.toDF("seed", "a", "na").join(found.toDF("seed", "b", "nb"), "seed")
        # texts of the likeness can't differ more in their numbers of n-grams
        grams_a, grams_b = F.shiftright("na", 32), F.shiftright("nb", 32)
        met = met.where(F.least(grams_a, grams_b) >= likeness * F.greatest(grams_a, grams_b) - 1e-9)
        of = F.least(F.col("na").bitwiseAND(0xFFFFFFFF), F.col("nb").bitwiseAND(0xFFFFFFFF))
        pairs = met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.first(of).alias("of")).where(F.col("n") >= shared * F.col("of"))
    pairs = cut(pairs.select("a", "b"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            out = []
            for a, b, ta, tb in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "ta", "tb"))):
                (x, nx), (y, ny) = hashed([ta], cache), hashed([tb], cache)
                gx, gy = np.unique(grams(x, nx, words)[0]), np.unique(grams(y, ny, words)[0])
                both = len(np.intersect1d(gx, gy, True))
                either = len(gx) + len(gy) - both
                if both and both >= likeness * either - 1e-9:
                    cx, cy, passages, longest = align(x, y, min(k, len(x), len(y)), slack)
                    out.append((a, b, both / either, cx / len(x), cy / len(y), passages, longest))
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], kind) for c, kind in enumerate(kinds)], names=["a", "b", "likeness", "coverage_a", "coverage_b", "passages", "longest"])

    side_a, side_b = (
        texts_of(df.where(F.col(split) == side), key, text, reps.where(F.col("split") == side).join(pairs.select(F.col(c).alias("id")).distinct(), "id", "left_semi")).toDF(c, "t" + c)
        for c, side in zip("ab", sides)
    )
    joined = pairs.join(side_a, "a").join(side_b, "b").select("a", "b", "ta", "tb")
    schema = "a bigint, b bigint, likeness double, coverage_a double, coverage_b double, passages int, longest int"
    return members, joined.mapInArrow(measure, schema)


def expanded(members: DataFrame, links: DataFrame) -> DataFrame:
    """Links between all keys of the linked classes: `x` of the first split, `y` of the second, and the links' figures."""
    m = members.select("id", "rep")
    return links.join(m.toDF("x", "a"), "a").join(m.toDF("y", "b"), "b")


def reported(members: DataFrame, links: DataFrame, *by: str, side: str = "eval") -> DataFrame:
    """For each value of `by` of the first split's records: their number, those with an overlap, their mean best coverage.

    Links stay between representatives: each record takes the best of its class. `side` is the
    first split's name.
    """
    best = links.groupBy("a").agg(F.max("coverage_a").alias("coverage"), F.max("likeness").alias("likeness")).withColumnRenamed("a", "rep")
    rows = members.where(F.col("split") == side).join(best, "rep", "left")
    return rows.groupBy("split", *by).agg(
        F.count(F.lit(1)).alias("records"), F.count("likeness").alias("overlapping"), F.count(F.when(F.col("likeness") == 1, 1)).alias("same"), F.round(F.avg(F.coalesce("coverage", F.lit(0.0))), 6).alias("mean_coverage")
    )
