"""Mixing sources to target weights by a Pfair schedule.

Every source with a target and with tokens gets its share of the total; where the total isn't
given it is the largest for which no source has to be used more than its number of repeats.
Sources without tokens can't contribute, so the other targets are scaled up to 1.

A source's stream (its records in an order by hash, over and over) is cut into blocks. Block i
of a source of weight w may run from slot floor(i / w) and has to be done by ceil((i + 1) / w);
in each slot the released block with the earliest deadline runs. So at any slot every source
is within less than a block of its share, whatever the total.

Weights are whole numbers of PERIOD-ths, so the schedule repeats itself after PERIOD slots: one
period is made on the driver, and the slot of any block follows from its number of periods and
its place in one. Records' places in their source's stream come from prefix sums in two levels.
"""

from __future__ import annotations

import heapq
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wrackline.session import cut

BUCKETS = 1024
#: Slots after which the schedule repeats; weights are rounded to this part.
PERIOD = 50_000


def schedule(weights: list[Fraction], blocks: list[int]) -> list[tuple[int, int]]:
    """(source, block) of each slot: earliest deadline first among released blocks."""
    at = lambda i, w: (-(-(i + 1) * w.denominator // w.numerator), i * w.denominator // w.numerator)
    waiting = [(at(0, w)[1], at(0, w)[0], s, 0) for s, w in enumerate(weights) if blocks[s]]
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []
    out: list[tuple[int, int]] = []
    slot = 0
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            _, deadline, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (deadline, s, i))
        _, s, i = heapq.heappop(ready)
        out.append((s, i))
        if i + 1 < blocks[s]:
            deadline, release = at(i + 1, weights[s])
            heapq.heappush(waiting, (release, deadline, s, i + 1))
        slot += 1
    return out


def period(weights: dict[str, Fraction], slots: int = PERIOD) -> dict[str, int]:
    """Blocks of each source in a period: the weights' largest remainders, at least one each."""
    ideal = {s: w * slots for s, w in weights.items()}
    out = {s: max(1, int(x)) for s, x in ideal.items()}
    order = sorted(weights, key=lambda s: (out[s] - ideal[s], s))
    for s in order[: max(0, slots - sum(out.values()))]:
        out[s] += 1
    while sum(out.values()) > slots:
        out[max(out, key=lambda s: (out[s] - ideal[s] if out[s] > 1 else -slots, s))] -= 1
    return out


def plan(sizes: dict[str, int], targets: dict[str, tuple[float, int]], total: int | None = None) -> tuple[int, dict[str, tuple[Fraction, int]]]:
    """Total tokens and, for each usable source, its weight and its tokens in the mix."""
    usable = {s: t for s, t in targets.items() if sizes.get(s, 0) > 0 and t[0] > 0 and t[1] > 0}
    if not usable:
        return 0, {}
    weights = {s: Fraction(t[0]).limit_denominator(10**6) for s, t in usable.items()}
    whole = sum(weights.values())
    weights = {s: w / whole for s, w in weights.items()}
    most = min(sizes[s] * usable[s][1] / weights[s] for s in usable)
    if total is None:
        total = int(most)
    return total, {s: (w, min(int(w * total), sizes[s] * usable[s][1])) for s, w in weights.items()}


def mixed(records: DataFrame, targets: DataFrame, total: int | None = None, block: int = 4096):
    """Returns `(chosen, shares)`.

    records: `id, source, tokens`, each id once; records without tokens can't be chosen. targets:
    `source, target_share, max_repeats` (one row a source; a null source, share or number of
    repeats is no target). chosen: `id, source, tokens, repeat, slot, offset`, a row for each use
    of a record (repeat from 0), in the order (slot, offset). shares: `source, target_share,
    available_tokens, max_repeats, records, uses, tokens, actual_share, binding` for every target;
    binding marks the sources that have used up all their repeats and so bound the total. A source's tokens are its share of the total, to within the one record that crosses it. A given
    total that a source can't meet within its repeats leaves that source short, as shares tell.
    """
    wanted = targets.where("source is not null and target_share > 0 and max_repeats > 0").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    rows = records.where("tokens > 0 and id is not null and source is not null").join(wanted.select("source"), "source", "left_semi")
    rows = cut(rows.withColumn("_bucket", F.pmod(F.xxhash64("id", F.lit("mix")), F.lit(BUCKETS)).cast("int")))
    buckets = cut(rows.groupBy("source", "_bucket").agg(F.sum("tokens").alias("n")))
    sizes = {r["source"]: int(r["n"]) for r in buckets.groupBy("source").agg(F.sum("n").alias("n")).collect()}  # a row per target
    asked = {r["source"]: (float(r["target_share"]), int(r["max_repeats"])) for r in wanted.collect()}
    total, parts = plan(sizes, asked, total)
    names = sorted(parts)
    each = period({s: parts[s][0] for s in names}, PERIOD) if names else {}
    slots = schedule([Fraction(each[s], PERIOD) for s in names], [each[s] for s in names])
    spark = records.sparkSession
    slot_rows = spark.createDataFrame([(names[s], i, n) for n, (s, i) in enumerate(slots)], "source string, nth long, at_slot long")
    part_rows = spark.createDataFrame([(s, sizes[s], parts[s][1]) for s in names], "source string, size long, use long")

    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    order = Window.partitionBy("source", "_bucket").orderBy(F.xxhash64("id"), "id").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.join(buckets.withColumn("base", before).select("source", "_bucket", "base"), ["source", "_bucket"])
    placed = placed.withColumn("start", F.col("base") + F.coalesce(F.sum("tokens").over(order), F.lit(0)))
    # a record is used once more for each pass in which it begins before the source's tokens are met
    passes = placed.join(F.broadcast(part_rows), "source").withColumn("uses", F.ceil((F.col("use") - F.col("start")) / F.col("size")).cast("int")).where("uses > 0")
    used = passes.select("id", "source", "tokens", F.explode(F.sequence(F.lit(0), F.col("uses") - 1)).alias("repeat"), "start", "size")
    used = used.withColumn("at", F.col("start") + F.col("repeat") * F.col("size")).withColumn("block", F.floor(F.col("at") / block))
    # PERIOD rows at most
    sizes_ = F.broadcast(spark.createDataFrame(sorted(each.items()), "source string, blocks long"))
    used = used.join(sizes_, "source").withColumn("nth", F.pmod("block", "blocks"))
    slot = F.floor(F.col("block") / F.col("blocks")) * PERIOD + F.col("at_slot")
    chosen = used.join(F.broadcast(slot_rows), ["source", "nth"]).select("id", "source", "tokens", "repeat", slot.alias("slot"), (F.col("at") - F.col("block") * block).alias("offset"))
    got = passes.groupBy("source").agg(F.count(F.lit(1)).alias("records"), F.sum("uses").alias("uses"), F.sum(F.col("uses") * F.col("tokens")).alias("tokens"))
    every = wanted.join(got, "source", "left").join(part_rows.select("source", "size"), "source", "left")
    zero = F.lit(0).cast("long")
    every = every.select("source", "target_share", F.coalesce("size", zero).alias("available_tokens"), "max_repeats", F.coalesce("records", zero).alias("records"), F.coalesce("uses", zero).alias("uses"), F.coalesce("tokens", zero).alias("tokens"))
    whole = F.sum("tokens").over(Window.partitionBy(F.lit(0)))  # over the targets only, a row each
    every = every.withColumn("actual_share", F.col("tokens") / whole)
    return chosen, every.withColumn("binding", (F.col("tokens") > 0) & (F.col("tokens") >= F.col("available_tokens") * F.col("max_repeats")))
