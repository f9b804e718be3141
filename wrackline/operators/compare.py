"""Multiple-choice results: outcomes, the paired comparison of two runs in all its groupings, intervals."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

LOCAL = ("local", "rare_local")
EDGE = 1e-9


def predicted(scores: Column) -> Column:
    """Index of the greatest score, the first of equal ones."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def margin(scores: Column, answer: Column) -> Column:
    """Score of the answer less the best of the others."""
    return F.get(scores, answer) - F.array_max(F.filter(scores, lambda _, i: i != answer))


def outcomes(scored: DataFrame) -> DataFrame:
    """Adds `predicted`, `correct` and `margin` to rows with `scores` and `answer_index`."""
    out = scored.withColumn("predicted", predicted(F.col("scores")))
    return out.withColumn("correct", F.col("predicted") == F.col("answer_index")).withColumn("margin", margin(F.col("scores"), F.col("answer_index")))


def paired(base: DataFrame, adapter: DataFrame, dims: tuple[str, ...], strict: bool = False) -> DataFrame:
    """`probe_id, <dims>, base_correct, adapter_correct, base_margin, adapter_margin, delta`.

    With `strict`, a probe in one run only or twice in one fails the job; else only common probes count.
    """
    b = base.select("probe_id", *dims, F.col("correct").alias("base_correct"), F.col("margin").alias("base_margin"))
    a = adapter.select("probe_id", F.col("correct").alias("adapter_correct"), F.col("margin").alias("adapter_margin"))
    if strict:
        counts = base.groupBy("probe_id").agg(F.count(F.lit(1)).alias("b")).join(adapter.groupBy("probe_id").agg(F.count(F.lit(1)).alias("a")), "probe_id", "full_outer")
        if not counts.where("coalesce(a, 0) <> 1 or coalesce(b, 0) <> 1").isEmpty():
            raise ValueError("both runs must have every probe once")
    return b.join(a, "probe_id").withColumn("delta", F.col("adapter_margin") - F.col("base_margin"))


def measures() -> list[Column]:
    delta, share = F.col("delta"), lambda c: F.avg(F.col(c).cast("int"))
    return [
        F.count(F.lit(1)).alias("n"), share("base_correct").alias("base_accuracy"), share("adapter_correct").alias("adapter_accuracy"), F.avg("base_margin").alias("base_margin"), F.avg("adapter_margin").alias("adapter_margin"), F.avg(delta).alias("margin_delta"),
        F.count_if(delta > EDGE).alias("wins"), F.count_if(F.abs(delta) <= EDGE).alias("ties"), F.count_if(delta < -EDGE).alias("losses"),
    ]


def grouped(pairs: DataFrame, dims: tuple[str, ...]) -> DataFrame:
    """`dimension, value, <measures>`: overall and by each dimension, in one pass of grouping sets."""
    pairs = pairs.select(*[F.col(d) for d in dims], "base_correct", "adapter_correct", "base_margin", "adapter_margin", "delta")
    rows = pairs.groupingSets([[], *[[d] for d in dims]], *dims).agg(*measures(), F.grouping_id().alias("_id"))
    full = 2 ** len(dims) - 1
    name, value = F.lit("overall"), F.lit(None).cast("string")
    for i, d in enumerate(dims):
        here = F.col("_id") == full - 2 ** (len(dims) - 1 - i)
        name, value = F.when(here, d).otherwise(name), F.when(here, F.col(d).cast("string")).otherwise(value)
    return rows.select(name.alias("dimension"), value.alias("value"), *[c for c in rows.columns if c not in (*dims, "_id")])


def with_all(rows: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Groups of a fixed list, those without rows as zeros."""
    listed = rows.sparkSession.createDataFrame([(v,) for v in values], f"{key} string")
    return F.broadcast(listed).join(rows, key, "left").fillna(0, [c for c in rows.columns if c != key])


def track_summary(pairs: DataFrame, tracks: tuple[str, ...]) -> DataFrame:
    """`track, n, <measures>, low, high`: each track of the list (without rows: zeros) in its order, then `overall`, with the interval of the mean delta."""
    rows = pairs.withColumn("_track", F.explode(F.array(F.col("track"), F.lit("overall"))))
    found = rows.groupBy(F.col("_track").alias("track")).agg(*measures(), bootstrap(F.col("delta"), F.col("probe_id")).alias("i")).select("*", "i.low", "i.high").drop("i")
    names = [*tracks, "overall"]
    every = with_all(found, "track", names)
    return every.orderBy(F.array_position(F.array(*[F.lit(n) for n in names]), F.col("track")))


def track_accuracy(results: DataFrame, tracks: tuple[str, ...]) -> DataFrame:
    """`track, n, right, accuracy`: each track of the list and `overall`; without rows the accuracy is null."""
    rows = results.withColumn("_track", F.explode(F.array(F.col("track"), F.lit("overall"))))
    found = rows.groupBy(F.col("_track").alias("track")).agg(F.count(F.lit(1)).alias("n"), F.count_if("correct").alias("right"))
    return with_all(found, "track", [*tracks, "overall"]).withColumn("accuracy", F.when(F.col("n") > 0, F.col("right") / F.col("n")))


def category_counts(results: DataFrame) -> DataFrame:
    """`name, n`: rows of each track and category, named track::category."""
    return results.groupBy(F.concat_ws("::", "track", "category").alias("name")).agg(F.count(F.lit(1)).alias("n"))


def family_groups(found: DataFrame) -> DataFrame:
    """`family_group, facts, base_passes, adapter_passes, acquired, regressed` of families: those to be acquired, and controls."""
    group = F.when(F.col("track") == "control", "control").otherwise("acquisition")
    counts = found.groupBy(group.alias("family_group")).agg(F.count(F.lit(1)).alias("facts"), F.count_if("base_all").alias("base_passes"), F.count_if("adapter_all").alias("adapter_passes"), F.count_if(F.col("change") == "acquired").alias("acquired"), F.count_if(F.col("change") == "regressed").alias("regressed"))
    return with_all(counts, "family_group", ["acquisition", "control"])


def robust_changes(found: DataFrame) -> DataFrame:
    """One row `acquired, regressed`: families (without controls) that passed in one run only."""
    return found.where("track <> 'control'").agg(F.count_if(F.col("change") == "acquired").alias("acquired"), F.count_if(F.col("change") == "regressed").alias("regressed"))


def mean_perplexity(losses: DataFrame, loss: str, *by: str) -> DataFrame:
    """`<by>, records, perplexity`: the exponential of the mean of records' losses, each record counting once whatever its length."""
    return losses.groupBy(*by).agg(F.count(loss).alias("records"), F.exp(F.avg(loss)).alias("perplexity"))


def best_step(log: DataFrame, step: str, loss: str, order: str, *by: str) -> DataFrame:
    """`<by>, best_step, best, last`: the first step with the least loss, that loss, and the last one."""
    return log.where(F.col(loss).isNotNull()).groupBy(*by).agg(F.min_by(step, F.struct(loss, order)).alias("best_step"), F.min(loss).alias("best"), F.max_by(loss, order).alias("last"))


def families(pairs: DataFrame) -> DataFrame:
    """`family, track, base_all, adapter_all, base_least, adapter_least, change`, by fact (or probe without one)."""
    key = F.coalesce(F.nullif(F.col("fact_id"), F.lit("")), F.col("probe_id").cast("string"))
    rows = pairs.groupBy(key.alias("family")).agg(F.min("track").alias("track"), F.count_distinct("track").alias("_tracks"), F.bool_and("base_correct").alias("base_all"), F.bool_and("adapter_correct").alias("adapter_all"), F.min("base_margin").alias("base_least"), F.min("adapter_margin").alias("adapter_least"))
    # a filter, so that no choice of columns loses the check
    rows = rows.where(F.when(F.col("_tracks") > 1, F.raise_error(F.concat(F.lit("tracks differ in "), "family")).cast("boolean")).otherwise(F.lit(True)))
    change = F.when(~F.col("base_all") & F.col("adapter_all"), "acquired").when(F.col("base_all") & ~F.col("adapter_all"), "regressed").otherwise("same")
    return rows.select("family", "track", "base_all", "adapter_all", "base_least", "adapter_least", change.alias("change"))


def contrasts(pairs: DataFrame) -> DataFrame:
    """One row: mean delta of local probes, of controls, their difference, and the mean of source means."""
    local = F.avg(F.when(F.col("track").isin(*LOCAL), F.col("delta")))
    control = F.avg(F.when(F.col("track") == "control", F.col("delta")))
    one = pairs.agg(F.coalesce(local, F.lit(0.0)).alias("local_delta"), F.coalesce(control, F.lit(0.0)).alias("control_delta"))
    macro = pairs.where("track <> 'control'").groupBy("source_group").agg(F.avg("delta").alias("m")).agg(F.coalesce(F.avg("m"), F.lit(0.0)).alias("source_macro_delta"))
    return one.crossJoin(F.broadcast(macro)).select("local_delta", "control_delta", (F.col("local_delta") - F.col("control_delta")).alias("adjusted_delta"), "source_macro_delta")


def bootstrap(values: Column, order: Column, samples: int = 2000, seed: int = 42) -> Column:
    """struct<low, high>: 95 % interval of the mean by resampling; values are put in `order` first."""

    @pandas_udf("struct<low double, high double>")
    def run(column: pd.Series) -> pd.DataFrame:
        out = []
        for rows in column:
            v = [r["v"] for r in rows]
            if len(v) < 2:
                out.append((v[0], v[0]) if v else (0.0, 0.0))
                continue
            draw = random.Random(seed)
            means = sorted(sum(draw.choice(v) for _ in v) / len(v) for _ in range(samples))
            out.append((means[int(samples * 0.025)], means[int(samples * 0.975)]))
        return pd.DataFrame(out, columns=["low", "high"])

    return run(F.array_sort(F.collect_list(F.struct(order.alias("o"), values.alias("v")))))


def membership(probes: DataFrame, train: DataFrame, held: DataFrame) -> DataFrame:
    """`id, membership`: where a probe's named digests stand: train before eval before absent; differing: mixed.

    Controls are `control`; a probe that names none is `mixed`. train and held have `digest`.
    """
    digest = probes.select("id", F.explode("source_digests").alias("digest"))
    a, b = train.select("digest").distinct().withColumn("t", F.lit(True)), held.select("digest").distinct().withColumn("e", F.lit(True))
    where = F.when(F.col("t"), "train").when(F.col("e"), "eval").otherwise("absent")
    found = digest.join(a, "digest", "left").join(b, "digest", "left").groupBy("id").agg(F.collect_set(where).alias("s"))
    joined = probes.select("id", "track").join(found, "id", "left")
    value = F.when(F.col("track") == "control", "control").when(F.size("s") == 1, F.get("s", 0)).otherwise("mixed")
    return joined.select("id", value.alias("membership"))
