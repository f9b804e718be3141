"""Validated records: reasons, deduplication, token window, reproducible split, summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wrackline.functions.text import eval_choice, sha256, stripped
from wrackline.operators.dedup import first_of_digest


def reason(raw: Column) -> Column:
    """Why a JSON line is no record, else null: one object whose messages all are assistant texts."""
    v = F.try_parse_json(raw)
    kind = lambda path: F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    parts = F.try_variant_get(v, "$.messages", "array<variant>")
    each = lambda test: F.exists(parts, test)
    role = lambda m: F.try_variant_get(m, "$.role", "string")
    content = lambda m: F.try_variant_get(m, "$.content", "variant")
    return (
        F.when(v.isNull(), "not JSON")
        .when(~F.coalesce(kind("$").startswith("OBJECT"), F.lit(False)), "not an object")
        .when(parts.isNull() | (F.size(parts) == 0), "no messages")
        .when(each(lambda m: ~role(m).eqNullSafe(F.lit("assistant"))), "role is not assistant")
        .when(each(lambda m: ~F.coalesce(F.schema_of_variant(content(m)) == "STRING", F.lit(False))), "content is not text")
        .when(each(lambda m: stripped(F.try_variant_get(m, "$.content", "string")) == ""), "content is blank")
    )


def validated(lines: DataFrame, tokens=F.length, quarantine: bool = False) -> DataFrame:
    """`shard, line_no, content, tokens, digest, reason` of `shard, line_no, raw`; a bad line fails the job.

    The check is a filter on the raw line, so it is made whatever columns are used afterwards, a
    bare count included. With `quarantine`, bad lines come out instead, with their `reason` (null
    for good ones).
    """
    marked = lines.where(stripped(F.col("raw")) != "").withColumn("reason", reason(F.col("raw")))
    if not quarantine:
        where = F.concat_ws(": ", F.concat_ws(":", "shard", F.col("line_no").cast("string")), "reason")
        marked = marked.where(F.when(F.col("reason").isNotNull(), F.raise_error(where).cast("boolean")).otherwise(F.lit(True)))
    texts = F.transform(F.try_variant_get(F.try_parse_json("raw"), "$.messages", "array<variant>"), lambda m: F.try_variant_get(m, "$.content", "string"))
    content = stripped(F.array_join(texts, " "))
    return marked.select("shard", "line_no", content.alias("content"), tokens(content).alias("tokens"), sha256(content).alias("digest"), "reason")


def in_token_order(records: DataFrame) -> DataFrame:
    """By tokens, ties by shard and line: a total order."""
    return records.orderBy("tokens", "shard", "line_no")


def windowed(records: DataFrame, least: int = 128, most: int = 4096) -> DataFrame:
    """First record of each digest with `status`: below, above or kept (bounds inclusive)."""
    first = first_of_digest(records.select("digest", "shard", "line_no", "tokens", "content"), "digest", "shard", "line_no")
    return first.withColumn("status", F.when(F.col("tokens") < least, "below").when(F.col("tokens") > most, "above").otherwise("kept"))


def with_split(kept: DataFrame, fraction: float = 0.01) -> DataFrame:
    """Kept records with `split`: the round(n * fraction) (half to even) least draws are eval."""
    # the draw's first 16 bits say which records surely are in; only those of one value are ranked
    draws = kept.withColumn("_first", F.substring("digest", 1, 4))
    counts = sorted((r["_first"], r["n"]) for r in draws.groupBy("_first").agg(F.count(F.lit(1)).alias("n")).collect())  # at most 65,536 rows
    left, edge = int(round(sum(n for _, n in counts) * fraction)), ""
    for edge, n in counts:
        if n > left:
            break
        left -= n
    else:
        edge = "g"  # beyond all hex digits
    order = Window.partitionBy("_first").orderBy(eval_choice(F.col("digest")), "tokens", "shard", "line_no")
    inside = draws.where(F.col("_first") == edge).withColumn("_nth", F.row_number().over(order)).withColumn("split", F.when(F.col("_nth") <= left, "eval").otherwise("train")).drop("_nth")
    others = draws.where(F.col("_first") != edge).withColumn("split", F.when(F.col("_first") < edge, "eval").otherwise("train"))
    return others.unionByName(inside).drop("_first")


def summary(records: DataFrame, seen: DataFrame, split: DataFrame, valid: Column | None = None) -> DataFrame:
    """One row of counts along the way, as a preparation reports them; `valid` marks the records that are (all, if not given)."""
    total = records.agg(F.count(F.lit(1)).alias("total_records"), F.count_if(valid if valid is not None else F.lit(True)).alias("valid_records"))
    by = seen.agg(F.count(F.lit(1)).alias("distinct"), F.count_if(F.col("status") == "below").alias("below_min_tokens"), F.count_if(F.col("status") == "above").alias("above_max_tokens"))
    sides = split.agg(*[f(F.col("split") == s, s) for s in ("train", "eval") for f in (lambda c, s: F.count_if(c).alias(f"{s}_records"), lambda c, s: F.coalesce(F.sum(F.when(c, F.col("tokens"))), F.lit(0)).cast("bigint").alias(f"{s}_tokens"))])
    one = total.crossJoin(F.broadcast(by)).crossJoin(F.broadcast(sides))  # one row each
    return one.select("total_records", "valid_records", (F.col("valid_records") - F.col("distinct")).alias("deduplicated"), "below_min_tokens", "above_max_tokens", "train_records", "eval_records", "train_tokens", "eval_tokens")
