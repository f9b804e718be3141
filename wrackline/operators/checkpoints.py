"""Checkpoints in listings: which are complete, which fit a recipe, which to fetch, keep and send.

listing: `run_id, folder, path, size, type` of a store, a row for each file (`path` is relative to
the folder); markers: `run_id, folder, raw`, the text of a folder's completion marker.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wrackline.functions.gates import ignored
from wrackline.functions.text import step_of

MARKER = "_COMPLETE.json"


def marker_hash(raw: Column) -> Column:
    """The recipe's hash that a marker names; unreadable or without one: the empty hash."""
    return F.coalesce(F.try_variant_get(F.try_parse_json(raw), "$.manifest_hash", "string"), F.lit(""))


def checkpoints(listing: DataFrame, markers: DataFrame | None = None) -> DataFrame:
    """`run_id, step, folder, files, bytes, complete, manifest_hash` of folders named by a step; others are left out.

    A folder is complete if a file of the marker's name is in it. bytes has all its files.
    """
    files = listing.withColumn("step", step_of(F.col("folder"))).where("step is not null")
    rows = files.groupBy("run_id", "step", "folder").agg(F.count(F.lit(1)).alias("files"), F.sum(F.coalesce("size", F.lit(0))).cast("bigint").alias("bytes"), F.bool_or(F.col("path").endswith(MARKER)).alias("complete"))
    if markers is None:
        return rows.withColumn("manifest_hash", F.lit(""))
    held = markers.select("run_id", "folder", marker_hash(F.col("raw")).alias("manifest_hash"))
    joined = rows.join(held, ["run_id", "folder"], "left")
    return joined.select("run_id", "step", "folder", "files", "bytes", "complete", F.when(F.col("complete"), F.coalesce("manifest_hash", F.lit(""))).otherwise("").alias("manifest_hash"))


def newest(found: DataFrame, recipes: DataFrame | None = None) -> DataFrame:
    """`run_id, step`: the newest complete checkpoint of each run; with `recipes` (`run_id, manifest_hash`), of those with the run's hash."""
    rows = found.where("complete")
    if recipes is not None:
        rows = rows.join(recipes.select("run_id", "manifest_hash"), ["run_id", "manifest_hash"], "left_semi")
    return rows.groupBy("run_id").agg(F.max("step").alias("step"))


def seeded(found: DataFrame, recipes: DataFrame) -> DataFrame:
    """`run_id, step`: complete checkpoints that a restarted sync counts as sent: those with the run's hash or with none."""
    r = recipes.select("run_id", F.col("manifest_hash").alias("_own"))
    return found.where("complete").join(r, "run_id").where("manifest_hash = '' or manifest_hash = _own").select("run_id", "step")


def restored(listing: DataFrame, chosen: DataFrame) -> DataFrame:
    """`run_id, step, path, size`: the files to fetch of the chosen checkpoints (`run_id, step`)."""
    return listing.withColumn("step", step_of(F.col("folder"))).join(chosen.select("run_id", "step"), ["run_id", "step"], "left_semi").select("run_id", "step", "path", "size")


def stale(found: DataFrame, keep: int = 2) -> DataFrame:
    """`run_id, step, folder`: complete checkpoints older than the `keep` newest complete ones."""
    nth = F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("step")))
    return found.where("complete").withColumn("_nth", nth).where(F.col("_nth") > keep).select("run_id", "step", "folder")


def upload_plan(files: DataFrame, most_bytes: int, ignore: tuple[str, ...] = ()) -> DataFrame:
    """`run_id, step, path, size, nth, chunk`: data files smallest first, in chunks of at most `most_bytes` (a larger file alone).

    The marker isn't in it: it goes last, by itself. Files that fit one of the `ignore` globs stay.
    """
    from wrackline.operators.sequences import packed

    data = files.where(~F.col("path").endswith(MARKER) & ~ignored(F.col("path"), ignore))
    nth = F.row_number().over(Window.partitionBy("run_id", "step").orderBy("size", "path"))
    keyed = data.withColumn("nth", nth).withColumn("_key", F.concat_ws("/", "run_id", "step"))
    bins = packed(keyed, "_key", "nth", "size", float(most_bytes)).select("_key", "nth", F.col("bin").alias("chunk"))
    return keyed.join(bins, ["_key", "nth"]).select("run_id", "step", "path", "size", "nth", "chunk")


def registered(registry: DataFrame, listing: DataFrame, name: str = "name") -> DataFrame:
    """Entries of a registry whose file exists in the listing."""
    return registry.join(listing.select(name).distinct(), name, "left_semi")


def folder_sizes(listing: DataFrame, *by: str) -> DataFrame:
    """`<by>, files, bytes`: all files below, however deep."""
    return listing.groupBy(*by).agg(F.count(F.lit(1)).alias("files"), F.sum(F.coalesce("size", F.lit(0))).cast("bigint").alias("bytes"))
