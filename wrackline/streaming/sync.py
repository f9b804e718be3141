"""Checkpoint folders seen in a stream of listings, sent once each when they have settled."""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wrackline.functions.text import step_of
from wrackline.operators.checkpoints import MARKER, upload_plan
from wrackline.operators.sequences import beyond_newest


def last_looks(looks: DataFrame, n: int = 2) -> DataFrame:
    """`run_id, step, path, looks`: the last n looks (struct seen_at, size) at each file, oldest first."""
    held = F.array_sort(F.collect_set(F.struct("seen_at", "size")))
    per_file = looks.groupBy("run_id", "step", "path").agg(held.alias("looks"))
    return per_file.withColumn("looks", F.slice("looks", F.greatest(F.size("looks") - (n - 1), F.lit(1)), n))


def settled(listing: DataFrame, expected: list[str] | None = None, stable_s: float = 0.0) -> DataFrame:
    """`run_id, step, files, bytes`: steps whose every file has the same size in its last two looks, at least `stable_s` apart.

    listing: `run_id, folder, path, size, seen_at`, each look a row for each file. With
    `expected`, all those files have to be there. Folders not named by a step are left out.
    """
    looks = listing.withColumn("step", step_of(F.col("folder"))).where("step is not null")
    return _settled(last_looks(looks), expected, stable_s)


def _settled(per_file: DataFrame, expected: list[str] | None, stable_s: float) -> DataFrame:
    first, last = F.get("looks", 0), F.element_at("looks", -1)
    apart = last["seen_at"].cast("timestamp").cast("double") - first["seen_at"].cast("timestamp").cast("double")
    still = (F.size("looks") >= 2) & (first["size"] == last["size"]) & (apart >= stable_s)
    rows = per_file.where(F.col("path") != MARKER).select("run_id", "step", "path", still.alias("still"), last["size"].alias("size"))
    every = F.bool_and("still") if not expected else F.bool_and("still") & (F.count_distinct(F.when(F.col("path").isin(expected), F.col("path"))) == len(set(expected)))
    return rows.groupBy("run_id", "step").agg(every.alias("ok"), F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes")).where("ok").drop("ok")


def sent(plan: DataFrame, put: Callable[[str, int, list[str]], None], marker: Callable[[str, int], None], tries: int = 3, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """`run_id, step, bytes, error`: each checkpoint's chunks (see `upload_plan`) handed to `put(run_id, step, paths)` in order, then `marker(run_id, step)`.

    A failed call is repeated after 2, 4, ... seconds, up to `tries` calls; then the checkpoint has
    an error and no marker. So a marked checkpoint is whole.
    """

    def tried(call, *args) -> None:
        for n in range(1, tries + 1):
            try:
                return call(*args)
            except Exception:
                if n == tries:
                    raise
                wait(2.0**n)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        run_id, step, error = part["run_id"].iloc[0], int(part["step"].iloc[0]), None
        try:
            for _, chunk in part.sort_values("nth").groupby("chunk", sort=True):
                tried(put, run_id, step, chunk["path"].tolist())
            tried(marker, run_id, step)
        except Exception as e:
            error = f"{type(e).__name__}: {e}"
        return pd.DataFrame([(run_id, step, int(part["size"].sum()), error)], columns=["run_id", "step", "bytes", "error"])

    # the files of one checkpoint are a task: names and sizes, no contents
    return plan.groupBy("run_id", "step").applyInPandas(run, "run_id string, step bigint, bytes bigint, error string")


def _folder(spark: SparkSession, path: str, empty: str) -> DataFrame:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return spark.read.schema(empty).parquet(path) if fs.exists(at) else spark.createDataFrame([], empty)


LOOKS = "run_id string, step bigint, path string, seen_at timestamp, size bigint"
LEDGER = "run_id string, step bigint, bytes bigint"


def sync(stream: DataFrame, ledger: str, put: Callable[[str, int, list[str]], None], marker: Callable[[str, int], None], checkpoint: str, trigger: dict | None = None, expected: list[str] | None = None, stable_s: float = 0.0, most_bytes: int = 2**30, ignore: tuple[str, ...] = (), keep: int = 2, prune: Callable[[DataFrame], None] | None = None, tries: int = 3, log: Callable[[str], None] | None = None):
    """Sends checkpoints once they have settled; the ledger (a Parquet folder) has those sent.

    Looks arrive in whatever micro-batches: the last two at each file that isn't sent yet are kept
    from batch to batch beside the ledger. Each step in turn is sent (see `sent`); one that
    fails isn't in the ledger and is tried again at the next batch. After a success, `prune` is
    given the run's checkpoints beyond the `keep` newest. A batch that is repeated after a loss
    sends nothing twice that the ledger has. A ledger that was filled beforehand seeds it.
    trigger: {"availableNow": True} for one pass, or {"processingTime": "20 seconds"} to go on.
    """
    at = lambda n: f"{ledger}.looks/{n}"

    def batch(rows: DataFrame, n: int) -> None:
        spark = rows.sparkSession
        done = _folder(spark, ledger, LEDGER).select("run_id", "step")
        new = rows.withColumn("step", step_of(F.col("folder"))).where("step is not null").select("run_id", "step", "path", F.col("seen_at").cast("timestamp").alias("seen_at"), F.col("size").cast("bigint").alias("size"))
        every = reduce(DataFrame.unionByName, [_folder(spark, at(n - 1), LOOKS), new]).join(done, ["run_id", "step"], "left_anti")
        per_file = last_looks(every)
        per_file.select("run_id", "step", "path", F.explode("looks").alias("l")).select("run_id", "step", "path", "l.*").write.mode("overwrite").parquet(at(n))
        held = last_looks(spark.read.schema(LOOKS).parquet(at(n)))
        ready = _settled(held, expected, stable_s)
        files = held.join(ready.select("run_id", "step"), ["run_id", "step"], "left_semi").select("run_id", "step", "path", F.element_at("looks", -1)["size"].alias("size"))
        results = sent(upload_plan(files, most_bytes, ignore), put, marker, tries).persist()
        results.where("error is null").select("run_id", "step", "bytes").write.mode("append").parquet(ledger)
        if log is not None:
            for r in results.orderBy("run_id", "step").collect():  # checkpoints of one batch
                log(f"{r['run_id']} step {r['step']}: {r['error'] or 'sent'}")
        if prune is not None and not results.where("error is null").isEmpty():
            prune(beyond_newest(_folder(spark, ledger, LEDGER).select("run_id", "step").distinct(), "run_id", "step", keep))
        results.unpersist()
        old = spark._jvm.org.apache.hadoop.fs.Path(at(n - 2))
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
