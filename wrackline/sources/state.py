"""Small files of state, recipes and transcripts, in whatever file system the path names."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def read_state(spark: SparkSession, path: str, default: dict) -> dict:
    """The JSON object in a file over `default`; a missing file or one that is no JSON object gives the default."""
    at, fs = _at(spark, path)
    if not fs.exists(at) or fs.getFileStatus(at).isDirectory():
        return dict(default)
    raw = spark.read.text(path, wholetext=True).first()
    try:
        found = json.loads(raw[0]) if raw else None
    except ValueError:
        found = None
    return default | found if isinstance(found, dict) else dict(default)


def consumed_s(state: dict) -> float:
    """Seconds of a metering state; what is no number or negative counts as none."""
    value = state.get("consumed_s", 0.0)
    return max(float(value), 0.0) if isinstance(value, (int, float)) and not isinstance(value, bool) and value == value else 0.0


def write_state(spark: SparkSession, path: str, state: dict) -> None:
    """A JSON file (state, recipe, provenance), whole or not at all: written beside its place and moved there."""
    at, fs = _at(spark, path)
    part, _ = _at(spark, path + ".part")
    out = fs.create(part, True)
    out.write(bytearray(json.dumps(state, indent=2, ensure_ascii=False, default=str).encode()))
    out.close()
    if not fs.rename(part, at):
        fs.delete(at, False)
        fs.rename(part, at)


def from_record(raw: Column, schema: str) -> Column:
    """A JSON text as a struct of the schema; with `to_record`, a round trip."""
    return F.from_json(raw, schema)


def to_record(row: Column) -> Column:
    return F.to_json(row, {"ignoreNullFields": "false"})


def write_transcripts(recordings: DataFrame, folder: str, texts: tuple[str, ...]) -> None:
    """Each recording's texts (columns) and all its columns as JSON: `recording_id=.../name=...` below the folder. Null texts aren't written."""
    names = F.array(*[F.struct(F.lit(t + ".txt").alias("name"), F.col(t).alias("value")) for t in texts], F.struct(F.lit("results.json").alias("name"), F.to_json(F.struct("*")).alias("value")))
    rows = recordings.select("recording_id", F.explode(names).alias("f")).select("recording_id", "f.*").where("value is not null")
    rows.write.mode("overwrite").partitionBy("recording_id", "name").text(folder)
