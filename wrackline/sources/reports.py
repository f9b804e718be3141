"""Reports of results as JSON and Markdown. Tables are aggregates of a few rows; files are written in one step."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wrackline.operators import compare as C
from wrackline.operators.probes import TRACKS
from wrackline.sources.state import _at


def _number(value: Column, pattern: str) -> Column:
    """The size of a number by its exact value, ties to the even digit, as Python and C print it."""
    return F.call_function("format_number", F.abs(value).cast("double"), F.lit(pattern))


def share(value: Column) -> Column:
    """A part of 1 as per cent with one decimal; null as a dash."""
    return F.coalesce(F.concat(_number(value * 100, "0.0"), F.lit("%")), F.lit("-"))


def _sign(value: Column) -> Column:
    return F.when(value < 0, "-").otherwise("+")


def signed_share(value: Column) -> Column:
    return F.concat(_sign(value), share(value))


def signed(value: Column) -> Column:
    return F.concat(_sign(value), _number(value, "0.000"))


def markdown(title: str, rows: DataFrame, numeric: tuple[str, ...] = ()) -> list[str]:
    """A section with a table; an empty one says so."""
    held = [["" if x is None else str(x) for x in r] for r in rows.collect()]  # a few rows
    lines = ["", f"## {title}", "", "| " + " | ".join(rows.columns) + " |", "|" + "|".join("---:" if c in numeric else "---" for c in rows.columns) + "|"]
    return lines + ["| " + " | ".join(r) + " |" for r in held or [["None", *["-"] * (len(rows.columns) - 1)]]]


def write(spark: SparkSession, path: str, text: str) -> None:
    """A text file, whole or not at all."""
    at, fs = _at(spark, path)
    part, _ = _at(spark, path + ".part")
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(at):
        fs.delete(at, False)
    fs.rename(part, at)


def comparison_tables(pairs: DataFrame, dims: tuple[str, ...] = ("track", "category", "exposure", "membership")) -> dict[str, DataFrame]:
    """The tables of a paired comparison: measures in all groupings, tracks with intervals, families and their counts, contrasts, regressions."""
    groups = C.grouped(pairs, dims)
    families = C.families(pairs)
    return {
        "groups": groups, "tracks": C.track_summary(pairs, TRACKS), "families": families, "family_groups": C.family_groups(families), "contrasts": C.contrasts(pairs),
        "regressed": pairs.where("delta < 0").select("probe_id", "track", "base_margin", "adapter_margin", "delta").orderBy("delta", "probe_id"),
    }


def write_comparison(pairs: DataFrame, path: str, title: str, dims: tuple[str, ...] = ("track", "category", "exposure", "membership")) -> None:
    """`<path>.json` and `<path>.md` of a paired comparison."""
    spark = pairs.sparkSession
    tables = comparison_tables(pairs, dims)
    col = F.col
    accuracy = [share(col("base_accuracy")).alias("Base accuracy"), share(col("adapter_accuracy")).alias("Adapter accuracy"), signed_share(col("adapter_accuracy") - col("base_accuracy")).alias("Accuracy delta")]
    interval = F.concat(signed(col("margin_delta")), F.lit(" ["), signed(col("low")), F.lit(", "), signed(col("high")), F.lit("]"))
    numeric = ("N", "Base accuracy", "Adapter accuracy", "Accuracy delta", "Margin delta", "Margin delta (95% CI)", "W/T/L", "Facts", "Base pass", "Adapter pass", "Acquired", "Regressed", "Base margin", "Adapter margin", "Delta")
    lines = [f"# {title}"]
    lines += markdown("Summary", tables["tracks"].select(col("track").alias("Track"), col("n").alias("N"), *accuracy, interval.alias("Margin delta (95% CI)"), F.concat_ws("/", *[col(c).cast("string") for c in ("wins", "ties", "losses")]).alias("W/T/L")), numeric)
    for d in dims[1:]:
        rows = tables["groups"].where(col("dimension") == d).orderBy("value")
        lines += markdown(f"By {d}", rows.select(col("value").alias("Group"), col("n").alias("N"), *accuracy, signed(col("margin_delta")).alias("Margin delta")), numeric)
    passed = lambda c: F.concat_ws("/", col(c).cast("string"), col("facts").cast("string"))
    lines += markdown("Facts with all wordings right", tables["family_groups"].select(col("family_group").alias("Group"), col("facts").alias("Facts"), passed("base_passes").alias("Base pass"), passed("adapter_passes").alias("Adapter pass"), col("acquired").alias("Acquired"), col("regressed").alias("Regressed")), numeric)
    lines += markdown("Contrasts", tables["contrasts"].select(*[signed(col(c)).alias(c) for c in tables["contrasts"].columns]))
    lines += markdown("Regressed probes", tables["regressed"].select(col("probe_id").cast("string").alias("Probe"), col("track").alias("Track"), *[signed(col(c)).alias(n) for c, n in (("base_margin", "Base margin"), ("adapter_margin", "Adapter margin"), ("delta", "Delta"))]), numeric)
    data = {name: [r.asDict(recursive=True) for r in df.collect()] for name, df in tables.items() if name != "regressed"}
    write(spark, path + ".json", json.dumps(data, indent=2, ensure_ascii=False, default=str))
    write(spark, path + ".md", "\n".join(lines) + "\n")


def write_snapshot(results: DataFrame, path: str, title: str) -> None:
    """`<path>.json` and `<path>.md` of one run (`probe_id, track, category, correct, margin`): accuracy by track, counts, wrong probes."""
    spark = results.sparkSession
    tracks, counts = C.track_accuracy(results, TRACKS), C.category_counts(results)
    lines = [f"# {title}"] + markdown("Accuracy", tracks.select(F.col("track").alias("Track"), F.col("n").alias("N"), F.col("right").alias("Correct"), share(F.col("accuracy")).alias("Accuracy")), ("N", "Correct", "Accuracy"))
    wrong = results.where(~F.col("correct")).orderBy("probe_id").select(F.col("probe_id").cast("string").alias("Probe"), F.col("track").alias("Track"))
    lines += markdown("Wrong probes", wrong)
    data = {"tracks": [r.asDict() for r in tracks.collect()], "categories": [r.asDict() for r in counts.collect()]}
    write(spark, path + ".json", json.dumps(data, indent=2, ensure_ascii=False, default=str))
    write(spark, path + ".md", "\n".join(lines) + "\n")
