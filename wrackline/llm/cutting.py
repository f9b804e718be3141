"""Windows that are too long, cut into windows under the limit at pauses, with overlap.

The time of a window is written as a string, a character for each tick (a millisecond): `|`
where the voice falls silent, `.` elsewhere. As every window but the first starts `overlap`
before the end of the one before, each piece covers `limit - overlap` new ticks after the
first `overlap` ticks. One regular expression takes the pieces off in turn, its alternatives
in order of the strength of the boundary: the end of the window, the last pause within
reach, any tick. Looking back by `overlap` from where a piece begins gives its start.
Everything is an expression of Spark SQL; no row meets another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLACK = 0.001


def end_of(end_s: str | Column, recording_s: str | Column) -> Column:
    """The smaller of end and recording length; the recording length if the end is null."""
    return F.least(F.col(end_s) if isinstance(end_s, str) else end_s, F.col(recording_s) if isinstance(recording_s, str) else recording_s)


def pieces(start: Column, end: Column, pauses: Column, limit: float = 30.0, overlap: float = 5.0, tick: float = 0.001) -> Column:
    """array<struct<start_s, end_s>> of a window from start to end; pauses are times like them.

    0 <= overlap < limit. A pause within the first `overlap` seconds can't end a piece, as the
    next would then not get beyond it. A window of no length or unknown bounds has no pieces.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")
    reach, back = round((limit - overlap) / tick), round(overlap / tick)
    pattern = f"[.|]{{1,{reach}}}+$|[.|]{{0,{reach - 1}}}\\||[.|]{{1,{reach}}}"
    # ticks after the first `back`; the end's tick is the last
    length = F.ceil((end - start) / tick - 1e-6).cast("int") - back
    at = F.transform(F.coalesce(pauses, F.array().cast("array<double>")), lambda p: F.round((p - start) / tick).cast("int") - back)
    inner = F.array_sort(F.array_distinct(F.filter(at, lambda p: (p >= 1) & (p < length))))

    def drawn(stops: Column) -> Column:
        before = F.concat(F.array(F.lit(0)), stops)
        gaps = F.zip_with(before, stops, lambda p, q: F.when(q.isNotNull(), F.concat(F.repeat(F.lit("."), q - p - 1), F.lit("|"))))
        return F.concat(F.array_join(gaps, ""), F.repeat(F.lit("."), length - F.element_at(before, -1)))

    def bounds(sizes: Column) -> Column:
        ends = F.aggregate(sizes, F.array(F.lit(0)), lambda sums, n: F.concat(sums, F.array(F.element_at(sums, -1) + n)))
        return let(
            ends,
            lambda e: F.transform(
                F.sequence(F.lit(0), F.size(e) - 2),
                lambda i: F.struct(
                    F.when(i == 0, start).otherwise(F.round(start + F.get(e, i) * tick, 6)).alias("start_s"),
                    F.when(i == F.size(e) - 2, end).otherwise(F.round(start + (F.get(e, i + 1) + back) * tick, 6)).alias("end_s"),
                ),
            ),
        )

    several = let(inner, lambda stops: let(F.transform(F.regexp_extract_all(drawn(stops), F.lit(pattern), F.lit(0)), F.length), bounds))
    whole = F.array(F.struct(start.alias("start_s"), end.alias("end_s")))
    return F.when(end - start <= limit + SLACK, F.when(end > start, whole)).otherwise(several)


def let(value: Column, use) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def recording_windows(df: DataFrame) -> DataFrame:
    """Each key (recording_id, index) once, its latest delivery; rows with a null key are left out."""
    order = [F.col("created_at").desc_nulls_last(), F.col("start_s"), F.col("end_s"), F.col("recording_s"), F.col("pauses")]
    ranked = df.where("recording_id is not null and index is not null").withColumn("_nth", F.row_number().over(Window.partitionBy("recording_id", "index").orderBy(*order)))
    rows = ranked.where("_nth = 1").select("recording_id", "index", "start_s", "end_s", "recording_s", "pauses")
    return rows.withColumn("until_s", F.when(F.col("end_s").isNull(), F.col("recording_s")).otherwise(end_of("end_s", "recording_s")))


def overlong(df: DataFrame, limit: float = 30.0) -> DataFrame:
    """`recording_id, index` of the windows longer than the limit by more than a millisecond.

    Taken from the windows that are cut into more than one piece, then checked exactly. Windows
    whose start or end is unknown are no case.
    """
    rows = recording_windows(df)
    parts = rows.withColumn("_n", F.size(pieces(F.col("start_s"), F.col("until_s"), F.col("pauses"), limit)))
    return parts.where((F.col("_n") > 1) & (F.col("until_s") - F.col("start_s") > limit + SLACK)).select("recording_id", "index")


def cut_windows(df: DataFrame, limit: float = 30.0, overlap: float = 5.0) -> DataFrame:
    """`recording_id, source_index, piece, index, start_s, end_s`: windows of at most the limit.

    Windows within the limit come out as they are (their end set right); a longer one as pieces
    that end at pauses where there are any and overlap by `overlap`. `index` numbers a
    recording's windows from 0 in the order (source_index, piece). Windows of no length or with
    unknown bounds come out as one piece with those bounds, so that no row is lost.
    """
    rows = recording_windows(df)
    parts = pieces(F.col("start_s"), F.col("until_s"), F.col("pauses"), limit, overlap)
    as_is = F.array(F.struct(F.col("start_s").alias("start_s"), F.col("until_s").alias("end_s")))
    cut = rows.select("recording_id", F.col("index").alias("source_index"), F.posexplode(F.coalesce(parts, as_is)).alias("piece", "window"))
    # numbered in two steps, so that a recording with a third of all windows isn't one task's
    block = F.floor(F.col("source_index") / 1000)
    counts = cut.groupBy("recording_id", block.alias("block")).agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("recording_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("recording_id", "block").orderBy("source_index", "piece"))
    numbered = cut.withColumn("block", block).withColumn("nth", inside).join(before.select("recording_id", "block", "before"), ["recording_id", "block"])
    return numbered.select("recording_id", "source_index", "piece", (F.col("before") + F.col("nth") - 1).cast("int").alias("index"), F.col("window.start_s").alias("start_s"), F.col("window.end_s").alias("end_s"))
