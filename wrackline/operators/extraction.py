"""Scans to records: conversion by a hook, outcome and error of each file, and a whole build from editions to shards."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wrackline.functions import predicates as K
from wrackline.functions.text import simhash, word_count
from wrackline.operators import blocks as B
from wrackline.operators import dedup as D
from wrackline.session import cut

STATUSES = ("skipped", "reused", "extracted", "failed")


def converted(files: DataFrame, convert: Callable[[str, bytes], str], known: tuple[type[Exception], ...] = (ValueError, OSError, RuntimeError), fail_fast: bool = False, log: Callable[[str], None] | None = None) -> DataFrame:
    """`path, text, error` of `path, content`: what `convert(path, content)` makes of each file.

    An exception of a known kind, or a blank text, becomes that file's error; with `fail_fast` it
    fails the job, as any other exception does. `log` hears of each file where it is converted.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for path, content in zip(part["path"], part["content"]):
                text, error = None, None
                try:
                    text = convert(path, content)
                    if not (text or "").strip():
                        raise ValueError("no text in it")
                except known as e:
                    if fail_fast:
                        raise
                    text, error = None, f"{type(e).__name__}: {e}"
                if log is not None:
                    log(f"{path}: {error or 'converted'}")
                out.append((path, text, error))
            yield pd.DataFrame(out, columns=["path", "text", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, text string, error string")


def measured(files: DataFrame, measure: Callable[[str, bytes], float], known: tuple[type[Exception], ...] = (ValueError, OSError, RuntimeError)) -> DataFrame:
    """`path, duration_s, error` of recordings (`path, content`): what a decoder given as `measure(path, content)` says of each.

    A failure of a known kind, or a length that is not a positive number, is that file's error.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for path, content in zip(part["path"], part["content"]):
                try:
                    seconds = float(measure(path, content))
                    if not 0 < seconds < float("inf"):
                        raise ValueError(f"a length of {seconds} s")
                    out.append((path, seconds, None))
                except known as e:
                    out.append((path, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["path", "duration_s", "error"]).astype({"duration_s": "float64"})

    return files.select("path", "content").mapInPandas(run, "path string, duration_s double, error string")


def outcomes(status: DataFrame, texts: DataFrame, records: DataFrame) -> DataFrame:
    """`stem, status, error` of each edition: what was planned (`stem, status`), or `failed` with its error.

    texts: `stem, error` of those converted; records: `stem` of all that have records now. An
    edition without any record has failed: an empty result is an error.
    """
    rows = status.join(texts.select("stem", "error"), "stem", "left").join(records.select("stem").distinct().withColumn("_any", F.lit(True)), "stem", "left")
    error = F.coalesce("error", F.when(F.col("_any").isNull() & (F.col("status") != "skipped"), "no records"))
    return rows.select("stem", F.when(error.isNotNull(), "failed").otherwise(F.col("status")).alias("status"), error.alias("error"))


def batch_summary(found: DataFrame) -> DataFrame:
    """One row `scanned, skipped, reused, extracted, failed`."""
    return found.agg(F.count(F.lit(1)).alias("scanned"), *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])


def build(editions: DataFrame, least: int = 250, most: int = 1000, shortest: int = 80, separator: str = r"\n\s*\n") -> tuple[DataFrame, DataFrame]:
    """Editions (`source, text`) to `(records, summary)`.

    records: `source, ordinal, content`, chunked, filtered by length and domain, without exact and
    near copies, in order. summary: one row of the seven counters.
    """
    chunks = cut(B.chunks(B.blocks(B.candidates(editions, separator)), least, most))
    records, rest = filtered(chunks, shortest)
    scanned = editions.agg(F.count_distinct("source").alias("scanned_files"))
    return records, scanned.crossJoin(F.broadcast(rest))  # one row each


def filtered(records: DataFrame, shortest: int = 80, hashing=simhash) -> tuple[DataFrame, DataFrame]:
    """Records (`source, ordinal, content`) that stay, in order, and one row of counters on the way."""
    content = F.col("content")
    marked = records.withColumn("_short", word_count(content) < shortest).withColumn("_off", K.is_off_domain(content))
    one = marked.agg(F.count(F.lit(1)).alias("extracted_records"), F.count_if("_short").alias("below_minimum_records"), F.count_if(F.expr("not _short and _off")).alias("off_domain_records"), F.count_if(F.expr("not _short and not _off")).alias("_kept"))
    inside = marked.where("not _short and not _off").select("source", "ordinal", "content")
    exact = D.longest_of_copies(inside).agg(F.count(F.lit(1)).alias("_exact"))
    out = cut(D.deduplicated(inside, hashing=hashing))
    both = one.crossJoin(F.broadcast(exact)).crossJoin(F.broadcast(out.agg(F.count(F.lit(1)).alias("output_records"))))  # one row each
    counters = both.select("extracted_records", "below_minimum_records", "off_domain_records", (F.col("_kept") - F.col("_exact")).alias("exact_duplicates"), (F.col("_exact") - F.col("output_records")).alias("near_duplicates"), "output_records")
    return D.in_order(out), counters
