"""Text, JSON-line, binary and listing sources; JSON-line sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wrackline.functions.text import step_done


def listed(spark: SparkSession, folder: str, suffix: str, limit: int | None = None) -> list[str]:
    """Paths of a folder's files with the suffix, sorted; a limit counts after sorting."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    names = sorted(s.getPath().toString() for s in found if s.isFile() and s.getPath().getName().endswith(suffix))
    return names[:limit]


def editions(spark: SparkSession, folder: str, limit: int | None = None) -> DataFrame:
    """`source, text`: whole text files; the source is the name without its ending."""
    paths = listed(spark, folder, ".txt", limit)
    if not paths:
        raise FileNotFoundError(f"no .txt file in {folder}")
    rows = spark.read.text(paths, wholetext=True)
    return rows.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.txt$", "").alias("source"), F.col("value").alias("text"))


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """`path, size, modified` of all files below a folder, however deep; path is relative to it. No file is opened."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    base = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toString().rstrip("/") + "/"
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    return rows.select(F.substring(plain("path"), F.length(plain(F.lit(base))) + 1, F.lit(2**30)).alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def shards(spark: SparkSession, folder: str) -> DataFrame:
    """`shard, line_no, raw` of JSON-line files; lines are numbered from 1 within their file.

    Files are read in blocks by many tasks: a line's number is its place in its block and the
    lines of the blocks before, counted first (a row for each block). Blank lines are left out.
    """
    paths = listed(spark, folder, ".jsonl")
    if not paths:
        raise FileNotFoundError(f"no .jsonl file in {folder}")
    # ids rise along a partition, and a block is in one partition
    rows = spark.read.option("lineSep", "\n").text(paths).select(F.col("_metadata.file_name").alias("shard"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nth"), "value")
    blocks = rows.groupBy("shard", "block").agg(F.min("nth").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = [(r["shard"], r["block"], r["first"], r["before"]) for r in blocks.withColumn("before", before).collect()]  # a row for each block of the files
    starts = spark.createDataFrame(held, "shard string, block long, first long, before long")
    numbered = rows.join(F.broadcast(starts), ["shard", "block"]).select("shard", (F.col("before") + F.col("nth") - F.col("first") + 1).alias("line_no"), F.regexp_replace("value", r"\r\z", "").alias("raw"))
    return numbered.where("raw <> ''")


def first_messages(lines: DataFrame) -> DataFrame:
    """`shard, line_no, text`: the content of the first message of each record line."""
    return lines.select("shard", "line_no", F.try_variant_get(F.try_parse_json("raw"), "$.messages[0].content", "string").alias("text"))


def trainer_log(lines: DataFrame, step: str = "global_step/max_steps") -> DataFrame:
    """`shard, line_no, step, loss` of log lines that have both a loss and a step mark ("n/m"); others are left out."""
    v = F.try_parse_json("raw")
    mark = F.try_variant_get(v, f"$['{step}']", "string")
    rows = lines.select("shard", "line_no", step_done(mark).alias("step"), F.try_variant_get(v, "$.loss", "double").alias("loss"))
    return rows.where("step is not null and loss is not null")


def packed_digests(lines: DataFrame) -> DataFrame:
    """`digest`: distinct SHA-256 of the joined contents of each record line (`raw`)."""
    texts = F.transform(F.try_variant_get(F.try_parse_json("raw"), "$.messages", "array<variant>"), lambda m: F.try_variant_get(m, "$.content", "string"))
    joined = F.regexp_replace(F.array_join(texts, " "), r"(?U)^\s+|\s+$", "")
    return lines.select(F.sha2(joined, 256).alias("digest")).where("digest is not null").distinct()


def binaries(spark: SparkSession, folder: str, suffix: str, limit: int | None = None) -> DataFrame:
    """`path, length, content` of binary files (scans, recordings) with the suffix, one row each; a limit counts after sorting by name."""
    paths = listed(spark, folder, suffix, limit)
    if not paths:
        raise FileNotFoundError(f"no {suffix} file in {folder}")
    return spark.read.format("binaryFile").load(paths).select("path", "length", "content")


def edition_status(listing: DataFrame) -> DataFrame:
    """`stem, status` of `path, length`: skipped (records exist), reused (text exists) or extracted."""
    name = F.element_at(F.split("path", "/"), -1)
    parts = listing.select(F.regexp_extract(name, r"^(.*)\.([^.]+)$", 1).alias("stem"), F.regexp_extract(name, r"\.([^.]+)$", 1).alias("ext"), "length")
    has = lambda ext, least=0: F.bool_or((F.col("ext") == ext) & (F.col("length") >= least))
    seen = parts.groupBy("stem").agg(has("pdf").alias("pdf"), has("jsonl").alias("jsonl"), has("txt", 1).alias("txt")).where("pdf")
    return seen.select("stem", F.when(F.col("jsonl"), "skipped").when(F.col("txt"), "reused").otherwise("extracted").alias("status"))


def with_record(records: DataFrame, content: str = "content") -> DataFrame:
    """Adds `value`, the record's JSON line: one assistant message."""
    return records.withColumn("value", F.to_json(F.struct(F.array(F.struct(F.lit("assistant").alias("role"), F.col(content).alias("content"))).alias("messages"))))


def write_shards(records: DataFrame, folder: str, one_file: bool = False) -> int:
    """One folder of JSON lines for each source, in order of ordinal; returns the number of lines.

    Refuses a folder with something in it. Large sources have several files, whose names are in
    order; with `one_file`, each has one, written by one task.
    """
    spark = records.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(path) and fs.listStatus(path):
        raise FileExistsError(folder)
    rows = with_record(records).select("source", "ordinal", "value")
    parted = rows.repartition("source") if one_file else rows.repartitionByRange("source", "ordinal")
    counted = Observation()
    ordered = parted.sortWithinPartitions("source", "ordinal").observe(counted, F.count(F.lit(1)).alias("n"))
    ordered.select("source", "value").write.mode("append").partitionBy("source").text(folder)
    return counted.get["n"]


def write_split(split: DataFrame, train: str, held: str) -> None:
    """Train and eval records as JSON lines in order of tokens; an empty side is not written."""
    for side, folder in (("train", train), ("eval", held)):
        rows = split.where(F.col("split") == side)
        if not rows.isEmpty():
            with_record(rows).orderBy("tokens", "shard", "line_no").select("value").write.text(folder)


def marker(files: DataFrame) -> DataFrame:
    """`run_id, step, marker`: the completion marker of each checkpoint, its files in order, as JSON."""
    held = F.array_sort(F.collect_list(F.struct("path", "size")))
    rows = files.groupBy("run_id", "step", "manifest_hash", "image_digest", "created_at").agg(held.alias("files"))
    return rows.select("run_id", "step", F.to_json(F.struct("run_id", "step", "manifest_hash", "image_digest", "created_at", "files")).alias("marker"))


def first_lines(df: DataFrame, per: str, order: str, n: int) -> DataFrame:
    """The first n rows of each group."""
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(per).orderBy(order))).where(F.col("_nth") <= n).drop("_nth")
