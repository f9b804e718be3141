"""Multiple-choice probes: strict reading with reasons, and the columns that scoring needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values.
TRACKS = ("local", "rare_local", "control")
VARIANTS = ("canonical", "paraphrase")
REQUIRED = ("answer_index", "category", "choices", "exposure", "fact_id", "id", "prompt", "source_digests", "stability", "track", "variant")


def parsed(lines: DataFrame) -> DataFrame:
    """The fields of JSON lines (`shard, line_no, raw`) with `shape`: why a line isn't an object of the required fields, else null.

    A field of another type than it should have is null and `<field>_bad` is true.
    """
    v = F.try_parse_json("raw")
    at = lambda name, kind: F.try_variant_get("v", f"$.{name}", kind)
    kind = lambda name: F.schema_of_variant(F.try_variant_get("v", f"$.{name}", "variant"))
    rows = lines.where(F.trim("raw") != "").withColumn("v", v)
    object_ = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    missing = F.filter(F.array(*[F.when(F.try_variant_get("v", f"$.{n}", "variant").isNull(), F.lit(n)) for n in REQUIRED]), lambda n: n.isNotNull())
    shape = F.when(F.col("v").isNull(), "not JSON").when(~object_, "not an object").when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ", ")))
    texts = lambda name: at(name, "array<variant>")
    all_text = lambda a: F.forall(a, lambda x: F.coalesce(F.schema_of_variant(x) == "STRING", F.lit(False)))
    as_text = lambda a: F.transform(a, lambda x: F.try_variant_get(x, "$", "string"))
    whole = F.coalesce(kind("answer_index").isin("BIGINT", "INT", "SMALLINT", "TINYINT"), F.lit(False))
    text = lambda name: F.when(F.coalesce(kind(name) == "STRING", F.lit(False)), at(name, "string"))
    absent = lambda name: F.try_variant_get("v", f"$.{name}", "variant").isNull()
    lists = {n: F.when(F.coalesce(all_text(texts(n)), F.lit(False)), as_text(texts(n))) for n in ("choices", "source_digests")}
    sources = F.when(absent("sources"), F.array().cast("array<string>")).when(F.coalesce(all_text(texts("sources")), F.lit(False)), as_text(texts("sources")))
    group = F.when(absent("source_group"), "").otherwise(text("source_group"))
    return rows.select(
        "shard", "line_no", shape.alias("shape"), text("id").alias("id"), text("fact_id").alias("fact_id"), text("variant").alias("variant"), text("track").alias("track"), at("category", "string").alias("category"), at("prompt", "string").alias("prompt"),
        F.size(texts("choices")).alias("n_choices"), lists["choices"].alias("choices"), F.when(whole, at("answer_index", "int")).alias("answer_index"), lists["source_digests"].alias("source_digests"), sources.alias("sources"), at("stability", "string").alias("stability"), at("exposure", "string").alias("exposure"),
        group.alias("source_group"),
    )


def problems() -> Column:
    """Why a probe is no good, the first of the rules it breaks in their order, else null.

    Needs the probe's fields, `shape` and `n_choices`; the same id twice is found with a window.
    """
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    nth = F.row_number().over(Window.partitionBy("id").orderBy("shard", "line_no"))
    digest = lambda d: F.coalesce(d.rlike("\\A[0-9a-f]{64}\\z"), F.lit(False))
    empty = lambda name: F.coalesce(F.col(name) == "", F.lit(True))
    return (
        F.when(F.col("shape").isNotNull(), F.col("shape"))
        .when(~F.coalesce(F.col("n_choices") == 4, F.lit(False)), "needs four choices")
        .when(F.col("choices").isNull() | F.exists("choices", blank), "choices must be texts")
        .when(~F.coalesce(F.col("answer_index").between(0, 3), F.lit(False)), "answer_index out of range")
        .when(empty("id"), "id must be a text")
        .when(nth > 1, "id stands twice")
        .when(~F.coalesce(F.col("track").isin(*TRACKS), F.lit(False)), "unknown track")
        .when(F.col("sources").isNull(), "sources must be texts")
        .when(empty("fact_id"), "fact_id must be a text")
        .when(~F.coalesce(F.col("variant").isin(*VARIANTS), F.lit(False)), "unknown variant")
        .when(F.col("source_group").isNull(), "source_group must be a text")
        .when(F.col("source_digests").isNull() | ~F.forall("source_digests", digest), "source_digests must be SHA-256")
        .when((F.col("track") != "control") & (F.size("source_digests") == 0), "needs source digests")
    )


def checked(rows: DataFrame) -> DataFrame:
    """Rows with `problem`: their own, else `fact needs both variants` if their fact hasn't exactly one probe of each."""
    fact = Window.partitionBy("fact_id")
    uneven = (F.count(F.lit(1)).over(fact) != len(VARIANTS)) | (F.size(F.collect_set("variant").over(fact)) != len(VARIANTS))
    return rows.withColumn("problem", problems()).withColumn("problem", F.coalesce("problem", F.when(uneven, "fact needs both variants")))


def loaded(lines: DataFrame) -> DataFrame:
    """The probes of JSON lines; a bad one fails the job with `shard:line: why`, and so does a file without any.

    The check is a filter, so no choice of columns loses it.
    """
    if lines.where(F.trim("raw") != "").isEmpty():
        raise ValueError("no probes found")
    rows = checked(parsed(lines))
    why = F.concat(F.col("shard"), F.lit(":"), F.col("line_no").cast("string"), F.lit(": "), F.col("problem"))
    good = rows.where(F.when(F.col("problem").isNotNull(), F.raise_error(why).cast("boolean")).otherwise(F.lit(True)))
    member = F.when(F.col("track") == "control", "control").otherwise("unverified").alias("membership")
    group = F.coalesce(F.nullif("source_group", F.lit("")), "id").alias("source_group")
    return good.select("id", "track", "category", "prompt", "choices", "answer_index", "sources", "stability", "exposure", "fact_id", "variant", group, "source_digests", member)


def completions(prompt: Column, choices: Column) -> Column:
    """The prompt completed by each choice."""
    return F.transform(choices, lambda c: F.concat(F.regexp_replace(prompt, r"(?U)\s+\z", ""), F.lit(" "), c))


def completion_start(prefix: Column, full: Column) -> Column:
    """Number of leading token ids that two arrays have in common: where the completion begins, a token merged over the border included."""
    same = F.zip_with(prefix, full, lambda a, b: F.coalesce(a == b, F.lit(False)))
    at = F.array_position(same, False)
    return F.when(at > 0, at - 1).otherwise(F.least(F.size(prefix), F.size(full))).cast("int")


def mean_log_probability(log_probs: Column, start: Column) -> Column:
    """Mean over the tokens from `start` (0-based) of each token's log-probability given those before it; none is an error.

    log_probs[i] is that of token i; a start before 1 has nothing to be predicted from.
    """
    tail = F.slice(log_probs, start + 1, F.greatest(F.size(log_probs) - start, F.lit(0)))
    mean = F.aggregate(tail, F.lit(0.0), lambda a, x: a + x) / F.size(tail)
    return F.when((start < 1) | (F.size(log_probs) <= start), F.raise_error(F.lit("no completion tokens")).cast("double")).otherwise(mean)
