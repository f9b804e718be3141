"""Exact copies: one representative for each text, so that a text that fills a third
of a table is handled once, and a table that leads from every key to its representative."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Rows of ids up to this number are sent to every task; more are joined by shuffle.
SENT = 100_000


def text_id(text: str) -> Column:
    """128 bits that stand for a text."""
    return F.struct(F.xxhash64(text).alias("x"), F.xxhash64(F.lit("b"), F.col(text)).alias("y"))


def newest(df: DataFrame, key: str, text: str, at: str | None, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row `id, text_id, <keep>` for each key: repeated deliveries count once, the last one holds.

    Texts themselves are not shuffled. Null keys are left out.
    """
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), text_id(text).alias("text_id"), *keep, (F.col(at) if at else F.lit(0)).alias("_at"))
    last = F.max_by(F.struct("text_id", *keep), F.struct(F.col("_at").isNotNull(), "_at", "text_id"))
    return rows.groupBy("id").agg(last.alias("_last")).select("id", "_last.*")


def classes(rows: DataFrame, *within: str) -> DataFrame:
    """`rows` with `rep`, the least id that has the same text (and the same `within`)."""
    by = ["text_id", *within]
    rep = rows.groupBy(*by).agg(F.min("id").alias("rep"))
    same = F.lit(True)
    for c in by:
        same = same & rows[c].eqNullSafe(rep[c])
    return rows.join(rep, same).select(rows["*"], rep["rep"])


def only(df: DataFrame, ids: DataFrame, how: str = "left_semi", most: int = SENT) -> DataFrame:
    """Rows of df whose id is (left_semi) or isn't (left_anti) in `ids` (a column `id`, counted here)."""
    ids = ids.select("id")
    return df.join(F.broadcast(ids) if ids.limit(most + 1).count() <= most else ids, "id", how)


def texts_of(df: DataFrame, key: str, text: str, wanted: DataFrame) -> DataFrame:
    """`id, text` of the ids of `wanted` (id, text_id): each once, in the delivery that holds.

    Rows are shuffled by their unique id, so no group of copies can crowd a task; if few are
    wanted, only their texts are.
    """
    rows = only(df.select(F.col(key).alias("id"), F.col(text).alias("text"), text_id(text).alias("text_id")), wanted)
    return rows.join(wanted.select("id", "text_id"), ["id", "text_id"]).dropDuplicates(["id"]).select("id", "text")
