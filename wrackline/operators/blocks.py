"""From edition text to blocks, articles and bounded chunks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wrackline.functions import patterns as P
from wrackline.functions import predicates as K
from wrackline.functions.text import normalised, stripped
from wrackline.operators.sequences import PART, following, preceding, running
from wrackline.session import cut

_WORD = re.compile(P.WORD)


def candidates(editions: DataFrame, separator: str = r"\n\s*\n", plain: bool = True) -> DataFrame:
    """`source, idx, text, explicit`: non-empty blocks of `source, text` in reading order."""
    raw = editions.select("source", F.posexplode(F.split("text", separator, -1)).alias("idx", "raw")).withColumn("raw", stripped(F.col("raw"))).where("raw <> ''")
    title = F.regexp_extract("raw", r"^##\s+([^\n]+)\z", 1)
    text = F.when(title != "", title).otherwise(F.col("raw"))
    return raw.select("source", "idx", (normalised(text) if plain else text).alias("text"), (title != "").alias("explicit")).where("text <> ''")


def blocks(cands: DataFrame, least: int = 8) -> DataFrame:
    """`source, idx, text, is_heading`: headings and prose; furniture, captions and the rest are gone."""
    marked = cands.withColumn("drop", K.is_noise(F.col("text")) | K.is_caption(F.col("text")))
    marked = following(marked, "source", "idx", F.when(~F.col("drop"), F.col("text")), "following")
    text = F.col("text")
    heading = F.col("explicit") | K.is_plain_heading(text, F.col("following"))
    kind = F.when(F.col("drop"), None).when(heading, F.when(K.is_useful_heading(text), "heading")).when(~K.is_byline(text) & K.is_prose(text, least), "prose")
    return marked.withColumn("kind", kind).where("kind is not null").select("source", "idx", "text", (F.col("kind") == "heading").alias("is_heading"))


def articles(found: DataFrame) -> DataFrame:
    """Blocks with `article`: a heading after prose begins a new one; articles without prose are dropped."""
    # looked at four times from here on
    rows = preceding(cut(found), "source", "idx", "is_heading", "_before")
    begins = (F.col("is_heading") & ~F.coalesce("_before", F.lit(True))).cast("int")
    numbered = running(rows, ["source"], F.floor(F.col("idx") / PART), ["idx"], begins, "_article").withColumn("article", F.col("_article").cast("int")).drop("_before", "_article")
    prose = F.max((~F.col("is_heading")).cast("int")).over(Window.partitionBy("source", "article"))
    return numbered.withColumn("_prose", prose).where("_prose = 1").drop("_prose")


def pieces(text: str, most: int) -> list[str]:
    """A text in parts of at most `most` words, at sentence ends where they allow it."""
    if len(_WORD.findall(text)) <= most:
        return [text]
    units = re.split(P.SENTENCE_END, text)
    if len(units) == 1:
        spans = [m.span() for m in _WORD.finditer(text)]
        return [text[group[0][0] : group[-1][1]] for group in (spans[i : i + most] for i in range(0, len(spans), most))]
    out, held, size = [], [], 0
    for unit in units:
        n = len(_WORD.findall(unit))
        if held and (n > most or size + n > most):
            out.append(" ".join(held))
            held, size = [], 0
        if n > most:
            out += pieces(unit, most)
        else:
            held.append(unit)
            size += n
    return out + [" ".join(held)] * bool(held)


def chunks(found: DataFrame, least: int = 250, most: int = 1000) -> DataFrame:
    """`source, ordinal, content`: articles cut to at most `most` words, legal notices left out.

    `least` bounds `most` and nothing else: short articles stay short.
    """
    if least < 1 or most < least:
        raise ValueError("1 <= least <= most is required")

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held, size, prose, nth = None, [], 0, False, 0
        for part in parts:
            out = []
            for source, article, text, heading in part[["source", "article", "text", "is_heading"]].itertuples(index=False):
                if now != (source, article):
                    if prose:
                        out.append((*now, nth, "\n\n".join(held)))
                    now, held, size, prose, nth = (source, article), [], 0, False, 0
                for piece in [text] if heading else pieces(text, most):
                    n = len(_WORD.findall(piece))
                    if not heading and prose and size + n > most:
                        out.append((*now, nth, "\n\n".join(held)))
                        held, size, prose, nth = [], 0, False, nth + 1
                    held.append(piece)
                    size += n
                    prose = prose or not heading
            yield pd.DataFrame(out, columns=["source", "article", "part", "content"])
        if prose:
            yield pd.DataFrame([(*now, nth, "\n\n".join(held))], columns=["source", "article", "part", "content"])

    # folded along sorted partitions: a chunk at a time is held, and many articles cost one call
    rows = articles(found).select("source", "article", "idx", "text", "is_heading").repartition("source", "article").sortWithinPartitions("source", "article", "idx")
    packed = rows.mapInPandas(fold, "source string, article int, part int, content string")
    packed = cut(packed.where(~K.is_legal_notice(F.col("content"))))
    numbered = running(packed, ["source"], F.floor(F.col("article") / 256), ["article", "part"], F.lit(1), "nth")
    return numbered.select("source", (F.col("nth") - 1).cast("int").alias("ordinal"), "content")
