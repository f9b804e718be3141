"""What a block of text is: furniture, caption, prose, heading, in or off the domain."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wrackline.functions import patterns as P
from wrackline.functions.text import any_of, matches, word_count, words


def is_noise(text: Column) -> Column:
    return any_of(text, P.NOISE)


def is_caption(text: Column) -> Column:
    return any_of(text, P.CAPTION) | ((word_count(text) <= 45) & matches(text, P.CAPTION_VERB) & ~F.contains(text, F.lit('"')))


def is_corrupt(text: Column) -> Column:
    """At least 12 words, more than 15 % of them of one character."""
    single = F.size(F.filter(words(text), lambda w: F.length(w) == 1))
    return (word_count(text) >= 12) & (single * 100 > word_count(text) * 15)


def is_prose(text: Column, least: int = 8) -> Column:
    return (word_count(text) >= least) & text.rlike("[a-z]{3}") & ~is_corrupt(text)


def is_byline(text: Column) -> Column:
    return matches(text, P.BYLINE)


def is_useful_heading(text: Column) -> Column:
    return ~is_byline(text) & ~matches(text, P.FIXTURE) & word_count(text).between(1, 24)


def is_plain_heading(text: Column, following: Column) -> Column:
    """A headline by its looks, before prose."""
    n = word_count(text)
    capital = F.size(F.filter(words(text), lambda w: F.substring(w, 1, 1).rlike("[A-Z]")))
    shouted = F.exists(words(text), lambda w: (F.length(w) > 1) & w.rlike("[A-Z]") & ~w.rlike("[a-z]"))
    all_upper = text.rlike("[A-Z]") & ~text.rlike("[a-z]")
    looks = n.between(1, 14) & (F.length(text) <= 160) & ~text.rlike(r"[.?!;:]\z") & ~text.rlike("^[\"'(]")
    fits = ~is_noise(text) & ~is_caption(text) & is_useful_heading(text)
    return F.coalesce(following.isNotNull() & (following != "") & looks & fits & is_prose(following, 12) & (all_upper | shouted | (capital * 4 >= n)), F.lit(False))


def is_legal_notice(text: Column) -> Column:
    return any_of(F.substring(text, 1, 500), P.LEGAL)


def is_off_domain(text: Column, local: str = P.LOCAL_TERMS, foreign: str = P.FOREIGN_TERMS) -> Column:
    return ~matches(text, local) & matches(text, foreign)
