"""Text as columns: Column -> Column, on the JVM wherever it has the means."""

from __future__ import annotations

import hashlib
import html
import io
import re
import unicodedata
import wave

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, LongType, StringType

from wrackline.functions import patterns as P


def rx(pattern: str) -> str:
    """A pattern for the JVM in which only \\n ends a line, as in other dialects."""
    return "(?d)" + pattern


def matches(text: Column, pattern: str) -> Column:
    return text.rlike(rx(pattern))


def any_of(text: Column, patterns: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | matches(text, p)
    return out


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(P.WORD))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(P.WORD), F.lit(0))


def canonical(text: Column) -> Column:
    """White space collapsed and trimmed, lower case: the key of exact copies."""
    return F.lower(F.trim(F.regexp_replace(text, P.SPACE, " ")))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def eval_choice(digest: Column) -> Column:
    """The first 32 bits of a digest as a number: a reproducible draw."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def sentences(text: Column) -> Column:
    return F.split(text, P.SENTENCE_END, -1)


@pandas_udf(StringType())
def _ascii(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode())


@pandas_udf(StringType())
def _unescaped(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else html.unescape(t) if "&" in t else t)


def normalised(text: Column, prefixes: tuple[tuple[str, str], ...] = P.PREFIXES) -> Column:
    """Entities, signs, accents and white space made plain; continuation marks and promotions dropped.

    `prefixes` (read, printed) put right a misread beginning; the first that fits is used.
    """
    text = _unescaped(text)
    for sign, plain in P.SIGNS:
        text = F.replace(text, F.lit(sign), F.lit(plain))
    text = F.trim(F.regexp_replace(_ascii(text), r"\s+", " "))
    text = F.regexp_replace(F.regexp_replace(text, P.CONTINUED, ""), P.PROMOTION, "")
    fixed = text
    for read, printed in reversed(prefixes):
        fixed = F.when(text.startswith(read), F.concat(F.lit(printed), F.substring(text, len(read) + 1, 2**30))).otherwise(fixed)
    return fixed


def let(value: Column, use) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def simhash_md5(text: Column, shingle: int = 5) -> Column:
    """As `simhash` with the low 64 bits of MD5 for each shingle: all on the JVM, and stated in SQL as well."""
    tokens = words(F.lower(text))
    parts = let(tokens, lambda t: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(t) - (shingle - 1), F.lit(1))), lambda i: F.array_join(F.slice(t, i, shingle), " "))))
    number = lambda p: F.conv(F.substring(F.md5(p), 17, 16), 16, -10).cast("bigint")
    hashes = F.transform(parts, number)
    bit = lambda h, b: F.call_function("shiftright", h, b).bitwiseAND(1)
    vote = lambda hs: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.when(F.size(F.filter(hs, lambda h: bit(h, b) == 1)) * 2 >= F.size(hs), F.call_function("shiftleft", F.lit(1).cast("bigint"), b)).otherwise(F.lit(0).cast("bigint")))
    return let(hashes, lambda hs: F.aggregate(vote(hs), F.lit(0).cast("bigint"), lambda a, x: a.bitwiseOR(x)))


def _votes(text: str | None, shingle: int) -> int | None:
    if text is None:
        return None
    tokens = re.findall(P.WORD, text.casefold())
    parts = {" ".join(tokens[i : i + shingle]) for i in range(max(1, len(tokens) - shingle + 1))}
    raw = b"".join(hashlib.blake2b(p.encode(), digest_size=8).digest() for p in parts)
    bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0)
    return int(np.packbits((2 * bits >= len(parts)).astype(np.uint8)).view(">i8")[0])


def simhash(text: Column, shingle: int = 5) -> Column:
    """64 votes over the distinct shingles of a text, as the BIGINT with those bits; null stays null."""

    @pandas_udf(LongType())
    def run(column: pd.Series) -> pd.Series:
        return pd.Series([_votes(t, shingle) for t in column], dtype="Int64")

    return run(text)


def clean_audio(text: Column) -> Column:
    """A transcript without special tags; music is no text."""
    text = stripped(F.regexp_replace(text, P.AUDIO_TAG, ""))
    return F.when(F.upper(text).startswith("MUSIC"), "").otherwise(text)


def step_of(name: Column) -> Column:
    """The step of a folder named checkpoint-<digits>, else null."""
    return F.when(name.rlike(r"^checkpoint-\d{1,18}$"), F.substring_index(name, "-", -1).cast("bigint"))


def step_done(text: Column) -> Column:
    """n of a progress mark "n/m"."""
    return F.split_part(text, F.lit("/"), F.lit(1)).cast("int")


def watts(raw: Column) -> Column:
    """A power reading; blank and N/A count as none. Text without a number is an error."""
    plain = F.trim(raw)
    number = F.regexp_extract(plain, r"[-+]?\d+(?:\.\d+)?", 0)
    return F.when((plain == "") | (F.upper(plain) == "N/A"), 0.0).when(number != "", number.cast("double")).when(raw.isNotNull(), F.raise_error(F.lit("no number in a power reading")).cast("double"))


def mono(samples: Column) -> Column:
    """Mean over the channels of each frame."""
    return F.transform(samples, lambda frame: F.aggregate(frame, F.lit(0.0), lambda a, b: a + b) / F.size(frame))


def resampled(samples: Column, rate: Column, to: int, most_s: float | None = None) -> Column:
    """Linear interpolation onto max(round(seconds * to), 1) points from the first sample to the last.

    With `most_s`, what comes after as many seconds is left out.
    """

    @pandas_udf(ArrayType(DoubleType()))
    def run(values: pd.Series, rates: pd.Series) -> pd.Series:
        out = []
        for v, r in zip(values, rates):
            if v is None or len(v) == 0 or r == to:
                out.append(v)
                continue
            at = np.linspace(0, len(v) - 1, max(round(len(v) / r * to), 1))
            out.append(np.interp(at, np.arange(len(v)), v))
        return pd.Series(out)

    out = run(samples, rate)
    return out if most_s is None else F.slice(out, 1, int(to * most_s))


def wav(samples: Column, rate: int) -> Column:
    """The bytes of a one-channel 16-bit WAV file of samples in [-1, 1]; null stays null."""

    @pandas_udf(BinaryType())
    def run(values: pd.Series) -> pd.Series:
        out = []
        for v in values:
            if v is None:
                out.append(None)
                continue
            held = io.BytesIO()
            with wave.open(held, "wb") as f:
                f.setnchannels(1), f.setsampwidth(2), f.setframerate(rate)
                f.writeframes(np.rint(np.clip(np.asarray(v, np.float64), -1, 1 - 1 / 32768) * 32768).astype("<i2").tobytes())
            out.append(held.getvalue())
        return pd.Series(out)

    return run(samples)
