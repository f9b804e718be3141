"""Text of scanned pages: what is damaged, and the text repaired.

Words are counted over all blocks. Those in enough of them are frequent; skip-gram vectors are
learned for them. A word that isn't frequent is linked to the frequent words that plausible
glyph edits lead to (letters that scanners take for one another, marks read into a word, a
space read into it); with several, the one nearest in meaning to the words around it is meant.
Rare names have no frequent form: there an edit is believed if it turns an unusual sequence of
letters into a usual one, by the trigrams of all rare words.

Running headers, page numbers and words cut at line or block ends are recognised first; then
blocks are put right and reflowed into paragraphs and headings, edition by edition. An edition
is worked on in chunks of blocks, so a bound volume with a third of all rows is many tasks. What
a chunk has to know of the others is the running text before it and after it, wherever that
stands: found by a row for each chunk, not by looking a fixed number of blocks ahead.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wrackline.session import cut

#: Blocks of a chunk: it bounds a task's rows, no result depends on it.
CHUNK = 1024
#: Least cosine of a word with the words around it for which an unsure edit to a less frequent word is believed.
FIT = 0.6
#: Share of the headers with one word beside name and date that a section has; how many times as frequent the section is that a word was misread from.
SECTION, FAR = 1e-3, 20
#: Glyphs as read -> as they may have been printed.
GLYPHS = {
    "rn": ["m"], "m": ["rn"], "cl": ["d"], "d": ["cl"], "li": ["h"], "h": ["li", "b"], "b": ["h"], "vv": ["w"], "w": ["vv"], "ii": ["u", "n"], "u": ["n", "ii"], "n": ["u", "ri", "ii"], "ri": ["n"],
    "c": ["e", "o"], "e": ["c", "o"], "o": ["c", "e", "a"], "a": ["o"], "i": ["l", "t", "j"], "l": ["i", "t"], "t": ["l", "f", "i"], "f": ["t", "s"], "s": ["f"], "j": ["i"], "g": ["q", "y"], "q": ["g"], "y": ["v", "g"], "v": ["y"],
    "in": ["m"], "ni": ["m"], "tn": ["m"], "fi": ["h"], "nn": ["m"], "ln": ["h"], "iii": ["m"], "k": ["h"], "x": ["z"], "z": ["x"], "p": ["b"], "r": ["t"],
    "0": ["o"], "1": ["l", "i"], "3": ["e"], "4": ["a"], "5": ["s"], "6": ["b", "o"], "7": ["t"], "8": ["b"], "9": ["g", "q"], "2": ["z"], "@": ["a"], "$": ["s"], "!": ["i", "l"], "|": ["l", "i"], "†": ["t"], "€": ["e"], "£": ["e"], "(": ["c"], "¢": ["c"], "}": [""], "{": [""], "*": [""], "~": [""], "^": [""], "_": [""], "•": [""], "¦": ["", "i"], "°": [""], "#": [""], "ﬁ": ["fi"], "ﬂ": ["fl"],
}
#: Those that are believed in names, too, where no frequent word speaks for them.
SURE = {"c": ["e"], "b": ["h"], "cl": ["d"], "ri": ["n"], "rn": ["m"], "m": ["rn"], "vv": ["w"], "v": ["y"], "ii": ["u"], "li": ["h"]}
#: Words of dates and page numbers.
DAYS = frozenset({"monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"})
MONTHS = frozenset({"january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december", "jan", "feb", "mar", "apr", "jun", "jul", "aug", "sep", "sept", "oct", "nov", "dec"})
COUNTS = frozenset({"one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen", "twenty"})
PAGE = {"page", "p", "pg", "pp"}

_DIGIT = "0-9IlOoSQ!|ZBi"
_NUMBER = re.compile(rf"[\[(-]*(?:[{_DIGIT}]{{1,4}})[\]).,-]*")
_PLAIN_PAGE = re.compile(rf"\s*(?:[-–—\[(]\s*)?(?:(?:p[gp]?|page)\b\.?\s*)?(?:([{_DIGIT}]{{1,4}})(?:\s*(?:/|of)\s*([{_DIGIT}]{{1,4}}))?)\s*[-–—\]).]*\s*", re.I)
_WORD_PAGE = re.compile(r"\s*page\s+([a-z]+)\s*", re.I)
_DATE = re.compile(rf"[{_DIGIT}]{{1,2}}[./-][{_DIGIT}]{{1,2}}[./-][{_DIGIT}]{{2,4}}[.,]?")
_CUT = "-¬­‐"
_LINE_CUT = re.compile(rf"([^\W\d_]+(?:['’][^\W\d_]+)?)[{_CUT}][ \t]*\r?\n[ \t]*([^\W\d_]+)")
_LOST_CUT = re.compile(rf"([^\W\d_]+)(?:- +|[¬­‐][ \t]*)([^\W\d_]+)")
_END_CUT = re.compile(rf"([^\W\d_]+)[{_CUT}]\s*$")
_COMPOUND = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)+")
_POSSESSIVE = re.compile(r"['’]s?$")
_STRIP = ".,;:!?\"'()[]“”‘’«»—–-…"
_ODD = re.compile(r"[}{†‡§|@*~^_<>\\=#•¢€£°¦¬ﬁﬂ]")
_MIXED_FINE = re.compile(r"\$?[\d.,:/-]+(?:st|nd|rd|th|s|am|pm|m|km|kg|ft|lb|[A-H])?|[A-H]\d+")


def bare(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))


def tokens(text: str) -> list[str]:
    return [w for t in text.split() if (w := t.strip(_STRIP))]


@lru_cache(500_000)
def parts_of(word: str) -> list[str]:
    """A token's words for counting: compound parts apart, possessives without their end, lower case."""
    return [_POSSESSIVE.sub("", p) for p in word.lower().split("-") if p]


def edits(word: str, glyphs: dict[str, list[str]] = GLYPHS) -> Iterator[str]:
    """The bare form, and forms one plausible glyph edit away."""
    plain = bare(word)
    if plain != word:
        yield plain
    for i in range(len(word)):
        for n in (1, 2, 3):
            for good in glyphs.get(word[i : i + n], ()) if i + n <= len(word) else ():
                yield word[:i] + good + word[i + n :]


class Lexicon:
    """Frequent words, compounds, trigrams of rare words, sections of headers, vectors."""

    def __init__(self, frequent: dict[str, int], compounds: dict[str, int], trigrams: dict[str, int], sections: set[str], vectors: dict[str, np.ndarray] | None = None):
        self.frequent, self.compounds, self.trigrams, self.sections, self.vectors = frequent, compounds, trigrams, frozenset(sections), vectors or {}
        self.floor = min(frequent.values(), default=1)
        self.links: dict[str, list[str]] = {}
        self.plain_tokens: dict[str, bool] = {}
        #: Frequent words that are one glyph edit from a far more frequent one: themselves misread, often.
        self.doubtful = {w for w, n in frequent.items() if len(w) > 2 and any(frequent.get(e, 0) > 200 * n for e in edits(w))}

    def likelier(self, word: str, other: str) -> tuple[float, int]:
        """How many times the rarest trigram that only `other` has is as frequent as that only `word` has, and its count."""
        a, b = ({w[i : i + 3] for i in range(len(w) - 2)} for w in (f"^{word}$", f"^{other}$"))
        ours = min((self.trigrams.get(t, 0) for t in a - b), default=0)
        theirs = min((self.trigrams.get(t, 0) for t in b - a), default=0)
        return theirs / (ours + 1), theirs

    def known(self, word: str) -> bool:
        return word in self.frequent

    def whole(self, token: str) -> bool:
        """Whether all parts of a token are frequent."""
        return all(p in self.frequent for p in parts_of(token))

    def plain(self, token: str) -> bool:
        """Whether a token is as printed beyond doubt: frequent words without odd signs or digits in it."""
        if (out := self.plain_tokens.get(token)) is None:
            if len(self.plain_tokens) > 500_000:
                self.plain_tokens.clear()
            raw = token.strip(_STRIP)
            letters = all(c.isalpha() or c in "-'’" for c in raw)
            out = bool(raw) and letters and (len(raw) > 1 or raw in "aI") and not _ODD.search(raw) and all(p in self.frequent and p not in self.doubtful for p in parts_of(raw))
            self.plain_tokens[token] = out
        return out

    def fitting(self, word: str, near: list[np.ndarray]) -> str | None:
        """Of the frequent words one edit away, however rare among these, the one that is near in meaning to the words around."""
        if not near or not word.isalpha() or len(word) < 4:
            return None
        mean = np.mean(near, axis=0)
        mean = mean / (np.linalg.norm(mean) + 1e-9)
        fit = {e: float(self.vectors[e] @ mean) for e in edits(word) if len(e) > 2 and e in self.vectors and e in self.frequent}
        best = max(fit, key=lambda e: (fit[e], e), default=None)
        return best if best is not None and fit[best] >= FIT else None

    def linked(self, word: str) -> list[str]:
        """Frequent words, or for a name the likelier spelling, that a rare word may be a misreading of."""
        if (out := self.links.get(word)) is None:
            if len(self.links) > 200_000:
                self.links.clear()
            # an edit that isn't sure must lead to a word well above the least frequent: two names may differ by it
            sure = set(edits(word, SURE)) if word.isalpha() else ()
            found = dict.fromkeys(e for e in edits(word) if len(e) > 2 and self.frequent.get(e, 0) >= (8 * self.floor if word.isalpha() and e not in sure else 1))
            if not found and len(word) > 4:
                # two edits: of marks and digits any, of letters only those that are sure
                glyphs = GLYPHS if not word.isalpha() or bare(word) != word else SURE
                if glyphs is GLYPHS or len(word) > 6:
                    found = dict.fromkeys(f for e in edits(word, glyphs) for f in edits(e, glyphs) if f in self.frequent and len(f) > 4)
            if not found and len(word) > 3:
                better = [(*self.likelier(word, e), e) for e in edits(word, SURE) if e.isalpha() and e.isascii()]
                if better and (best := max(better))[0] >= 6 and best[1] >= 10:
                    found = {best[2]: None}
            out = self.links[word] = list(found)
        return out

    def meant(self, word: str, around: list[str]) -> str | None:
        """The linked word nearest in meaning to the words around it; the most frequent without vectors."""
        options = self.linked(word)
        near = [self.vectors[a] for a in around if a in self.vectors] if len(options) != 1 else []
        if not options:
            return self.fitting(word, near)
        if near and len(options) > 1:
            mean = np.mean(near, axis=0)
            fit = {o: float(self.vectors[o] @ mean) if o in self.vectors else -1.0 for o in options}
            return max(options, key=lambda o: (fit[o], self.frequent.get(o, 0)))
        return max(options, key=lambda o: self.frequent.get(o, 0))


def header_of(text: str, paper: str, sections: frozenset[str]) -> tuple[int, bool]:
    """Length of the running header that a block begins with (0: none), and whether it has a page number."""
    names = paper.split()
    if not names:
        return 0, False
    first, sections = text.lstrip(), frozenset(sections)
    skip = len(text) - len(first)
    found = _Lazy(_header_tokens(first, _known(paper, sections)))
    end = at = 0
    name = day = section = page = False
    numbers = months = 0
    while found.has(at):
        raw, stop = found[at]
        word = raw.strip(_STRIP).lower()
        if not name and _like([t.strip(_STRIP).lower() for t, _ in found.some(at, at + len(names))], names):
            name, at = True, at + len(names)
            end = found[at - 1][1]
            continue
        if not name and word == "the" and _like([t.strip(_STRIP).lower() for t, _ in found.some(at + 1, at + 1 + len(names))], names):
            at += 1
            continue
        if not word or word == "|":
            pass
        elif word in DAYS or len(word) > 4 and _near(word, DAYS):
            day = True
        elif word in MONTHS or len(word) > 2 and _near(word, MONTHS):
            months += 1
        elif _DATE.fullmatch(raw.strip(",")):
            day = True
        elif word in PAGE:
            page = True
        elif word in COUNTS and page:
            numbers += 1
        elif _NUMBER.fullmatch(raw.strip(",")) and (any(c.isdigit() for c in raw) or len(word) <= 2):
            numbers += 1
        elif word in sections or len(word) > 3 and _near(word, sections):
            if section and name:
                break
            section = True
        else:
            break
        end = stop
        at += 1
        if name and "\n" in first[end : found[at][1] - len(found[at][0]) if found.has(at) else end]:
            break
    if not name or not (day or months or section or page or (numbers and end >= len(first.rstrip()))):
        return (len(text), False) if name and end >= len(first.rstrip()) else (0, False)
    return skip + end, page or numbers > (2 if months else 0)


def _header_tokens(text: str, known: frozenset[str]) -> Iterator[tuple[str, int]]:
    """The words of a text and where they end; words read with spaces in them are joined."""
    words = re.finditer(r"\S+", text)
    ahead: list[tuple[str, int]] = []

    def more(n: int) -> bool:
        while len(ahead) <= n and (m := next(words, None)):
            ahead.append((m.group(), m.end()))
        return len(ahead) > n

    while more(0):
        run = 0
        while more(run) and len(ahead[run][0]) == 1 and ahead[run][0].isalpha():
            run += 1
        if run >= 3:
            yield "".join(t for t, _ in ahead[:run]), ahead[run - 1][1]
            del ahead[:run]
        elif run and more(1) and (ahead[0][0] + ahead[1][0]).strip(_STRIP).lower() in known:
            yield ahead[0][0] + ahead[1][0], ahead[1][1]
            del ahead[:2]
        else:
            yield ahead.pop(0)


class _Lazy:
    """A sequence over an iterator, read as far as it is asked for."""

    def __init__(self, items: Iterator):
        self.items, self.held = items, []

    def has(self, n: int) -> bool:
        while len(self.held) <= n and (x := next(self.items, None)) is not None:
            self.held.append(x)
        return len(self.held) > n

    def __getitem__(self, n: int):
        return self.held[n] if self.has(n) else None

    def some(self, a: int, b: int) -> list:
        self.has(b - 1)
        return self.held[a:b]


@lru_cache(100_000)
def _known(paper: str, sections: frozenset[str]) -> frozenset[str]:
    return frozenset({*paper.split(), *DAYS, *MONTHS, *sections})


@lru_cache(200_000)
def _near(word: str, words: frozenset[str]) -> bool:
    return word not in words and any(e in words for e in edits(word))


def _like(read: list[str], names: list[str]) -> bool:
    if len(read) != len(names):
        return False
    wrong = sum(a != b for a, b in zip(read, names))
    return not wrong or wrong <= max(1, len(names) // 2) and all(a == b or _alike(a, b) for a, b in zip(read, names))


@lru_cache(200_000)
def _alike(a: str, b: str) -> bool:
    if bare(a) == b or b in edits(a):
        return True
    return abs(len(a) - len(b)) <= 1 and len(b) > 3 and any(b in edits(e) for e in edits(a))


def page_number(text: str) -> str | None:
    """The number of a block that is nothing but a page number, as read."""
    m = _PLAIN_PAGE.fullmatch(text)
    if m and (any(c.isdigit() for c in m[1]) or len(m[1]) <= 3 and m[1] not in ("o", "i", "B")):
        return m[0].strip()
    m = _WORD_PAGE.fullmatch(text)
    return m[0].strip() if m and (m[1].lower() in COUNTS or _near(m[1].lower(), COUNTS)) else None


def cut_words(text: str, following: str | None, lex: Lexicon) -> list[tuple[int, int, str]]:
    """(start, end, whole) of words cut at line ends or, with `following`, at the block's end."""
    out = []

    def is_cut(left: str, right: str, soft: bool) -> bool:
        a, b = left.lower(), right.lower()
        compound = lex.compounds.get(f"{a}-{b}", 0)
        return soft or compound <= lex.frequent.get(a + b, 0) or not compound

    soft_sign = any(c in text for c in _CUT[1:])
    for pattern in (_LINE_CUT, _LOST_CUT):
        if not soft_sign and (("- " if pattern is _LOST_CUT else "-") not in text or pattern is _LINE_CUT and "\n" not in text):
            continue
        for m in pattern.finditer(text):
            soft = any(c in m[0] for c in "¬­‐")
            if pattern is _LOST_CUT and not soft and (m[1].lower() + m[2].lower() not in lex.frequent and lex.known(m[1].lower()) and lex.known(m[2].lower())):
                continue
            if not any(s < m.end() and m.start() < e for s, e, _ in out) and is_cut(m[1], m[2], soft):
                out.append((m.start(), m.end(), m[1] + m[2]))
    if m := _END_CUT.search(text):
        after = re.match(r"\s*([^\W\d_]+)", following or "")
        soft = any(c in m[0] for c in "¬­‐")
        if (not after and (soft or not lex.known(m[1].lower()))) or (after and is_cut(m[1], after[1], soft)):
            out.append((m.start(), m.end(), m[1] + (after[1] if after else "")))
    return sorted(out)


def misread(text: str, lex: Lexicon) -> list[tuple[str, str | None]]:
    """Misread tokens of a text without furniture and cuts, and what was meant (None: not known)."""
    words = text.split()
    low = [w.strip(_STRIP).lower() for w in words]
    out: list[tuple[str, str | None]] = []
    i = 0
    while i < len(words):
        if lex.plain(words[i]) and (i + 1 == len(words) or lex.plain(words[i + 1])):
            i += 1
            continue
        w, raw = low[i], words[i].strip(_STRIP)
        if not w:
            if any(c in _ODD.findall(words[i]) for c in words[i]):
                out.append((words[i], None))
            i += 1
            continue
        run = i
        while run < len(words) and len(low[run]) == 1 and low[run].isalpha() and words[run].strip("\"'“") == low[run]:
            run += 1
        if run - i >= 3:
            out.append((" ".join(words[i:run]), "".join(low[i:run])))
            i = run
            continue
        around = low[max(0, i - 4) : i] + low[i + 1 : i + 5]
        if i + 1 < len(words) and low[i + 1] and words[i][-1].isalpha() and words[i + 1][0].isalpha():
            b = _POSSESSIVE.sub("", low[i + 1])
            whole = w + b
            first = lex.whole(w) and (len(w) > 1 or w in ("a", "i"))
            if lex.whole(whole) and not (first and lex.whole(b)):
                out.append((words[i] + " " + words[i + 1], whole))
                i += 2
                continue
            if len(w) == 1 and w.isalpha() and w not in "ai" and len(words[i]) == 1 and not lex.whole(b) and words[i + 1][0].islower():
                out.append((words[i] + " " + words[i + 1], whole))
                i += 2
                continue
        if _ODD.search(raw):
            out.append((raw, lex.meant(_POSSESSIVE.sub("", w), around)))
        elif any(c.isdigit() for c in w):
            if any(c.isalpha() for c in w) and not _MIXED_FINE.fullmatch(raw) or "!" in w:
                out.append((raw, lex.meant(w, around)))
        elif re.fullmatch(rf"[$]?[\d,.]*[IlOSQ!]+[\d,.]*", raw) and (raw[0] == "$" or any(c.isdigit() for c in raw)):
            out.append((raw, None))
        elif "!" in w or ("$" in w and not w.startswith("$")):
            out.append((raw, lex.meant(w, around)))
        else:
            for p in parts_of(raw):
                if p and not lex.known(p) and (len(p) > 2 or bare(p) != p) and (meant := lex.meant(p, around)) is not None:
                    out.append((p, meant))
                elif p in lex.doubtful:
                    out.append((p, lex.meant(p, around)))
        i += 1
    return out


def _paper(source: str | None) -> str:
    return re.sub(r"^the\s+", "", (source or "").split("_")[0].replace("-", " ").lower())


def lexicon(blocks: DataFrame, part: float = 2e-4, least: int = 5, vectors: bool = True) -> Lexicon:
    """Counts over all blocks (`source, idx, text`), reduced to tables of bounded size.

    A word is frequent if it stands in at least `part` of the blocks, `least` at least: there are
    at most (words of a block) / part of them. A section is the one word beside name and date of
    at least SECTION of the headers, `least` at least: there are at most 1 / SECTION of them.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n: dict[tuple[str, str], int] = {}
            for source, text in zip(batch.column("source").to_pylist(), batch.column("text").to_pylist()):
                flat = _LINE_CUT.sub(" ", text)
                seen = {("w", p) for t in tokens(flat) for p in parts_of(t) if p} | {("c", c.lower()) for c in _COMPOUND.findall(flat)}
                line = text.strip().split("\n")[0].lower()
                name = _paper(source)
                if name and name in line and len(line) < len(name) + 24:
                    rest = [w for t in tokens(line.replace(name, " ")) if any(c.isalpha() for c in t) and (w := t.strip("|" + _STRIP)) not in DAYS | MONTHS | PAGE | COUNTS | {"the"}]
                    if len(rest) == 1 and rest[0].isalpha():
                        seen.add(("s", rest[0]))
                for k in seen:
                    n[k] = n.get(k, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in n]), pa.array([w for _, w in n]), pa.array(list(n.values()), pa.int64())], names=["kind", "word", "n"])

    known = blocks.where("text is not null").select("source", "text")
    counts = cut(known.mapInArrow(count, "kind string, word string, n bigint").groupBy("kind", "word").agg(F.sum("n").alias("n")))
    total = known.count()
    floor = max(least, part * total)
    frequent = counts.where((F.col("kind") == "w") & (F.col("n") >= floor)).select("word", "n").toPandas()
    compounds = counts.where((F.col("kind") == "c") & (F.col("n") >= max(2, floor / 8))).select("word", "n").toPandas()
    headers = counts.where("kind = 's'").agg(F.sum("n")).first()[0] or 0
    named = counts.where((F.col("kind") == "s") & (F.col("n") >= max(least, SECTION * headers))).select("word", "n").toPandas()
    rare = counts.where((F.col("kind") == "w") & (F.col("n") < floor) & F.col("word").rlike("^[a-z]{4,24}$"))
    spelt = F.concat(F.lit("^"), F.col("word"), F.lit("$"))
    grams = rare.select(F.explode(F.transform(F.sequence(F.lit(1), F.length(spelt) - 2), lambda i: F.substring(spelt, i, F.lit(3)))).alias("gram"))
    trigrams = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).toPandas()  # at most 28 ** 3 rows
    words = dict(zip(frequent["word"], frequent["n"].astype(int)))
    learned = skip_grams(known, sorted(words)) if vectors and words else {}
    return Lexicon(words, dict(zip(compounds["word"], compounds["n"].astype(int))), dict(zip(trigrams["gram"], trigrams["n"].astype(int))), _sections(dict(zip(named["word"], named["n"].astype(int)))), learned)


def _sections(named: dict[str, int]) -> set[str]:
    """The words of headers without those that are misread: one glyph edit from a far more frequent one, a day or a month."""
    return {w for w, n in named.items() if not any(e in DAYS or e in MONTHS or named.get(e, 0) > FAR * n for e in edits(w))}


def skip_grams(blocks: DataFrame, words: list[str], size: int = 24, seed: int = 7) -> dict[str, np.ndarray]:
    """Unit skip-gram vectors of the (frequent, so bounded) words, learned over all blocks."""
    from pyspark.ml.feature import Word2Vec

    known = blocks.select(F.split(F.lower(F.regexp_replace("text", r"[^\p{L}\s]+", " ")), r"\s+").alias("words"))
    model = Word2Vec(vectorSize=size, minCount=20, windowSize=4, maxIter=1, numPartitions=max(1, min(64, blocks.rdd.getNumPartitions())), seed=seed, inputCol="words", outputCol="v").fit(known)
    wanted = blocks.sparkSession.createDataFrame([(w,) for w in words], "word string")
    rows = model.getVectors().join(wanted, "word", "left_semi").collect()
    return {r["word"]: (v := r["vector"].toArray().astype(np.float32)) / (np.linalg.norm(v) + 1e-9) for r in rows}


def _marked(df: DataFrame, lex) -> DataFrame:
    """Each block once (its latest scan) with its chunk, `length` and `numbered` of its header, `page` and its running `body`."""
    order = Window.partitionBy("source", "idx").orderBy(F.col("scanned_at").desc_nulls_last(), F.col("text").desc_nulls_last(), F.col("is_heading").desc_nulls_last())
    once = df.where("idx is not null").withColumn("_nth", F.row_number().over(order)).where("_nth = 1").select("source", F.col("idx").cast("int").alias("idx"), "text", "is_heading")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for source, text in zip(batch.column("source").to_pylist(), batch.column("text").to_pylist()):
                text = text or ""
                length, numbered, page = (0, False, True) if page_number(text) is not None else (*header_of(text, _paper(source), lex.value.sections), False)
                body = None if page else text[length:]
                out.append((length, numbered, page, body if body and not body.isspace() else None))
            kinds = (pa.int32(), pa.bool_(), pa.bool_(), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([o[c] for o in out], k) for c, k in enumerate(kinds))], names=[*batch.schema.names, "length", "numbered", "page", "body"])

    rows = once.mapInArrow(mark, "source string, idx int, text string, is_heading boolean, length int, numbered boolean, page boolean, body string")
    return rows.withColumn("chunk", F.floor(F.col("idx") / CHUNK))


def _chunks(df: DataFrame, lex) -> DataFrame:
    """The marked blocks (`role` 0) and, in each chunk, the running block before (-1) and after it (1), wherever they stand."""
    marked = cut(_marked(df, lex))
    running = F.col("body").isNotNull()
    block = F.struct("idx", "is_heading", "body")
    ends = marked.groupBy("source", "chunk").agg(F.min_by(block, F.when(running, F.col("idx"))).alias("first"), F.max_by(block, F.when(running, F.col("idx"))).alias("last"))
    # a row for each chunk; both windows run from the far end, so each row is added once
    up, down = (Window.partitionBy("source").orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.asc("chunk"), F.desc("chunk")))
    sides = ends.select("source", "chunk", F.last("last", True).over(up).alias("before"), F.last("first", True).over(down).alias("after"))
    columns = ["source", "chunk", "role", "idx", "text", "is_heading", "length", "numbered", "page", "body"]
    none = [F.lit(None).cast("string").alias("text"), F.lit(0).alias("length"), F.lit(False).alias("numbered"), F.lit(False).alias("page")]
    side = lambda name, role: sides.where(F.col(name).isNotNull()).select("source", "chunk", F.lit(role).alias("role"), f"{name}.*", *none).select(*columns)
    return marked.withColumn("role", F.lit(0)).select(*columns).unionByName(side("before", -1)).unionByName(side("after", 1))


def damage(df: DataFrame, lex: Lexicon) -> DataFrame:
    """`source, idx, kind`: damaged blocks, a row for each kind (hyphen, ocr, header, page_number).

    Each (source, idx) once, its latest scan; null and blank texts have no damage, rows with a
    null idx are left out, a null source is an edition of its own.
    """
    shared = df.sparkSession.sparkContext.broadcast(lex)

    def find(part: pd.DataFrame) -> pd.DataFrame:
        lex_, out = shared.value, []
        part = part.sort_values(["role", "idx"], kind="stable", ascending=False)
        source, follow = part["source"].iloc[0], None
        for role, idx, text, length, numbered, page, body in part[["role", "idx", "text", "length", "numbered", "page", "body"]].itertuples(index=False):
            if role == 0:
                text, kinds = text or "", []
                if page:
                    kinds.append("page_number")
                    if not re.search(r"\d", text) and not _WORD_PAGE.fullmatch(text) or re.search(r"[IlOSQ!|Z]\d|\d[IlOSQ!|Z]|[/\s][IlSQ!]+\s*$", text):
                        kinds.append("ocr")
                else:
                    if length:
                        kinds.append("header")
                        if numbered:
                            kinds.append("page_number")
                    rest = text[length:]
                    cuts = cut_words(rest, follow, lex_)
                    if cuts:
                        kinds.append("hyphen")
                    if misread(_joined(rest, cuts), lex_) or length and _header_misread(text[:length], _paper(source), lex_):
                        kinds.append("ocr")
                out += [(source, idx, k) for k in kinds]
            follow = body or follow
        return pd.DataFrame(out, columns=["source", "idx", "kind"])

    return _chunks(df, shared).groupBy("source", "chunk").applyInPandas(find, "source string, idx int, kind string")


def _header_misread(header: str, paper: str, lex: Lexicon) -> bool:
    fine = {*paper.split(), "the", *DAYS, *MONTHS, *PAGE, *COUNTS, *lex.sections}
    return any(w.strip(_STRIP + "|").lower() not in fine and not re.fullmatch(r"[\d.,/|\[\]()-]*", w) for w in header.split())


def _joined(text: str, cuts: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for start, end, whole in cuts:
        out += [text[at:start], whole]
        at = end
    return "".join(out) + text[at:]


def repaired(df: DataFrame, lex: Lexicon) -> DataFrame:
    """`source, idx, text, is_heading`: continuous paragraphs and headings, by edition and reading order.

    Headers and page numbers are gone, cut words whole again, misread words put right, lines
    joined; a paragraph that goes on beyond a page's end stands whole at its first block, also
    over any number of chunks. A block counts as a heading if it is marked so and does not end a
    sentence, or isn't marked but is short and has the capitals of one.
    """
    shared = df.sparkSession.sparkContext.broadcast(lex)

    def state(text: str, heading, follow: str | None, lex_: Lexicon) -> tuple[list, bool, bool, bool]:
        """Cuts of a running block, whether its last word goes on in the next, whether it is a heading, whether the next block goes on with it."""
        cuts = cut_words(text, follow, lex_)
        taken = bool(_END_CUT.search(text) and cuts and cuts[-1][1] >= len(text.rstrip()))
        whole = " ".join(_joined(text, cuts).split())
        capital = [w for w in whole.split() if w[:1].isalpha()]
        looks = len(whole) < 110 and bool(capital) and whole[-1:] not in ".!?\"" and sum(w[0].isupper() for w in capital) >= 0.6 * len(capital)
        head = (heading is True or heading is np.True_) and whole[-1:] not in ".!?" or looks
        goes = taken or not head and bool(whole) and whole[-1] not in ".!?\"”'’:" and len(whole.split()) > 6
        return cuts, taken, head, goes

    def fix(part: pd.DataFrame) -> pd.DataFrame:
        lex_, out = shared.value, []
        part = part[part["body"].notna()].sort_values(["role", "idx"], kind="stable")
        rows = [(int(r), int(i), h, b.strip()) for r, i, h, b in part[["role", "idx", "is_heading", "body"]].itertuples(index=False)]
        source, chunk = (part["source"].iloc[0], int(part["chunk"].iloc[0])) if rows else (None, 0)
        open_ = taken_before = False
        for n, (role, idx, heading, text) in enumerate(rows):
            cuts, taken, head, goes = state(text, heading, rows[n + 1][3] if n + 1 < len(rows) else None, lex_)
            if role == 0:
                whole = _joined(text, cuts)
                if taken_before:
                    whole = re.sub(r"^\s*[^\W\d_]+", "", whole)
                for wrong, right in misread(whole, lex_):
                    if right:
                        shown = right.upper() if wrong.isupper() else right.capitalize() if wrong[:1].isupper() else right
                        whole = re.sub(re.escape(wrong).replace(r"\ ", r"\s+"), lambda _: shown, whole, count=1, flags=re.I if wrong.islower() else 0)
                whole = re.sub(r"\s+", " ", whole).strip()
                joins = open_ and not head
                if joins:
                    whole = whole if whole[:1] in ".,;:!?'’" else " " + whole if whole else ""
                if joins and out:
                    out[-1][3] += whole
                else:
                    out.append([source, chunk, idx, whole, head, joins, False])
            open_, taken_before = goes, taken
        if out:
            out[-1][6] = True
        return pd.DataFrame(out, columns=["source", "chunk", "idx", "text", "is_heading", "joins", "last"])

    found = cut(_chunks(df, shared).groupBy("source", "chunk").applyInPandas(fix, "source string, chunk bigint, idx int, text string, is_heading boolean, joins boolean, last boolean"))
    # paragraphs at the ends of chunks are put together: two rows a chunk at most
    order = Window.partitionBy("source").orderBy("idx")
    edges = found.where("joins or last").withColumn("paragraph", F.sum((~F.col("joins")).cast("int")).over(order))
    held = F.array_sort(F.collect_list(F.struct("idx", "text", "is_heading")))
    whole = edges.groupBy("source", "paragraph").agg(held.alias("held")).select("source", F.get("held", 0)["idx"].alias("idx"), F.ltrim(F.array_join(F.transform("held", lambda x: x["text"]), "")).alias("text"), F.get("held", 0)["is_heading"].alias("is_heading"))
    return found.where("not joins and not last").select("source", "idx", "text", "is_heading").unionByName(whole).where("text <> ''")
