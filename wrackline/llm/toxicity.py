"""Abusive, hateful or sexually explicit passages by their nearest labelled examples.

Labelled documents (a bounded sample) are cut into sentences; each is an example. A sentence
of the collection is compared with the examples by the exact cosine of TF-IDF vectors of its
words and word pairs, over an inverted index whose postings are held in blocks with the
greatest weight of each: lists are added in the order of what they can still give, and
examples whose blocks can't reach the best found so far are left out. The nearest examples
vote, by the fourth power of their cosines; a document's score is that of its worst sentence.

Labels are given to documents, so the harmless sentences of a labelled document carry its
label, too. They are found by the same vote, each example judged by those of other documents,
and lose the label. The map from votes to scores is a monotone fit on the same leave-one-out
votes. Inverse document frequencies are counted over the sentences of all documents.
"""

from __future__ import annotations

import pickle
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_HIDDEN = re.compile("[­​-‏⁠﻿]")
_END = re.compile(r"(?<=[.!?])[\"'”’)\]]*\s+|[\r\n]+")
_SPELT = re.compile(r"\b(?:[^\W\d_][-.*_]){2,}[^\W\d_]\b")
_JOINT = re.compile(r"[^\W\d_][-.*_][^\W\d_][-.*_]")
_TOKEN = re.compile(r"[a-z0-9@$]+")
_RUN = re.compile(r"(.)\1+")
_LEET = str.maketrans("013457@$", "oieastas")
#: Letters that only look like the Latin ones. Fixed values.
_ALIKE = str.maketrans("аеорсухіј", "aeopcyxij")


#: Votes from here on count as found; harmless sentences have votes near 0.
CUT = 0.4


def sentences(text: str | None) -> list[str]:
    return [s for s in _END.split(text) if s and not s.isspace()] if text else []


@lru_cache(200_000)
def _meant(word: str) -> str:
    if not word.isalpha() and any("a" <= c <= "z" for c in word):
        word = word.translate(_LEET)
    elif word.isdigit() or "$" in word or "@" in word:
        word = "0"
    return _RUN.sub(r"\1", word)


def features(sentence: str) -> list[str]:
    """Words as meant (spelt out, stretched or disguised ones restored), then word pairs; distinct."""
    s = _HIDDEN.sub("", sentence).lower()
    if not s.isascii():
        s = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).translate(_ALIKE)
    if _JOINT.search(s):
        s = _SPELT.sub(lambda m: re.sub(r"[-.*_]", "", m[0]), s)
    out = [_meant(w) for w in _TOKEN.findall(s.replace("'", ""))]
    return list(dict.fromkeys(out + [a + " " + b for a, b in zip(["^"] + out, out + ["$"])]))


class Index:
    """Examples as unit vectors, by feature, in blocks."""

    BLOCK = 64
    #: A list of more postings is only looked up for examples that can still be among the nearest.
    LONG = 256

    def __init__(self, units: Units, idf: np.ndarray):
        self.n, self.idf = len(units), idf
        feature, example = units.flat, units.of
        square = np.bincount(example, idf[feature] ** 2, self.n) + units.extra
        weight = (idf[feature] / np.sqrt(np.maximum(square, 1e-12))[example]).astype(np.float32)
        order = np.argsort(feature, kind="stable")
        self.example, self.weight = example[order].astype(np.int32), weight[order]
        self.start = np.searchsorted(feature[order], np.arange(len(idf) + 1))
        self.most = np.zeros(len(idf), np.float32)
        np.maximum.at(self.most, feature, weight)
        self.sizes = np.diff(self.start)
        self.blocks: dict[int, np.ndarray] = {}
        for f in np.flatnonzero(self.sizes > self.LONG):
            best = np.zeros(self.n // self.BLOCK + 1, np.float32)
            np.maximum.at(best, self.example[self.start[f] : self.start[f + 1]] // self.BLOCK, self.weight[self.start[f] : self.start[f + 1]])
            self.blocks[int(f)] = best

    def _list(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.start[f], self.start[f + 1]
        return self.example[a:b], self.weight[a:b]

    def nearest(self, query: np.ndarray, k: int, without: slice | None = None, extra: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest examples and their cosines, exactly; ties go to the earlier example.

        extra: squared weight of the query's features that no example has.
        """
        q = np.asarray(query, np.int64)
        if not len(q):
            return np.empty(0, np.int64), np.empty(0, np.float32)
        w = self.idf[q]
        w = w / np.sqrt((w**2).sum() + extra)
        length = self.sizes[q]
        brief = length <= self.LONG
        brief &= length > 0
        few = q[brief].tolist()
        if few:
            lists = [self._list(f) for f in few]
            at = np.concatenate([x for x, _ in lists])
            score = np.bincount(at, np.repeat(w[brief], length[brief]) * np.concatenate([x for _, x in lists]), self.n)
        else:
            score = np.zeros(self.n)
        long = length > self.LONG
        q, w = q[long], w[long]
        if without is not None:
            score[without] = -9
        i, least = 0, 0.0
        if len(q):
            gain = w * self.most[q]
            order = np.argsort(-gain, kind="stable")
            q, w, gain = q[order], w[order], gain[order]
            left = np.append(np.cumsum(gain[::-1])[::-1], 0.0)
            # lists are added until what is left can't bring in an example not seen so far: the k-th best is looked up
            # where that may be so for the first time, and only rises from there on
            turn = int(np.argmax(left <= 0.6 * left[0]))
            for i in range(len(q) + 1):
                if i == turn:
                    near = score[score > 0]
                    least = float(np.partition(near, -k)[-k]) if len(near) >= k else 0.0
                if i == len(q) or i >= turn and least >= left[i] and least > 0:
                    break
                at, weight = self._list(q[i])
                score[at] += w[i] * weight
            if without is not None:
                score[without] = -9
        near = np.flatnonzero(score > 0)
        if i < len(q):  # only examples whose blocks can still lift them to the k best
            hope = score[near].copy()
            for f, x in zip(q[i:], w[i:]):
                hope += x * self.blocks[int(f)][near // self.BLOCK]
            near = near[hope >= least - 1e-6]
            for f, x in zip(q[i:], w[i:]):
                ids = self.example[self.start[f] : self.start[f + 1]]
                place = np.minimum(np.searchsorted(ids, near), len(ids) - 1)
                hit = ids[place] == near
                score[near[hit]] += x * self.weight[self.start[f] + place[hit]]
        value = score[near]
        if len(near) > k:
            best = np.lexsort((near, -value))[:k]
            near, value = near[best], value[best]
        return near, value


def monotone(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: steps (x, mean y) that rise with x."""
    pools: list[list[float]] = []
    order = np.argsort(x, kind="stable")
    for a, b in zip(x[order], y[order]):
        pools.append([a, float(b), 1])
        while len(pools) > 1 and (pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2] or pools[-2][0] == pools[-1][0]):
            last = pools.pop()
            pools[-1] = [last[0], pools[-1][1] + last[1], pools[-1][2] + last[2]]
    return np.array([p[0] for p in pools]), np.array([p[1] / p[2] for p in pools])


class Units:
    """Sentences as lists of feature numbers, end to end; `extra` is the squared weight of features that no example has."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray, extra: np.ndarray):
        self.flat, self.sizes, self.extra = flat, sizes, extra
        self.edges = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        self.of = np.repeat(np.arange(len(sizes)), sizes)

    def __len__(self) -> int:
        return len(self.sizes)

    def __getitem__(self, i: int) -> np.ndarray:
        return self.flat[self.edges[i] : self.edges[i + 1]]

    def take(self, which: np.ndarray) -> Units:
        return Units(np.concatenate([self[i] for i in which]) if len(which) else np.empty(0, np.int64), self.sizes[which], self.extra[which])

    @staticmethod
    def joined(parts: list[list[int]], extra: np.ndarray | None = None) -> Units:
        sizes = np.array([len(r) for r in parts], np.int64)
        return Units(np.array([x for r in parts for x in r], np.int64), sizes, np.zeros(len(parts)) if extra is None else extra)


class Panel:
    """The bad examples, held against many sentences at once.

    Examples stand in blocks; a block's greatest weight of each feature bounds what its examples
    can give a sentence. Sentences that a block can give next to nothing pass it by, the others
    are multiplied with its matrix of weights.
    """

    BLOCK, LITTLE = 256, 0.04

    def __init__(self, units: Units, idf: np.ndarray):
        self.n, self.idf, self.blocks = len(units), idf, []
        for at in range(0, self.n, self.BLOCK):
            own = units.take(np.arange(at, min(at + self.BLOCK, self.n)))
            weight = idf[own.flat]
            norm = np.sqrt(np.maximum(np.bincount(own.of, weight**2, len(own)) + own.extra, 1e-12))
            known, row = np.unique(own.flat, return_inverse=True)
            matrix = np.zeros((len(known), len(own)), np.float32)
            matrix[row, own.of] = weight / norm[own.of]
            self.blocks.append((known, matrix, matrix.max(axis=1, initial=0)))

    def powers(self, units: Units, without: list[slice | None] | None = None) -> np.ndarray:
        """For each sentence, the sum of the fourth powers of its cosines with the examples, from above."""
        w = self.idf[units.flat]
        norm = np.sqrt(np.maximum(np.bincount(units.of, w * w, len(units)) + units.extra, 1e-12))
        w = (w / norm[units.of]).astype(np.float32)
        total = np.zeros(len(units))
        for nth, (known, matrix, most) in enumerate(self.blocks):
            row = np.minimum(np.searchsorted(known, units.flat), len(known) - 1) if len(known) else units.flat
            here = np.flatnonzero(known[row] == units.flat) if len(known) else np.empty(0, np.int64)
            row, of, part = row[here], units.of[here], w[here]
            bound = np.bincount(of, part * most[row], len(units))
            total += np.where(bound < self.LITTLE, matrix.shape[1] * bound**4, 0)
            go = bound[of] >= self.LITTLE
            row, of, part = row[go], of[go], part[go]
            starts = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1]))) if len(of) else np.empty(0, np.int64)
            for lo in range(0, len(starts), 2000):
                some = starts[lo : lo + 2000]
                end = starts[lo + 2000] if lo + 2000 < len(starts) else len(of)
                got = np.add.reduceat(matrix[row[some[0] : end]] * part[some[0] : end, None], some - some[0], axis=0)
                who = of[some]
                if without is not None:
                    for n, i in enumerate(who.tolist()):
                        if (span := without[i]) is not None:
                            got[n, max(span.start - nth * self.BLOCK, 0) : max(span.stop - nth * self.BLOCK, 0)] = 0
                got *= got
                total[who] += (got * got).sum(axis=1)
        return total


class Judge:
    """Examples, votes and the map to scores. document: of each example, equal ones together.

    names: feature -> number, -1 for those too common to tell anything. A feature that no
    example has counts in a sentence's length as one never seen.

    A sentence is first held against the bad examples alone: where all of them together, with no
    harmless one beside them, couldn't bring the vote to LEAST (half the cut), the vote is 0. The
    others are searched among all examples.
    """

    LEAST = CUT / 2

    def __init__(self, names: dict[str, int], idf: np.ndarray, unseen: float, rows: Units, document: np.ndarray, given: np.ndarray, k: int, cut: float, spread=None, alone: float = 0.16):
        """spread(judge, n, work) runs work(judge, numbers) over parts of range(n), here if not given."""
        spread = spread or (lambda judge, n, work: work(judge, np.arange(n)))
        self.names, self.unseen, self.k, self.rows = names, unseen, k, rows
        self.document, self.given = document, given
        self.spans = self._spans(document)
        self.index = Index(rows, idf)
        self.asked = np.flatnonzero(given)
        near = spread(self, len(self.asked), Judge._neighbours)
        # an example that nothing harmless is like keeps its label, though it may be the only one of its kind
        single = np.array([not len(n) or s[given[n] == 0].max(initial=0) < alone for n, s in near], bool)
        self.bad = given.astype(np.float64)
        for least in (0.5, cut, cut):
            votes = np.array([self.vote(*x) for x in near])
            self.bad = np.zeros(len(rows))
            self.bad[self.asked] = (votes >= least) | single
        worse = np.flatnonzero(self.bad)
        self.panel = Panel(rows.take(worse), idf)
        self.own = self._spans(document[worse])
        votes = spread(self, len(rows), Judge._left_out)
        worst: dict[int, list[float]] = {}
        for vote, d, g in zip(votes, document.tolist(), given.tolist()):
            worst[d] = [max(vote, worst.get(d, [0.0])[0]), float(g)]
        x, y = np.array(list(worst.values())).T if worst else (np.zeros(1), np.zeros(1))
        self.x, self.y = monotone(x, y)

    def _neighbours(self, which: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """The nearest examples of examples given as bad, from other documents."""
        return [self.index.nearest(self.rows[a], self.k, self.spans[int(self.document[a])]) for a in self.asked[which]]

    def _left_out(self, which: np.ndarray) -> list[float]:
        """The votes of other documents' examples on examples."""
        d = self.document[which].tolist()
        return self.judge(self.rows.take(which), [(self.own.get(x), self.spans[x]) for x in d])[0].tolist()

    @staticmethod
    def _spans(document: np.ndarray) -> dict[int, slice]:
        first = np.flatnonzero(np.concatenate(([True], document[1:] != document[:-1]))) if len(document) else []
        return {int(document[a]): slice(int(a), int(b)) for a, b in zip(first, [*first[1:], len(document)])}

    def units(self, found: list[list[str]]) -> Units:
        """The features of sentences as numbers."""
        sizes, extra, flat = np.zeros(len(found), np.int64), np.zeros(len(found)), []
        for i, fs in enumerate(found):
            ids = [x for f in fs if (x := self.names.get(f, -2)) != -1]
            known = [x for x in ids if x >= 0]
            flat += known
            sizes[i], extra[i] = len(known), len(ids) - len(known)
        return Units(np.array(flat, np.int64), sizes, extra * self.unseen**2)

    def vote(self, near: np.ndarray, similar: np.ndarray) -> float:
        if not len(near):
            return 0.0
        w = similar.astype(np.float64) ** 4
        return float((w * self.bad[near]).sum() / (w.sum() + 0.01))

    def judge(self, units: Units, without: list[tuple[slice | None, slice | None]] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Vote of each sentence and the document of its nearest bad example (-1: none)."""
        votes, example = np.zeros(len(units)), np.full(len(units), -1, np.int64)
        power = self.panel.powers(units, [w[0] for w in without] if without else None)
        for i in np.flatnonzero(power >= self.LEAST * (power + 0.01)):
            query, extra, all_mine = units[i], float(units.extra[i]), without[i][1] if without else None
            near, similar = self.index.nearest(query, self.k, all_mine, extra)
            votes[i] = self.vote(near, similar)
            bad = self.bad[near] > 0
            if bad.any():
                example[i] = self.document[near[bad][0]]
        return votes, example

    def score(self, votes: np.ndarray) -> np.ndarray:
        return np.interp(votes, self.x, self.y)


def sample(documents: DataFrame, key: str, text: str, labels: DataFrame, label: str, most: int) -> list[tuple[int, str, int]]:
    """Up to `most` labelled documents in the order of a hash of the key; raters that disagree evenly are left out."""
    votes = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.avg(label).alias("mean"))
    marked = votes.where("mean <> 0.5").select("id", (F.col("mean") > 0.5).cast("int").alias("bad"))
    chosen = marked.orderBy(F.xxhash64("id", F.lit("example")), "id").limit(most)
    rows = documents.select(F.col(key).alias("id"), F.col(text).alias("text")).where(F.length("text") > 0)
    return sorted({(r["id"], r["text"], r["bad"]) for r in rows.join(F.broadcast(chosen), "id").collect()})


def trained(documents: DataFrame, key: str, text: str, labels: DataFrame, label: str = "toxic", most: int = 8000, k: int = 12, common: float = 0.1, cut: float = CUT, unseen: float = 1.0) -> Judge:
    """The judge made of at most `most` labelled documents.

    Frequencies are counted over the sentences of all documents; features in more than the
    part `common` of them tell nothing and are left out. `unseen` scales the weight that
    features of no example have in a sentence's length.
    """
    docs = sample(documents, key, text, labels, label, most)
    found = [(d, b, features(x)) for d, t, b in docs for x in sentences(t)]
    names = {f: i for i, f in enumerate(sorted({f for _, _, fs in found for f in fs}))}
    shared = documents.sparkSession.sparkContext.broadcast(names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        n = np.zeros(len(known) + 1, np.int64)
        for batch in batches:
            ids: list[int] = []
            for t in batch.column("text").to_pylist():
                for x in sentences(t):
                    n[-1] += 1
                    ids += [i for f in features(x) if (i := known.get(f)) is not None]
            n[:-1] += np.bincount(np.array(ids, np.int64), minlength=len(known))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["feature", "n"])

    rows = documents.select(F.col(text).alias("text"))
    counts = rows.mapInArrow(count, "feature bigint, n bigint").groupBy("feature").agg(F.sum("n").alias("n")).toPandas()  # a row for each feature of the sample
    shared.unpersist()
    n = np.zeros(len(names) + 1)
    n[counts["feature"].to_numpy(np.int64)] = counts["n"].to_numpy()
    told = n[:-1] <= max(common * n[-1], 20)
    place = np.where(told, np.cumsum(told) - 1, -1)
    idf = np.log((n[-1] + 1) / (n[:-1][told] + 1)) + 0.1
    ids = [[x for f in fs if (x := int(place[names[f]])) >= 0] for _, _, fs in found]
    sc = documents.sparkSession.sparkContext

    def spread(judge: Judge, n: int, work) -> list:
        sent = sc.broadcast(judge)
        parts = np.array_split(np.arange(n), max(1, min(4 * sc.defaultParallelism, n // 50)))
        frame = documents.sparkSession.createDataFrame([(i, part.tolist()) for i, part in enumerate(parts)], "i int, part array<int>").repartition(len(parts), "i")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                got = [pickle.dumps(work(sent.value, np.array(x, np.int64))) for x in batch.column("part").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("i"), pa.array(got, pa.binary())], names=["i", "got"])

        rows = sorted((r["i"], bytes(r["got"])) for r in frame.mapInArrow(run, "i int, got binary").collect())  # a value for each example of the bounded sample
        sent.unpersist()
        return [x for _, got in rows for x in pickle.loads(got)]

    return Judge(dict(zip(names, place.tolist())), idf, float(np.log(n[-1] + 1) + 0.1) * unseen, Units.joined(ids), np.array([d for d, _, _ in found], np.int64), np.array([b for _, b, _ in found], np.int64), k, cut, spread)


def scored(documents: DataFrame, key: str, text: str, judge: Judge, keep: tuple[str, ...] = ()) -> DataFrame:
    """`id, <keep>, vote, score, passage, example`: every document's worst sentence.

    passage is that sentence, example the document of the nearest bad example. Null, empty and
    blank texts have vote 0 and no passage; whole texts are read. Every row is judged by itself,
    so repeated rows come out repeatedly.
    """
    shared = documents.sparkSession.sparkContext.broadcast(judge)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = shared.value
        seen: dict[str, tuple[float, int]] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                parted = [sentences(t) for t in part.column("_text").to_pylist()]
                new = [x for x in dict.fromkeys(x for p in parted for x in p) if x not in seen]
                votes, example = one.judge(one.units([features(x) for x in new]))
                now = {new[i]: (float(votes[i]), int(example[i])) for i in np.flatnonzero(votes)}
                if len(seen) > 50_000:
                    seen.clear()
                out = []
                for p in parted:
                    best = (0.0, None, None)
                    for x in p:
                        got = now.get(x) or seen.get(x)
                        if got and got[0] > best[0]:
                            best = (got[0], x, got[1] if got[1] >= 0 else None)
                    out.append(best)
                seen.update(now)
                vote = np.array([o[0] for o in out])
                names = [c for c in batch.schema.names if c != "_text"]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in names), pa.array(vote, pa.float64()), pa.array(one.score(vote), pa.float64()), pa.array([o[1] for o in out], pa.string()), pa.array([o[2] for o in out], pa.int64())],
                    names=[*names, "vote", "score", "passage", "example"],
                )

    rows = documents.select(F.col(key).alias("id"), *keep, F.col(text).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_text")
    return rows.mapInArrow(run, schema + ", vote double, score double, passage string, example bigint")


def rates(scores: DataFrame, *by: str, cut: float = CUT) -> DataFrame:
    """`<by>, documents, found, rate, mean_score`; a null source is a group of its own."""
    found = F.count(F.when(F.col("vote") >= cut, 1))
    return scores.groupBy(*by).agg(F.count(F.lit(1)).alias("documents"), found.alias("found"), (found / F.count(F.lit(1))).alias("rate"), F.avg("score").alias("mean_score"))
