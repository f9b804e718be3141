"""Encoding of a collection with a public byte-level BPE tokenizer.

Texts are parted into pre-tokens by the tokenizer's own pattern. Each distinct pre-token is
encoded once in the whole cluster; ids are joined back to the places of the pre-tokens, and
texts are put together in the order of places. Pre-tokens that stand in at least `part` of the
texts (at most (pre-tokens of a text) / part of them, whatever the collection's size) go to
every task as a table; only the others are shuffled. The rows of a text's frequent words pass the
join under keys of their own, so no key of it is hot.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wrackline.session import cut

FOLDER = os.environ.get("TOKENIZER_FOLDER", "/opt/tokenizers")
NAME = "byte_bpe_50k"
#: Fixed value: the public pre-token pattern of this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


_made: dict[str, object] = {}


def tokenizer(folder: str = FOLDER, name: str = NAME):
    """The tokenizer (once per process), without special tokens."""
    path = os.path.join(folder, name + ".tiktoken")
    if path not in _made:
        import tiktoken

        _made[path] = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks(path), special_tokens={})
    return _made[path]


def pretokens(text: str) -> dict[str, list[int]]:
    """Distinct pre-tokens of a text and their places."""
    import regex

    found = _made.get("pattern") or _made.setdefault("pattern", regex.compile(PATTERN))
    out: dict[str, list[int]] = {}
    for at, piece in enumerate(found.findall(text)):
        out.setdefault(piece, []).append(at)
    return out


def vocabulary(texts: DataFrame, folder: str, name: str) -> DataFrame:
    """`word, texts, ids`: each distinct pre-token of `text`, in how many texts, encoded once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str, int] = {}
            for text in batch.column("text").to_pylist():
                for w in pretokens(text or ""):
                    seen[w] = seen.get(w, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "texts"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = tokenizer(folder, name)
        for batch in batches:
            ids = [one._encode_single_piece(w) for w in batch.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("texts"), pa.array(ids, pa.list_(pa.int32()))], names=["word", "texts", "ids"])

    counts = texts.mapInArrow(count, "word string, texts bigint").groupBy("word").agg(F.sum("texts").alias("texts"))
    return counts.mapInArrow(encode, "word string, texts bigint, ids array<int>")


def encoded(df: DataFrame, key: str, text: str, folder: str = FOLDER, name: str = NAME, part: float = 0.002) -> DataFrame:
    """`<key>, ids`: each text's token ids, without special tokens, whose strings are ordinary text.

    Null and empty texts have the empty list. Keys are taken to be unique; a row repeated as
    it is counts once; rows with a null key are left out. Texts are encoded whole.
    """
    rows = df.select(F.col(key).alias("id"), F.col(text).alias("text")).where("id is not null")
    known = cut(vocabulary(rows.select("text"), folder, name))
    least = max(2.0, part * rows.count())
    frequent = known.where(F.col("texts") >= least).select("word", "ids").toPandas()  # bounded by `part`
    table = {w: list(map(int, i)) for w, i in zip(frequent["word"], frequent["ids"])}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ints = pa.list_(pa.int32())
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part_ = batch.slice(start, 500)
                ids, words, places, tokens = [], [], [], []
                for i, t in zip(part_.column("id").to_pylist(), part_.column("text").to_pylist()):
                    sizes, flat, at = [], [], []
                    for w, where in pretokens(t or "").items():
                        if (enc := table.get(w)) is None:
                            ids.append(i), words.append(w), places.append(where), tokens.append(None)
                        else:
                            for p in where:
                                at.append(p), sizes.append(len(enc)), flat.extend(enc)
                    # one row for all frequent words: places, then sizes, in `places`; ids in `tokens`
                    ids.append(i), words.append(None), places.append(at + sizes), tokens.append(flat)
                yield pa.RecordBatch.from_arrays([pa.array(ids, part_.column("id").type), pa.array(words, pa.string()), pa.array(places, ints), pa.array(tokens, ints)], names=["id", "word", "places", "ids"])

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column("parts")
            fields = parts.flatten()
            where, codes, rare = (fields.field(n) for n in ("places", "ids", "rare"))
            text = np.repeat(np.arange(batch.num_rows), np.diff(parts.offsets.to_numpy()))
            places, ids, rare = where.flatten().to_numpy(False), codes.flatten().to_numpy(False), rare.to_numpy(False).astype(bool)
            n, length = (c.value_lengths().fill_null(0).to_numpy(False).astype(np.int64) for c in (where, codes))
            first, begin = np.cumsum(n) - n, np.cumsum(length) - length
            # a rare word's places share its ids; frequent words have places and then their sizes, with ids in that order
            n = np.where(rare, n, n // 2)
            row = np.repeat(np.arange(len(n)), n)
            inside = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            place = places[first[row] + inside]
            size = np.where(rare[row], length[row], places[np.minimum(first[row] + inside + n[row], max(len(places) - 1, 0))] if len(places) else 0)
            own = np.where(rare[row], 0, size)
            before = np.cumsum(own) - own
            start = np.cumsum(n) - n
            base = np.concatenate((before, [0]))[np.minimum(start, len(before))]
            at = begin[row] + np.where(rare[row], 0, before - base[row])
            order = np.lexsort((place, text[row]))
            # a row that is repeated as it is gives its places again
            where_, of = place[order], text[row][order]
            order = order[np.concatenate((np.ones(min(len(order), 1), bool), (np.diff(where_) != 0) | (np.diff(of) != 0)))]
            size, at = size[order], at[order]
            take = np.arange(size.sum()) + np.repeat(at - (np.cumsum(size) - size), size)
            total = np.bincount(text[row][order], size, batch.num_rows).astype(np.int64) if len(order) else np.zeros(batch.num_rows, np.int64)
            ends = np.concatenate(([0], np.cumsum(total))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids[take] if len(take) else np.empty(0, np.int32), pa.int32()))], names=["id", "ids"])

    kind = rows.schema["id"].dataType.simpleString()
    placed = rows.mapInArrow(place, f"id {kind}, word string, places array<int>, ids array<int>")
    # rows of frequent words meet nothing; each has a key of its own (no pre-token joins a control sign and a digit), so that they don't meet in one task
    key_of = F.coalesce("word", F.concat(F.lit("\0"), F.xxhash64("id").cast("string")))
    rare = placed.withColumnRenamed("ids", "own").withColumn("_key", key_of).join(known.where(F.col("texts") < least).select(F.col("word").alias("_key"), "ids"), "_key", "left")
    parts = rare.select("id", F.struct("places", F.coalesce("own", "ids").alias("ids"), F.col("word").isNotNull().alias("rare")).alias("part"))
    grouped = parts.groupBy("id").agg(F.collect_list("part").alias("parts"))
    return grouped.mapInArrow(together, f"id {kind}, ids array<int>").withColumnRenamed("id", key)


def token_bytes(spark, folder: str = FOLDER, name: str = NAME) -> DataFrame:
    """`token, bytes` of the vocabulary (a fixed table of some 50,000 rows)."""
    rows = [(i, bytearray(b)) for b, i in ranks(os.path.join(folder, name + ".tiktoken")).items()]
    return spark.createDataFrame(rows, "token int, bytes binary")


def decoded(df: DataFrame, key: str, ids: str = "ids", folder: str = FOLDER, name: str = NAME) -> DataFrame:
    """`<key>, text` of token ids; an empty list gives the empty text, null gives null."""
    table = F.broadcast(token_bytes(df.sparkSession, folder, name))
    each = df.select(F.col(key).alias("id"), F.posexplode_outer(ids).alias("at", "token"), F.col(ids).isNull().alias("none"))
    joined = each.join(table, "token", "left")
    whole = joined.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", F.hex("bytes").alias("hex")))).alias("all"), F.max("none").alias("none"))
    text = F.decode(F.unhex(F.array_join(F.transform("all", lambda x: x["hex"]), "")), "utf-8")
    return whole.select(F.col("id").alias(key), F.when(~F.col("none"), text).alias("text"))


def token_counts(df: DataFrame, key: str, text: str, keep: tuple[str, ...] = (), folder: str = FOLDER, name: str = NAME) -> DataFrame:
    """`<key>, tokens, <keep>`: the number of tokens of each whole text (null: 0), each row on its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = tokenizer(folder, name)
        for batch in batches:
            sizes = [len(one.encode_ordinary(t)) if t else 0 for t in batch.column("_text").to_pylist()]
            names = [n for n in batch.schema.names if n != "_text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sizes, pa.int64())], names=[*names, "tokens"])

    rows = df.select(key, *keep, F.col(text).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_text")
    return rows.mapInArrow(run, schema + ", tokens bigint")
