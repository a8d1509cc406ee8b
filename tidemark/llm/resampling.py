"""Importance resampling towards a target distribution.

Features are runs of one to ``longest`` words, hashed into buckets. Counts of the
corpus and of the target are added up in the workers, so what is shuffled and what
reaches the driver is one array of ``buckets`` numbers a task, whatever the corpus.
The array of gains scores a document by looking its features up, and a seeded Gumbel
number makes the highest scores a draw without replacement.

Ranks come from a distributed LSD radix sort over the composite key (score falling,
id rising): each pass takes one digit of 12 bits, from the least significant on.
Rows lie in blocks of consecutive places. A pass counts each block's digits, turns the
counts into global prefix offsets (all smaller digits, then the same digit in earlier
blocks), and a row's destination is its offset plus its place among the block's rows of
that digit, so the pass is stable. No task ever holds more than one digit of one block.
Digits that all rows share need no pass.

A null text is empty, a null id counts as an empty one in the hash and goes after all
others in ties; rows that share id and score take neighbouring ranks in the order in
which they were read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Words: ASCII digits and letters, and all that is not ASCII. The bytes of a UTF-8 text tell.
WORDS, GAP = re.compile(rb"[0-9a-z\x80-\xff]+"), re.compile(rb"[^0-9a-z\x80-\xff]")
#: Bytes of a text that are split into words at a time, and words whose bucket a worker remembers.
SLICE, REMEMBERED = 1 << 22, 200_000
DIGIT_BITS, BLOCK_BITS = 12, 20


def sliced_words(raw: bytes, words: re.Pattern = WORDS, gap: re.Pattern = GAP) -> Iterator[list[bytes]]:
    """The words of a text, a slice at a time; slices end between words."""
    at = 0
    while at < len(raw):
        cut = gap.search(raw, at + SLICE) if at + SLICE < len(raw) else None
        end = cut.start() if cut else len(raw)
        yield words.findall(raw, at, end)
        at = end


class Buckets(dict):
    """Bucket of a feature by its CRC-32, remembered within a bound."""

    def __init__(self, buckets: int):
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[feature] = zlib.crc32(feature) % self.buckets
        return found

    def of(self, text: str, longest: int) -> Iterator[np.ndarray]:
        """Buckets of all features of a text, repeats included, a slice at a time; the first array of a slice is that of its words."""
        before: list[bytes] = []
        for words in sliced_words(text.encode().lower()):
            yield np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))
            run = before + words
            for n in range(2, longest + 1):
                new = range(max(0, len(before) - n + 1), len(run) - n + 1)
                yield np.fromiter((self[b" ".join(run[k : k + n])] for k in new), dtype=np.int64, count=len(new))
            before = run[len(run) - longest + 1 :] if longest > 1 else []


def bucket_counts(texts: DataFrame, buckets: int, longest: int = 1) -> np.ndarray:
    """How many features of ``texts(text)`` fall in each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        own, total = common.remembered(f"buckets {buckets}", lambda: Buckets(buckets)), np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for text in common.text_rows(batch):
                for found in own.of(text, longest):
                    total += np.bincount(found, minlength=buckets)
        some = np.flatnonzero(total)
        yield {"bucket": some, "n": total[some]}

    sums = common.map_arrow(texts.select("text"), run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, dtype=np.int64)
    for r in sums.collect():  # one row a bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log-ratio of the target's share to the corpus's, add-one smoothed, in thousandths."""
    size, s_all, t_all = len(corpus), int(corpus.sum()), int(target.sum())
    each = [math.floor(1000 * math.log((t + 1) * (s_all + size) / ((s + 1) * (t_all + size)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)]
    return np.array(each, dtype=np.int64)


def scored(docs: DataFrame, gain: np.ndarray, longest: int = 1, seed: int = 2024) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score`` of every document, with its place in its task (``_block, _at``)."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # one number a bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        own, gain, start = common.remembered(f"buckets {len(shared.value)}", lambda: Buckets(len(shared.value))), shared.value, 0
        block = TaskContext.get().partitionId()
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("n_words", "n_features", "weight", "score")}
            ids = batch.column("doc_id").to_pylist()
            for doc, text in zip(ids, common.text_rows(batch), strict=True):
                words = features = total = 0
                for k, found in enumerate(own.of(text, longest)):
                    words += len(found) if k % longest == 0 else 0
                    features += len(found)
                    total += int(gain[found].sum())
                weight = total // features if features else 0
                h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
                score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
                for name, value in zip(out, (words, features, weight, score), strict=True):
                    out[name].append(value)
            yield out | {"doc_id": batch.column("doc_id"), "_block": np.full(len(ids), block), "_at": np.arange(start, start + len(ids))}
            start += len(ids)

    return common.map_arrow(docs.select("doc_id", "text"), run, "doc_id long, n_words long, n_features long, weight long, score long, _block long, _at long")


def radix_pass(rows: DataFrame, digit: Column) -> DataFrame:
    """One stable counting-sort pass by ``digit``: new ``_at`` over all rows, and the ``_block`` in which it lies."""
    keyed = rows.withColumn("_digit", digit)
    counts = keyed.groupBy("_digit", "_block").agg(F.count("*").alias("_n"))
    totals = counts.groupBy("_digit").agg(F.sum("_n").alias("_all"))  # one row a digit
    start = totals.select("_digit", (F.sum("_all").over(Window.orderBy("_digit")) - F.col("_all")).alias("_start"))
    earlier = F.sum("_n").over(Window.partitionBy("_digit").orderBy("_block")) - F.col("_n")
    offsets = counts.withColumn("_earlier", earlier).join(start, "_digit").select("_digit", "_block", (F.col("_earlier") + F.col("_start")).alias("_offset"))
    among = F.row_number().over(Window.partitionBy("_digit", "_block").orderBy("_at")) - 1
    placed = keyed.withColumn("_among", among).join(offsets, ["_digit", "_block"]).withColumn("_at", (F.col("_offset") + F.col("_among")).cast("long"))
    return placed.withColumn("_block", F.shiftright("_at", BLOCK_BITS)).select(*rows.columns)


def ranked(rows: DataFrame, keys: list[Column], bits: int = DIGIT_BITS) -> DataFrame:
    """``rows(..., _block, _at)`` with ``_at`` as their place, from 0, in the order of ``keys``, the most significant first.

    Keys are 64-bit numbers, ordered as unsigned ones. Which of their digits differ at
    all is one aggregation; the rest is one pass for each of those.
    """
    names = [f"_key{k}" for k in range(len(keys))]
    now = rows.select("*", *(key.alias(n) for n, key in zip(names, keys, strict=True)))
    spread = now.agg(*(F.bit_or(n).bitwiseXOR(F.bit_and(n)).alias(n) for n in names)).first()
    table = None
    for name in reversed(names):
        differ = (spread[name] or 0) & (2**64 - 1)
        for low in range(0, 64, bits):
            if differ >> low & (2**bits - 1):
                after = common.keep(radix_pass(now, F.shiftrightunsigned(name, low).bitwiseAND(2**bits - 1)), "radix")
                if table is not None:
                    common.discard(table)
                now = table = after
    if table is None:  # all keys are equal: one pass over a constant numbers the rows
        now = common.keep(radix_pass(now, F.lit(0).cast("long")), "radix")
    return now.drop(*names)


def resample(docs: DataFrame, target: DataFrame, buckets: int = 10_000, longest: int = 1, least: int = 20, percent: int = 10, seed: int = 2024) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every document; ``rank`` only of the drawn.

    Of the documents with ``least`` words, the ``percent`` per cent with the highest scores are drawn.
    """
    gain = gains(bucket_counts(docs, buckets, longest), bucket_counts(target, buckets, longest))
    rows = common.keep(scored(docs, gain, longest, seed), "scored")
    able, rest = rows.where(F.col("n_words") >= least), rows.where(F.col("n_words") < least)
    n, top = able.agg(F.count("*"), F.max("score")).first()
    out = ["doc_id", "n_features", "weight", "score"]
    order = [F.lit(top or 0) - F.col("score"), F.col("doc_id").isNull().cast("long"), F.coalesce("doc_id", F.lit(0)).bitwiseXOR(F.lit(-(2**63)))]
    sorted_ = ranked(able, order)
    rank = F.when(F.col("_at") < n * percent // 100, F.col("_at") + 1)
    return sorted_.select(*out, rank.alias("rank")).unionByName(rest.select(*out, F.lit(None).cast("long").alias("rank")))


def drawn(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn documents, all their columns; documents that share an id come with it if it is drawn."""
    picked = resample(docs, target, **options).where("rank is not null").select(F.col("doc_id").alias("_tm_drawn")).distinct()
    return docs.join(picked, docs["doc_id"].eqNullSafe(picked["_tm_drawn"]), "left_semi")
