"""How far the word use of sources lies from that of others in their language.

Words are counted by (lang, source) in the workers before anything is shuffled. A
language keeps the words of at least ``least`` of its documents; they are dealt into
chunks of about ``CHUNK`` by hash and numbered in each, so a word's id is exact and no
array of ids grows with the vocabulary. Each group gives one sorted array of (id, count)
a chunk. Pair tasks co-group the arrays of one chunk, once for each unordered pair: the
shorter array gallops through the longer one, and words of both, of one side only and
of neither are priced both ways. Sums over chunks are the divergences.

All arithmetic is in whole numbers. Null text, lang and source are ''. Groups without
words and languages without kept words have divergence 0 to all. An empty table gives
an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .resampling import sliced_words

#: Words: ASCII letters, and all that is not ASCII. The bytes of a UTF-8 text tell.
WORDS, GAP = re.compile(rb"[a-z\x80-\xff]+"), re.compile(rb"[^a-z\x80-\xff]")
#: Words that a worker counts before it passes them on, and kept words of a chunk.
HELD, CHUNK = 100_000, 1 << 14
#: Groups of a language that lie in one tile.
TILE = 16
#: Digits of a share: shares are whole numbers of 10 ** -DIGITS.
DIGITS = 9


def word_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, df``: occurrences and documents of each word in each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        groups: dict[tuple, tuple[Counter, Counter]] = {}

        def counted() -> Iterator[dict]:
            for (lang, source), (n, df) in groups.items():
                if n:
                    yield {"lang": [lang] * len(n), "source": [source] * len(n), "term": [w.decode() for w in n], "n": list(n.values()), "df": [df[w] for w in n]}
            groups.clear()

        held = 0
        for batch in batches:
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), common.text_rows(batch), strict=True):
                n, df = groups.setdefault((lang, source), (Counter(), Counter()))
                before, own = len(n), set()
                for words in sliced_words(text.encode().lower(), WORDS, GAP):
                    n.update(words)
                    own.update(words)
                df.update(own)
                held += len(n) - before
                if held > HELD:
                    yield from counted()
                    held = 0
        yield from counted()

    own = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), "text")
    parts = common.map_arrow(own, run, "lang string, source string, term string, n long, df long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def share(n: Column, total: Column, terms: Column) -> Column:
    """``1 + floor(10 ** DIGITS * (n + 1) / (total + terms))``, exact for any counts."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.lit(1) + F.call_function("div", wide(n + 1) * F.lit(10**DIGITS).cast("decimal(10,0)"), wide(total + terms))


def shares(n: np.ndarray, total: int, terms: int) -> np.ndarray:
    """``share`` of an array, by long division."""
    base = total + terms
    if base > 2**63 // 10:
        raise OverflowError(f"{base} words are too many for long division in 64 bits")
    out, rest = np.divmod(n + 1, base)
    for _ in range(DIGITS):
        digit, rest = np.divmod(rest * 10, base)
        out = out * 10 + digit
    return out + 1


def price(p, q):
    return (p - q) * (p - q) // q


def gallop(keys: np.ndarray, among: np.ndarray) -> np.ndarray:
    """For each key, the first place in the sorted ``among`` that is not below it.

    Starts where the key would lie if both were spread alike, doubles its steps until
    it has passed the key, and halves what lies between.
    """
    n = len(among)
    high = np.arange(len(keys)) * n // max(1, len(keys))
    low = high - 1
    step = 1
    while len(on := np.flatnonzero((high < n) & (among[np.minimum(high, n - 1)] < keys))):
        low[on] = high[on]
        high[on] = np.minimum(n, high[on] + step)
        step *= 2
    step = 1
    while len(on := np.flatnonzero((low >= 0) & (among[np.maximum(low, 0)] >= keys))):
        high[on] = low[on]
        low[on] = np.maximum(-1, low[on] - step)
        step *= 2
    while len(on := np.flatnonzero(high - low > 1)):
        mid = (low[on] + high[on]) // 2
        below = among[mid] < keys[on]
        low[on] = np.where(below, mid, low[on])
        high[on] = np.where(below, high[on], mid)
    return high


class Side:
    """One group's words of one chunk: sorted ids, their shares, and the share of a word that it lacks."""

    def __init__(self, source: str, ids: np.ndarray, n: np.ndarray, total: int, terms: int):
        self.source, self.ids, self.p = source, ids, shares(n, total, terms) if terms else n
        self.p0 = int(shares(np.zeros(1, dtype=np.int64), total, terms)[0]) if terms else 1


def merged(a: Side, b: Side, size: int) -> tuple[int, int]:
    """Divergence of a from b, and of b from a, over one chunk of ``size`` words."""
    if len(a.ids) > len(b.ids):
        return merged(b, a, size)[::-1]
    at = gallop(a.ids, b.ids) if len(b.ids) else np.zeros(len(a.ids), dtype=np.int64)
    both = np.zeros(len(a.ids), dtype=bool)
    inside = np.flatnonzero(at < len(b.ids))
    both[inside] = b.ids[at[inside]] == a.ids[inside]
    alone = np.ones(len(b.ids), dtype=bool)
    alone[at[both]] = False
    x, y, left, right = a.p[both], b.p[at[both]], a.p[~both], b.p[alone]
    absent = size - len(a.ids) - len(right)
    there = int(price(x, y).sum()) + int(price(left, b.p0).sum()) + int(price(a.p0, right).sum()) + absent * price(a.p0, b.p0)
    back = int(price(y, x).sum()) + int(price(b.p0, left).sum()) + int(price(right, a.p0).sum()) + absent * price(b.p0, a.p0)
    return there, back


def pair_sums(cells: DataFrame) -> DataFrame:
    """``lang, source, item, value`` of all ordered pairs, from ``cells(lang, chunk, tile, tiles, source, total, terms, size, ids, ns)``.

    A chunk's groups meet by pairs of tiles, so an array is sent once for each tile and
    not once for each group that it is compared with, and a task holds two tiles' arrays.
    """
    others = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("other")
    keys = ("lang", "chunk", "first", "second")
    tasks = cells.select("*", others).withColumns({"first": F.least("tile", "other"), "second": F.greatest("tile", "other")})
    tasks = tasks.drop("other", "tiles").repartition(*keys).sortWithinPartitions(*keys, "tile", "source")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        sums: dict[tuple, list[int]] = {}
        now, sides = None, ([], [])

        def met() -> None:
            lang, _, first, second, size = now
            for k, a in enumerate(sides[0]):
                for b in sides[0][k + 1 :] if first == second else sides[1]:
                    low, high = (a, b) if a.source < b.source else (b, a)
                    there, back = merged(low, high, size)
                    own = sums.setdefault((lang, low.source, high.source), [0, 0])
                    own[0] += there
                    own[1] += back

        def summed() -> dict:
            keys = list(sums)
            out = {n: [k[i] for k in keys] for i, n in enumerate(("lang", "a", "b"))} | {n: [sums[k][i] for k in keys] for i, n in enumerate(("there", "back"))}
            sums.clear()
            return out

        for batch in batches:
            at = {c: batch.column(c) for c in batch.schema.names}
            heads = zip(*(at[c].to_pylist() for c in (*keys, "size", "tile", "source", "total", "terms")), strict=True)
            for k, (*key, tile, source, total, terms) in enumerate(heads):
                if key != now:
                    if now is not None:
                        met()
                    now, sides = key, ([], [])
                    if len(sums) > HELD:
                        yield summed()
                ids, n = (at[c][k].values.to_numpy(zero_copy_only=False) for c in ("ids", "ns"))
                sides[tile != key[2]].append(Side(source, ids, n, total, terms))
        if now is not None:
            met()
        yield summed()

    parts = common.map_arrow(tasks, run, "lang string, a string, b string, there long, back long")
    sums = parts.groupBy("lang", "a", "b").agg(F.sum("there").alias("there"), F.sum("back").alias("back"))
    ways = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item"), F.col("there").alias("value")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"), F.col("back").alias("value")))
    return sums.select("lang", F.inline(ways))


def audit(docs: DataFrame, least: int = 3, most: int = 200) -> DataFrame:
    """``lang, source, part, item, value, rank``: other sources by divergence (part pair), and the ``most`` words that a source overuses most against its language (part term)."""
    counts = common.keep(word_counts(docs), "counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("df").alias("df"), F.sum("n").alias("lang_n")).where(F.col("df") >= least)
    sizes = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    sizes = common.keep(sizes.withColumn("chunks", F.ceil(F.col("terms") / CHUNK).cast("long")), "sizes")  # one row a language
    chunk = F.pmod(F.xxhash64("term"), F.col("chunks"))
    known = kept.join(sizes, "lang").withColumn("chunk", chunk).withColumn("id", F.row_number().over(Window.partitionBy("lang", "chunk").orderBy("term")))
    known = common.keep(known.select("lang", "term", "chunk", "id", "lang_n", "terms", "lang_total"), "terms")
    entries = common.keep(counts.select("lang", "source", "term", "n").join(known, ["lang", "term"]), "entries")
    common.discard(counts)

    totals = entries.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    every = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    none = F.lit(0).cast("long")
    groups = every.join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
    groups = common.keep(groups.select("lang", "source", F.coalesce("total", none).alias("total"), F.coalesce("terms", none).alias("terms"), F.coalesce("chunks", none).alias("chunks")), "groups")

    arrays = entries.groupBy("lang", "source", "chunk").agg(F.sort_array(F.collect_list(F.struct("id", "n"))).alias("own"))
    widths = known.groupBy("lang", "chunk").agg(F.count("*").alias("size"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    tiled = groups.withColumn("tile", F.floor(place / TILE)).withColumn("tiles", F.max("tile").over(Window.partitionBy("lang")) + 1)
    grid = tiled.withColumn("chunk", F.explode(F.sequence(none, F.greatest(F.col("chunks") - 1, none)))).join(widths, ["lang", "chunk"], "left")
    cells = grid.join(arrays, ["lang", "source", "chunk"], "left")
    field = lambda name, kind: F.coalesce(F.col(f"own.{name}"), F.array()).cast(f"array<{kind}>").alias(f"{name}s")
    cells = common.keep(cells.select("lang", "chunk", "tile", "tiles", "source", "total", "terms", F.coalesce("size", none).alias("size"), field("id", "int"), field("n", "long")), "cells")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pair_sums(cells).withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit("pair"))

    p, q = share(F.col("n"), F.col("total"), F.col("terms")), share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    own = entries.select("lang", "source", F.col("term").alias("item"), "n", "lang_n", "lang_total").join(groups.select("lang", "source", "total", "terms"), ["lang", "source"])
    own = own.select("lang", "source", "item", p.alias("p"), q.alias("q")).where("p > q").withColumn("value", F.expr("(p - q) * (p - q) div q"))
    terms = own.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).withColumn("part", F.lit("term"))
    out = ("lang", "source", "part", "item", "value", "rank")
    return pairs.select(*out).unionByName(terms.select(*out))
