"""SimHash fingerprints, linked by a binary-trie self-join under a Hamming budget.

Equal fingerprints are one node. Five blocks of the bits can't all differ within a
budget of four, so a fingerprint goes to one bucket for each block; a bucket that is
too large is dealt out again by five blocks of its remaining bits. In a bucket the
sorted fingerprints are a trie: pairs of its nodes are walked down together, differing
bits add up, and a pair of nodes ends where the budget is exceeded. A task gives
edges that span what it has linked, not all its pairs.

Null and empty texts have fingerprint zero and link like others. Rows with a null id
link too but never name a component; repeated rows link with each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .anchored import text_key

BLOCKS = 5
#: Rows of a bucket from which it is dealt out again, and how often that is done.
BUCKET_ROWS = 8192
LEVELS = (12, 10, 8)
PAIRS_AT_ONCE = 1 << 21


def fingerprint(text: str, words_each: int = 4, seed: int = 42) -> int:
    """64 bits, each set if over half the shingles' hashes set it."""
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < words_each:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        ends = list(accumulate(len(w) + 1 for w in words))
        starts = [0, *ends]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a : b - 1], seed) for a, b in zip(starts, ends[words_each - 1 :], strict=False)]
    set_ = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[at : at + (1 << 16)], dtype="<u8").view(np.uint8).reshape(-1, 8)
        set_ += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(set_ * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, tkey, fp``: the fingerprint of every whole text as a signed long; tkey tells texts of one id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            found = np.array([fingerprint(t) for t in common.text_rows(batch)], dtype=np.uint64)
            yield {"doc_id": batch.column("doc_id"), "tkey": batch.column("tkey"), "fp": found.view(np.int64)}

    return common.map_arrow(docs.select("doc_id", text_key(), "text"), run, "doc_id long, tkey long, fp long")


def trie_pairs(prints: np.ndarray, starts: np.ndarray, ends: np.ndarray, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions within ``budget`` bits in each run [start, end) of sorted unsigned fingerprints."""
    a0, a1, b0, b1 = starts, ends, starts, ends
    spent = np.zeros(len(starts), dtype=np.int64)
    for bit in range(63, -2, -1):
        small = (a1 - a0) * (b1 - b0) <= 64
        if bit < 0:
            small[:] = True
        yield from _verified(prints, a0[small], a1[small], b0[small], b1[small], budget)
        a0, a1, b0, b1, spent = (x[~small] for x in (a0, a1, b0, b1, spent))
        if not len(a0):
            return
        ma, mb = (_first_set(prints, lo, hi, bit) for lo, hi in ((a0, a1), (b0, b1)))
        own = a0 == b0
        children = (
            (a0, ma, b0, mb, spent, np.ones(len(a0), dtype=bool)),
            (ma, a1, mb, b1, spent, np.ones(len(a0), dtype=bool)),
            (a0, ma, mb, b1, spent + 1, np.ones(len(a0), dtype=bool)),
            (ma, a1, b0, mb, spent + 1, ~own),
        )
        parts = []
        for c0, c1, d0, d1, s, keep in children:
            keep = keep & (c1 > c0) & (d1 > d0) & (s <= budget)
            parts.append([x[keep] for x in (c0, c1, d0, d1, s)])
        a0, a1, b0, b1, spent = (np.concatenate(x) for x in zip(*parts, strict=True))


def _first_set(prints: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: int) -> np.ndarray:
    """First position of each run whose fingerprint has ``bit`` set; the bits above are equal in a run."""
    lo, hi = lo.copy(), hi.copy()
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        high = (prints[np.minimum(mid, len(prints) - 1)] >> np.uint64(bit)) & np.uint64(1) == 1
        hi = np.where(open_ & high, mid, hi)
        lo = np.where(open_ & ~high, mid + 1, lo)
    return lo


def _verified(prints, a0, a1, b0, b1, budget) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    width, total = b1 - b0, (a1 - a0) * (b1 - b0)
    upto = np.cumsum(total)
    at = 0
    while at < len(total):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS_AT_ONCE, side="right")))
        n = total[at:to]
        which = np.repeat(np.arange(at, to), n)
        k = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        i, j = a0[which] + k // width[which], b0[which] + k % width[which]
        near = (i < j) & (np.bitwise_count(prints[i] ^ prints[j]) <= budget)
        yield i[near], j[near]
        at = to


def spanning(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smallest position that each position is linked with, over the pairs."""
    label = np.arange(n)
    for i, j in pairs:
        while len(i):
            low = np.minimum(label[i], label[j])
            np.minimum.at(label, label[i], low)
            np.minimum.at(label, label[j], low)
            np.minimum.at(label, i, low)
            np.minimum.at(label, j, low)
            while (label[label] != label).any():
                label = label[label]
            apart = label[i] != label[j]
            i, j = i[apart], j[apart]
    return label


def links(prints: DataFrame, budget: int = 4) -> DataFrame:
    """Edges ``a, b`` that span every pair of distinct ``prints(fp)`` within ``budget`` bits."""
    if budget >= BLOCKS:
        raise ValueError(f"{BLOCKS} blocks allow a budget of {BLOCKS - 1} bits")
    todo = prints.select("fp", F.lit(0).cast("long").alias("bucket"), F.col("fp").alias("rest"))
    found = None
    for level, bits in enumerate(LEVELS):
        parts = [
            F.struct(
                ((F.col("bucket") * 8 + k) * 4096 + F.shiftrightunsigned("rest", k * bits).bitwiseAND(2**bits - 1)).alias("bucket"),
                F.shiftleft(F.shiftrightunsigned("rest", (k + 1) * bits), k * bits).bitwiseOR(F.col("rest").bitwiseAND(2 ** (k * bits) - 1)).alias("rest"),
            )
            for k in range(BLOCKS)
        ]
        keyed = todo.select("fp", F.explode(F.array(*parts)).alias("p")).select("fp", "p.bucket", "p.rest")
        sizes = keyed.groupBy("bucket").agg(F.count("*").alias("n"))
        large = common.stash(sizes.where(F.col("n") > BUCKET_ROWS).select("bucket"), "large") if level + 1 < len(LEVELS) else None
        more = large is not None and bool(large.take(1))
        now = keyed.join(large, "bucket", "left_anti") if more else keyed
        edges = _bucket_links(now.select("bucket", "fp"), budget)
        found = edges if found is None else found.union(edges)
        if not more:
            break
        todo = keyed.join(large, "bucket", "left_semi")
    return found.distinct()


def _bucket_links(keyed: DataFrame, budget: int) -> DataFrame:
    def edges(bucket: np.ndarray, fp: np.ndarray) -> dict:
        prints = (fp ^ np.int64(-(2**63))).view(np.uint64)
        starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        ends = np.r_[starts[1:], len(bucket)]
        many = ends - starts > 1
        label = spanning(len(fp), trie_pairs(prints, starts[many], ends[many], budget))
        linked = np.flatnonzero(label != np.arange(len(fp)))
        return {"a": fp[linked], "b": fp[label[linked]]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held = [np.empty(0, dtype=np.int64)] * 2
        for batch in batches:
            held = [np.concatenate([h, batch.column(c).to_numpy()]) for h, c in zip(held, ("bucket", "fp"), strict=True)]
            if len(held[0]) > 200_000 and held[0][0] != held[0][-1]:
                cut = int(np.searchsorted(held[0], held[0][-1]))
                yield edges(*(h[:cut] for h in held))
                held = [h[cut:] for h in held]
        if len(held[0]):
            yield edges(*held)

    return common.map_arrow(keyed.repartition("bucket").sortWithinPartitions("bucket", "fp"), run, "a long, b long")


def groups(docs: DataFrame, budget: int = 4) -> DataFrame:
    """``doc_id, tkey, fp, root, component_id``: documents grouped by linked fingerprints; ``root`` is one fingerprint of the group."""
    prints = common.stash(fingerprints(docs), "fingerprints")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("low"))
    found = common.components(links(nodes, budget))
    rooted = nodes.join(found, nodes.fp == found.node, "left").select("fp", "low", F.coalesce("component", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    return prints.join(rooted.select("fp", "root").join(lowest, "root"), "fp").select("doc_id", "tkey", "fp", "root", "component_id")


def hex_of(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, budget: int = 4) -> DataFrame:
    """One row of each group stays: one with the smallest id, or if no row has an id any one."""
    first = groups(docs, budget).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    id_, other, key, place = common.free(docs, "_tm_id", "_tm_other", "_tm_key", "_tm_n")
    first = first.groupBy("root").agg(F.min(F.struct("doc_id", "tkey")).alias("one")).select(F.col("one.doc_id").alias(id_), F.col("one.tkey").alias(other))
    keyed = docs.withColumn(key, text_key())
    same = F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(key) == F.col(other))
    kept = keyed.join(first, same, "left_semi")
    order = Window.partitionBy("doc_id", key).orderBy(key)
    return kept.withColumn(place, F.row_number().over(order)).where(F.col(place) == 1).drop(place, key)
