"""Embedding near-dedup: cross-polytope hashing after fast Hadamard rotations.

Equal vectors are one class. A class goes to a bucket for each table: the nearest
corners of two or more pseudo-random rotations (three rounds of signs and fast Hadamard
transforms); multiprobe adds the buckets with the next corner of one rotation. A code
takes as many rotations as the number of classes asks for, so buckets stay small, and
longer codes come with more tables, which keep the recall. Sizes of buckets are
counted on ids alone; only classes that meet another in a bucket travel there, once for
each bucket, with their components as they came. Pairs that share a bucket (one of them
by its own corners) are verified by cosine in double precision, in blocks for large
buckets. A pair that meets in several buckets counts in the first only, so links are
counted without listing pairs; each task gives edges that span its links.

Vectors that are null, zero, or hold null or non-finite components link with nothing,
as do rows without an id. Vectors of different sizes never link. Rows are vectors of
their own, also if they share an id or are equal in all, and link with each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from . import common, simhash

BLOCK = 1024
#: Buckets of so many classes are verified pair by pair, larger ones by matrix products.
SMALL = 64
#: Classes for each possible code beyond which codes take one rotation more.
CROWDED = 8
#: Codes of large spaces are folded below this prime; what then shares a bucket is told apart by its cosine.
FOLD = (1 << 31) - 1


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Hadamard transform of the rows; their size is a power of two."""
    h, x = 1, x.copy()
    while h < x.shape[1]:
        y = x.reshape(len(x), -1, 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), -1)
        h *= 2
    return x


def turns_for(classes: int, components: int) -> int:
    """Rotations a code takes, so that it has a value for every CROWDED classes at least."""
    faces, turns = 2 << max(1, (components - 1).bit_length()), 2
    while classes > CROWDED * faces**turns:
        turns += 1
    return turns


def corners(x: np.ndarray, tables: int, seed: int, turns: int = 2) -> np.ndarray:
    """Corners of unit vectors: (rows, tables, turns + 1), own corners first and then the probes, each with the next corner of one rotation."""
    n, d = x.shape
    size = 1 << max(1, (d - 1).bit_length())
    padded = np.zeros((n, size))
    padded[:, :d] = x
    rng = np.random.default_rng([seed, d])
    codes = np.empty((n, tables, turns + 1), dtype=np.int32)
    for t in range(tables):
        nearest, following = [], []
        for _ in range(turns):
            y = padded
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], size)) / np.sqrt(size)
            far = np.abs(y)
            top = np.argpartition(-far, 1, axis=1)[:, :2]
            swap = np.take_along_axis(far, top, 1)
            top = np.where((swap[:, :1] >= swap[:, 1:]), top, top[:, ::-1])
            sign = np.take_along_axis(y, top, 1) < 0
            code = top * 2 + sign
            nearest.append(code[:, 0])
            following.append(code[:, 1])
        for k in range(turns + 1):
            code = np.zeros(n, dtype=np.int64)
            for turn in range(turns):
                code = (code * 2 * size + (following if turn == k - 1 else nearest)[turn]) % FOLD
            # Two codes that fold to one are one bucket, where the class is already; the second moves on.
            while (same := (codes[:, t, :k] == code[:, None]).any(axis=1)).any():
                code[same] = (code[same] + 1) % FOLD
            codes[:, t, k] = code
    return codes


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of finite components, not all zero, as unit vectors in double precision."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def classes(vectors: DataFrame) -> DataFrame:
    """``vec_id, key, vec``: digest and components (as bytes), null for vectors that link with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            keys, vecs = [], []
            for value, id_ in zip(batch.column("embedding"), batch.column("vec_id"), strict=True):
                key = vec = None
                own = value.values
                if own is not None and len(own) and not own.null_count and id_.is_valid:
                    x = own.to_numpy(zero_copy_only=False) + 0  # -0.0 is 0.0
                    if np.isfinite(x).all() and x.any():
                        vec = x.tobytes()
                        key = hashlib.md5(vec).digest()
                keys.append(key)
                vecs.append(vec)
            yield {"vec_id": batch.column("vec_id"), "key": keys, "vec": vecs}

    return common.map_arrow(vectors.select("vec_id", "embedding"), run, "vec_id long, key binary, vec binary")


def _matrix(vecs: pa.Array, kind: type) -> np.ndarray:
    """Rows of equally long binary cells as a matrix."""
    return np.frombuffer(b"".join(vecs.to_pylist()), dtype=kind).reshape(len(vecs), -1)


def _bucketed(nodes: DataFrame, kind: type, tables: int, seed: int, turns: int) -> DataFrame:
    """``key, low, mult, vec, codes, places``: codes lists the own corners and the probes of each table, places numbers their buckets over all sizes and tables."""

    width = tables * (turns + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            raw = batch.column("vec")
            sizes = pc.binary_length(raw).to_numpy()
            codes, places = np.empty((len(raw), width), dtype=np.int32), np.empty((len(raw), width), dtype=np.int64)
            for size in np.unique(sizes):
                which = np.flatnonzero(sizes == size)
                x = _matrix(raw.take(pa.array(which)), kind)
                codes[which] = corners(_unit(x), tables, seed, turns).reshape(len(which), -1)
                places[which] = (x.shape[1] * tables + np.arange(width) // (turns + 1) << 32) + codes[which]
            edges = pa.array(np.arange(len(raw) + 1, dtype=np.int32) * width)
            lists = {"codes": pa.ListArray.from_arrays(edges, pa.array(codes.ravel())), "places": pa.ListArray.from_arrays(edges, pa.array(places.ravel()))}
            yield {c: batch.column(c) for c in ("key", "low", "mult", "vec")} | lists

    return common.map_arrow(nodes, run, "key binary, low long, mult long, vec binary, codes array<int>, places array<long>")


def linked(vectors: DataFrame, least: float = 0.95, tables: int = 8, seed: int = 7, turns: int | None = None) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every vector. ``tables`` are those of codes of two rotations; each rotation more adds as many."""
    kind = np.float32 if vectors.schema["embedding"].dataType.elementType == FloatType() else np.float64
    rows = common.stash(classes(vectors.withColumn("embedding", F.col("embedding").cast("array<float>" if kind is np.float32 else "array<double>"))), "vectors")
    known = rows.where("key is not null")
    nodes = known.groupBy("key").agg(F.min("vec_id").alias("low"), F.count("*").alias("mult"), F.first("vec").alias("vec"))
    nodes = common.stash(nodes, "nodes")
    if turns is None:
        size = nodes.agg(F.count("*").alias("n"), F.min(F.octet_length("vec")).alias("bytes")).first()
        turns = turns_for(size["n"], (size["bytes"] or 0) // np.dtype(kind).itemsize)
    hashed = common.stash(_bucketed(nodes, kind, tables * (turns - 1), seed, turns).withColumn("node", F.monotonically_increasing_id()), "hashed")
    common.discard(nodes)
    probes = turns + 1
    keyed = hashed.select("node", F.posexplode("places").alias("place", "bucket"))
    sizes = keyed.groupBy("bucket").agg(F.count("*").alias("size"), F.count_if(F.col("place") % probes == 0).alias("own")).where("size > 1 and own > 0")
    sizes = sizes.select("bucket", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    # A class has at most turns + 1 places for each table.
    met = keyed.join(sizes, "bucket").groupBy("node").agg(F.collect_list(F.struct("place", "bucket", "blocks")).alias("met"))
    met = hashed.select("node", "mult", "vec", "codes").join(met, "node").select("node", "mult", "vec", "codes", F.inline("met"))
    met = met.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # A block meets itself and every other block of its bucket once.
    dealt = met.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))
    found = common.stash(_verified(dealt.select("bucket", "lo", "hi", "block", "place", "node", "mult", "vec", "codes"), kind, least, probes), "links")
    more = found.where("links > 0").groupBy("a").agg(F.sum("links").alias("links"))
    parts = common.components(found.select("a", "b"))
    named = hashed.select("key", "node", "low", "mult").join(more, F.col("node") == F.col("a"), "left").join(parts.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left")
    named = named.select("key", "low", F.coalesce("component", "node").alias("root"), (F.col("mult") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"))
    smallest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    named = common.stash(named.join(smallest, "root").select("key", "n_links", "component_id"), "named")
    for done in (hashed, found):
        common.discard(done)
    alone = rows.where("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    every = known.select("vec_id", "key").join(named, "key").select("vec_id", "n_links", "component_id").union(alone)
    return every.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _verified(dealt: DataFrame, kind: type, least: float, probes: int) -> DataFrame:
    """``a, b, links``: for each class and block pair the rows it links with that meet it here first, and an edge."""

    def near_pairs(heads: np.ndarray, ends: np.ndarray, x: list[np.ndarray], own: np.ndarray, block: np.ndarray, crossed: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions of pairs that link, of all block pairs in the rows."""
        small = ends - heads <= SMALL
        group = np.repeat(np.arange(len(heads)), ends - heads)
        for matrix, first in x:  # runs of rows whose vectors have one size
            inside = np.arange(first, first + len(matrix))
            inside = inside[small[group[inside]]]
            for step in range(1, SMALL):
                i = inside[inside + step < len(group)]
                i = i[group[i] == group[i + step]]
                if not len(i):
                    break
                j = i + step
                meet = (own[i] | own[j]) & (~crossed[i] | (block[i] != block[j]))
                i, j = i[meet], j[meet]
                for at in range(0, len(i), 1 << 14):
                    a, b = i[at : at + (1 << 14)], j[at : at + (1 << 14)]
                    near = np.einsum("ij,ij->i", matrix[a - first], matrix[b - first]) >= least
                    yield a[near], b[near]
            for g in np.flatnonzero(~small):
                if not first <= heads[g] < first + len(matrix):
                    continue
                of = np.arange(heads[g], ends[g])
                if crossed[heads[g]]:
                    left, right = of[block[of] == block[of].min()], of[block[of] == block[of].max()]
                else:
                    left = right = of
                for at in range(0, len(left), BLOCK):
                    i = left[at : at + BLOCK]
                    near = (matrix[i - first] @ matrix[right - first].T >= least) & (own[i][:, None] | own[right][None, :])
                    if left is right:
                        near &= i[:, None] < right[None, :]
                    a, b = np.nonzero(near)
                    yield i[a], right[b]

    def judge(rows: pa.RecordBatch) -> dict:
        n = rows.num_rows
        bucket, lo, hi, block, place, node, mult = (rows.column(c).to_numpy() for c in ("bucket", "lo", "hi", "block", "place", "node", "mult"))
        codes = rows.column("codes").flatten().to_numpy().reshape(n, -1)
        heads = np.flatnonzero(_new(bucket, lo, hi))
        sizes = pc.binary_length(rows.column("vec")).to_numpy()
        turns = np.flatnonzero(np.r_[True, sizes[1:] != sizes[:-1]]).tolist() + [n]
        x = [(_unit(_matrix(rows.column("vec").slice(a, b - a), kind)), a) for a, b in pairwise(turns)]
        count = np.zeros(n, dtype=np.int64)

        def counted() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for p, q in near_pairs(heads, np.r_[heads[1:], n], x, place % probes == 0, block, lo != hi):
                for at in range(0, len(p), 1 << 16):
                    a, b = p[at : at + (1 << 16)], q[at : at + (1 << 16)]
                    table, code = _first_meeting(codes[a], codes[b], probes)
                    first = (table == place[a] // probes) & (code == codes[a, place[a]])
                    count[:] += np.bincount(a[first], mult[b[first]], n).astype(np.int64) + np.bincount(b[first], mult[a[first]], n).astype(np.int64)
                yield p, q

        label = simhash.spanning(n, counted())
        which = np.flatnonzero((label != np.arange(n)) | (count > 0))
        return {"a": node[which], "b": node[label[which]], "links": count[which]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch if held is None else pa.concat_batches([held, batch])
            last = int(np.flatnonzero(_new(*(rows.column(c).to_numpy() for c in ("bucket", "lo", "hi"))))[-1])
            if last:
                yield judge(rows.slice(0, last))
            held = rows.slice(last)  # a block pair may go on in the next batch
        if held is not None:
            yield judge(held)

    return common.map_arrow(dealt.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi"), run, "a long, b long, links long")


def _new(*keys: np.ndarray) -> np.ndarray:
    """Where any of the keys changes."""
    return np.r_[True, np.logical_or.reduce([k[1:] != k[:-1] for k in keys])]


def _first_meeting(a: np.ndarray, b: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """Table and code of the first bucket that two classes share with one of them there by its own corners."""
    table, code = np.full(len(a), -1), np.full(len(a), -1, dtype=np.int32)
    for t in range(0, a.shape[1], probes):
        low = np.full(len(a), np.iinfo(np.int32).max, dtype=np.int32)
        for i, j in [(0, k) for k in range(probes)] + [(k, 0) for k in range(1, probes)]:
            same = a[:, t + i] == b[:, t + j]
            low[same] = np.minimum(low[same], a[same, t + i])
        new = (table < 0) & (low < np.iinfo(np.int32).max)
        table[new], code[new] = t // probes, low[new]
    return table, code
