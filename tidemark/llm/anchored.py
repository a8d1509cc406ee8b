"""Anchored runs of windows: how repeated windows of a sequence are found without a row for each window.

Every window of ``length`` symbols is anchored at its leftmost smallest hash of
``anchor`` symbols. Consecutive windows with the same anchor form a run, one row that
stands for all of them. Equal windows are anchored alike, so
1. runs whose anchor occurs once have no repeated window and go;
2. runs of equal content are one class with its count and smallest document;
3. where an anchor has several classes, one run of each class travels to the anchor's
   bucket as one packed string of its symbols. There the strings are sorted twice: by
   what comes before the anchor, read backwards, and by what follows. Ranks in both
   orders, cut at a window's two ends, tell exactly which windows are equal;
4. an anchor with more classes than one task should hold is split: its runs are cut
   into short stretches by the windows' distance from the anchor. What all windows of a
   stretch have in common is its core; stretches whose core occurs once go, and the
   windows of the others are grouped with map-side combine.
Equal content, of runs in 2 and of windows in 4, means equal values of two polynomials
over their symbols, at two points drawn once from the field of 2^61 - 1 elements. Two
given sequences of n symbols that differ agree in both with a chance below (n / 2^61)^2.
The smallest hashes only choose anchors and buckets; a collision there costs time.
No step needs the rows of a hot key in one task; joins are sort-merge joins that adaptive
execution can split.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: An odd multiplier for the hash that orders anchors.
BASE = np.uint64(0x9E3779B97F4A7C15)
#: The field of the fingerprints and the points at which they are taken, drawn from a fixed seed.
PRIME = (1 << 61) - 1
POINTS = tuple(map(int, np.random.default_rng(61).integers(1 << 40, PRIME, 2)))
MIX = np.uint64(0xFF51AFD7ED558CCD)
#: Symbols handled at once; longer texts are cut into pieces that overlap by a window.
PIECE = 1 << 17
LOW_BITS = np.uint64((1 << 21) - 1)
#: Windows that a bucket's classes may have; a bucket with more is split, and smaller ones are handled together up to it.
CELLS = 1_500_000
#: A key with more rows than one in SHARE of all, LEAST at least, is dealt over several tasks.
SHARE, LEAST = 10_000, 1_000
#: Packed strings written in one batch.
FLUSH = 4_000


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX
    return x ^ (x >> np.uint64(29))


def field(x: np.ndarray) -> np.ndarray:
    """Numbers below 2^64 modulo the prime."""
    x = (x & np.uint64(PRIME)) + (x >> np.uint64(61))
    return np.where(x >= PRIME, x - np.uint64(PRIME), x)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of field elements, from halves of 31 bits: 2^62 is 2 there, and 2^61 is 1."""
    half, low = np.uint64(31), np.uint64((1 << 31) - 1)
    ah, al, bh, bl = a >> half, a & low, b >> half, b & low
    mid = ah * bl + al * bh
    return field(((ah * bh) << np.uint64(1)) + (mid >> np.uint64(30)) + ((mid & np.uint64((1 << 30) - 1)) << half) + al * bl)


def running(x: np.ndarray) -> np.ndarray:
    """Sums of the first 0, 1, ... field elements."""
    out = np.zeros(len(x) + 1, dtype=np.uint64)
    high = np.cumsum(x >> np.uint64(32))
    shifted = (high >> np.uint64(29)) + ((high & np.uint64((1 << 29) - 1)) << np.uint64(32))
    out[1:] = field(field(shifted) + field(np.cumsum(x & np.uint64((1 << 32) - 1))))
    return out


class Powers:
    """Powers of numbers and of their inverses as far as a piece needs them: of BASE modulo 2^64, and of POINTS in the field."""

    def __init__(self):
        self.plain: tuple[np.ndarray, ...] = ()
        self.points: list[tuple[np.ndarray, np.ndarray]] = []

    def upto(self, n: int) -> tuple[np.ndarray, ...]:
        if not self.plain or len(self.plain[0]) < n:
            found = []
            for b in (int(BASE), pow(int(BASE), -1, 1 << 64)):
                steps = np.full(n, b, dtype=np.uint64)
                steps[0] = 1
                found.append(np.multiply.accumulate(steps))
            self.plain = tuple(found)
        return self.plain

    def in_field(self, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
        if not self.points or len(self.points[0][0]) < n:
            self.points = [(self._doubled(b, n), self._doubled(pow(b, -1, PRIME), n)) for b in POINTS]
        return self.points

    @staticmethod
    def _doubled(base: int, n: int) -> np.ndarray:
        out = np.ones(1, dtype=np.uint64)
        while len(out) < n:
            out = np.concatenate([out, product(out, np.uint64(pow(base, len(out), PRIME)))])
        return out[:n]


POWERS = Powers()


class Hashed:
    """Hashes of any stretch of a symbol sequence from running sums.

    ``symbols`` has a row of numbers, or two that are independent of each other, one for each point.
    """

    def __init__(self, symbols: np.ndarray):
        self.symbols, self.n = symbols, symbols.shape[1]
        self.room = max(2 * PIECE, self.n) + 1
        power, self.inverse = POWERS.upto(self.room)
        self.total = np.zeros(self.n + 1, dtype=np.uint64)
        np.cumsum(symbols[0] * power[: self.n], out=self.total[1:])
        self.sums: list[np.ndarray] = []

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.total[end] - self.total[start]) * self.inverse[start])

    def all(self, length: int) -> np.ndarray:
        n = self.n - length + 1
        return mixed((self.total[length:] - self.total[:n]) * self.inverse[:n])

    def prints(self, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
        """Fingerprints of stretches, one for each point."""
        points = POWERS.in_field(self.room)
        if not self.sums:
            self.sums = [running(product(field(row), power[: self.n])) for row, (power, _) in zip((self.symbols[0], self.symbols[-1]), points, strict=True)]
        prime = np.uint64(PRIME)
        return [product(field(total[end] + prime - total[start]), inverse[start]).view(np.int64) for total, (_, inverse) in zip(self.sums, points, strict=True)]


def runs(hashed: Hashed, first: np.ndarray, last: np.ndarray, length: int, anchor: int) -> dict[str, np.ndarray]:
    """Runs of windows in a piece whose sequences are [first, last): position, windows, the anchor's place in the run and its hash."""
    none = np.empty(0, dtype=np.int64)
    if hashed.n > int(LOW_BITS):
        raise ValueError(f"{hashed.n} symbols at once; an anchor's place has room for {int(LOW_BITS)}")
    if hashed.n < length:
        return {"at": none, "n": none, "spot": none, "k": none}
    own = hashed.all(anchor)
    keys = own & ~LOW_BITS | np.arange(len(own), dtype=np.uint64)
    span, power, low = length - anchor + 1, 1, keys
    while 2 * power <= span:
        low = np.minimum(low[: len(low) - power], low[power:])
        power *= 2
    windows = hashed.n - length + 1
    low = np.minimum(low[:windows], low[span - power : span - power + windows])
    place = (low & LOW_BITS).astype(np.int64)
    fits = np.zeros(hashed.n + 1, dtype=np.int32)
    enough = last - first >= length
    np.add.at(fits, first[enough], 1)
    np.add.at(fits, last[enough] - length + 1, -1)
    inside = np.cumsum(fits)[:windows] > 0
    new = inside.copy()
    new[1:] &= (place[1:] != place[:-1]) | ~inside[:-1]
    heads = np.zeros(hashed.n + 1, dtype=bool)
    heads[first[enough]] = True
    new |= heads[:windows] & inside
    at = np.flatnonzero(new)
    upto = np.cumsum(inside)
    ends = np.r_[at[1:], windows]
    n = upto[ends - 1] - upto[at] + 1
    spot = place[at]
    return {"at": at, "n": n, "spot": spot - at, "k": own[spot].view(np.int64)}


@dataclass(frozen=True)
class Symbols:
    """How a text is read as symbols.

    ``numbers``: rows of a number below 2^61 for each symbol of a text, from which hashes are made.
    ``split``: the symbols themselves; ``pack``: some of them as one string.
    ``units``: the symbols of packed strings in a row as unsigned big-endian numbers that are equal only for equal symbols.
    """

    numbers: Callable[[str], np.ndarray]
    split: Callable[[str], Sequence]
    pack: Callable[[Sequence], bytes]
    units: Callable[[list[bytes]], np.ndarray]


def _pieces(texts: Iterator[str], symbols: Callable[[str], np.ndarray], length: int) -> Iterator[tuple[np.ndarray, list, list, list, list]]:
    """Symbols of several texts in a row, with each stretch's bounds, row and offset in its text."""
    held, first, last, row, offset, size = [], [], [], [], [], 0
    for k, text in enumerate(texts):
        own = symbols(text)
        for at in range(0, max(own.shape[1] - length, 0) + 1, PIECE):
            part = own[:, at : at + PIECE + length - 1]
            if part.shape[1] < length:
                continue
            held.append(part)
            first.append(size)
            size += part.shape[1]
            last.append(size)
            row.append(k)
            offset.append(at)
            if size >= PIECE:
                yield np.concatenate(held, axis=1), first, last, row, offset
                held, first, last, row, offset, size = [], [], [], [], [], 0
    if held:
        yield np.concatenate(held, axis=1), first, last, row, offset


def text_key(column: str = "text"):
    """Tells rows with the same id and other texts apart."""
    return F.xxhash64(F.coalesce(F.col(column), F.lit(""))).alias("tkey")


def run_rows(docs: DataFrame, symbols: Symbols, length: int, anchor: int) -> DataFrame:
    """``doc_id, tkey, at, n, spot, k, t, u``: every run of every text; ``t, u`` are its content's fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            ids, keys = (batch.column(c) for c in ("doc_id", "tkey"))
            for joined, first, last, row, offset in _pieces(common.text_rows(batch), symbols.numbers, length):
                first, last, row, offset = (np.array(x, dtype=np.int64) for x in (first, last, row, offset))
                hashed = Hashed(joined)
                found = runs(hashed, first, last, length, anchor)
                t, u = hashed.prints(found["at"], found["at"] + found["n"] + length - 1)
                which = np.searchsorted(first, found["at"], side="right") - 1
                rows = pa.array(row[which])
                yield {"doc_id": ids.take(rows), "tkey": keys.take(rows), "at": (found["at"] - first[which] + offset[which]).astype(np.int32), "n": found["n"].astype(np.int32), "spot": found["spot"].astype(np.int32), "k": found["k"], "t": t, "u": u}

    return common.map_arrow(docs.select("doc_id", text_key(), "text"), run, "doc_id long, tkey long, at int, n int, spot int, k long, t long, u long")


def anchor_counts(docs: DataFrame, symbols: Symbols, length: int, anchor: int) -> DataFrame:
    """``k, c``: how often each anchor occurs, summed in the task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for joined, first, last, _, _ in _pieces(common.text_rows(batch), symbols.numbers, length):
                found = runs(Hashed(joined), np.array(first), np.array(last), length, anchor)
                k, c = np.unique(found["k"], return_counts=True)
                yield {"k": k, "c": c.astype(np.int32)}

    return common.map_arrow(docs.select("text"), run, "k long, c int").groupBy("k").agg(F.sum("c").alias("c"))


def _dealt_join(rows: DataFrame, keyed: DataFrame, counts: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join of runs with a table of distinct keys and their counts ``c``, which ``counts`` has too; rows of frequent keys are dealt over several tasks.

    At most SHARE keys are frequent enough, so they can be broadcast, and their copies in
    ``keyed`` are at most twice as many.
    """
    total = counts.agg(F.sum("c")).first()[0] or 0
    share = max(total // SHARE, LEAST)
    hot = F.broadcast(counts.where(F.col("c") > share).select(*keys, F.ceil(F.col("c") / share).cast("int").alias("_parts")))
    one = F.coalesce("_parts", F.lit(1))
    left = rows.join(hot, keys, "left").withColumn("_part", F.pmod(F.xxhash64("doc_id", "at"), one).cast("int")).drop("_parts")
    right = keyed.withColumn("_part", F.explode(F.sequence(F.lit(0), F.when(F.col("c") > share, F.ceil(F.col("c") / share).cast("int")).otherwise(1) - 1)))
    return left.join(right, [*keys, "_part"]).drop("_part")


def flagged(docs: DataFrame, symbols: Symbols, length: int, anchor: int, earlier: bool) -> DataFrame:
    """``doc_id, tkey, found``: for each text the stretches (at, n) of windows that are repeated.

    ``earlier``: a window counts if it also starts in a document with a smaller id;
    otherwise if it also starts anywhere else. With ``earlier``, rows without an id
    take no part.
    """
    docs = docs.where("doc_id is not null") if earlier else docs
    often = common.stash(anchor_counts(docs, symbols, length, anchor).where("c > 1"), "often")
    every = run_rows(docs, symbols, length, anchor)
    rows = common.stash(_dealt_join(every, often, often, ["k"]).select(*every.columns), "runs")
    common.discard(often)
    classes = rows.groupBy("k", "t", "u").agg(F.count("*").alias("c"), F.min("doc_id").alias("low"), F.min(F.struct("doc_id", "tkey", "at", "n", "spot")).alias("one"))
    classes = common.stash(classes, "classes")
    most = max(1, CELLS // (length - anchor + 1))
    several = classes.groupBy("k").agg(F.count("*").alias("_classes"), F.min("c").alias("_least"))
    several = several.where("_classes > 1" if earlier else "_classes > 1 and _least = 1").select("k", (F.col("_classes") > most).alias("wide"))
    run = F.struct("one.at", "one.n", "one.spot", "k", "t", "u", "c", F.coalesce("low", F.lit(0)).alias("low"), "wide")
    unsure = classes.join(several, "k").groupBy("one.doc_id", "one.tkey").agg(F.collect_list(run).alias("runs"))
    packed = common.stash(_packed(docs, unsure, symbols, length, anchor), "packed")
    buckets = packed.where("core is null").select("k", "t", "u", "c", "low", "n", "spot", "packed").repartition("k").sortWithinPartitions("k")
    stretches = packed.where("core is not null").select("core", "k", "t", "u", "c", "low", "o", "prints")
    cores = stretches.groupBy("core").agg(F.count("*").alias("_n")).where("_n > 1").select("core")
    windows = stretches.join(cores, "core", "left_semi").select("core", "k", "t", "u", "c", "low", "o", F.posexplode("prints").alias("_more", "w"))
    windows = common.stash(windows.select("core", "w", "k", "t", "u", "c", "low", (F.col("o") + F.col("_more")).alias("o")), "windows")
    shared = windows.groupBy("core", "w").agg(F.count("*").alias("_c"), F.min("low").alias("_low")).where("_c > 1")
    again = windows.join(shared, ["core", "w"])
    again = again.where("_low < low") if earlier else again.where("c = 1")
    split = again.groupBy("k", "t", "u").agg(F.collect_list("o").alias("spots"))
    spots = common.stash(_bucket_spots(buckets, symbols, length, anchor, earlier).unionByName(split), "spots")
    common.discard(packed)
    common.discard(windows)
    judged = classes.select("k", "t", "u", "c", "low").join(spots, ["k", "t", "u"], "left")
    both = _dealt_join(rows, judged, classes, ["k", "t", "u"])
    whole = F.col("low") < F.col("doc_id") if earlier else F.col("c") > 1
    stretches = F.when(whole, F.array(F.struct("at", "n"))).otherwise(F.transform(F.coalesce("spots", F.array().cast("array<int>")), lambda o: F.struct((F.col("at") + o).alias("at"), F.lit(1).alias("n"))))
    return both.where(whole | F.col("spots").isNotNull()).groupBy("doc_id", "tkey").agg(F.flatten(F.collect_set(stretches)).alias("found"))


def _packed(docs: DataFrame, unsure: DataFrame, symbols: Symbols, length: int, anchor: int) -> DataFrame:
    """The given runs as packed strings, those of wide buckets as stretches.

    ``k, t, u, c, low`` of the run; for packed strings ``n`` windows and ``spot``, the
    anchor's place in the string; for stretches ``core``, the first window's place ``o``
    in its run and ``prints``, the windows' fingerprints.
    """
    own = unsure.withColumnRenamed("doc_id", "_id").withColumnRenamed("tkey", "_key")
    texts = docs.select("doc_id", text_key(), "text")
    both = texts.join(own, texts.doc_id.eqNullSafe(own._id) & (F.col("tkey") == F.col("_key"))).select("text", "runs")
    most = length - anchor
    step = max(1, most // 15)
    names = ("k", "t", "u", "c", "low")

    def strings(runs_of: dict, held: list[np.ndarray], packed: list[bytes]) -> dict:
        of = np.concatenate(held)
        out = {c: runs_of[c][of] for c in (*names, "n", "spot")}
        return out | {"packed": packed, "core": pa.nulls(len(packed)), "o": pa.nulls(len(packed)), "prints": pa.nulls(len(packed))}

    def stretches(hashed: Hashed, start: np.ndarray, many: np.ndarray, spot: np.ndarray, run_of: dict) -> dict:
        which = np.repeat(np.arange(len(start)), many)
        o = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
        first = start[which] + o
        part = (spot[which] - first) // step
        heads = np.flatnonzero(np.r_[True, (which[1:] != which[:-1]) | (part[1:] != part[:-1])])
        row, near = which[heads], part[heads] * step
        far = np.minimum(near + step - 1, most)
        prints = pa.StructArray.from_arrays(hashed.prints(first, first + length), names=["a", "b"])
        return {c: run_of[c][row] for c in names} | {
            "core": hashed.of(spot[row] - near, spot[row] - far + length).view(np.int64),
            "o": o[heads].astype(np.int32),
            "prints": pa.ListArray.from_arrays(pa.array(np.r_[heads, len(which)].astype(np.int32)), prints),
        } | {c: pa.nulls(len(heads)) for c in ("n", "spot", "packed")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            lists = batch.column("runs")
            at, n, spot, *rest, wide = (x.to_numpy(zero_copy_only=False) for x in lists.flatten().flatten())
            runs_of = dict(zip(names, rest, strict=True)) | {"n": n, "spot": spot}
            ends = np.cumsum(lists.value_lengths().to_numpy()).tolist()
            held, packed = [], []
            for text, begin, end in zip(common.text_rows(batch), [0, *ends], ends):
                hot = wide[begin:end]
                short, long = begin + np.flatnonzero(~hot), begin + np.flatnonzero(hot)
                if len(short):
                    seq = symbols.split(text)
                    held.append(short)
                    packed += [symbols.pack(seq[a : a + m + length - 1]) for a, m in zip(at[short].tolist(), n[short].tolist(), strict=True)]
                if len(long):
                    numbers = symbols.numbers(text)
                    for piece in range(0, numbers.shape[1], PIECE):
                        of = long[(at[long] >= piece) & (at[long] < piece + PIECE)]
                        if len(of):
                            start = at[of].astype(np.int64) - piece
                            yield stretches(Hashed(numbers[:, piece : piece + PIECE + length - 1]), start, n[of].astype(np.int64), start + spot[of], {c: runs_of[c][of] for c in names})
                if len(packed) >= FLUSH:
                    yield strings(runs_of, held, packed)
                    held, packed = [], []
            if packed:
                yield strings(runs_of, held, packed)

    return common.map_arrow(both, run, "k long, t long, u long, c long, low long, n int, spot int, packed binary, core long, o int, prints array<struct<a: long, b: long>>")


def _sorted_groups(keys: list[bytes], width: int, depths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key's rank in the order of all, and for each depth and rank where the group begins that agrees in so many symbols.

    Keys start with four bytes that must agree at every depth.
    """
    order = sorted(range(len(keys)), key=keys.__getitem__)
    common_ = np.full(len(keys), -1, dtype=np.int64)
    for i, (x, y) in enumerate(pairwise(order), 1):
        a, b = keys[x], keys[y]
        n = min(len(a), len(b))
        differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
        common_[i] = (n - (differ.bit_length() + 7) // 8 - 4) // width
    begins = np.where(common_ < depths[:, None], np.arange(len(keys)), 0)
    rank = np.empty(len(keys), dtype=np.int64)
    rank[order] = np.arange(len(keys))
    return rank, np.maximum.accumulate(begins, axis=1)


def _repeated(rows: dict, packed: list[bytes], symbols: Symbols, length: int, anchor: int, earlier: bool) -> Iterator[tuple[int, np.ndarray]]:
    """(row, places of windows in the row's run) of windows that are repeated among the packed strings of some buckets.

    The order of what precedes an anchor, read backwards from it, and the order of
    what starts at it combine into the order of the windows: a window that has o
    symbols before its anchor is its group at depth o in the first and at depth
    ``length - o`` in the second.
    """
    k, n, spot, c, low = (rows[x].astype(np.int64) for x in ("k", "n", "spot", "c", "low"))
    size, most, m = n + length - 1, length - anchor, len(k)
    units = symbols.units(packed)
    width, total = units.itemsize, len(units)
    ahead, back = units.tobytes(), units[::-1].tobytes()
    start = np.cumsum(size) - size
    at = start + spot
    buckets = np.cumsum(np.r_[0, k[1:] != k[:-1]]).astype(">u4").tobytes()
    before, after = [], []
    for i, (s, p, e) in enumerate(zip(start.tolist(), at.tolist(), (start + size).tolist(), strict=True)):
        bucket = buckets[4 * i : 4 * i + 4]
        before.append(bucket + back[(total - p) * width : (total - s) * width])
        after.append(bucket + ahead[p * width : e * width])
    depths = np.arange(most + 1)
    rank, begins = _sorted_groups(before, width, depths)
    rank_after, begins_after = _sorted_groups(after, width, length - depths)
    row = np.repeat(np.arange(m), n)
    place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    o = spot[row] - place
    code = (o * m + begins[o, rank[row]]) * m + begins_after[o, rank_after[row]]
    order = np.argsort(code, kind="stable")
    heads = np.flatnonzero(np.r_[True, code[order][1:] != code[order][:-1]])
    counts = np.diff(np.r_[heads, len(code)])
    if earlier:
        again = np.repeat(np.minimum.reduceat(low[row[order]], heads), counts) < low[row[order]]
    else:
        again = (np.repeat(counts, counts) > 1) & (c[row[order]] == 1)
    chosen = np.sort(order[again])
    if not len(chosen):
        return
    of, first = np.unique(row[chosen], return_index=True)
    yield from zip(of.tolist(), np.split(place[chosen], first[1:]), strict=True)


def _bucket_spots(buckets: DataFrame, symbols: Symbols, length: int, anchor: int, earlier: bool) -> DataFrame:
    """``k, t, u, spots``: the repeated windows of each packed run; the rows of a bucket come one after another."""
    most = max(1, CELLS // (length - anchor + 1))

    def judge(batch: pa.RecordBatch) -> Iterator[dict]:
        rows = {x: batch.column(x).to_numpy() for x in ("k", "t", "u", "c", "low", "n", "spot")}
        packed = batch.column("packed").to_pylist()
        heads = np.flatnonzero(np.r_[True, rows["k"][1:] != rows["k"][:-1]])
        cuts = heads[np.flatnonzero(np.r_[True, heads[1:] // most != heads[:-1] // most])].tolist() + [len(packed)]
        for low, high in pairwise(cuts):
            part = {x: v[low:high] for x, v in rows.items()}
            found = list(_repeated(part, packed[low:high], symbols, length, anchor, earlier))
            if found:
                of = [i for i, _ in found]
                yield {x: part[x][of] for x in ("k", "t", "u")} | {"spots": [places for _, places in found]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            k = batch.column("k").to_numpy()
            last = int(np.searchsorted(k, k[-1]))
            if last:
                held.append(batch.slice(0, last))
            elif held and held[-1].column("k")[-1].as_py() != k[0]:
                pass
            else:
                held.append(batch)
                continue
            yield from judge(pa.concat_batches(held))
            held = [batch.slice(last)]
        if held:
            yield from judge(pa.concat_batches(held))

    return common.map_arrow(buckets, run, "k long, t long, u long, spots array<int>")


def covered(n: int, found, length: int) -> np.ndarray:
    """Which of n symbols lie in a window of the stretches ``found``."""
    edge = np.zeros(n + 1, dtype=np.int64)
    if found is not None and len(found):
        at, many = (found.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2))
        np.add.at(edge, at, 1)
        np.add.at(edge, at + many + length - 1, -1)
    return np.cumsum(edge)[:n] > 0


def with_found(docs: DataFrame, found: DataFrame, name: str = "_tm_found") -> DataFrame:
    """Documents with their stretches as ``name``, which must be free, null where nothing is repeated; all columns stay."""
    id_, other, key = common.free(docs, "_tm_id", "_tm_other", "_tm_key")
    own = found.select(F.col("doc_id").alias(id_), F.col("tkey").alias(other), F.col("found").alias(name))
    keyed = docs.withColumn(key, text_key())
    same = F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(key) == F.col(other))
    return keyed.join(own, same, "left").drop(id_, other, key)
