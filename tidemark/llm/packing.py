"""Best-fit packing with Martello-Toth dominance reduction.

Lengths are whole numbers up to the capacity, so the instance is its histogram: at
most ``capacity`` rows whatever the corpus. The driver plans on it: sets of one to
three items that provably dominate every alternative are fixed for as many items as
they hold for, and the rest goes best-fit, largest first, whole runs of equal lengths
at a time. The plan says which ranks of a length go where; executors rank the pieces
of each length (in salted groups, so a length that holds most pieces is no single
task) and look their place up.

A null text is empty; an empty text is the single end id. Rows with a null or
repeated id are packed like others.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe, common

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, vocabulary_path: str, capacity: int, end_id: int = 0) -> DataFrame:
    """Encode every text, append ``end_id`` and cut what is longer than ``capacity``."""
    shared = bpe.share_vocabulary(docs.sparkSession, vocabulary_path)
    end, step = end_id.to_bytes(4, "little"), 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        encoder = bpe.worker_encoder(shared)
        for batch in batches:
            out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
            for doc, text in zip(batch.column("doc_id").to_pylist(), common.text_rows(batch), strict=True):
                ids = encoder.ids(text) + end
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    for name, value in zip(out, (doc, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        out[name].append(value)
            yield out

    return common.map_arrow(docs.select("doc_id", "text"), run, PIECES)


def reduce_by_dominance(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Fix sets that dominate all others with their item; takes them out of ``counts``. Returns (lengths, how often).

    {a} dominates if nothing fits beside a. {a, b}, b the largest that fits, dominates
    if it fills the sequence, or if every other selection beside a sums to at most b.
    {a, b, c}, c the largest that fits beside both, dominates if no three fit beside a
    and of every two that do, the smaller is at most c or both sum to at most b.
    """
    fixed = []
    changed = True
    while changed:
        changed = False
        for a in range(capacity, 0, -1):
            while counts[a]:
                room = capacity - a
                counts[a] -= 1
                there = np.flatnonzero(counts[: room + 1])
                counts[a] += 1
                if not len(there):
                    fixed.append(((a,), int(counts[a])))
                    counts[a] = 0
                    changed = True
                    break
                b = int(there[-1])
                if b != room and _beats(there, counts, b, room):
                    counts[a] -= 1
                    c = _third(there, counts, b, room)
                    counts[a] += 1
                    if not c:
                        break
                    times = min(int(counts[x]) // n for x, n in Counter((a, b, c)).items())
                    fixed.append(((a, b, c), times))
                    for x in (a, b, c):
                        counts[x] -= times
                    changed = True
                    continue
                times = int(counts[a]) // 2 if a == b else int(min(counts[a], counts[b]))
                fixed.append(((a, b), times))
                counts[a] -= times
                counts[b] -= times
                changed = True
    return fixed


def _beats(there: np.ndarray, counts: np.ndarray, b: int, room: int) -> bool:
    """Whether two or more of the lengths may sum to more than ``b`` and at most ``room``."""
    if 2 * there[0] > room:
        return False
    seen = np.zeros(room + 2, dtype=np.int64)
    seen[there + 1] = 1
    upto = np.cumsum(seen)  # upto[k + 1]: lengths of at most k
    if (upto[np.maximum(room - there, 0) + 1] > upto[np.maximum(b - there, 0) + 1]).any():
        return True
    sums = 1
    for x in map(int, there):
        for _ in range(min(int(counts[x]), room // x)):
            sums |= (sums << x) & ((1 << (room + 1)) - 1)
    return bool(sums >> (b + 1))


def _third(there: np.ndarray, counts: np.ndarray, b: int, room: int) -> int:
    """The length that makes a dominating set of three with ``b``, or 0. ``counts`` are without the first item."""
    least = np.repeat(there, np.minimum(counts[there], 3))[:3]
    if len(least) == 3 and least.sum() <= room:
        return 0
    beside = there[(there <= room - b) & (counts[there] > (there == b))]
    if not len(beside):
        return 0
    c = int(beside[-1])
    for q in map(int, there[there > c]):
        p = there[(there >= q) & (there <= room - q) & (there + q > b)]
        if len(p) and (p[-1] > q or counts[q] > 1):
            return 0
    return c


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit, largest first, over runs of equal lengths: (lengths, how often)."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    rooms: list[int] = []

    def add(room: int, lengths: tuple[int, ...], times: int) -> None:
        if room not in open_:
            open_[room] = []
            insort(rooms, room)
        open_[room].append((lengths, times))

    for size in range(capacity, 0, -1):
        left = int(counts[size])
        while left:
            k = bisect_left(rooms, size)
            if k == len(rooms):
                each = capacity // size
                full, rest = divmod(left, each)
                if full:
                    add(capacity - each * size, (size,) * each, full)
                if rest:
                    add(capacity - rest * size, (size,) * rest, 1)
                break
            room = rooms[k]
            lengths, times = open_[room].pop()
            if not open_[room]:
                del open_[room]
                rooms.pop(k)
            each = room // size
            used = min(times, left // each)
            if used:
                add(room - each * size, lengths + (size,) * each, used)
                left -= used * each
            if used < times and left:  # fewer than one sequence takes
                add(room - left * size, lengths + (size,) * left, 1)
                used, left = used + 1, 0
            if used < times:
                add(room, lengths, times - used)
    return [x for groups in open_.values() for x in groups]


def plan(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, how many, first sequence, offset): where the pieces of each length go by rank."""
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        counts[length] = n
    chosen = reduce_by_dominance(counts, capacity)
    chosen += best_fit(counts, capacity)
    rows, taken, sequence = [], [0] * (capacity + 1), 0
    for lengths, times in chosen:
        offset = 0
        for length in lengths:
            rows.append((length, taken[length], times, sequence, offset))
            taken[length] += times
            offset += length
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def pack(items: DataFrame, capacity: int, group: int = 20_000) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to ``items(doc_id, piece, start, length, ...)``.

    The plan that is sent out has at most one row for each length and free room, so
    its size is bounded by the capacity. ``group``: pieces ranked in one group.
    """
    histogram = {r["length"]: r["n"] for r in items.groupBy("length").agg(F.count("*").alias("n")).collect()}
    shared = items.sparkSession.sparkContext.broadcast(plan(histogram, capacity))
    salts = max(1, math.ceil(max(histogram.values(), default=1) / group))
    salted = items.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    before = (
        salted.groupBy("length", "_salt")
        .agg(F.count("*").alias("_n"))
        .withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n"))
        .select(F.col("length").alias("_length"), F.col("_salt").alias("_with"), "_before")
    )
    own = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("_rank", F.row_number().over(own) - 1).join(before, (F.col("length") == F.col("_length")) & (F.col("_salt") == F.col("_with")))
    ranked = ranked.select(*items.columns, (F.col("_rank") + F.col("_before")).cast("long").alias("_rank"))
    names = items.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        rows = shared.value
        keys = rows[:, 0] << 44 | rows[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "_rank"))
            at = np.searchsorted(keys, length << 44 | rank, side="right") - 1
            place = rows[at]
            yield {c: batch.column(c) for c in names} | {"sequence_id": place[:, 3] + rank - place[:, 1], "offset": place[:, 4]}

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in items.schema)
    return common.map_arrow(ranked, run, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary_path: str, capacity: int = 2048) -> DataFrame:
    """Pieces of all documents with their place: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``."""
    return pack(common.stash(pieces(docs, vocabulary_path, capacity), "pieces"), capacity)
