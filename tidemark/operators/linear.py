"""Linear models on sparse rows, fitted by conjugate gradients whose vectors never leave the executors.

With a quadratic penalty the weights are always a sum of rows, each times a number of
its own. So weights, gradients and directions are held as those numbers, a few for each
row, next to their products with the rows (the margins). One step needs one product
with all rows: columns lie in blocks, a block adds up its weights from the rows'
numbers and gives back its share of the margins. Blocks are dealt to a few tasks, so
that the rows' numbers travel once a task and not once a block, and the tasks' shares
are summed by chunks of rows. Along a direction margins are known, so its length is found without a product.
The driver holds sums, a few numbers for each model and chunk; the weights are
added up once at the end, block by block.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import delete, shared_dir, shuffles_dropped

#: Rows of a chunk, columns of a block, about, and of a block that is not one of the first few; how many these are, and blocks that share a task.
CHUNK, BLOCK, LITTLE, FEW, MANY = 4096, 1 << 16, 1 << 14, 16, 64
#: Vectors of a state: the weights, the gradient and the direction as numbers by row, each followed by its margins.
WEIGHTS, MARGINS, GRADIENT, GRADIENT_MARGINS, DIRECTION, DIRECTION_MARGINS = range(6)
STATE = "chunk int, label binary, weight binary, fold binary, norm binary, vectors binary, sums array<double>"
#: Lengths tried along a direction, as multiples of the last one; the first step knows none.
FIRST, LATER = 2.0 ** np.arange(-8, 25), 2.0 ** np.linspace(-6, 6, 49)


def blocks_of(columns: int) -> int:
    return max(-(-columns // BLOCK), min(-(-columns // LITTLE), FEW), 1)


def deals_of(blocks: int) -> int:
    """Tasks that blocks are dealt to: each of the first few has its own, later as many blocks share one."""
    return max(min(blocks, FEW), -(-blocks // MANY))


@dataclass
class Problem:
    """Models fitted side by side: ``softmax``, one over all classes, or ``margin``, one for each fold left out and class by the squared hinge loss."""

    kind: str
    classes: list[int]
    folds: int
    penalty: float
    #: Each model's sum of row weights, intercepts, their gradient and direction, and the last step's factors.
    total: np.ndarray = None
    intercept: np.ndarray = None
    slope: np.ndarray = None
    turn: np.ndarray = None
    kept: np.ndarray = None
    length: np.ndarray = None
    norm: np.ndarray = field(default=None)

    def __post_init__(self):
        shape = (1, len(self.classes)) if self.kind == "softmax" else (self.folds * len(self.classes), 1)
        self.intercept, self.slope, self.turn = (np.zeros(shape) for _ in range(3))
        self.kept, self.length = np.zeros(shape[0]), np.zeros(shape[0])

    @property
    def shape(self) -> tuple[int, int]:
        return self.intercept.shape

    def shares(self, weight: np.ndarray, fold: np.ndarray) -> np.ndarray:
        """Each row's weight in each model."""
        if self.kind == "softmax":
            return weight[:, None]
        return weight[:, None] * (fold[:, None] != np.repeat(np.arange(self.folds), len(self.classes))[None])

    def loss(self, label: np.ndarray, share: np.ndarray, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Losses by row and model, and their slopes in the margins."""
        own = label[:, None] == np.array(self.classes)[None]
        if self.kind == "softmax":
            top = margins.max(axis=2, keepdims=True)
            e = np.exp(margins - top)
            total = e.sum(axis=2, keepdims=True)
            lost = (np.log(total) + top)[:, :, 0] - (margins * own[:, None, :]).sum(axis=2)
            return lost * share, (e / total - own[:, None, :]) * share[:, :, None]
        y = np.where(np.tile(own, self.folds), 1.0, -1.0)[:, :, None]
        short = np.maximum(0.0, 1 - y * margins)
        return short[:, :, 0] ** 2 * share, -2 * y * short * share[:, :, None]


@dataclass
class Chunk:
    label: np.ndarray
    weight: np.ndarray
    fold: np.ndarray
    norm: np.ndarray
    vectors: np.ndarray

    @classmethod
    def of(cls, row: dict, shape: tuple[int, int]) -> Chunk:
        label, fold = (np.frombuffer(row[k], dtype=np.int32) for k in ("label", "fold"))
        weight, norm = (np.frombuffer(row[k]) for k in ("weight", "norm"))
        vectors = np.frombuffer(row["vectors"]).reshape(6, len(label), *shape) if row["vectors"] else np.zeros((6, len(label), *shape))
        return cls(label, weight, fold, norm, vectors)

    def turned(self, p: Problem) -> tuple[np.ndarray, np.ndarray]:
        """The new direction and its margins: against the gradient, with a share of the last one kept."""
        keep = p.kept[None, :, None]
        v = self.vectors
        return keep * v[DIRECTION] - v[GRADIENT], keep * v[DIRECTION_MARGINS] - v[GRADIENT_MARGINS]

    def moved(self, p: Problem) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Vectors after the last step, and losses and their slopes there, by row; the gradient is still the old one."""
        v, far = self.vectors.copy(), p.length[None, :, None]
        v[DIRECTION], v[DIRECTION_MARGINS] = self.turned(p)
        v[WEIGHTS] += far * v[DIRECTION]
        v[MARGINS] += far * v[DIRECTION_MARGINS]
        lost, slopes = p.loss(self.label, p.shares(self.weight, self.fold) / p.total[None], v[MARGINS] + p.intercept[None])
        return v, lost, slopes


def _rows(table: pa.Table | pa.RecordBatch) -> Iterator[dict]:
    for batch in table.to_batches() if isinstance(table, pa.Table) else [table]:
        for k in range(batch.num_rows):
            yield {name: batch.column(n)[k].as_py() for n, name in enumerate(batch.schema.names)}


#: What a block and chunk store as strings of bytes: its columns' places in the block, how many cells of count 1 each has and these cells' rows; then column, row and count of the others.
CELLS = {"at": np.dtype(np.int32), "n": np.dtype(np.int32), "place": np.dtype(np.uint16), "more_column": np.dtype(np.int32), "more_place": np.dtype(np.uint16), "more_count": np.dtype(np.int32)}
#: A block has a row for each of its chunks and one, of the chunk -1, with its columns' scales. A cell's value is 1 + ln(count), times its column's scale.
PACKED = f"block int, chunk int, {', '.join(f'{name} binary' for name in CELLS)}, scale binary"


def packed(chunk: int, column: np.ndarray, place: np.ndarray, count: np.ndarray) -> dict:
    """The row of a chunk of one block, from its cells; a cell is named once."""
    at, own = np.unique(column, return_inverse=True)
    one = count == 1
    order = np.argsort(own[one], kind="stable")
    found = (at, np.bincount(own[one], minlength=len(at)), place[one][order], own[~one], place[~one], count[~one])
    return {"chunk": chunk} | {name: a.astype(t).tobytes() for (name, t), a in zip(CELLS.items(), found, strict=True)}


@dataclass
class Cells:
    """A chunk's cells of one block."""

    chunk: int
    at: np.ndarray
    column: np.ndarray
    place: np.ndarray
    more_column: np.ndarray
    more_place: np.ndarray
    more: np.ndarray

    @classmethod
    def of(cls, row: dict) -> Cells:
        at, n, place, more_column, more_place, more_count = (np.frombuffer(row[name], dtype=t) for name, t in CELLS.items())
        return cls(row["chunk"], at, np.repeat(np.arange(len(at)), n), place.astype(np.intp), more_column.astype(np.intp), more_place.astype(np.intp), 1 + np.log(more_count))

    def by_column(self, numbers: np.ndarray) -> np.ndarray:
        """For each model's numbers of the rows, the sums over each column without its scale."""
        total = lambda x: np.bincount(self.column, x.take(self.place), minlength=len(self.at)) + np.bincount(self.more_column, self.more * x.take(self.more_place), minlength=len(self.at))
        return np.stack([total(x) for x in numbers])

    def by_row(self, numbers: np.ndarray, size: int) -> np.ndarray:
        """For each model's numbers of the columns, the sums over each row of a chunk of ``size``."""
        total = lambda x: np.bincount(self.place, x.take(self.column), minlength=size) + np.bincount(self.more_place, self.more * x.take(self.more_column), minlength=size)
        return np.stack([total(x) for x in numbers])

    def squares(self, scale: np.ndarray, size: int) -> np.ndarray:
        own = scale[self.at] ** 2
        return np.bincount(self.place, own.take(self.column), minlength=size) + np.bincount(self.more_place, self.more**2 * own.take(self.more_column), minlength=size)


def _blocks(left: pa.Table) -> Iterator[tuple[int, np.ndarray, list[Cells]]]:
    """Each block of a task with its columns' scales and its chunks in their order."""
    blocks = left["block"].to_numpy()
    for block in np.unique(blocks):
        rows = sorted(_rows(left.filter(pa.array(blocks == block))), key=lambda r: r["chunk"])
        yield int(block), np.frombuffer(rows[0]["scale"]), [Cells.of(r) for r in rows[1:]]


def _summed(scale: np.ndarray, cells: list[Cells], numbers: dict[int, np.ndarray], columns: int) -> np.ndarray:
    """A block's columns added up over all rows, each times its numbers, without their scale."""
    u = np.zeros((columns, len(scale)))
    for c in cells:
        u[:, c.at] += c.by_column(numbers[c.chunk])
    return u


def _numbers_of(right: pa.Table, columns: int) -> dict[int, np.ndarray]:
    return {r["chunk"]: np.ascontiguousarray(np.frombuffer(r["numbers"]).reshape(-1, columns).T) for r in _rows(right)}


def _numbers(state: DataFrame, p: Problem, deals: int, what) -> DataFrame:
    """``chunk, numbers, deal``: a number for each row and model, for each task of blocks."""
    shape = p.shape

    def run(batches):
        for batch in batches:
            for row in _rows(batch):
                chunk = Chunk.of(row, shape)
                numbers = what(chunk, p) / chunk.norm[:, None, None]
                yield pa.RecordBatch.from_arrays([pa.array([row["chunk"]], pa.int32()), pa.array([np.ascontiguousarray(numbers).tobytes()], pa.binary())], names=["chunk", "numbers"])

    return state.mapInArrow(run, "chunk int, numbers binary").withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1))))


def _step(state: DataFrame, x: DataFrame, p: Problem, deals: int) -> DataFrame:
    """The state after the last step, with the gradient there, its margins and all sums that the next one needs."""
    shape, columns, size = p.shape, p.intercept.size, CHUNK
    kind = pa.schema([("chunk", pa.int32()), ("deal", pa.int32()), ("margins", pa.binary())])

    def multiply(left: pa.Table, right: pa.Table) -> pa.Table:
        numbers = _numbers_of(right, columns)
        shares: dict[int, np.ndarray] = {}
        for _, scale, cells in _blocks(left):
            u = _summed(scale, cells, numbers, columns) * scale**2
            for c in cells:
                found = c.by_row(u[:, c.at], size)
                if c.chunk in shares:
                    shares[c.chunk] += found
                else:
                    shares[c.chunk] = found
        deal = right["deal"][0].as_py() if len(right) else 0
        return pa.Table.from_pylist([{"chunk": k, "deal": deal, "margins": np.ascontiguousarray(share.T).tobytes()} for k, share in sorted(shares.items())], schema=kind)

    whole = pa.schema([("chunk", pa.int32()), *((n, pa.binary()) for n in ("label", "weight", "fold", "norm", "vectors")), ("sums", pa.list_(pa.float64()))])

    def gather(left: pa.Table, right: pa.Table) -> pa.Table:
        (row,) = _rows(left)
        chunk = Chunk.of(row, shape)
        v, lost, slopes = chunk.moved(p)
        image = np.zeros((size, columns))
        for part in sorted(_rows(right), key=lambda r: r["deal"]):
            image += np.frombuffer(part["margins"]).reshape(size, columns)
        image = image[: len(chunk.label)].reshape(-1, *shape) / chunk.norm[:, None, None]
        old = v[GRADIENT_MARGINS].copy()
        v[GRADIENT] = p.penalty * v[WEIGHTS] + slopes
        v[GRADIENT_MARGINS] = p.penalty * v[MARGINS] + image
        dot = lambda a, b: (a * b).sum(axis=(0, 2))
        sums = [dot(v[GRADIENT], v[GRADIENT_MARGINS]), dot(v[GRADIENT], old), dot(v[DIRECTION], v[GRADIENT_MARGINS]), lost.sum(axis=0) + p.penalty / 2 * dot(v[WEIGHTS], v[MARGINS]), slopes.sum(axis=0).ravel()]
        row |= {"vectors": v.tobytes(), "sums": np.concatenate(sums).tolist()}
        return pa.Table.from_pylist([row], schema=whole)

    sent = _numbers(state, p, deals, lambda chunk, p: chunk.moved(p)[2])
    shares = x.groupBy("deal").cogroup(sent.groupBy("deal")).applyInArrow(multiply, "chunk int, deal int, margins binary")
    return state.groupBy("chunk").cogroup(shares.groupBy("chunk")).applyInArrow(gather, STATE)


def _along(state: DataFrame, p: Problem, lengths: np.ndarray) -> np.ndarray:
    """Each model's slope along the new direction at each of its ``lengths``."""
    shape = p.shape

    def run(batches):
        for batch in batches:
            for row in _rows(batch):
                chunk = Chunk.of(row, shape)
                ahead, s = chunk.turned(p)
                v, share = chunk.vectors, p.shares(chunk.weight, chunk.fold) / p.total[None]
                rise = p.penalty * (v[WEIGHTS] * s).sum(axis=(0, 2))
                bend = p.penalty * (ahead * s).sum(axis=(0, 2))
                found = [((s + p.turn[None]) * p.loss(chunk.label, share, v[MARGINS] + p.intercept[None] + far[None, :, None] * (s + p.turn[None]))[1]).sum(axis=(0, 2)) + rise + far * bend for far in lengths]
                yield pa.RecordBatch.from_arrays([pa.array([row["chunk"]], pa.int32()), pa.array([np.concatenate(found).tolist()], pa.list_(pa.float64()))], names=["chunk", "sums"])

    return _collected(state.mapInArrow(run, "chunk int, sums array<double>")).reshape(len(lengths), -1)


def _collected(state: DataFrame) -> np.ndarray:
    """Sums over all chunks, always in their order: a few numbers for each of them reach the driver."""
    return np.sum([r["sums"] for r in sorted(state.select("chunk", "sums").collect(), key=lambda r: r["chunk"])], axis=0)


def _root(lengths: np.ndarray, slopes: np.ndarray) -> np.ndarray:
    """Where each model's slope, which grows, is zero: between the two lengths around it on a line; else the end that is nearer."""
    out = np.zeros(lengths.shape[1])
    for g in range(len(out)):
        t, s = np.r_[0.0, lengths[:, g]], slopes[:, g]
        up = np.flatnonzero(s[1:] >= 0)
        if not len(up):
            out[g] = t[-1]
            continue
        k = up[0] + 1
        out[g] = t[k] if s[k] == s[k - 1] else t[k - 1] + (t[k] - t[k - 1]) * min(1.0, max(0.0, -s[k - 1] / (s[k] - s[k - 1])))
    return out


@dataclass
class Fitted:
    """A fitted problem: its last state, from which weights and margins are made."""

    problem: Problem
    state: DataFrame
    x: DataFrame
    deals: int
    at: str

    def weights(self) -> DataFrame:
        """``block, w``: for each of a block's columns one number for each model and class, as a string of bytes."""
        p, columns = self.problem, self.problem.intercept.size
        kind = pa.schema([("block", pa.int32()), ("w", pa.binary())])

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            numbers = _numbers_of(right, columns)
            rows = [{"block": block, "w": np.ascontiguousarray((_summed(scale, cells, numbers, columns) * scale).T).tobytes()} for block, scale, cells in _blocks(left)]
            return pa.Table.from_pylist(rows, schema=kind)

        sent = _numbers(self.state, p, self.deals, lambda chunk, p: chunk.vectors[WEIGHTS])
        return self.x.groupBy("deal").cogroup(sent.groupBy("deal")).applyInArrow(run, "block int, w binary")

    def held_out(self) -> DataFrame:
        """``model, margin, label, weight`` of every row by the models that its fold was left out of."""
        p = self.problem
        kind = pa.schema([("model", pa.int32()), ("margin", pa.float64()), ("label", pa.float64()), ("weight", pa.float64())])

        def run(batches):
            for batch in batches:
                for row in _rows(batch):
                    chunk = Chunk.of(row, p.shape)
                    for k, c in enumerate(p.classes):
                        model = chunk.fold * len(p.classes) + k
                        margin = (chunk.vectors[MARGINS] + p.intercept[None])[np.arange(len(model)), model, 0]
                        yield pa.RecordBatch.from_arrays([pa.array(model.astype(np.int32)), pa.array(margin), pa.array((chunk.label == c).astype(float)), pa.array(chunk.weight)], schema=kind)

        return self.state.mapInArrow(run, "model int, margin double, label double, weight double")

    def close(self) -> None:
        """Give back what is kept; tables made of it must have been written."""
        self.x.unpersist()
        delete(self.at)


def fit(rows: DataFrame, cells: DataFrame, blocks: int, problem: Problem, steps: int, tolerance: float = 1e-6) -> Fitted:
    """Fit on ``rows(doc, label, weight, fold)``, numbered from 0, and ``cells`` (``PACKED``); rows count with length 1.

    Ends after ``steps``, or when no model's loss falls by more than ``tolerance`` of itself.
    """
    p, spark, size, deals = problem, rows.sparkSession, CHUNK, deals_of(blocks)
    base = f"{shared_dir(spark)}/linear-{uuid.uuid4().hex}"
    x = cells.select((F.col("block") % deals).alias("deal"), "block", "chunk", *CELLS, "scale").repartition(2 * deals, "deal").sortWithinPartitions("deal").persist()
    chunk, place = F.floor(F.col("doc") / CHUNK).cast("int").alias("chunk"), (F.col("doc") % CHUNK).cast("int").alias("place")
    each = rows.select(chunk, F.struct(place, F.col("label").cast("int").alias("label"), "weight", "fold").alias("r"))
    lists = each.groupBy("chunk").agg(F.sort_array(F.collect_list("r")).alias("r")).select("chunk", "r.label", "r.weight", "r.fold")
    kinds = {"label": np.int32, "weight": np.float64, "fold": np.int32}
    square = pa.schema([("chunk", pa.int32()), ("squares", pa.binary())])
    start = pa.schema([("chunk", pa.int32()), *((n, pa.binary()) for n in (*kinds, "norm", "vectors")), ("sums", pa.list_(pa.float64()))])

    def square_sums(left: pa.Table) -> pa.Table:
        sums: dict[int, np.ndarray] = {}
        for _, scale, cells in _blocks(left):
            for c in cells:
                sums[c.chunk] = sums.get(c.chunk, 0.0) + c.squares(scale, size)
        return pa.Table.from_pylist([{"chunk": k, "squares": v.tobytes()} for k, v in sorted(sums.items())], schema=square)

    def begin(left: pa.Table, right: pa.Table) -> pa.Table:
        (row,) = _rows(left)
        values = {n: np.array(row[n], dtype=t) for n, t in kinds.items()}
        # in one order whatever tasks ended first
        total = sum(sorted((np.frombuffer(r["squares"]) for r in _rows(right)), key=bytes), np.zeros(size))[: len(values["label"])]
        norm = np.sqrt(np.where(total > 0, total, 1.0))
        sums = p.shares(values["weight"], values["fold"]).sum(axis=0)
        found = {n: v.tobytes() for n, v in values.items()} | {"chunk": row["chunk"], "norm": norm.tobytes(), "vectors": None, "sums": sums.tolist()}
        return pa.Table.from_pylist([found], schema=start)

    squares = x.groupBy("deal").applyInArrow(square_sums, "chunk int, squares binary")

    def kept(df: DataFrame, step: int) -> DataFrame:
        df.write.parquet(f"{base}/{step}")
        return spark.read.schema(STATE).parquet(f"{base}/{step}")

    with shuffles_dropped(spark):
        state = kept(lists.groupBy("chunk").cogroup(squares.groupBy("chunk")).applyInArrow(begin, STATE), 0)
        p.total = np.maximum(_collected(state), 1e-300)
        lengths, before, loss = np.repeat(FIRST[:, None], p.shape[0], axis=1), None, None
        for step in range(1, steps + 2):
            state = kept(_step(state, x, p, deals), step)
            delete(f"{base}/{step - 1}")
            sums = _collected(state)
            new, across, ahead, lost = sums[: 4 * p.shape[0]].reshape(4, -1)
            slope = sums[4 * p.shape[0] :].reshape(p.shape)
            norm = new + (slope**2).sum(axis=1)
            p.kept = np.zeros(p.shape[0]) if before is None else np.maximum(0.0, (norm - across - (slope * p.slope).sum(axis=1)) / np.maximum(before, 1e-300))
            down = -norm + p.kept * (ahead + (slope * p.turn).sum(axis=1))
            p.kept = np.where(down < 0, p.kept, 0.0)  # a direction that doesn't lead down is dropped
            p.turn = p.kept[:, None] * p.turn - slope
            p.slope, before = slope, norm
            still = loss is None or bool(np.any(loss - lost > tolerance * np.abs(loss)))
            loss = lost
            if step > steps or not still:
                break
            slopes = _along(state, p, np.concatenate([np.zeros((1, p.shape[0])), lengths]))
            p.length = _root(lengths, slopes)
            p.intercept = p.intercept + p.length[:, None] * p.turn
            lengths = np.maximum(p.length, 1e-12)[None] * LATER[:, None]
    return Fitted(p, state, x, deals, base)
