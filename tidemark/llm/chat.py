"""Chat formatting: roles of a transcript by a hidden Markov model, then canonical turns.

A turn's observation is its speaker marker and line features (question mark, number of
lines, length). Start, transition and emission counts come from one aggregation over
all turns that carry a role, over the borders of stretches too. Viterbi runs by
stretches of a conversation: a stretch is summed up by a max-plus matrix between roles, the matrices of a conversation give the
roles at the stretches' borders, and each stretch is then decoded alone. Stretches are
cut by numbers of rows from ranges of the order of all turns, so a very long
conversation is no single task, whatever its turn numbers.

Null texts are empty turns; null turns come first; ties of turn are ordered by text, and
what is equal there by role, which then changes no observation; repeated rows are turns of their own; rows without a conversation id form one
conversation. With no labelled turn all transitions are alike and markers decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

ROLES = ("system", "user", "assistant")
#: What speakers are called at the start of a turn.
MARKERS = {"system": ("system", "instructions"), "user": ("user", "human", "customer", "me", "q"), "assistant": ("assistant", "bot", "ai", "agent", "model", "a")}
STRETCH = 4096
LENGTHS = (40, 80, 160, 320, 640, 1280, 2560)
SYMBOLS = 4 * 2 * 3 * (len(LENGTHS) + 1)


def marker_pattern(*roles: str) -> str:
    names = "|".join(name for role in roles for name in MARKERS[role])
    return rf"(?i)^\s*(?:[#*<\[|]+\s*)?(?:{names})\s*(?:[>\]|*]*\s*:|[>\]|]+)"


def observed(turns: DataFrame) -> DataFrame:
    """All columns plus ``symbol``, a number for the turn's markers and line features."""
    text = F.coalesce(F.col("text"), F.lit(""))
    marker = F.lit(0)
    for k, role in enumerate(ROLES, 1):
        marker = F.when(text.rlike(marker_pattern(role)), k).otherwise(marker)
    asks = F.when(F.rtrim(text).endswith("?"), 1).otherwise(0)
    n = F.regexp_count(text, F.lit("\n"))
    lines = F.when(n == 0, 0).when(n <= 2, 1).otherwise(2)
    length = sum((F.when(F.length(text) > x, 1).otherwise(0) for x in LENGTHS), F.lit(0))
    return turns.withColumn("symbol", (((marker * 2 + asks) * 3 + lines) * (len(LENGTHS) + 1) + length).cast("int"))


def fit(turns: DataFrame) -> dict[str, np.ndarray]:
    """Log start, transition and emission probabilities with add-one smoothing, from all turns that carry a role."""
    return fit_stretches(common.stash(stretches(turns), "stretches"))


def fit_stretches(parts: DataFrame) -> dict[str, np.ndarray]:
    """``fit`` on stretches. Only the first turn of a conversation is a start; a turn after one without a known role is neither a start nor a transition."""
    size = "size(turns)"
    inside = parts.select(F.expr(f"slice(turns.role, 1, {size} - 1)").alias("before"), F.expr(f"slice(turns.role, 2, {size})").alias("role"), F.expr(f"slice(turns.symbol, 2, {size})").alias("symbol"))
    inside = inside.select(F.lit(False).alias("opens"), F.inline(F.arrays_zip("before", "role", "symbol")))
    order = Window.partitionBy("conv_id").orderBy("stretch")
    ends = parts.select("conv_id", "stretch", F.expr("turns[0].role").alias("role"), F.expr("turns[0].symbol").alias("symbol"), F.expr(f"turns[{size} - 1].role").alias("last"))
    heads = ends.select((F.row_number().over(order) == 1).alias("opens"), F.lag("last").over(order).alias("before"), "role", "symbol")
    pairs = inside.union(heads).where(F.col("role").isin(*ROLES)).withColumn("before", F.when(F.col("before").isin(*ROLES), F.col("before")))
    pairs = pairs.groupBy("opens", "before", "role", "symbol").agg(F.count("*").alias("n"))
    start, move, emit = np.ones(3), np.ones((3, 3)), np.full((3, SYMBOLS), 0.1)
    for k, role in enumerate(ROLES):
        plain, marked = range(SYMBOLS // 4), range((k + 1) * SYMBOLS // 4, (k + 2) * SYMBOLS // 4)
        emit[k, [*plain]] += 0.1
        emit[k, [*marked]] += 1.0
    for r in pairs.collect():  # at most one row for each pair of roles and symbol
        to = ROLES.index(r["role"])
        emit[to, r["symbol"]] += r["n"]
        if r["before"] in ROLES:
            move[ROLES.index(r["before"]), to] += r["n"]
        elif r["opens"]:
            start[to] += r["n"]
    log = lambda x: np.log(x / x.sum(axis=-1, keepdims=True))
    return {"start": log(start), "move": log(move), "emit": log(emit)}


def viterbi(model: dict[str, np.ndarray], symbols: np.ndarray, enter: np.ndarray, leave: int | None = None) -> np.ndarray:
    """Best roles of a stretch; ``enter``: log score of each role at its first turn before emission."""
    emit = model["emit"][:, symbols]
    score, back = enter + emit[:, 0], np.zeros((len(symbols), 3), dtype=np.int64)
    for t in range(1, len(symbols)):
        through = score[:, None] + model["move"]
        back[t] = through.argmax(axis=0)
        score = through.max(axis=0) + emit[:, t]
    path = np.empty(len(symbols), dtype=np.int64)
    path[-1] = score.argmax() if leave is None else leave
    for t in range(len(symbols) - 1, 0, -1):
        path[t - 1] = back[t][path[t]]
    return path


def summed(model: dict[str, np.ndarray], symbols: np.ndarray) -> np.ndarray:
    """Best log score of a stretch from each role at its first turn to each at its last, all emissions included."""
    emit = model["emit"][:, symbols]
    through = np.where(np.eye(3, dtype=bool), emit[:, 0][:, None], -np.inf)
    for t in range(1, len(symbols)):
        through = (through[:, :, None] + model["move"][None]).max(axis=1) + emit[:, t]
    return through


def borders(model: dict[str, np.ndarray], parts: list[np.ndarray]) -> list[tuple[int, int]]:
    """First and last role of each stretch on the best path through all."""
    score, backs = model["start"], []
    for k, part in enumerate(parts):
        if k:
            through = score[:, None] + model["move"]
            came, score = through.argmax(axis=0), through.max(axis=0)
        else:
            came = np.zeros(3, dtype=np.int64)
        inside = score[:, None] + part
        backs.append((came, inside.argmax(axis=0)))
        score = inside.max(axis=0)
    last, out = int(score.argmax()), []
    for came, entered in reversed(backs):
        first = int(entered[last])
        out.append((first, last))
        last = int(came[first])
    return out[::-1]


def stretches(turns: DataFrame) -> DataFrame:
    """``conv_id, stretch, turns``: consecutive turns of a conversation, STRETCH at most; ``stretch`` is unique and follows their order.

    All turns are dealt over ranges of their order, and a random salt deals what is
    equal in every column, so neither a conversation nor a turn number is one task.
    Each task cuts its sorted rows where the conversation or the count says so.
    """
    most, order = STRETCH, ("conv_id", "turn", "text", "role")
    salted = turns.select(*order, F.rand(11).alias("_salt"))
    dealt = salted.repartitionByRange(*order, "_salt").sortWithinPartitions(*order)
    rows = observed(dealt.drop("_salt")).withColumn("_part", F.spark_partition_id())
    names = ("turn", "role", "text", "symbol")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held, done = None, 0

        def found(rows: pa.RecordBatch, edges: np.ndarray) -> dict:
            own = rows.slice(0, int(edges[-1]))
            turns = pa.StructArray.from_arrays([own.column(c) for c in names], names=names)
            number = (rows.column("_part")[0].as_py() << 32) + done + np.arange(len(edges) - 1)
            return {"conv_id": own.column("conv_id").take(pa.array(edges[:-1])), "stretch": number, "turns": pa.ListArray.from_arrays(pa.array(edges, pa.int32()), turns)}

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch if held is None else pa.concat_batches([held, batch])
            conv = rows.column("conv_id")
            ids, none = conv.fill_null(0).to_numpy(), conv.is_null().to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (none[1:] != none[:-1])])
            place = np.arange(len(ids)) - np.repeat(starts, np.diff(np.r_[starts, len(ids)]))
            edges = np.flatnonzero(place % most == 0)
            if len(edges) > 1:
                yield found(rows, edges)
                done += len(edges) - 1
            held = rows.slice(int(edges[-1]))  # may go on in the next batch
        if held is not None:
            yield found(held, np.array([0, held.num_rows]))

    return common.map_arrow(rows, cut, "conv_id long, stretch long, turns array<struct<turn: long, role: string, text: string, symbol: int>>")


def recover(turns: DataFrame, model: dict[str, np.ndarray] | None = None) -> DataFrame:
    """``conv_id, turn, role, recovered, rendered``: each turn with its recovered role and canonical rendering."""
    parts = common.stash(stretches(turns), "stretches")
    model = fit_stretches(parts) if model is None else model
    shared = turns.sparkSession.sparkContext.broadcast(model)

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            found = [summed(shared.value, np.array([t["symbol"] for t in cell.as_py()])).ravel().tolist() for cell in batch.column("turns")]
            yield {"conv_id": batch.column("conv_id"), "stretch": batch.column("stretch"), "matrix": found}

    chained = common.map_arrow(parts.select("conv_id", "stretch", "turns"), matrices, "conv_id long, stretch long, matrix array<double>")
    chained = chained.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("stretch", "matrix"))).alias("parts"))

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            out = {k: [] for k in ("conv_id", "stretch", "first", "last")}
            for conv, cell in zip(batch.column("conv_id").to_pylist(), batch.column("parts"), strict=True):
                own = cell.as_py()
                for part, (first, last) in zip(own, borders(shared.value, [np.array(p["matrix"]).reshape(3, 3) for p in own]), strict=True):
                    for name, value in zip(out, (conv, part["stretch"], first, last), strict=True):
                        out[name].append(value)
            yield out

    ends = common.map_arrow(chained, bound, "conv_id long, stretch long, first int, last int").withColumnsRenamed({"conv_id": "_conv", "stretch": "_stretch"})
    both = parts.join(ends, parts.conv_id.eqNullSafe(ends._conv) & (parts.stretch == ends._stretch))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            out = {k: [] for k in ("conv_id", "turn", "role", "text", "recovered")}
            rows = (batch.column(c) for c in ("conv_id", "turns", "first", "last"))
            for conv, cell, first, last in zip(*rows, strict=True):
                own = cell.as_py()
                enter = np.full(3, -np.inf)
                enter[first.as_py()] = 0.0
                path = viterbi(shared.value, np.array([t["symbol"] for t in own]), enter, last.as_py())
                for t, role in zip(own, path, strict=True):
                    for name, value in zip(out, (conv.as_py(), t["turn"], t["role"], t["text"], ROLES[role]), strict=True):
                        out[name].append(value)
            yield out

    turns_ = common.map_arrow(both.select("conv_id", "turns", "first", "last"), decode, "conv_id long, turn long, role string, text string, recovered string")
    return turns_.select("conv_id", "turn", "role", "recovered", render("recovered", "text").alias("rendered"))


def render(role: str, text: str):
    """A turn as ``<|role|>`` line, content without the one speaker marker it begins with, end line. ``<|`` in the content is escaped."""
    content = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), marker_pattern(*ROLES), "")
    content = F.replace(F.trim(content), F.lit("<|"), F.lit("<\\|"))
    return F.concat(F.lit("<|"), F.col(role), F.lit("|>\n"), content, F.lit("\n<|end|>\n"))


def parse_transcripts(raw: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Lines of raw transcripts as turns ``conv_id, turn, role, text``: a line with a speaker marker opens a turn, other lines go on with it."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    lines = raw.select(F.col(id_column).alias("conv_id"), F.posexplode(F.split(text, "\n")).alias("line", "text"))
    opens = F.lit(False)
    for role in ROLES:
        opens = opens | F.col("text").rlike(marker_pattern(role))
    order = Window.partitionBy("conv_id").orderBy("line")
    turned = lines.withColumn("turn", F.sum(opens.cast("long")).over(order))
    joined = turned.groupBy("conv_id", "turn").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda s: s["text"]), "\n").alias("text"))
    return joined.select("conv_id", "turn", F.lit(None).cast("string").alias("role"), "text")
