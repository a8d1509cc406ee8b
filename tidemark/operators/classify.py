"""Text classifiers on tf-idf of words and word pairs: balanced logistic regression and a calibrated linear SVM.

Terms are words of two letters or more and pairs of neighbours that at least two texts
have; a term counts 1 + ln(tf), times ln((1 + n) / (1 + df)) + 1, and rows have length 1.
Texts are counted by chunks. A chunk's terms go to their blocks, each with the texts
that have it, packed, and a block counts what it got, numbers the terms that stay and
keeps their cells. ``linear`` fits the models, with neither weights nor texts at the
driver. A fitted model is a table of weights by term,
so predicting is a join, too.
"""

from __future__ import annotations

import json
import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import text as T
from . import linear
from .ordering import numbered
from .tables import keep, shuffles_dropped

#: What a stored model must agree with to be loaded.
CHECKED = ("labels", "agreement", "seed")
CLASSES = range(len(C.LABELS))
FOLDS = 5
#: Letters of all texts for one column, about, by which the number of blocks is chosen; results are the same whatever it is.
LETTERS = 64


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)\b(\w\w+)\b"), F.lit(1))


def terms_of(text: Column) -> Column:
    """Words and pairs of neighbours."""
    words = words_of(text)
    pairs = F.zip_with(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))
    return F.concat(words, pairs)


def input_text(title: Column, target: Column | None = None) -> Column:
    """What a model reads: the cleaned title, after its target where the model depends on one."""
    return T.clean_text(title) if target is None else T.target_text(target, title)


#: Of a chunk's terms in one block: the terms, in how many texts each is, these texts' places in the chunk, and how often they have it.
POSTINGS = {"terms": None, "ends": np.dtype(np.int32), "n": np.dtype(np.int32), "place": np.dtype(np.uint16), "count": np.dtype(np.int32)}


def _bytes_of(terms: pa.Array) -> tuple[bytes, np.ndarray]:
    """Strings as their bytes and where each ends."""
    terms = pa.concat_arrays([terms.cast(pa.large_string())])
    offsets = np.frombuffer(terms.buffers()[1], dtype=np.int64)[terms.offset : terms.offset + len(terms) + 1]
    data = terms.buffers()[2].to_pybytes()[offsets[0] : offsets[-1]] if len(terms) and terms.buffers()[2] else b""
    return data, offsets[1:] - offsets[0]


def _strings(data: bytes, ends: bytes) -> pa.Array:
    offsets = np.r_[0, np.frombuffer(ends, dtype=np.int32)].astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(data))


def postings(chunks: DataFrame, blocks: int) -> DataFrame:
    """``block, chunk`` and ``POSTINGS`` of ``chunks(chunk, place, words)``: every term of every text, counted. A term's block is its crc32 modulo their number."""
    size = linear.CHUNK
    kind = pa.schema([("block", pa.int32()), ("chunk", pa.int64()), *((name, pa.binary()) for name in POSTINGS)])

    def run(table: pa.Table) -> pa.Table:
        lists = table["words"].combine_chunks()
        coded = lists.flatten().dictionary_encode()
        names, word = coded.dictionary.cast(pa.large_string()), coded.indices.to_numpy().astype(np.int64)
        text = np.repeat(table["place"].to_numpy().astype(np.int64), pc.list_value_length(lists).to_numpy())
        if not len(word):
            return kind.empty_table()
        both = text[1:] == text[:-1]
        # A term's number: its word's, or those of both words; with its text's place behind.
        key = np.r_[word, len(names) * (word[:-1][both] + 1) + word[1:][both]] * size + np.r_[text, text[1:][both]]
        key.sort()
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        count, key = np.diff(np.r_[first, len(key)]), key[first]
        number, place = key // size, key % size
        first = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
        n, number = np.diff(np.r_[first, len(number)]), number[first]
        pair = number >= len(names)
        joined = pc.binary_join_element_wise(names.take(pa.array(number[pair] // len(names) - 1)), names.take(pa.array(number[pair] % len(names))), pa.scalar(" ", pa.large_string()))
        terms = pa.concat_arrays([names.take(pa.array(number[~pair])), joined])  # numbers of words come before those of pairs
        data, ends = _bytes_of(terms)
        at = [0, *ends.tolist()]
        block = np.fromiter((zlib.crc32(data[a:b]) % blocks for a, b in zip(at, at[1:], strict=False)), dtype=np.int64, count=len(terms))
        rows = []
        for k in np.unique(block):
            own = np.flatnonzero(block == k)
            cells = np.repeat(first[own] - (np.cumsum(n[own]) - n[own]), n[own]) + np.arange(n[own].sum())
            data, *numbers = (*_bytes_of(terms.take(pa.array(own))), n[own], place[cells], count[cells])
            packed = {name: a.astype(t).tobytes() for (name, t), a in zip(list(POSTINGS.items())[1:], numbers, strict=True)}
            rows.append({"block": int(k), "chunk": table["chunk"][0].as_py(), "terms": data} | packed)
        return pa.Table.from_pylist(rows, schema=kind)

    return chunks.groupBy("chunk").applyInArrow(run, f"block int, chunk long, {', '.join(f'{name} binary' for name in POSTINGS)}")


def cells_of(found: DataFrame, n: int, least: int = 2) -> DataFrame:
    """``linear.PACKED`` of the ``postings`` of ``n`` texts, for terms that ``least`` texts have; the row with a block's scales, their idf, has its terms, too."""
    names = [*linear.CELLS, "scale", "terms", "ends"]
    kind = pa.schema([("block", pa.int32()), ("chunk", pa.int32()), *((name, pa.binary()) for name in names)])

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["chunk"])
        coded = pa.concat_arrays([_strings(r["terms"], r["ends"]) for r in rows]).dictionary_encode()
        term, df = coded.indices.to_numpy(), np.concatenate([np.frombuffer(r["n"], dtype=POSTINGS["n"]) for r in rows])
        df_of = np.bincount(term, df, minlength=len(coded.dictionary)).astype(np.int64)
        stays = df_of >= least
        new, upto, out = np.cumsum(stays) - 1, 0, []
        data, ends = _bytes_of(coded.dictionary.filter(pa.array(stays)))
        scale = np.log((1.0 + n) / (1 + df_of[stays])) + 1
        out.append({"chunk": -1, "scale": scale.tobytes(), "terms": data, "ends": ends.astype(np.int32).tobytes()})
        for r in rows:
            each, place, count = (np.frombuffer(r[name], dtype=POSTINGS[name]) for name in ("n", "place", "count"))
            own = term[upto : upto + len(each)]
            upto += len(each)
            cell = np.repeat(own, each)
            use = stays[cell]
            if use.any():
                out.append(linear.packed(r["chunk"], new[cell[use]], place[use], count[use]))
        return pa.Table.from_pylist([{"block": rows[0]["block"]} | r for r in out], schema=kind)

    return found.groupBy("block").applyInArrow(run, f"{linear.PACKED}, terms binary, ends binary")


def unpacked_terms(blocks: DataFrame, columns: int | None = None) -> DataFrame:
    """``term, idf, block, at`` of ``cells_of``'s rows with terms; with ``columns`` also ``w``, so many numbers a term."""
    kind = pa.schema([("term", pa.string()), ("idf", pa.float64()), ("block", pa.int32()), ("at", pa.int32()), *([("w", pa.list_(pa.float64()))] if columns else [])])

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                terms, scale = _strings(r["terms"], r["ends"]).cast(pa.string()), np.frombuffer(r["scale"])
                own = [terms, pa.array(scale), pa.array(np.full(len(terms), r["block"], dtype=np.int32)), pa.array(np.arange(len(terms), dtype=np.int32))]
                if columns:
                    own.append(pa.ListArray.from_arrays(pa.array(np.arange(len(terms) + 1, dtype=np.int32) * columns), pa.array(np.frombuffer(r["w"]))))
                yield from pa.Table.from_arrays(own, schema=kind).to_batches(max_chunksize=1 << 14)

    return blocks.select("block", "scale", "terms", "ends", *(["w"] if columns else [])).mapInArrow(run, "term string, idf double, block int, at int" + ", w array<double>" * bool(columns))


@dataclass
class Classifier:
    """``weights(term, idf, w)``, ``w`` being one number for each of the model's margins, with their intercepts and what turns them to probabilities."""

    weights: DataFrame
    intercepts: list[float]
    sigmoids: list[tuple[float, float]] | None
    metadata: dict

    def margins(self, rows: DataFrame) -> DataFrame:
        """All columns of ``rows(text)`` plus ``_margins``; every row is told apart, repeated ones too."""
        docs = keep(rows.withColumn("_doc", F.monotonically_increasing_id()), "texts")
        sums = self.sums(docs.select(F.col("_doc").alias("doc"), "text"))
        out = docs.join(sums, docs["_doc"] == sums["doc"], "left")
        return out.select(*rows.columns, F.array(*(F.lit(b) + F.coalesce(F.col("sums")[k] / F.col("norm"), F.lit(0.0)) for k, b in enumerate(self.intercepts))).alias("_margins"))

    def sums(self, docs: DataFrame) -> DataFrame:
        """``doc, norm, sums`` of ``docs(doc, text)``: the length of a text's vector and, for each margin, its cells times their weights; texts without a known term are left out."""
        blocks, width, size = linear.blocks_of(self.weights.count()), len(self.intercepts), linear.CHUNK
        chunk, place = F.floor(F.col("doc") / size).alias("chunk"), (F.col("doc") % size).cast("int").alias("place")
        texts = docs.select(chunk, place, "text").repartition("chunk")
        found = postings(texts.select("chunk", "place", words_of(F.col("text")).alias("words")), blocks)
        own = self.weights.select(F.pmod(F.crc32("term"), F.lit(blocks)).cast("int").alias("block"), "term", "idf", "w")
        part = pa.schema([("chunk", pa.int64()), ("block", pa.int32()), ("sums", pa.binary())])
        whole = pa.schema([("doc", pa.int64()), ("norm", pa.float64()), ("sums", pa.list_(pa.float64()))])

        def multiply(left: pa.Table, right: pa.Table) -> pa.Table:
            if not len(left) or not len(right):
                return part.empty_table()
            rows = right.to_pylist()
            known, idf, w = left["term"].combine_chunks().cast(pa.large_string()), left["idf"].to_numpy(), left["w"].combine_chunks().flatten().to_numpy().reshape(-1, width)
            at = pc.fill_null(pc.index_in(pa.concat_arrays([_strings(r["terms"], r["ends"]) for r in rows]), value_set=known), -1).to_numpy()
            upto, out = 0, []
            for r in rows:
                each, places, count = (np.frombuffer(r[name], dtype=POSTINGS[name]) for name in ("n", "place", "count"))
                term = np.repeat(at[upto : upto + len(each)], each)
                upto += len(each)
                use = term >= 0
                term, places = term[use], places[use].astype(np.intp)
                v = (1 + np.log(count[use])) * idf[term]
                sums = [np.bincount(places, v * v, minlength=size), *(np.bincount(places, v * w[term, k], minlength=size) for k in range(width))]
                out.append({"chunk": r["chunk"], "block": r["block"], "sums": np.stack(sums).tobytes()})
            return pa.Table.from_pylist(out, schema=part)

        def add(table: pa.Table) -> pa.Table:
            rows = sorted(table.to_pylist(), key=lambda r: r["block"])
            total = sum((np.frombuffer(r["sums"]).reshape(width + 1, size) for r in rows), np.zeros((width + 1, size)))
            some = np.flatnonzero(total[0] > 0)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(total[1:, some].T).ravel()))
            return pa.Table.from_arrays([pa.array(rows[0]["chunk"] * size + some), pa.array(np.sqrt(total[0, some])), lists], schema=whole)

        parts = own.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(multiply, "chunk long, block int, sums binary")
        return parts.groupBy("chunk").applyInArrow(add, "doc long, norm double, sums array<double>")

    def probabilities(self, rows: DataFrame) -> DataFrame:
        """All columns plus ``p``, the labels' probabilities; a label that the model hasn't seen has 0."""
        out, seen = self.margins(rows), self.metadata["seen"]
        at = lambda k: F.col("_margins")[k]
        if self.sigmoids is None:
            top = F.array_max("_margins")
            found = [F.exp(at(k) - top) for k in range(len(seen))]
        else:  # each fold's calibrated classes, made one, and the mean of the folds
            found = [F.lit(0.0)] * len(seen)
            for fold in range(len(self.sigmoids) // len(seen)):
                each = [1 / (1 + F.exp(a * at(m) + b)) for m, (a, b) in ((fold * len(seen) + k, self.sigmoids[fold * len(seen) + k]) for k in range(len(seen)))]
                total = sum(each[1:], each[0])
                found = [f + F.coalesce(F.try_divide(e, total), F.lit(1.0 / len(seen))) for f, e in zip(found, each, strict=True)]
        total = sum(found[1:], found[0])
        p = {c: f / total for c, f in zip(seen, found, strict=True)}
        return out.select(*rows.columns, F.array(*(p.get(k, F.lit(0.0)) for k in CLASSES)).alias("p"))

    def predict(self, rows: DataFrame) -> DataFrame:
        """All columns plus ``predicted`` (a number, the smallest of equals) and ``confidence``, its probability."""
        top = F.array_max("p")
        return self.probabilities(rows).select(*rows.columns, (F.array_position("p", top) - 1).cast("int").alias("predicted"), top.alias("confidence"))

    def classify(self, articles: DataFrame) -> DataFrame:
        """``articles(title)`` with ``label`` and ``confidence``; a model that depends on targets reads ``target`` before the title."""
        target = F.col("target") if self.metadata.get("target_dependent") else None
        rows = self.predict(articles.withColumn("text", input_text(F.col("title"), target)))
        return rows.select(*articles.columns, F.get(F.array(*map(F.lit, C.LABELS)), "predicted").alias("label"), "confidence")

    def save(self, path: str) -> None:
        self.weights.write.parquet(f"{path}/weights")
        rest = json.dumps(self.metadata | {"intercepts": self.intercepts, "sigmoids": self.sigmoids})
        SparkSession.active().createDataFrame([(rest,)], "value string").coalesce(1).write.text(f"{path}/metadata")

    @classmethod
    def load(cls, spark: SparkSession, path: str, **expected) -> Classifier:
        """A stored classifier; an error if its labels, agreement bound or seed are not as expected."""
        metadata = json.loads(spark.read.text(f"{path}/metadata").first().value)
        for name, value in ({"labels": list(C.LABELS)} | expected).items():
            if name in CHECKED and metadata.get(name) != value:
                raise ValueError(f"{path}: {name} is {metadata.get(name)!r}, not {value!r}")
        intercepts, sigmoids = metadata.pop("intercepts"), metadata.pop("sigmoids")
        return cls(spark.read.parquet(f"{path}/weights"), intercepts, sigmoids and [tuple(s) for s in sigmoids], metadata)


def folds(docs: DataFrame, n: int = FOLDS, seed: int = C.SPLIT_SEED) -> DataFrame:
    """Add ``fold``, from 0: each class's rows in hash order, dealt in turn. ``doc`` becomes the place in that order, from 0."""
    place = numbered(docs, [F.col("label"), F.xxhash64("doc", F.lit(seed)), F.col("doc")], "_n")
    return place.withColumn("fold", (F.col("_n") % n).cast("int")).withColumn("doc", F.col("_n") - 1).drop("_n")


def balanced(rows: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """Add ``weight``, which makes all classes count alike, and the classes' sizes (three numbers)."""
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n = sum(sizes.values())
    weight = F.coalesce(*(F.when(F.col("label") == k, n / (len(sizes) * c)) for k, c in sizes.items())) if sizes else F.lit(1.0)
    return rows.withColumn("weight", weight.cast("double")), sizes


@dataclass
class Features:
    """``docs(doc, label, weight, fold)`` numbered from 0, their cells as ``cells_of`` packs them, and the number of blocks; the last two are None where there is nothing to tell apart."""

    docs: DataFrame
    sizes: dict[int, int]
    seed: int
    packed: DataFrame | None = None
    blocks: int | None = None

    @property
    def terms(self) -> DataFrame:
        return self.packed.where("chunk = -1")

    @property
    def vocabulary(self) -> DataFrame:
        """``term, idf, block, at``; a block's terms are numbered from 0."""
        return unpacked_terms(self.terms)

    @property
    def cells(self) -> DataFrame:
        """``doc, block, at, w``, one row a cell."""
        kind, size = pa.schema([("doc", pa.int64()), ("block", pa.int32()), ("at", pa.int32()), ("f", pa.float64())]), linear.CHUNK

        def run(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    c = linear.Cells.of(row)
                    at, place = (np.concatenate(x) for x in ((c.column, c.more_column), (c.place, c.more_place)))
                    factor = np.r_[np.ones(len(c.column)), c.more]
                    yield pa.RecordBatch.from_arrays([pa.array(place + row["chunk"] * size), pa.array(np.full(len(at), row["block"], dtype=np.int32)), pa.array(c.at[at]), pa.array(factor)], schema=kind)

        cells = self.packed.where("chunk >= 0").select("block", "chunk", *linear.CELLS).mapInArrow(run, "doc long, block int, at int, f double")
        return cells.join(self.vocabulary.select("block", "at", "idf"), ["block", "at"]).select("doc", "block", "at", (F.col("f") * F.col("idf")).alias("w"))


def features(rows: DataFrame, seed: int = C.SPLIT_SEED) -> Features:
    """What models are fitted on, made once for all kinds, of ``rows(text, label)`` with labels 0 to 2; rows without a label don't count."""
    own = rows.where("label is not null").select(F.monotonically_increasing_id().alias("row"), "text", F.col("label").cast("int").alias("label"))
    texts = keep(own, "labelled")
    weighed, sizes = balanced(texts.select(F.col("row").alias("doc"), "row", "label"))
    if len(sizes) < 2:
        return Features(weighed, sizes, seed)
    docs = keep(folds(weighed, seed=seed), "folds")
    blocks = linear.blocks_of((texts.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0) // LETTERS)
    chunk, place = F.floor(F.col("doc") / linear.CHUNK).cast("int").alias("chunk"), (F.col("doc") % linear.CHUNK).cast("int").alias("place")
    chunks = texts.select("row", "text").join(docs.select("row", chunk, place), "row").select("chunk", "place", "text").repartition("chunk")
    found = postings(chunks.select("chunk", "place", words_of(F.col("text")).alias("words")), blocks)
    with shuffles_dropped(rows.sparkSession):
        cells = keep(cells_of(found, sum(sizes.values())), "cells")
    return Features(docs, sizes, seed, cells, blocks)


def fit(rows: DataFrame | Features, kind: str = "logistic", seed: int = C.SPLIT_SEED, steps: int = 200, **metadata) -> Classifier | None:
    """Fit ``logistic`` or ``svm`` on ``rows(text, label)`` or their ``features``, which bring their seed. None without a row."""
    if kind not in ("logistic", "svm"):
        raise ValueError(f"unknown kind {kind!r}")
    own = rows if isinstance(rows, Features) else features(rows, seed)
    n, seen = sum(own.sizes.values()), sorted(own.sizes)
    if not n:
        return None
    metadata = {"labels": list(C.LABELS), "seed": own.seed, "rows": n, "kind": kind, "seen": seen} | metadata
    if len(seen) == 1:  # nothing to tell apart
        return Classifier(own.docs.sparkSession.createDataFrame([], "term string, idf double, w array<double>"), [0.0], None, metadata)
    problem = linear.Problem("softmax" if kind == "logistic" else "margin", seen, FOLDS, 1.0 / n)
    found = linear.fit(own.docs.select("doc", "label", "weight", "fold"), own.packed, own.blocks, problem, steps if kind == "logistic" else min(steps, 50))
    weighed = own.terms.join(found.weights(), "block")
    weights = keep(unpacked_terms(weighed, problem.intercept.size).select("term", "idf", "w"), "weights")
    sigmoids = sigmoid_fit(keep(found.held_out(), "held"), FOLDS * len(seen)) if kind == "svm" else None
    found.close()
    return Classifier(weights, problem.intercept.ravel().tolist(), sigmoids, metadata)


def sigmoid_fit(held: DataFrame, models: int, steps: int = 30) -> list[tuple[float, float]]:
    """``(a, b)`` for each model of ``held(model, margin, label)``: P(label) = 1 / (1 + exp(a * margin + b)) by Platt's targets.

    Newton's method on sums: each step is one aggregation for all models at once, with
    five numbers a model. Steps that make a model's loss grow are halved.
    """
    counts = {r["model"]: (r["up"], r["down"]) for r in held.groupBy("model").agg(F.count_if(F.col("label") == 1).alias("up"), F.count_if(F.col("label") == 0).alias("down")).collect()}
    goal = {m: ((up + 1) / (up + 2), 1 / (down + 2)) for m, (up, down) in counts.items()}
    now = {m: (0.0, math.log((counts[m][1] + 1) / (counts[m][0] + 1))) for m in counts}
    loss = dict.fromkeys(now, math.inf)
    best = dict(now)
    move = dict.fromkeys(now, (0.0, 0.0))
    for _ in range(steps):
        frame = held.sparkSession.createDataFrame([(m, *now[m], *goal[m]) for m in now], "model int, a double, b double, up double, down double")
        z = -(F.col("a") * F.col("margin") + F.col("b"))
        t = F.when(F.col("label") == 1, F.col("up")).otherwise(F.col("down"))
        p = 1 / (1 + F.exp(-z))
        # ln(1 + e^-z) without overflow
        soft = F.greatest(-z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))
        rows = held.join(F.broadcast(frame), "model").select("model", "margin", (t - p).alias("d"), (p * (1 - p)).alias("h"), (t * soft + (1 - t) * (soft + z)).alias("loss"))
        x = F.col("margin")
        sums = rows.groupBy("model").agg(F.sum(F.col("d") * x).alias("ga"), F.sum("d").alias("gb"), F.sum(F.col("h") * x * x).alias("aa"), F.sum(F.col("h") * x).alias("ab"), F.sum("h").alias("bb"), F.sum("loss").alias("loss")).collect()
        still = False
        for r in sums:
            m = r["model"]
            if r["loss"] > loss[m] + 1e-12:
                move[m] = (move[m][0] / 2, move[m][1] / 2)
                now[m] = (best[m][0] + move[m][0], best[m][1] + move[m][1])
                still |= max(map(abs, move[m])) > 1e-9
                continue
            loss[m], best[m] = r["loss"], now[m]
            aa, bb, ab = r["aa"] + 1e-12, r["bb"] + 1e-12, r["ab"]
            det = aa * bb - ab * ab
            if det <= 0 or max(abs(r["ga"]), abs(r["gb"])) < 1e-7:
                move[m] = (0.0, 0.0)
                continue
            move[m] = (-(bb * r["ga"] - ab * r["gb"]) / det, -(aa * r["gb"] - ab * r["ga"]) / det)
            now[m] = (best[m][0] + move[m][0], best[m][1] + move[m][1])
            still |= max(map(abs, move[m])) > 1e-9
        if not still:
            break
    return [best.get(m, (-1.0, 0.0)) for m in range(models)]


def evaluate(predicted: DataFrame) -> DataFrame:
    """One row on ``predicted(label, predicted)``: size, accuracy, macro-F1 over the classes of either side, the majority class with its share, confusion and distribution."""
    cells = predicted.groupBy(F.col("label").alias("h"), F.col("predicted").alias("m")).agg(F.count("*").alias("n"))
    cell = lambda h, m: F.coalesce(F.sum(F.when((F.col("h") == h) & (F.col("m") == m), F.col("n"))), F.lit(0)).cast("long")
    total = cells.agg(F.array(*(F.array(*(cell(h, m) for m in CLASSES)) for h in CLASSES)).alias("confusion"))
    rows = total.withColumn("support", F.transform("confusion", lambda row: F.aggregate(row, F.lit(0).cast("long"), lambda a, x: a + x)))
    said = F.array(*(sum((F.col("confusion")[h][m] for h in CLASSES), F.lit(0).cast("long")) for m in CLASSES))
    rows = rows.withColumn("said", said).withColumn("n", F.aggregate("support", F.lit(0).cast("long"), lambda a, x: a + x))
    hits = [F.col("confusion")[k][k] for k in CLASSES]
    f1 = F.array_compact(F.array(*(F.when(F.col("support")[k] + F.col("said")[k] > 0, 2.0 * hits[k] / (F.col("support")[k] + F.col("said")[k])) for k in CLASSES)))
    majority = F.array_position("support", F.array_max("support")) - 1
    return rows.select(
        "n", F.try_divide(sum(hits[1:], hits[0]), F.col("n")).alias("accuracy"),
        F.try_divide(F.aggregate(f1, F.lit(0.0), lambda a, x: a + x), F.size(f1)).alias("macro_f1"),
        F.when(F.col("n") > 0, F.get(F.array(*map(F.lit, C.LABELS)), majority.cast("int"))).alias("majority_class"),
        F.try_divide(F.array_max("support"), F.col("n")).alias("majority_share"),
        "confusion", F.map_from_arrays(F.array(*map(F.lit, C.LABELS)), F.col("support")).alias("distribution"),
    )


def comparison(metadata: DataFrame) -> DataFrame:
    """The table of models from their metadata (``name, trained_at, metrics``): figures to four digits, and a dash for what one lacks."""
    raw = lambda *path: F.get_json_object("value", "$." + ".".join(path)).cast("double")
    figure = lambda *path: F.when(raw(*path).isNotNull(), F.format_string("%.4f", raw(*path))).otherwise("—")
    text = lambda name: F.get_json_object("value", f"$.{name}")
    number = F.get_json_object("value", "$.metrics.test.cpu_ms_per_sentence")
    return metadata.select(
        F.coalesce(text("model_name"), F.lit("—")).alias("model"), figure("metrics", "val", "macro_f1").alias("val_macro_f1"), figure("metrics", "test", "macro_f1").alias("test_macro_f1"),
        figure("metrics", "test", "accuracy").alias("test_accuracy"), figure("metrics", "test", "majority_baseline_accuracy").alias("majority"),
        F.coalesce(number, F.lit("—")).alias("cpu_ms"), F.left(F.coalesce(text("trained_at"), F.lit("")), F.lit(10)).alias("trained"),
    ).orderBy("model")
